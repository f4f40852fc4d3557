"""All shared beginnings of conversations as the nodes of a trie, by ROLLUP over positional columns of turn ids.

A turn id is 128 bits of the SHA-256 of role and text, with the text's length. A block of a conversation has one column
for each of its ``WIDTH`` turns; ``ROLLUP`` over these columns aggregates every prefix at once, and ``grouping_id`` tells
which. Longer conversations go on in further blocks. A block is grouped by the node that the block before ends at,
named by a digest of all turns so far, so blocks of any number are rolled up together: there is no round for each depth.
These digests come from digests of blocks, then of groups of blocks, and so on, so that no task reads a whole conversation.

A node belongs to its smallest member. What a member owns is a chain of nodes down to its last turn, so sums over a subtree are
sums over the members of a node, less what its own chain has above it. A second ``ROLLUP`` takes them.

Nothing hot is collected: turns are numbered over ranges of keys, parents are looked up by salted keys, and members that end
at one node travel as packed pieces, in order, through a running SHA-256.
"""

from __future__ import annotations

import hashlib
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.tables import load, map_arrow, shuffle_partitions, stored
from shardloom.operators.ordered import range_blocks, running_sums

#: Columns of a block, and how many blocks (or groups) are digested together.
WIDTH = 8
#: Bytes of a digest; a turn id has four more, its length in code points.
DIGEST = 16
#: Conversations share the opening of the first of their family of ``FAMILY`` ids, up to ``OPENING - 1`` turns of it.
FAMILY, OPENING = 100, 6
#: Member ids in one packed piece, rows in a batch of pieces, and turns of one conversation that meet in a task.
PIECE, BATCH, STRETCH = 2048, 256, 1 << 16
COLUMNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def digest(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 2 * DIGEST))


def joined(values: list[Column]) -> Column:
    return F.concat(*(F.coalesce(v, F.lit(b"")) for v in values))


def numbered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``conv_id, place, id, total``: turns of each conversation, counted from 0."""
    said, who = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    length = F.unhex(F.lpad(F.hex(F.char_length(said)), 8, F.lit("0")))
    id_ = F.concat(digest(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said)), length)
    turns = rows.where(F.col(conv).isNotNull()).select(
        F.coalesce(F.col(conv).cast("bigint"), F.lit(0).cast("bigint")).alias("conv_id"), F.col(turn).alias("turn"), id_.alias("id")
    )
    # Equal turns are one row until they are numbered, so the order of the rest is total.
    turns = turns.groupBy("conv_id", "turn", "id").agg(F.count("*").alias("n"))
    ranges = range_blocks(turns, ["conv_id", "turn", "id"], partitions=shuffle_partitions(rows))
    placed = running_sums(ranges, ["conv_id"], "block", ["turn", "id"], {"before": "n"}, whole={"total": "n"})
    places = F.explode(F.sequence("before", F.col("before") + F.col("n") - 1))
    return placed.select("conv_id", places.alias("place"), "id", "total")


def families(turns: DataFrame) -> DataFrame:
    """Conversations rebuilt on the opening of their family's first one: ``conv_id, length, place, id``; a conversation
    left without turns is one row without id."""
    conv, taken = F.col("conv_id"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % OPENING
    first = turns.where((F.col("place") < OPENING - 1) & (conv % FAMILY == 0)).groupBy(conv.alias("base"))
    openings = first.agg(F.sort_array(F.collect_list(F.struct("place", "id")))["id"].alias("opening"))
    own = turns.where("place = 0").select(conv, "total", taken.alias("taken"), (conv - conv % FAMILY).alias("base"))
    held = F.least("taken", F.coalesce(F.size("opening"), F.lit(0)).cast("bigint"))
    convs = own.join(openings, "base", "left").select(
        "conv_id", "total", "taken", "opening", held.alias("held"), (held + F.greatest(F.col("total") - F.col("taken"), F.lit(0))).alias("length")
    )
    convs = stored(convs, "families")
    opened = convs.where("held > 0").select("conv_id", "length", F.posexplode(F.slice("opening", 1, F.col("held").cast("int"))).alias("place", "id"))
    stretch = F.call_function("div", F.col("place"), F.lit(STRETCH))
    stretches = convs.where("total > taken").select(
        "conv_id", "length", "held", "taken", F.explode(F.sequence(F.lit(0).cast("bigint"), F.call_function("div", F.col("total") - 1, F.lit(STRETCH)))).alias("stretch")
    )
    rest = turns.withColumn("stretch", stretch).join(stretches, ["conv_id", "stretch"]).where("place >= taken")
    rest = rest.select("conv_id", "length", (F.col("held") + F.col("place") - F.col("taken")).alias("place"), "id")
    none = convs.where("length = 0").select("conv_id", "length", F.lit(0).cast("bigint").alias("place"), F.lit(None).cast("binary").alias("id"))
    return opened.select("conv_id", "length", F.col("place").cast("bigint"), "id").unionByName(rest).unionByName(none)


def positions(digests: DataFrame, last: int) -> DataFrame:
    """``conv_id, block, prior, next``: what names all blocks before a block, and all blocks up to it.

    ``digests`` has ``conv_id, block, digest``, blocks without gaps. Groups of ``WIDTH`` blocks are named first, by the same
    means, so the names of a block come from those of its group and of fewer than ``WIDTH`` blocks before it.
    """
    if not last:
        root = digest(F.lit(b"root"))
        return digests.select("conv_id", "block", root.alias("prior"), digest(F.concat(root, "digest")).alias("next"))
    group = F.call_function("div", F.col("block"), F.lit(WIDTH))
    held = F.sort_array(F.collect_list(F.struct("block", "digest")))
    groups = stored(digests.groupBy("conv_id", group.alias("group")).agg(held.alias("held")), "blocks")
    whole = digest(F.aggregate("held", F.lit(b""), lambda all_, x: F.concat(all_, x["digest"])))
    above = positions(groups.select("conv_id", F.col("group").alias("block"), whole.alias("digest")), last // WIDTH)
    above = above.select("conv_id", F.col("block").alias("group"), F.col("prior").alias("_prior"), F.col("next").alias("_next"))

    def up_to(end: Column) -> Column:
        return digest(F.aggregate(F.slice("held", F.lit(1), end), F.col("_prior"), lambda all_, x: F.concat(all_, x["digest"])))

    rows = groups.join(above, ["conv_id", "group"]).select("*", F.posexplode("held").alias("i", "at"))
    return rows.select(
        "conv_id", F.col("at.block").alias("block"), up_to(F.col("i")).alias("prior"),
        F.when(F.col("i") < WIDTH - 1, up_to(F.col("i") + 1)).otherwise(digest(F.col("_next"))).alias("next"),
    )


def turn_blocks(turns: DataFrame) -> DataFrame:
    """``conv_id, length, block, prior, t1 ..``, stored. The last column also holds the name of the node it ends at."""
    block = F.call_function("div", F.col("place"), F.lit(WIDTH)).alias("block")
    held = F.sort_array(F.collect_list(F.struct("place", "id")))["id"].alias("ids")
    rows = stored(turns.groupBy("conv_id", "length", block).agg(held), "turns")
    ids = [F.get("ids", F.lit(i)) for i in range(WIDTH)]
    last = rows.agg(F.max("block")).first()[0] or 0
    named = positions(rows.select("conv_id", "block", digest(joined(ids)).alias("digest")), last)
    last_id = F.concat(ids[-1], F.col("next"))
    blocks = rows.join(named, ["conv_id", "block"])
    return stored(blocks.select("conv_id", "length", "block", "prior", *(c.alias(n) for c, n in zip([*ids[:-1], last_id], COLUMNS, strict=True))), "blocks")


def node_name(depth: Column) -> Column:
    """Name of the node ``depth`` columns into a block."""
    shown = joined([F.when(depth >= i, F.col(c)) for i, c in enumerate(COLUMNS, 1)])
    full = F.substring(F.col(COLUMNS[-1]), DIGEST + 5, DIGEST)
    return F.when(depth == 0, F.col("prior")).when(depth == WIDTH, full).otherwise(digest(F.concat("prior", shown)))


def rolled_up(blocks: DataFrame, aggregates: str) -> DataFrame:
    """All prefixes with their aggregates: columns of the block, ``step`` (depth in the block) and ``depth``."""
    names = ", ".join(COLUMNS)
    rows = blocks.sparkSession.sql(
        f"SELECT block, prior, {names}, {WIDTH} - bit_count(grouping_id()) AS step, {aggregates} FROM {{blocks}} GROUP BY block, prior, ROLLUP ({names})",
        blocks=blocks,
    )
    # A conversation that ends before a column has no node there; the node a block starts at belongs to the block before.
    real = (F.size(F.array_compact(F.array(*COLUMNS))) == F.col("step")) & ((F.col("step") > 0) | (F.col("block") == 0))
    return rows.where(real).withColumn("depth", F.col("block") * WIDTH + F.col("step"))


def trie_nodes(blocks: DataFrame) -> DataFrame:
    """Nodes with their place in the chain of their owner: ``conv_id, depth, name, parent, n_convs, saved, before, index,
    total, count`` (``saved`` is the node's own, ``before`` and ``index`` sum over the chain above it), stored."""
    step = F.col("step")
    last = F.element_at(F.array(*COLUMNS), F.greatest(step, F.lit(1)).cast("int"))
    length = F.when(step > 0, F.conv(F.hex(F.substring(last, DIGEST + 1, 4)), 16, 10).cast("bigint")).otherwise(F.lit(0))
    nodes = rolled_up(blocks, "count(*) AS n_convs, min(conv_id) AS conv_id").select(
        F.coalesce("conv_id", F.lit(0).cast("bigint")).alias("conv_id"), "depth", node_name(step).alias("name"),
        F.when(step > 0, node_name(step - 1)).alias("parent"), "n_convs",
        ((F.col("n_convs") - 1) * length).alias("saved"), F.lit(1).cast("bigint").alias("one"),
        F.coalesce(F.shiftright("depth", 16), F.lit(0).cast("bigint")).alias("stretch"),
    )
    chains = running_sums(
        nodes, ["conv_id"], "stretch", ["depth"], {"before": "saved", "index": "one"}, whole={"total": "saved", "count": "one"}
    )
    return stored(chains.drop("one", "stretch"), "nodes")


def with_parents(nodes: DataFrame) -> DataFrame:
    """``conv_id, depth, name, before, index, total, count, n_convs, parent_conv_id, n_children``, stored.

    Only the first node of a chain hangs on another owner's node. A parent of very many is looked up once for each salt."""
    salts = shuffle_partitions(nodes)
    hanging = nodes.where("index = 0 AND depth > 0").select("conv_id", "depth", "parent", F.pmod(F.xxhash64("conv_id"), F.lit(salts)).alias("salt"))
    asked = hanging.groupBy("parent", "salt").agg(F.count("*").alias("n"))
    found = asked.join(nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("owner"), F.col("depth").alias("at")), "parent")
    above = hanging.join(found.select("parent", "salt", "owner"), ["parent", "salt"]).select("conv_id", "depth", "owner")
    below = found.groupBy(F.col("owner").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("n").alias("n"))
    rows = nodes.drop("parent").join(above, ["conv_id", "depth"], "left").join(below, ["conv_id", "depth"], "left")
    own_child = F.when(F.col("index") < F.col("count") - 1, 1).otherwise(0)
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("index") > 0, F.col("conv_id")).otherwise(F.col("owner"))
    children = (F.coalesce("n", F.lit(0)) + own_child).cast("bigint")
    return stored(rows.select(*nodes.drop("parent").columns, parent.alias("parent_conv_id"), children.alias("n_children")), "nodes")


def ends_digests(blocks: DataFrame) -> DataFrame:
    """``name, ends_sha256`` of the nodes at which a conversation ends. Members of one node are cut into ranges, packed
    and hashed piece after piece, so neither a hot node's members nor their text are ever held together."""
    left = (F.col("length") - F.col("block") * WIDTH).alias("left")
    ends = blocks.where(F.col("length") <= (F.col("block") + 1) * WIDTH).select(node_name(left).alias("name"), "conv_id")

    def rows(batches):
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    def together(made, names):
        """Rows of a generator in batches of bounded size."""
        while held := list(islice(made, BATCH)):
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*held, strict=True), strict=True)))

    def pieces_of(batches):
        for name, members in groupby(rows(batches), lambda r: r[0]):
            while ids := [c for _, c in islice(members, PIECE)]:
                yield name, ids[0], ",".join(map(str, ids))

    def digests_of(batches):
        for name, pieces in groupby(rows(batches), lambda r: r[0]):
            state, comma = hashlib.sha256(), b""
            for _, _, ids in pieces:
                state.update(comma + ids.encode())
                comma = b","
            yield name, state.hexdigest()

    def pack(batches):
        return together(pieces_of(batches), ["name", "first", "ids"])

    def hash_pieces(batches):
        return together(digests_of(batches), ["name", "ends_sha256"])

    parts = shuffle_partitions(blocks)
    ranges = ends.repartitionByRange(parts, "name", "conv_id").sortWithinPartitions("name", "conv_id")
    pieces = map_arrow(ranges, pack, "name binary, first bigint, ids string")
    pieces = pieces.repartition(parts, "name").sortWithinPartitions("name", "first")
    return map_arrow(pieces, hash_pieces, "name binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuilt: bool = False) -> DataFrame:
    """One row for each distinct beginning of the conversations, the empty one included: ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` (code points that sharing the subtree's turns
    saves) and ``ends_sha256`` (SHA-256 of the ids of the conversations that end here, ascending, joined by commas).

    Turns go by ``turn``, null first; those of one number by their digest, so they have one order everywhere. Null role and text
    are empty. Equal rows are turns of their own. Rows with a null ``conv`` belong to no conversation. ``rebuilt`` puts
    each conversation on the opening of the first of its hundred (see :func:`families`). Without conversations there is no
    node. Conversations may have any number of turns. Other columns are not read.
    """
    turns = numbered_turns(rows, conv, turn, role, text)
    if rebuilt:
        turns = families(stored(turns, "numbered"))
    else:
        turns = turns.withColumnRenamed("total", "length")
    blocks = turn_blocks(turns)
    nodes = with_parents(trie_nodes(blocks))
    owners = nodes.where("index = count - 1").select("conv_id", "total", (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    sums = rolled_up(blocks.join(owners, "conv_id"), "min(conv_id) AS conv_id, sum(total) AS whole, sum(leaf) AS n_leaves")
    full = nodes.join(sums.select("conv_id", "depth", "whole", "n_leaves"), ["conv_id", "depth"]).join(ends_digests(blocks), "name", "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("whole") - F.col("before")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(load(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), rebuilt=True)


#: CRC-32 of a decimal number in DuckDB: its bytes go in one after the other, each followed by eight shifts.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
    lambda i: [ascii((conv_id::VARCHAR)[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, o: CASE WHEN o >= 0 THEN xor(x, o) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295::BIGINT)"""

SQL = f"""WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place, coalesce(role, '') AS role,
    coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, n, {_CRC} % {OPENING} AS h FROM (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id)),
r AS (
  SELECT c.conv_id, b.place, b.role, b.text FROM c JOIN t b ON b.conv_id = c.conv_id - c.conv_id % {FAMILY} AND b.place < c.h
  UNION ALL SELECT t.conv_id, least(c.h, coalesce(b.n, 0)) + t.place - c.h, t.role, t.text
  FROM t JOIN c ON c.conv_id = t.conv_id LEFT JOIN c b ON b.conv_id = t.conv_id - t.conv_id % {FAMILY} WHERE t.place >= c.h),
l AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY place) FILTER (place IS NOT NULL), []) AS turns
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, len(turns) AS size, d, turns[1:d] AS prefix FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM l)),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM p GROUP BY prefix, d),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT prefix[1:j] AS prefix, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM (
    SELECT nodes.prefix, unnest(range(0, depth + 1)) AS j, CASE WHEN n IS NULL THEN 1 ELSE 0 END AS leaf,
      (n_convs - 1) * coalesce(length(nodes.prefix[depth].text), 0) AS saved
    FROM nodes LEFT JOIN kids ON kids.prefix = nodes.prefix) GROUP BY ALL)
SELECT nodes.conv_id, nodes.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, nodes.n_convs, coalesce(kids.n, 0) AS n_children,
  n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, nodes.ends_sha256
FROM nodes LEFT JOIN nodes up ON nodes.depth > 0 AND up.depth = nodes.depth - 1 AND up.prefix = nodes.prefix[1:nodes.depth - 1]
LEFT JOIN kids ON kids.prefix = nodes.prefix JOIN sums ON sums.prefix = nodes.prefix"""
