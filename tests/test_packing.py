import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shardloom import ByteTokenizer, apply_budget, pack_documents, pack_shards, split_totals, token_offsets, tokenize
from shardloom.functions.splits import assign_split
from shardloom.functions.tokenizers import pack_ids, packed_slice, packed_tokens, unpack_ids
from shardloom.operators.offsets import counted_documents
from shardloom.operators.ordered import range_blocks, running_sums
from shardloom.plans.epochs import shard_layout

# Two stages of one job may fail on the same row; Spark then reports both, as a plain Java error.
JOB_ERRORS = (PySparkException, Py4JJavaError)
TOKENIZED = "doc_id bigint, split string, tokens array<int>"


def pack(spark, documents, size=10, split="train"):
    rows = spark.createDataFrame([(i, split, list(t)) for i, t in enumerate(documents)], TOKENIZED)
    packed = pack_shards(rows, size).orderBy("shard_index").collect()
    assert all(r.token_count == len(r.tokens) and r.split == split for r in packed)
    return {r.shard_index: r.tokens for r in packed}


@pytest.mark.parametrize("documents, shards", [
    ([[7, 8, 9, 10]], {0: [7, 8, 9, 10]}),
    ([range(4), range(4, 12)], {0: list(range(10)), 1: [10, 11]}),
    ([range(10)], {0: list(range(10))}),
    ([range(25)], {0: list(range(10)), 1: list(range(10, 20)), 2: list(range(20, 25))}),
    ([range(10), [], range(10, 13)], {0: list(range(10)), 1: [10, 11, 12]}),
    ([[]], {}),
])
def test_packing_cases(spark, documents, shards):
    assert pack(spark, documents) == shards


def random_documents(spark, n=400, keys=None, hot_split=True):
    rng = np.random.default_rng(5)
    keys = np.arange(n) if keys is None else keys
    rows, streams = [], {"train": [], "val": []}
    for key in keys:
        split = "val" if rng.random() < 0.05 else "train"
        tokens = rng.integers(0, 65536, rng.integers(0, 60)).tolist()
        rows.append((int(key), split, tokens))
    for key, split, tokens in sorted(rows):
        streams[split] += tokens
    return spark.createDataFrame(rows, TOKENIZED), rows, streams


def check_streams(packed, streams, size):
    for split, stream in streams.items():
        mine = sorted((r.shard_index, r.tokens) for r in packed if r.split == split)
        assert [i for i, _ in mine] == list(range(len(mine)))
        assert [t for _, part in mine for t in part] == stream
        assert all(len(part) == size for _, part in mine[:-1]) and all(part for _, part in mine)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_packing_does_not_depend_on_partitions(spark, partitions):
    rows, _, streams = random_documents(spark)
    check_streams(pack_shards(rows.repartition(partitions), 64).collect(), streams, 64)


@pytest.mark.parametrize("bits", [1, 4, 20])
def test_packing_does_not_depend_on_block_size(spark, monkeypatch, bits):
    monkeypatch.setattr("shardloom.operators.ordered.BLOCK_BITS", bits)
    monkeypatch.setattr("shardloom.operators.ordered.SUPER_BITS", bits)
    rows, _, streams = random_documents(spark, 150)
    check_streams(pack_shards(rows, 37).collect(), streams, 37)


def test_a_document_may_span_very_many_shards(spark):
    rows = spark.range(2).selectExpr("id AS doc_id", "'train' AS split", "transform(sequence(int(id), int(id) + 1999999), x -> x % 65536) AS tokens")
    packed = pack_shards(rows, 500)
    ends = packed.selectExpr("shard_index", "token_count", "tokens[0] AS a", "tokens[499] AS z").orderBy("shard_index").collect()
    assert [r.token_count for r in ends] == [500] * 8000
    assert [(r.a, r.z) for r in ends[:4000]] == [(i * 500 % 65536, (i * 500 + 499) % 65536) for i in range(4000)]
    assert [(r.a, r.z) for r in ends[4000:]] == [((i * 500 + 1) % 65536, (i * 500 + 500) % 65536) for i in range(4000)]


def test_sparse_and_negative_keys(spark):
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 48), 1 << 48, 200))
    rows, _, streams = random_documents(spark, keys=keys)
    check_streams(pack_shards(rows, 50).collect(), streams, 50)


def test_superblocks_are_summed_in_order(spark):
    # Keys far apart fall into different superblocks of the second level.
    keys = [i << 31 for i in range(12)] + [(i << 31) + 5 for i in range(12)]
    rows, plain, _ = random_documents(spark, keys=keys)
    offsets = token_offsets(rows.withColumn("n_tokens", F.size("tokens").cast("bigint"))).collect()
    start = {"train": 0, "val": 0}
    expected = {}
    for key, split, tokens in sorted(plain):
        expected[key] = start[split]
        start[split] += len(tokens)
    assert {r.doc_id: r.start for r in offsets} == expected


@pytest.mark.parametrize("rows, message", [
    ([(1, "train", [1]), (1, "train", [2])], "duplicate order key"),
    ([(None, "train", [1])], "order key is null"),
])
def test_bad_order_keys(spark, rows, message):
    with pytest.raises(JOB_ERRORS, match=message):
        pack_shards(spark.createDataFrame(rows, TOKENIZED), 10).collect()


def test_offsets_and_packing_take_every_64_bit_key(spark):
    keys = [-(1 << 63), -(1 << 62) - 7, -1, 0, 1 << 40, (1 << 40) + 1, 1 << 51, (1 << 63) - 1]
    rows, plain, streams = random_documents(spark, keys=keys)
    check_streams(pack_shards(rows, 7).collect(), streams, 7)
    start, expected = {"train": 0, "val": 0}, {}
    for key, split, tokens in sorted(plain):
        expected[key] = start[split]
        start[split] += len(tokens)
    counted = rows.withColumn("n_tokens", F.size("tokens").cast("bigint"))
    assert {r.doc_id: r.start for r in token_offsets(counted).collect()} == expected


def test_packed_ids_take_two_bytes_and_come_back(spark):
    lists = [[], [0], [65535, 1, 256], list(range(300))]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, tokens array<int>")
    packed = rows.select("id", pack_ids(F.col("tokens")).alias("p"))
    assert {r.id: bytes(r.p) for r in packed.collect()} == {i: np.array(x, "<u2").tobytes() for i, x in enumerate(lists)}
    both = packed.select("id", unpack_ids(F.array("p", packed_slice(F.col("p"), F.lit(1), F.lit(2)))).alias("t"))
    assert {r.id: r.t for r in both.collect()} == {i: x + x[1:3] for i, x in enumerate(lists)}
    text = spark.createDataFrame([("",), ("aé",)], "text string")
    assert [bytes(r[0]) for r in text.select(packed_tokens(ByteTokenizer(), F.col("text"))).collect()] == [
        np.array(x, "<u2").tobytes() for x in ([50256], [50256, 97, 195, 169])
    ]
    for bad in ([-1], [65536]):
        with pytest.raises(JOB_ERRORS, match="token id outside"):
            spark.createDataFrame([(bad,)], "t array<int>").select(pack_ids(F.col("t"))).collect()


def test_text_is_hashed_once_and_tokens_travel_in_two_bytes(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(100)], "doc_id bigint, text string")
    rows.write.parquet(str(tmp_path / "docs"))
    plan = pack_documents(spark.read.parquet(str(tmp_path / "docs")), ByteTokenizer(), 64)._jdf.queryExecution().executedPlan().toString()
    assert "sha2" not in plan and plan.count("text#") > 0
    exchange = [line for line in plan.splitlines() if "Exchange" in line and "shard_index" in line]
    assert len(exchange) == 1 and "array<int>" not in exchange[0]


def test_budget_keeps_the_overshooting_document_whole(spark):
    rows = spark.createDataFrame(
        [(0, "train", 6), (1, "val", 5), (2, "train", 6), (3, "train", 6), (4, "val", 5), (5, "val", 5)],
        "doc_id bigint, split string, n_tokens bigint",
    )
    taken = apply_budget(token_offsets(rows), {"train": 7, "val": 10})
    assert sorted(r.doc_id for r in taken.collect()) == [0, 1, 2, 4]
    totals = {r.split: r for r in split_totals(taken, 4, {"train": 7, "val": 10}).collect()}
    assert (totals["train"].tokens, totals["train"].shards, totals["train"].overshoot) == (12, 3, 5)
    assert (totals["val"].documents, totals["val"].tokens, totals["val"].overshoot) == (2, 10, 0)


def test_documents_pack_like_their_tokens_and_layout_matches(spark):
    texts = [(i, "x" * (i * 7 % 90) + str(i)) for i in range(300)]
    documents = spark.createDataFrame(texts, "doc_id bigint, text string")
    targets = {"train": 5_000, "val": 100}
    direct = pack_documents(documents, ByteTokenizer(), 64, targets=targets)
    tokens = tokenize(assign_split(documents), ByteTokenizer())
    assert sorted(direct.collect()) == sorted(pack_shards(tokens, 64, targets=targets).collect())
    taken = apply_budget(token_offsets(counted_documents(documents, ByteTokenizer())), targets)
    layout = shard_layout(split_totals(taken, 64), 64)
    assert sorted(layout.collect()) == sorted(direct.select("split", "shard_index", "token_count").collect())


def test_layout_is_expanded_in_chunks(spark, monkeypatch):
    monkeypatch.setattr("shardloom.plans.epochs.LAYOUT_CHUNK", 4)
    totals = spark.createDataFrame([("train", 103), ("val", 10), ("other", 0)], "split string, tokens bigint")
    rows = sorted(shard_layout(totals, 10).collect())
    assert [(r.shard_index, r.token_count) for r in rows if r.split == "train"] == [*((i, 10) for i in range(10)), (10, 3)]
    assert [(r.shard_index, r.token_count) for r in rows if r.split == "val"] == [(0, 10)]


def test_shard_size_must_be_positive(spark):
    rows = spark.createDataFrame([(0, "train", [1])], TOKENIZED)
    with pytest.raises(ValueError, match="shard_size"):
        pack_shards(rows, 0)


def test_running_sums_over_range_blocks_with_one_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot" if rng.random() < 0.6 else f"g{rng.integers(5)}", float(rng.integers(20)), i) for i in range(2000)]
    frame = spark.createDataFrame(rows, "g string, t double, id bigint").select(
        F.coalesce("g", F.lit("")).alias("g"), "t", "id", F.lit(1).cast("bigint").alias("one")
    )
    blocked = range_blocks(frame, ["g", "t", "id"], partitions=8)
    assert blocked.filter("g = 'hot'").select("block").distinct().count() > 1
    got = {r.id: r.before for r in running_sums(blocked, ["g"], "block", ["t", "id"], {"before": "one"}).collect()}
    expected = {}
    for group in {g for g, _, _ in rows}:
        ordered = sorted((t, i) for g, t, i in rows if g == group)
        expected |= {i: n for n, (_, i) in enumerate(ordered)}
    assert got == expected


def test_running_sums_compute_their_input_once(spark):
    rows = spark.range(1000).selectExpr("id AS doc_id", "'train' AS split", "id % 7 AS n_tokens")
    offsets = token_offsets(rows)
    offsets.collect()
    assert "ReusedExchange" in offsets._jdf.queryExecution().executedPlan().toString()
