"""Order of shards per epoch, and the global number of every batch.

The order of an epoch is a keyed permutation of the shard numbers, so a shard's place, and the shard at a place, are
expressions. Where all shards but the last are alike, as in every set written here, so is the number of its first batch:
nothing is sorted, joined or listed, whatever the number of shards. Sets of uneven shards need running sums instead.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.checks import required
from shardloom.functions.names import NAME_FORMAT, shard_name
from shardloom.functions.shuffle import permuted, permuted_column, place_column, round_keys
from shardloom.functions.splits import check_split
from shardloom.operators.ordered import running_sums
from shardloom.operators.windows import batch_count, check_shape, cut_batches

# Shards listed from one row when a layout is expanded, and places looked up at once.
LAYOUT_CHUNK = 1 << 12
# Largest shard list that numpy mode shuffles on the driver.
NUMPY_LIMIT = 1_000_000
PLAN_COLUMNS = ("split", "epoch", "position", "shard_index", "shard_name", "token_count", "n_batches", "first_ordinal")


def _div(a, b) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def expand_chunks(rows: DataFrame, last: Column, *carried: str) -> DataFrame:
    """One row for each number ``0 .. last``, as ``index``, beside ``carried``; chunks of numbers are spread over tasks."""
    chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), last, F.lit(LAYOUT_CHUNK).cast("bigint"))).alias("_chunk")
    # Chunks are few and small, what is made of them is not: a given number of partitions is not merged into one.
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.select(*carried, last.alias("_last"), chunk).repartition(parts, *carried, "_chunk")
    index = F.explode(F.sequence("_chunk", F.least(F.col("_last"), F.col("_chunk") + (LAYOUT_CHUNK - 1))))
    return spread.select(*carried, index.alias("index"))


def shard_layout(totals: DataFrame, shard_size: int) -> DataFrame:
    """``split, shard_index, token_count`` of the shards that ``split, tokens`` totals are cut into.

    All shards but the last of a split are full, so totals suffice; no token is read.
    """
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    shards = expand_chunks(totals.filter("tokens > 0"), _div(F.col("tokens") - 1, shard_size), "split", "tokens")
    count = F.least(F.lit(shard_size).cast("bigint"), F.col("tokens") - F.col("index") * shard_size)
    return shards.select("split", F.col("index").cast("int").alias("shard_index"), count.cast("int").alias("token_count"))


@dataclass(frozen=True)
class EpochOrder:
    """Order of the batches of one split over all epochs, for a set of ``shards`` shards of ``shard_size`` tokens, the last of
    which holds what is left of ``tokens``.

    Train shards are permuted anew in every epoch, val shards stay in order. Positions are 64-bit numbers throughout.
    """

    split: str
    shards: int
    shard_size: int
    tokens: int
    batch_size: int
    sequence_length: int
    seed: int = 32

    def __post_init__(self):
        check_split(self.split)
        check_shape(self.batch_size, self.sequence_length)
        if self.shards < 1:
            raise ValueError(f"No shards found for split {self.split}")
        if not 1 <= self.tokens - (self.shards - 1) * self.shard_size <= self.shard_size:
            raise ValueError("shards but the last are not of one size")
        if not self.per_epoch:
            raise ValueError(f"No shard contains enough tokens for a batch of size {self.step + 1}")

    @classmethod
    def of_totals(cls, totals: DataFrame, split: str, shard_size: int, batch_size: int, sequence_length: int, seed: int = 32) -> EpochOrder:
        """From ``split, tokens`` totals: one row reaches the driver."""
        row = totals.filter(F.col("split") == check_split(split)).agg(F.sum("tokens").alias("tokens")).first()
        return cls(split, -(-(row.tokens or 0) // shard_size), shard_size, row.tokens or 0, batch_size, sequence_length, seed)

    @classmethod
    def of_manifest(cls, manifest: dict, split: str, batch_size: int, sequence_length: int, seed: int = 32) -> EpochOrder:
        prefix = "train" if check_split(split) == "train" else "validation"
        shards, tokens = manifest[f"{prefix}_shards"], manifest[f"{prefix}_tokens"]
        return cls(split, shards, manifest["shard_size"], tokens, batch_size, sequence_length, seed)

    @property
    def step(self) -> int:
        """Tokens a batch advances by."""
        return self.batch_size * self.sequence_length

    @property
    def full(self) -> int:
        """Batches of every shard but the last."""
        return max(self.shard_size - 1, 0) // self.step

    @property
    def last(self) -> int:
        return (self.tokens - (self.shards - 1) * self.shard_size - 1) // self.step

    @property
    def per_epoch(self) -> int:
        return (self.shards - 1) * self.full + self.last

    def name(self, shard: int) -> str:
        return NAME_FORMAT % (self.split, shard)

    def place(self, shards, epoch: int) -> np.ndarray:
        """Positions of shards within an epoch."""
        shards = np.asarray(shards, np.int64)
        return permuted(shards, self.shards, round_keys(self.seed, epoch)) if self.split == "train" else shards

    def shard_at(self, places, epoch: int) -> np.ndarray:
        places = np.asarray(places, np.int64)
        return permuted(places, self.shards, round_keys(self.seed, epoch), inverse=True) if self.split == "train" else places

    def first_ordinal(self, place: int, epoch: int) -> int:
        """Number of the first batch of the shard at a place of an epoch."""
        short = place > int(self.place(self.shards - 1, epoch))
        return epoch * self.per_epoch + place * self.full - short * (self.full - self.last)

    def locate(self, ordinal: int) -> tuple[int, int, int]:
        """Epoch, place in it and batch within the shard of a batch number."""
        epoch, at = divmod(ordinal, self.per_epoch)
        short = int(self.place(self.shards - 1, epoch))  # where the last shard stands
        before = short * self.full
        if at < before:
            return epoch, at // self.full, at % self.full
        if at < before + self.last:
            return epoch, short, at - before
        at -= before + self.last
        return epoch, short + 1 + at // self.full, at % self.full

    def segments(self, start: int, end: int):
        """Runs of batches of one shard that make up ``start <= ordinal < end``: ``shard, epoch, ordinal, batch, batches``."""
        while start < end:
            epoch, place, batch = self.locate(start)
            # A read of few batches looks up few shards: the last one may hold fewer batches than the others.
            need = (batch + end - start) // max(self.full, 1) + 2
            places = np.arange(place, min(place + min(need, LAYOUT_CHUNK), self.shards))
            for shard in self.shard_at(places, epoch).tolist():
                take = min((self.last if shard == self.shards - 1 else self.full) - batch, end - start)
                if take > 0:
                    yield shard, epoch, start, batch, take
                start, batch = start + max(take, 0), 0
                if start >= end:
                    return


def _numbers(values) -> Column:
    """Numbers known here as one ``array<bigint>`` constant."""
    return F.split(F.lit(",".join(str(int(v)) for v in values)), ",").cast("array<bigint>")


def ordered_shards(shards: DataFrame, order: EpochOrder, epochs: range) -> DataFrame:
    """Rows of an evenly cut set for each of some epochs, with ``epoch, position, n_batches, first_ordinal``. Narrow: every
    added column is an expression of the shard's number."""
    own = shards.filter(F.col("split") == order.split)
    rows = own.withColumn("epoch", F.explode(F.sequence(F.lit(epochs.start), F.lit(epochs.stop - 1))))
    index, count = F.col("shard_index").cast("bigint"), F.lit(order.shards).cast("bigint")
    if order.split == "train":
        # Rows hold tokens, which would wait in a queue beside a Python function: an expression, with the keys at hand.
        at = (F.col("epoch") - epochs.start + 1).cast("int")
        keys = F.element_at(F.array(*(_numbers(round_keys(order.seed, e)) for e in epochs)), at)
        short = F.element_at(_numbers([order.place(order.shards - 1, e) for e in epochs]), at)
        rows = rows.withColumns({"position": permuted_column(index, count, keys), "_short": short})
    else:
        rows = rows.withColumns({"position": index, "_short": count - 1})
    return _with_ordinals(rows, F.lit(order.full), F.lit(order.last), index == count - 1, F.lit(order.per_epoch)).drop("_short")


def _with_ordinals(rows: DataFrame, full: Column, last: Column, is_last: Column, per_epoch: Column) -> DataFrame:
    missing = F.when(F.col("position") > F.col("_short"), full - last).otherwise(0)
    first = F.col("epoch").cast("bigint") * per_epoch + F.col("position") * full - missing
    return rows.withColumns({"n_batches": F.when(is_last, last).otherwise(full).cast("bigint"), "first_ordinal": first.cast("bigint")})


def total_plan(
    totals: DataFrame, shard_size: int, batch_size: int, sequence_length: int, seed: int = 32, epochs: int = 1, first_epoch: int = 0
) -> DataFrame:
    """:func:`epoch_plan` of the shards that ``split, tokens`` totals are cut into, in closed form.

    The only exchange spreads chunks of numbers; no plan row is shuffled, sorted or joined.
    """
    step = check_shape(batch_size, sequence_length)
    check_epochs(epochs, first_epoch)
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    tokens = F.col("tokens")
    last = _div(tokens - 1, shard_size)
    every = F.explode(F.sequence(F.lit(first_epoch), F.lit(first_epoch + epochs - 1))).alias("epoch")
    index, train = F.col("index"), F.col("split") == "train"

    def place(shard: Column) -> Column:
        return F.when(train, place_column(shard, last + 1, seed, F.col("epoch"))).otherwise(shard)

    each = totals.filter("tokens > 0").select("split", "tokens", every).withColumn("_short", place(last))
    rows = expand_chunks(each, last, "split", "tokens", "epoch", "_short")
    full, of_last = F.lit(max(shard_size - 1, 0) // step), _div(tokens - last * shard_size - 1, step)
    rows = rows.withColumn("position", place(index))
    rows = _with_ordinals(rows, full, of_last, index == last, last * full + of_last)
    size = F.least(F.lit(shard_size).cast("bigint"), tokens - index * shard_size).cast("int")
    rows = rows.withColumns({"shard_index": index.cast("int"), "token_count": size})
    return rows.withColumn("shard_name", shard_name(F.col("split"), F.col("shard_index"))).select(*PLAN_COLUMNS)


def check_epochs(epochs: int, first_epoch: int) -> None:
    if epochs < 1 or first_epoch < 0:
        raise ValueError("need at least one epoch and a first epoch of 0 or more")


def permuted_order(shards: DataFrame, seed: int, first_epoch: int, end_epoch: int) -> DataFrame:
    """Shards of any sizes and numbers per epoch, with their place as ``_key``: train shards are ranked by number and the ranks
    permuted, val shards keep their number."""
    rows = shards.select(
        required(F.col("split"), "split is null", "").alias("split"), "shard_index", "token_count", F.lit(1).cast("bigint").alias("_one"),
        required(F.shiftright(F.col("shard_index").cast("bigint"), 16), "shard_index is null", 0).alias("_block"),
    )
    ranked = running_sums(rows, ["split"], "_block", ["shard_index"], {"_rank": "_one"}, whole={"_count": "_one"})
    ranked = ranked.withColumn("epoch", F.explode(F.sequence(F.lit(first_epoch), F.lit(end_epoch - 1))))
    place = place_column(F.col("_rank"), F.col("_count"), seed, F.col("epoch"))
    ranked = ranked.withColumn("_key", F.when(F.col("split") == "train", place).otherwise(F.col("_rank")))
    name = shard_name(F.col("split"), F.col("shard_index")).alias("shard_name")
    block = F.coalesce(F.shiftright("_key", 16), F.lit(0).cast("bigint")).alias("_block")
    return ranked.select("split", "shard_index", "token_count", name, "epoch", "_key", block)


def numpy_orders(names: list[str], rng: np.random.Generator, epochs: range) -> dict[int, list[str]]:
    """Orders of some epochs by successive in-place shuffles of the sorted names: each permutes the order before it."""
    orders, order = {}, list(names)
    for epoch in range(epochs.stop):
        rng.shuffle(order)
        if epoch in epochs:
            orders[epoch] = list(order)
    return orders


def listed_order(shards: DataFrame, split: str, orders: dict[int, list[str]]) -> DataFrame:
    """Shards in orders given as lists, per epoch. The lists are bounded by ``NUMPY_LIMIT`` names."""
    spark: SparkSession = shards.sparkSession
    listed = [(split, e, p, n) for e, order in orders.items() for p, n in enumerate(order)]
    order = spark.createDataFrame(listed, "split string, epoch int, _key bigint, shard_name string")
    named = shards.withColumn("shard_name", shard_name(F.col("split"), F.col("shard_index")))
    rows = named.select("split", "shard_index", "token_count", "shard_name").join(order, ["split", "shard_name"])
    return rows.withColumn("_block", F.coalesce(F.shiftright("_key", 16), F.lit(0).cast("bigint")))


def bounded_names(shards: DataFrame, split: str) -> list[str]:
    rows = shards.filter(F.col("split") == split).select("shard_index").limit(NUMPY_LIMIT + 1).collect()
    if len(rows) > NUMPY_LIMIT:
        raise ValueError(f"numpy mode shuffles on the driver and takes at most {NUMPY_LIMIT} shards; use mode='keyed'")
    return [f"dataset_{split}_{i:06d}.bin" for i in sorted(r.shard_index for r in rows)]


def numbered(ordered: DataFrame, batch_size: int, sequence_length: int) -> DataFrame:
    """Position in the epoch and ordinal of the first batch, for shards that carry ``_block`` and ``_key``."""
    rows = ordered.select(
        required(F.col("split"), "split is null", "").alias("split"),
        required(F.col("epoch").cast("bigint"), "epoch is null", 0).alias("epoch"),
        "shard_index", "shard_name", "token_count", "_block", "_key",
        batch_count(F.col("token_count"), batch_size, sequence_length).alias("n_batches"),
        F.lit(1).cast("bigint").alias("_one"),
    )
    plan = running_sums(
        rows, ["split", "epoch"], "_block", ["_key", "shard_index"],
        {"position": "_one", "first_ordinal": "n_batches"}, whole={"_per_epoch": "n_batches"},
    )
    # Every epoch holds the same number of batches.
    first = F.col("epoch") * F.col("_per_epoch") + F.col("first_ordinal")
    return plan.withColumns({"first_ordinal": first, "epoch": F.col("epoch").cast("int")}).select(*PLAN_COLUMNS)


def epoch_plan(
    shards: DataFrame,
    batch_size: int,
    sequence_length: int,
    seed: int = 32,
    epochs: int = 1,
    first_epoch: int = 0,
    mode: str = "keyed",
) -> DataFrame:
    """One row per epoch and shard: ``split, epoch, position, shard_index, shard_name, token_count,
    n_batches, first_ordinal``. Shards may have any sizes and numbers; see :func:`total_plan` for sets cut evenly.

    ``mode="keyed"`` permutes train shards by a keyed permutation per epoch, computed in parallel.
    ``mode="numpy"`` replays numpy's seeded shuffles on the driver for short shard lists.
    """
    shards = shards.select("split", "shard_index", "token_count")
    end = first_epoch + epochs
    check_epochs(epochs, first_epoch)
    if mode == "keyed":
        return numbered(permuted_order(shards, seed, first_epoch, end), batch_size, sequence_length)
    if mode != "numpy":
        raise ValueError("mode must be 'keyed' or 'numpy'")
    names = bounded_names(shards, "train")
    if len(names) * epochs > NUMPY_LIMIT:
        raise ValueError(f"numpy mode lists at most {NUMPY_LIMIT} shards over all epochs; use mode='keyed'")
    orders = numpy_orders(names, np.random.default_rng(seed), range(first_epoch, end))
    train = listed_order(shards, "train", orders)
    val = permuted_order(shards.filter("split = 'val'"), seed, first_epoch, end)
    return numbered(train.unionByName(val), batch_size, sequence_length)


def batch_ordinals(plan: DataFrame, batch_size: int, sequence_length: int) -> DataFrame:
    """One row per batch: ``split, epoch, ordinal, shard_index, batch_in_shard, token_position``."""
    step = batch_size * sequence_length
    some = plan.filter(F.col("n_batches") > 0)
    number = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_batches") - 1))
    rows = some.select("split", "epoch", "first_ordinal", "shard_index", number.alias("batch_in_shard"))
    return rows.select(
        "split", "epoch", (F.col("first_ordinal") + F.col("batch_in_shard")).alias("ordinal"), "shard_index",
        "batch_in_shard", (F.col("batch_in_shard") * step).alias("token_position"),
    )


def batches_in_order(shards: DataFrame, order: EpochOrder, first: int = 0, end: int | None = None) -> DataFrame:
    """Batches ``first <= ordinal < end`` (by default the first epoch) of an evenly cut table of shards: ``split, epoch, ordinal,
    row, inputs, targets``. Their numbers are expressions of the shard's own, so no token moves and no plan is joined."""
    end = order.per_epoch if end is None else end
    if not 0 <= first < end:
        raise ValueError("need 0 <= first < end")
    epochs = range(first // order.per_epoch, (end - 1) // order.per_epoch + 1)
    return cut_batches(ordered_shards(shards, order, epochs), order.batch_size, order.sequence_length, first, end)
