"""Next-token windows and batches. Shards are self-contained, so cutting them shuffles nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_shape(batch_size: int, sequence_length: int) -> int:
    if batch_size < 1 or sequence_length < 1:
        raise ValueError("batch_size and sequence_length must be at least 1")
    return batch_size * sequence_length


def batch_count(token_count: Column, batch_size: int, sequence_length: int) -> Column:
    """Batches in a shard. Each reads ``B*S + 1`` tokens and advances by ``B*S``; leftovers are skipped."""
    step = check_shape(batch_size, sequence_length)
    return F.call_function("div", F.greatest(token_count - 1, F.lit(0)), F.lit(step))


def undersized_shards(shards: DataFrame, batch_size: int, sequence_length: int) -> DataFrame:
    """Shards too small for one batch."""
    return shards.filter(F.col("token_count") < check_shape(batch_size, sequence_length) + 1)


def _explode_batches(shards: DataFrame, batch_size: int, sequence_length: int) -> DataFrame:
    count = batch_count(F.col("token_count"), batch_size, sequence_length)
    # sequence(0, -1) counts down, hence the guard for shards without a batch.
    numbers = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1))
    return shards.withColumn("batch_in_shard", F.explode(numbers))


def _rows(exploded: DataFrame, batch_size: int, sequence_length: int, keep: list[str]) -> DataFrame:
    at = (F.col("batch_in_shard") * (batch_size * sequence_length) + F.col("row") * sequence_length).cast("int")
    return exploded.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(batch_size - 1)))).select(
        *keep,
        "row",
        F.slice("tokens", at + 1, sequence_length).alias("inputs"),
        F.slice("tokens", at + 2, sequence_length).alias("targets"),
    )


def token_windows(shards: DataFrame, batch_size: int, sequence_length: int) -> DataFrame:
    """``split, shard_index, batch_in_shard, row, inputs, targets``; a batch is ``batch_size`` rows."""
    exploded = _explode_batches(shards, batch_size, sequence_length)
    return _rows(exploded, batch_size, sequence_length, ["split", "shard_index", "batch_in_shard"])


def cut_batches(planned: DataFrame, batch_size: int, sequence_length: int, first: int = 0, end: int | None = None) -> DataFrame:
    """Batches ``first <= ordinal < end`` of shards that carry ``epoch``, ``n_batches`` and ``first_ordinal``."""
    wanted = planned.filter(F.col("n_batches") > 0).filter(F.col("first_ordinal") + F.col("n_batches") > first)
    if end is not None:
        wanted = wanted.filter(F.col("first_ordinal") < end)
    exploded = _explode_batches(wanted, batch_size, sequence_length)
    exploded = exploded.withColumn("ordinal", F.col("first_ordinal") + F.col("batch_in_shard"))
    exploded = exploded.filter(F.col("ordinal") >= first)
    if end is not None:
        exploded = exploded.filter(F.col("ordinal") < end)
    return _rows(exploded, batch_size, sequence_length, ["split", "epoch", "ordinal"])


def batches(
    shards: DataFrame, plan: DataFrame, batch_size: int, sequence_length: int, first: int = 0, end: int | None = None
) -> DataFrame:
    """Batches ``first <= ordinal < end`` of an epoch plan: ``split, epoch, ordinal, row, inputs, targets``.

    For tables of uneven shards, whose plan must be joined; Spark chooses how. An evenly cut set needs no join
    (:func:`~shardloom.plans.epochs.batches_in_order`), shard files are read by position
    (:func:`~shardloom.sources.shards.read_batches`). An ``end`` beyond the plan is an error.
    """
    if end is not None:
        # One row of totals; a plan that is too short must not pass for the whole.
        planned = plan.agg(F.max(F.col("first_ordinal") + F.col("n_batches"))).first()[0] or 0
        if planned < end:
            raise ValueError(f"the plan ends at batch {planned}, before {end}: plan more epochs")
    wanted = plan.select("split", "shard_index", "epoch", "n_batches", "first_ordinal")
    return cut_batches(shards.join(wanted, ["split", "shard_index"]), batch_size, sequence_length, first, end)


def export_batches(batch_rows: DataFrame) -> DataFrame:
    """Token ids widened to 64 bits, as a trainer takes them."""
    wide = {c: F.col(c).cast("array<bigint>") for c in ("inputs", "targets")}
    return batch_rows.withColumns(wide)
