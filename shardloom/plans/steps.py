"""Grouping of batches into optimizer updates, and what is due at each of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.schedule import due, learning_rate, tokens_seen
from shardloom.plans.epochs import EpochOrder, batches_in_order


def step_plan(
    ordinals: DataFrame, accumulation_steps: int, batch_size: int, sequence_length: int, total_steps: int | None = None
) -> DataFrame:
    """Add ``update_step``, ``micro_step`` and ``tokens`` seen after the step; stop at ``total_steps``."""
    if accumulation_steps < 1:
        raise ValueError("accumulation_steps must be at least 1")
    step = F.call_function("div", F.col("ordinal"), F.lit(accumulation_steps)) + 1
    rows = ordinals.withColumns({
        "update_step": step, "micro_step": (F.col("ordinal") % accumulation_steps).cast("int"),
    })
    if total_steps is not None:
        rows = rows.filter(F.col("update_step") <= total_steps)
    return rows.withColumn("tokens", tokens_seen(F.col("update_step"), accumulation_steps, batch_size, sequence_length))


def step_cadence(
    steps: DataFrame, log_interval: int, eval_interval: int, checkpoint_interval: int, total_steps: int,
    step: str = "update_step",
) -> DataFrame:
    """Flags for the work due at each step; a checkpoint is also due at the last one."""
    at = F.col(step)
    return steps.withColumns({
        "log_due": due(at, log_interval),
        "eval_due": due(at, eval_interval),
        "checkpoint_due": due(at, checkpoint_interval, total_steps),
    })


def update_steps(planned: DataFrame, **schedule) -> DataFrame:
    """One row per update: ``update_step, tokens, micro_steps, learning_rate``."""
    updates = planned.groupBy("update_step", "tokens").agg(F.count("*").alias("micro_steps"))
    return updates.withColumn("learning_rate", learning_rate(F.col("update_step"), **schedule))


def counted_updates(
    spark: SparkSession, batches: int, accumulation_steps: int, batch_size: int, sequence_length: int, limit: int | None = None, **schedule
) -> DataFrame:
    """:func:`update_steps` of ``batches`` consecutive batches (of the first ``limit`` updates, if given), from their number alone: no
    batch is listed."""
    if accumulation_steps < 1:
        raise ValueError("accumulation_steps must be at least 1")
    count = -(-batches // accumulation_steps)
    count = count if limit is None else min(count, limit)
    step = F.col("update_step")
    micro = F.least(F.lit(accumulation_steps).cast("bigint"), F.lit(batches) - (step - 1) * accumulation_steps)
    return spark.range(1, count + 1).toDF("update_step").select(
        step, tokens_seen(step, accumulation_steps, batch_size, sequence_length).alias("tokens"), micro.alias("micro_steps"),
        learning_rate(step, **schedule).alias("learning_rate"),
    )


def eval_batches(shards: DataFrame, order: EpochOrder, eval_steps: int) -> DataFrame:
    """The first validation batches, the same ones at every evaluation; where an epoch has fewer, those of the next follow."""
    if eval_steps < 1:
        raise ValueError("eval_steps must be at least 1")
    if order.split != "val":
        raise ValueError("evaluation takes the order of the val split")
    return batches_in_order(shards, order, 0, eval_steps)
