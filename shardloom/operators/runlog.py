"""Aggregates and curves over the metric logs of many runs.

One run may hold most of the records, so nothing windows over a whole run: steps are cut into blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.checks import required
from shardloom.functions.schedule import learning_rate, tokens_seen

# Intervals per block of one run.
BLOCK_INTERVALS = 1 << 12


def trim(metrics: DataFrame, saved: DataFrame) -> DataFrame:
    """Records up to the saved step of their run (``run_id, saved_step``); runs without one stay whole."""
    joined = metrics.join(saved.select("run_id", "saved_step"), "run_id", "left")
    return joined.filter(F.col("saved_step").isNull() | (F.col("step") <= F.col("saved_step"))).select(*metrics.columns)


def interval_of(step: str, interval: int):
    if interval < 1:
        raise ValueError("interval must be at least 1")
    return F.call_function("div", F.col(step) - 1, F.lit(interval))


def interval_loss(metrics: DataFrame, interval: int) -> DataFrame:
    """Mean train loss of every complete interval: ``run_id, end_step, mean_loss``."""
    groups = metrics.groupBy("run_id", interval_of("step", interval).alias("interval"))
    sums = groups.agg(F.sum("train_loss").alias("total"), F.count("*").alias("records"))
    full = sums.filter(F.col("records") == interval)
    return full.select(
        "run_id", ((F.col("interval") + 1) * interval).alias("end_step"), (F.col("total") / interval).alias("mean_loss")
    )


def latest_losses(metrics: DataFrame, interval: int) -> DataFrame:
    """Latest interval mean and validation loss known at each step.

    The last values of each block are carried over the short list of a run's blocks first; within a
    block they are carried by a window. Both windows of a block share one shuffle.
    """
    block = F.call_function("div", interval_of("step", interval), F.lit(BLOCK_INTERVALS))
    rows = metrics.select(
        required(F.col("run_id"), "run_id is null", "").alias("run_id"), "step", "train_loss", "val_loss",
        interval_of("step", interval).alias("_interval"), required(block, "step is null", 0).alias("_block"),
    ).repartition("run_id", "_block")

    whole = Window.partitionBy("run_id", "_block", "_interval")
    complete = (F.count("*").over(whole) == interval) & (F.pmod("step", F.lit(interval)) == 0)
    rows = rows.withColumn("_mean", F.when(complete, F.sum("train_loss").over(whole) / interval))

    def last(column: str):
        return F.max_by(column, F.when(F.col(column).isNotNull(), F.col("step")))

    ends = rows.groupBy("run_id", "_block").agg(
        last("_mean").alias("_mean_end"), last("val_loss").alias("_val_end"),
    )
    earlier = Window.partitionBy("run_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        "run_id", "_block", F.last("_mean_end", True).over(earlier).alias("_mean_in"),
        F.last("_val_end", True).over(earlier).alias("_val_in"),
    )
    upto = Window.partitionBy("run_id", "_block").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carried, ["run_id", "_block"]).select(
        "run_id", "step",
        F.coalesce(F.last("_mean", True).over(upto), "_mean_in").alias("latest_avg_loss"),
        F.coalesce(F.last("val_loss", True).over(upto), "_val_in").alias("latest_val_loss"),
    )


def run_bounds(metrics: DataFrame) -> DataFrame:
    """First and last record of every run."""
    columns = [c for c in metrics.columns if c not in ("run_id", "step")]
    return metrics.groupBy("run_id").agg(
        F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        *(F.min_by(c, "step").alias(f"first_{c}") for c in columns),
        *(F.max_by(c, "step").alias(f"last_{c}") for c in columns),
    )


def validation_curve(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("val_loss").isNotNull()).select("run_id", "step", "val_loss")


def eval_mean(losses: DataFrame, eval_steps: int) -> DataFrame:
    """Mean loss over the first ``eval_steps`` ordinals of each run."""
    if eval_steps < 1:
        raise ValueError("eval_steps must be at least 1")
    first = losses.filter((F.col("ordinal") >= 0) & (F.col("ordinal") < eval_steps))
    return first.groupBy("run_id").agg(F.avg("loss").alias("mean_loss"), F.count("loss").alias("batches"))


def update_loss_mean(losses: DataFrame, accumulation_steps: int) -> DataFrame:
    """Mean loss of the microbatches of each update; incomplete updates are left out."""
    step = F.call_function("div", F.col("ordinal"), F.lit(accumulation_steps)) + 1
    grouped = losses.groupBy("run_id", step.alias("update_step"))
    means = grouped.agg(F.avg("loss").alias("mean_loss"), F.count("*").alias("micro_steps"))
    return means.filter(F.col("micro_steps") == accumulation_steps).drop("micro_steps")


def align_schedule(
    metrics: DataFrame, accumulation_steps: int, batch_size: int, sequence_length: int, updates: DataFrame | None = None, **schedule
) -> DataFrame:
    """Every record with ``planned_rate`` and ``planned_tokens`` of its step, and how far the logged values are from them:
    ``rate_drift``, ``token_drift`` (null where nothing was logged).

    With ``updates`` (``update_step, tokens, micro_steps, learning_rate``, one row each) the plan is that of the update, which is
    joined, and its ``micro_steps`` are told; they are null for a record beyond the last update, which keeps the schedule's values.
    """
    step = F.col("step")
    rate = learning_rate(step, **schedule)
    tokens = tokens_seen(step, accumulation_steps, batch_size, sequence_length)
    if updates is not None:
        planned = updates.select(F.col("update_step").alias("step"), F.col("tokens").alias("_tokens"), F.col("learning_rate").alias("_rate"), "micro_steps")
        metrics = metrics.join(planned, "step", "left")
        rate, tokens = F.coalesce("_rate", rate), F.coalesce("_tokens", tokens)
    aligned = metrics.withColumns({
        "planned_rate": rate, "planned_tokens": tokens, "rate_drift": F.col("learning_rate") - rate, "token_drift": F.col("tokens") - tokens,
    })
    return aligned if updates is None else aligned.drop("_tokens", "_rate")
