"""Learning-rate schedule, cadence and token counters as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def learning_rate(
    step: Column, max_lr: float = 3e-4, min_lr: float = 3e-5, warmup_steps: int = 100, total_steps: int = 1120
) -> Column:
    """Linear warmup to ``max_lr``, cosine decay to ``min_lr``, then constant: a fixed formula, which logged rates must meet."""
    if not 0 < min_lr <= max_lr:
        raise ValueError("min_lr must lie in (0, max_lr]")
    if not 0 < warmup_steps < total_steps:
        raise ValueError("warmup_steps must lie in (0, total_steps)")
    done = (step - warmup_steps).cast("double") / float(total_steps - warmup_steps)
    cosine = (F.cos(done * math.pi) + 1.0) * 0.5
    return (
        F.when(step <= warmup_steps, step.cast("double") * (max_lr / warmup_steps))
        .when(step >= total_steps, F.lit(float(min_lr)))
        .otherwise(cosine * (max_lr - min_lr) + min_lr)
    )


def due(step: Column, interval: int, last_step: int | None = None) -> Column:
    """Whether something done every ``interval`` steps (and at ``last_step``) is due at this step."""
    if interval < 1:
        raise ValueError("interval must be at least 1")
    hit = F.pmod(step, F.lit(interval)) == 0
    return hit if last_step is None else hit | (step == last_step)


def tokens_seen(step: Column, accumulation_steps: int, batch_size: int, sequence_length: int) -> Column:
    return step.cast("bigint") * (accumulation_steps * batch_size * sequence_length)
