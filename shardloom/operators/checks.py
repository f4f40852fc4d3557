"""Invariants of a data set, as joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from shardloom.functions.names import header_checks

#: Parts of all rows that :func:`equality` compares by sums first, as a power of two.
PART_BITS = 10
_LOW = (1 << 32) - 1


def missing_shards(saved: DataFrame, found: DataFrame) -> DataFrame:
    """Shard names of a saved state without a shard."""
    return saved.join(found, "shard_name", "left_anti")


def split_leakage(documents: DataFrame, text: str = "text") -> DataFrame:
    """Distinct texts per split and how many lie in both (none, as the split depends on the text only).

    Hashes rather than texts travel, in one shuffle; copies of a text are merged before it.
    """
    train = F.col("split") == "train"
    held = documents.groupBy(F.sha2(text, 256)).agg(F.max(train).alias("train"), F.max(~train).alias("val"))

    def texts(which, name: str):
        return F.count(F.when(which, 1)).alias(name)

    in_train, in_val = F.col("train"), F.col("val")
    return held.agg(texts(in_train, "train_texts"), texts(in_val, "val_texts"), texts(in_train & in_val, "shared_texts"))


def _sides(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.withColumn("_left", F.lit(1)).unionAll(right.select(*left.columns).withColumn("_left", F.lit(0)))


def _signed(both: DataFrame) -> DataFrame:
    columns = [c for c in both.columns if c != "_left"]
    return both.groupBy(*columns).agg(F.sum("_left").alias("_left"), F.count("*").alias("_all"))


def difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that do not occur equally often on both sides, with ``surplus``: how much more often on the left.

    Empty if both are equal. One shuffle, in which equal rows have been merged.
    """
    surplus = (F.col("_left") * 2 - F.col("_all")).alias("surplus")
    return _signed(_sides(left, right)).select(*left.columns, surplus).filter(F.col("surplus") != 0)


def equality(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows each side was found to have, and how many differ in how often they occur.

    Rows fall into parts by a hash. At once each side's rows of each part are counted, and 128 bits of hashes of every row summed;
    only rows of parts whose counts or sums differ are shuffled, to be compared one by one, and only they are computed
    again. Rows with arrays, maps or structs are all compared one by one: a hash passes over nulls inside them.
    """
    both = _sides(left, right)
    if not all(isinstance(f.dataType, AtomicType) for f in both.schema):
        return _signed(both).agg(
            F.coalesce(F.sum("_left"), F.lit(0)).alias("left_rows"), F.coalesce(F.sum(F.col("_all") - F.col("_left")), F.lit(0)).alias("right_rows"),
            F.count(F.when(F.col("_left") * 2 != F.col("_all"), 1)).alias("differing_rows"),
        )
    values = [v for c in left.columns for v in (F.col(c), F.col(c).isNull())]
    one, two = F.xxhash64(*values), F.xxhash64(F.lit(1), *values)
    part, sign = one.bitwiseAND(F.lit((1 << PART_BITS) - 1)), F.col("_left") * 2 - 1
    halves = [half for h in (one, two) for half in (h.bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(h, 32))]
    sums = both.groupBy(part.alias("part")).agg(
        F.sum("_left").alias("left"), F.sum(1 - F.col("_left")).alias("right"), *(F.sum(sign * half).alias(f"sum{i}") for i, half in enumerate(halves))
    ).collect()
    unequal = [r.part for r in sums if r.left != r.right or any(r[3:])]
    return _signed(both.where(part.isin(unequal) if unequal else F.lit(False))).agg(
        F.lit(sum(r.left for r in sums)).cast("bigint").alias("left_rows"), F.lit(sum(r.right for r in sums)).cast("bigint").alias("right_rows"),
        F.count(F.when(F.col("_left") * 2 != F.col("_all"), 1)).alias("differing_rows"),
    )


def shard_validity(headers: DataFrame) -> DataFrame:
    """``valid`` and the rules behind it, for a header scan."""
    checks = header_checks(F.col("magic"), F.col("version"), F.col("token_count"), F.col("length"))
    valid = F.lit(True)
    for check in checks.values():
        valid = valid & check
    return headers.withColumns({**checks, "valid": valid})
