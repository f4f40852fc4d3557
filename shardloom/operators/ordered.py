"""Ordered computations that never put a whole group into one task.

A running sum over ``Window.partitionBy(split)`` would send nearly the whole corpus to one task.
Here rows are cut into blocks of consecutive keys. Totals per block are small; their own running
sum is taken the same way, one level up, until few entries are left. Every window then covers one
block, whatever share of the rows its group holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardloom.functions.checks import required
from shardloom.session import shared_folder

# Keys per block, and blocks per superblock, as powers of two. Two levels of blocks cover every 64-bit key.
BLOCK_BITS = 16
SUPER_BITS = 24


def key_block(key: Column) -> Column:
    """Block of an integer key. Keys are unique, so a block holds at most ``2**BLOCK_BITS`` rows of a group."""
    return F.shiftright(required(key.cast("bigint"), "order key is null", 0), BLOCK_BITS)


def range_blocks(rows: DataFrame, keys: Sequence[str], block: str = "block", partitions: int | None = None) -> DataFrame:
    """Blocks for keys of any type: range-partition by them and number the partitions.

    The key as a whole must be (nearly) unique; then a hot leading column is spread over many
    partitions. Range bounds are sampled, so the numbering is stored before use: computed again
    after a lost executor it might differ. Without ``partitions`` Spark sizes them by bytes.
    """
    shared_folder(rows.sparkSession)
    ranged = rows.repartitionByRange(*keys) if partitions is None else rows.repartitionByRange(partitions, *keys)
    return ranged.withColumn(block, F.coalesce(F.spark_partition_id().cast("bigint"), F.lit(0))).checkpoint()


def block_bases(totals: DataFrame, group: Sequence[str], block: str, sums: Sequence[str]) -> DataFrame:
    """Per group and block, from block totals: the sum over earlier blocks as ``<name>_base`` and over
    all blocks as ``<name>_all``.

    Blocks are cut into superblocks, so no window covers more than ``2**SUPER_BITS`` totals, whatever the keys.
    """
    zero = F.lit(0).cast("bigint")

    def earlier(*keys: str, order: str) -> dict[str, Column]:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return {c: F.coalesce(F.sum(c).over(before), zero) for c in sums}

    upper = totals.withColumn("_super", F.coalesce(F.shiftright(block, SUPER_BITS), zero))
    whole = Window.partitionBy(*group).orderBy("_super").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tops = upper.groupBy(*group, "_super").agg(*(F.sum(c).alias(c) for c in sums))
    tops = tops.select(
        *group, "_super",
        *(total.alias(f"_{c}_top") for c, total in earlier(*group, order="_super").items()),
        *(F.sum(c).over(whole).alias(f"{c}_all") for c in sums),
    )
    inside = earlier(*group, "_super", order=block).items()
    inner = upper.select(*group, "_super", block, *(total.alias(f"_{c}_in") for c, total in inside))
    return inner.join(tops, [*group, "_super"]).select(
        *group, block,
        *((F.col(f"_{c}_top") + F.col(f"_{c}_in")).alias(f"{c}_base") for c in sums),
        *(f"{c}_all" for c in sums),
    )


def running_sums(
    rows: DataFrame,
    group: Sequence[str],
    block: str,
    order: Sequence[str],
    sums: dict[str, str],
    whole: dict[str, str] | None = None,
) -> DataFrame:
    """Add, for each ``out: column`` in ``sums``, the sum of ``column`` over all earlier rows of the group,
    and for each in ``whole`` (columns of ``sums`` only) the sum over the whole group.

    Both passes read one exchange, so the input is computed once. Two things let Spark see that they
    can share it: the totals refer to every column, or pruning would narrow one copy (so keep ``rows``
    narrow), and group and block are declared non-null, or the join would filter one copy for nulls.
    Two rows of a group with one order key raise an error: their order would be arbitrary.
    """
    columns = list(dict.fromkeys(sums.values()))
    rows = rows.repartition(*group, block)
    totals = rows.groupBy(*group, block).agg(
        *(F.sum(c).alias(c) for c in columns), F.bit_xor(F.xxhash64(*rows.columns)).alias("_all")
    ).filter("_all IS NOT NULL")
    bases = block_bases(totals.drop("_all"), group, block, columns)
    return within_blocks(rows.join(bases, [*group, block]), group, block, order, sums, whole)


def within_blocks(
    based: DataFrame,
    group: Sequence[str],
    block: str,
    order: Sequence[str],
    sums: dict[str, str],
    whole: dict[str, str] | None = None,
) -> DataFrame:
    """Second half of :func:`running_sums`, for rows joined with the bases of their block."""
    inside = Window.partitionBy(*group, block).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    columns = set(sums.values())
    kept = [c for c in based.columns if c not in {f"{c}{end}" for c in columns for end in ("_base", "_all")}]
    added = {out: F.col(f"{c}_base") + F.coalesce(F.sum(c).over(before), F.lit(0)) for out, c in sums.items()}
    key = F.struct(*order)
    twice = F.lag(key).over(inside).eqNullSafe(key) & (F.row_number().over(inside) > 1)
    message = F.concat(F.lit("duplicate order key "), F.to_json(key))
    return based.select(
        *kept,
        *(F.when(~twice, total).otherwise(F.raise_error(message)).cast("bigint").alias(out) for out, total in added.items()),
        *(F.col(f"{c}_all").alias(out) for out, c in (whole or {}).items()),
    )
