"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

For every shard a record's key gives a pseudo-random number ``u`` in (0, 1); the shard with the smallest
``-ln(u) / weight`` takes it, which happens in proportion to the weights. A record's numbers for old shards do not
change when one is added, so records move into the new shard only. Slots number a shard's records without gaps:
records are cut into blocks by hash, block totals are summed, and only a block is ever sorted as a whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.tables import load

SHARDS, BLOCK_ROWS = 24, 50_000


def shard_cost(key: Column, shard: int, weight: float = 1.0) -> Column:
    # Python's % keeps the seed a plain literal; 53 bits make an exact double.
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + 0.5) / float(1 << 53)
    return -F.log(u) / weight


def rendezvous(key: Column, weights: list[float]) -> Column:
    """``struct<cost, shard>`` of the shard that takes the key; equal costs go to the smaller number."""
    costs = [F.struct(shard_cost(key, i, w).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return F.array_min(F.array(*costs))


def assign_shards(docs: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, new_weight: float = 1.0) -> DataFrame:
    """Per row: ``key``, ``size`` (UTF-8 bytes of the text and 8), ``text_crc32``, ``law`` ("key"), ``shard``, ``slot`` (from 0, without
    gaps in each shard) and ``grown_shard``, where the record goes if a shard of ``new_weight`` is added.

    Only the key decides. Null texts count as empty. Null keys are one key. Rows that repeat a key share its shard and have
    slots of their own; slots of identical rows are interchangeable. Other columns are not read.
    """
    weights = weights or [1.0] * SHARDS
    id_ = F.col(key)
    blocks = max(1, math.ceil(docs.count() / (len(weights) * BLOCK_ROWS)))
    best = rendezvous(id_, weights)
    block = F.pmod(F.xxhash64(id_, F.lit("slot")), F.lit(blocks)).cast("int")
    text_bytes = F.coalesce(F.col(text), F.lit("")).cast("binary")
    placed = docs.select(
        id_, (F.octet_length(text_bytes) + F.lit(8).cast("bigint")).alias("size"), F.crc32(text_bytes).alias("text_crc32"),
        best.alias("_best"), block.alias("_block"),
    ).select(
        key, "size", "text_crc32", F.col("_best.shard").alias("shard"), "_block",
        F.when(shard_cost(id_, len(weights), new_weight) < F.col("_best.cost"), F.lit(len(weights))).otherwise(F.col("_best.shard")).alias("grown_shard"),
    )
    # Only the key is read for the totals; a block may be one of many of its shard.
    totals = docs.select(best.getField("shard").alias("shard"), block.alias("_block")).groupBy("shard", "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("shard", "_block").orderBy(id_, "size", "text_crc32")
    return placed.join(bases, ["shard", "_block"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"),
        (F.col("_base") + F.row_number().over(inside) - 1).cast("bigint").alias("slot"), F.col("grown_shard").cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(load(spark, sf_dir, "documents", "doc_id", "text"))
