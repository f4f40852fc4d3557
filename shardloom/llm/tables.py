"""Small parts shared by the operators: input columns, stored intermediate tables, sketches, components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.session import bound_batches, freed_shuffles, release_memory, scratch, ship_code, shared_folder
from shardloom.sources.files import DriverFiles


#: Least and most bits of a :class:`BitMap`, as powers of two: 16 MB at most.
MAP_BITS = 16, 27


def load(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return rows.select(*columns) if columns else rows


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, or one with more underscores, that no column of ``rows`` has."""
    taken = {c.lower() for c in rows.columns}
    while name in taken:
        name = "_" + name
    return name


def stored(rows: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back: lineage ends here, and the rows are computed once. Shuffle files go at once."""
    spark = rows.sparkSession
    path = scratch(spark, label)
    with freed_shuffles(spark):
        rows.write.parquet(path)
    found = spark.read.schema(rows.schema).parquet(path)
    found.stored_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads, nor what a step has returned. Tables from elsewhere are left alone."""
    for table in tables:
        path = getattr(table, "stored_at", None)
        if path is not None:
            DriverFiles(table.sparkSession, path).remove()


def map_arrow(rows: DataFrame, task: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose code travels with the plan, in batches bounded by bytes: long texts make short batches."""
    spark = rows.sparkSession
    shared_folder(spark)
    bound_batches(spark)
    ship_code()

    def released(batches):
        try:
            yield from task(batches)
        finally:
            release_memory()

    return rows.mapInArrow(released, schema)


def shuffle_partitions(rows: DataFrame, factor: float = 1.0) -> int:
    """Partitions for a shuffle of ``factor`` times the input: the session's setting, or the number of
    input splits times ``factor`` where that is more."""
    splits = rows.rdd.getNumPartitions()
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(splits * factor))


def components(edges: DataFrame, left: str = "a", right: str = "b", limit: int = 60) -> DataFrame:
    """Connected components of an undirected graph: ``node``, ``root`` (its smallest node), for every node
    of an edge. Each round lets larger neighbours point at the smallest one, then smaller ones (large-star,
    small-star), so long chains shrink by halves; hubs are never collected. Each round's edges are stored.
    """
    now = stored(edges.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b")).where("a <> b").distinct(), "edges")

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else pairs
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        joined = both.join(lowest, "a")
        kept = joined.where("b > a").select(F.col("b").alias("x"), "m") if large else joined.select(F.col("b").alias("x"), "m").unionAll(lowest.select(F.col("a").alias("x"), "m"))
        return kept.where("x <> m").select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()

    state = None
    for _ in range(limit):
        before, now = now, stored(star(star(now, True), False), "edges")
        discard(before)
        last, state = state, now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {limit} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())


class BitMap:
    """A Bloom filter, two bits a value, of ``2**bits`` bits. What it lets through by chance costs work, never a result."""

    def __init__(self, data: np.ndarray, bits: int):
        self.data, self.bits = data, bits

    def holds(self, values: np.ndarray) -> np.ndarray:
        values, low = values.view(np.uint64), np.uint64((1 << self.bits) - 1)
        out = self._bit(values & low)
        out[out] = self._bit((values[out] >> np.uint64(self.bits)) & low)
        return out

    def _bit(self, at: np.ndarray) -> np.ndarray:
        at = at.astype(np.int64)
        return (self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bit_map(values: DataFrame) -> BitMap:
    """The column ``h`` of ``values`` as a filter of 16 bits a value; above eight million values it stays at 16 MB and lets
    more through. ``values`` are counted first, so they should be stored."""
    bits = min(max((16 * values.count()).bit_length(), MAP_BITS[0]), MAP_BITS[1])
    mask = (1 << bits) - 1
    places = values.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", bits).bitwiseAND(mask))).alias("bit"))
    at = F.col("bit") + 1
    parts = places.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("data"))
    out = np.zeros(1 << (bits - 3), np.uint8)
    for row in parts.toLocalIterator():
        out[(row.part - 1) << 12 : row.part << 12] = np.frombuffer(row.data, np.uint8)
    return BitMap(out, bits)


def planes(numbers: np.ndarray) -> bytes:
    """Byte planes: first the lowest bytes of all numbers, then the next ones. High planes are mostly zero."""
    return np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), -1).T).tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    width = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(dtype).ravel()
