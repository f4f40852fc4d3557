"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors belong to the nearest of a few centroids; what is left over is normalised, rotated at random and kept
as one bit a dimension, with two scalars: its length, and how well the code stands for it. From packed
bits these give an unbiased estimate of a query's inner product with a vector, and a bound on its error.
For each query a vector is measured exactly only if its least possible distance is within the ``k``-th smallest of the
largest possible ones. Lists of vectors are cut into blocks of bounded size; queries stream past each block.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.tables import load, map_arrow, stored

#: Centroids are fitted on about ``SAMPLE`` vectors at most, chosen by hash; every vector is indexed.
SAMPLE, MOST_LISTS, BLOCK_ROWS, QUERY_CHUNK = 8192, 256, 4096, 64
#: Share of the lists that a query looks into, nearest first.
PROBED = 0.8
#: Width of the error bound, in standard deviations of the estimate.
ERROR_WIDTH = 3.0
_QUERY_BITS = 8


def usable(vector) -> F.Column:
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced rows; a centroid without vectors stays where it is."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        near = nearest_lists(sample, centres, 1)[:, 0]
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        counts = np.bincount(near, minlength=lists)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def nearest_lists(vectors: np.ndarray, centres: np.ndarray, count: int) -> np.ndarray:
    far = (centres**2).sum(1) - 2 * vectors @ centres.T
    return np.argsort(far, axis=1, kind="stable")[:, :count]


def encode(residuals: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits (64-bit words), lengths, and the inner product of each unit vector with its code."""
    d = residuals.shape[1]
    norm = np.linalg.norm(residuals, axis=1)
    unit = residuals / np.where(norm > 0, norm, 1)[:, None] @ rotation
    bits = unit > 0
    fit = np.abs(unit).sum(1) / math.sqrt(d)
    words = np.zeros((len(bits), -(-d // 64) * 64), bool)
    words[:, :d] = bits
    return np.packbits(words, axis=1, bitorder="little").view(np.uint64), norm, np.where(norm > 0, fit, 1.0)


def distance_bounds(queries: np.ndarray, codes: np.ndarray, norm: np.ndarray, fit: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest squared distance of each query's residual (rows) to each coded vector (columns)."""
    d = queries.shape[1]
    turned = queries @ rotation
    low = turned.min(1, keepdims=True)
    step = np.maximum(turned.max(1, keepdims=True) - low, 1e-12) / ((1 << _QUERY_BITS) - 1)
    levels = np.rint((turned - low) / step).astype(np.uint16)
    # Whole numbers: sums of 2**(24 - _QUERY_BITS) levels are exact in single precision.
    kind = np.float32 if d <= 1 << (24 - _QUERY_BITS) else np.float64
    dot = (levels.astype(kind) @ np.unpackbits(codes.view(np.uint8), axis=1, count=d, bitorder="little").astype(kind).T).astype(np.float64)
    ones = np.bitwise_count(codes).sum(1, dtype=np.int64)
    # <bits, query> from the levels, then of the code's +-1 / sqrt(d) entries.
    bits_dot = step * dot + low * ones
    code_dot = (2 * bits_dot - turned.sum(1, keepdims=True)) / math.sqrt(d)
    length = np.linalg.norm(queries, axis=1, keepdims=True)
    estimate = code_dot / fit
    spread = np.sqrt(np.maximum(1 - fit**2, 0)) / fit * ERROR_WIDTH / math.sqrt(max(d - 1, 1)) * length
    spread = spread + step * math.sqrt(d) / 2 / fit  # rounding of the query, at most
    base = norm**2 + length**2
    return base - 2 * norm * (estimate + spread) - 1e-9 * base, base - 2 * norm * (estimate - spread) + 1e-9 * base


def search_block(ids, vectors, codes, norm, fit, centre, rotation, query_ids, queries, k: int):
    """``query, id, distance`` of each query's ``k`` nearest in a block, itself aside, ties to smaller ids."""
    low, high = distance_bounds(queries - centre, codes, norm, fit, rotation)
    own = query_ids[:, None] == ids[None]
    high[own] = np.inf
    kth = np.partition(high, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(queries), np.inf)
    row, column = np.nonzero((low <= kth[:, None]) & ~own)
    out = np.empty(len(row))
    for i in range(0, len(row), 1 << 14):
        part = slice(i, i + (1 << 14))
        out[part] = np.sqrt(((vectors[column[part]] - queries[row[part]]) ** 2).sum(1))
    order = np.lexsort((ids[column], out, row))
    row, column, out = row[order], column[order], out[order]
    first = np.searchsorted(row, row)
    keep = np.arange(len(row)) - first < k
    return query_ids[row[keep]], ids[column[keep]], out[keep]


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, key: str = "vec_id", vector: str = "embedding", probed: float = PROBED) -> DataFrame:
    """Per row of ``queries`` its ``k`` nearest rows found (all, if fewer): ``query_id, rank, vec_id, score``, the Euclidean distance
    in double precision on the original vectors; ties go to the smaller key, rows of the query's own key take no part.

    Null keys and vectors that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of
    another dimension than most have (the smaller one of equally many). Rows that repeat key and vector count once.
    """
    good = lambda df: df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    base, asked = good(rows), good(queries)
    sizes = base.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "query_id bigint, rank int, vec_id bigint, score double"
    spark = rows.sparkSession
    if sizes is None:
        return spark.createDataFrame([], result)
    d, total = sizes["d"], sizes["count"]
    base, asked = base.where(F.size("v") == d), asked.where(F.size("v") == d)
    one_in = max(1, math.ceil(total / SAMPLE))
    sample = base.where(F.pmod(F.xxhash64("id"), F.lit(one_in)) == 0).orderBy("id").limit(4 * SAMPLE)
    taken = sample.toArrow().column("v").combine_chunks()
    taken = _matrix(taken) if len(taken) else _matrix(base.limit(1).toArrow().column("v").combine_chunks())
    lists = max(1, min(MOST_LISTS, math.isqrt(total), len(taken)))
    centres = fit_centroids(taken, lists)
    rotation = np.linalg.qr(np.random.default_rng(7).standard_normal((d, d)))[0]
    model = spark.sparkContext.broadcast((centres, rotation))

    def index(batches):
        centres, rotation = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column(1))
            near = nearest_lists(v, centres, 1)[:, 0]
            codes, norm, fit = encode(v - centres[near], rotation)
            raw, wide = codes.tobytes(), codes.shape[1] * 8
            yield pa.RecordBatch.from_pydict({
                "list": pa.array(near, pa.int32()), "id": batch.column(0), "v": batch.column(1),
                "code": [raw[i * wide : (i + 1) * wide] for i in range(len(v))], "norm": norm, "fit": fit,
            })

    coded = stored(map_arrow(base.distinct(), index, "list int, id bigint, v array<double>, code binary, norm double, fit double"), "codes")
    blocks = coded.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))

    def probe(batches):
        centres, _ = model.value
        count = max(1, math.ceil(probed * len(centres)))
        for batch in batches:
            if batch.num_rows:
                near = nearest_lists(_matrix(batch.column(1)), centres, count)
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0), "v": batch.column(1),
                    "lists": pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32())),
                })

    where = map_arrow(asked.distinct(), probe, "id bigint, v array<double>, lists array<int>")
    where = where.select("id", "v", F.explode("lists").alias("list")).join(blocks, "list")
    null = lambda kind: F.lit(None).cast(kind)
    sides = coded.join(blocks, "list").select(
        "list", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("side"), "id", "v", "code", "norm", "fit",
    ).unionAll(where.select(
        "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("side"), "id", "v",
        null("binary").alias("code"), null("double").alias("norm"), null("double").alias("fit"),
    ))

    def search(batches):
        centres, rotation = model.value
        at, held, ready = None, [], None
        for batch in batches:
            owner = np.stack([batch.column(i).to_numpy() for i in range(3)], 1)
            cuts = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]).any(1)]) if len(owner) else []
            for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True):
                part, place = batch.slice(a, b - a), tuple(owner[a][:2])
                if place != at:
                    at, held, ready = place, [], None
                if owner[a][2] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ready is None:
                    table = pa.Table.from_batches(held).combine_chunks()
                    column = lambda n: table.column(n).chunk(0)  # noqa: E731, B023
                    codes = np.frombuffer(b"".join(column("code").to_pylist()), np.uint64).reshape(table.num_rows, -1)
                    ready = column("id").to_numpy(), _matrix(column("v")), codes, column("norm").to_numpy(), column("fit").to_numpy()
                ids, v = part.column(3).to_numpy(), _matrix(part.column(4))
                for i in range(0, len(ids), QUERY_CHUNK):
                    found = search_block(*ready, centres[place[0]], rotation, ids[i : i + QUERY_CHUNK], v[i : i + QUERY_CHUNK], k)
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    placed = sides.repartition("list", "block").sortWithinPartitions("list", "block", "side")
    found = map_arrow(placed, search, "query_id bigint, vec_id bigint, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0))
