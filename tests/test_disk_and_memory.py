"""What jobs shuffle, and how many rows are held together."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shardloom.functions.tokenizers import ByteTokenizer
from shardloom.llm import nearest
from shardloom.operators import checks
from shardloom.streaming import prepare


def compared(spark, left, right, schema="a bigint, b string, c double"):
    return tuple(checks.equality(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).first())


def test_equality_counts_what_differs(spark):
    rows = [(i, str(i % 7), i / 3) for i in range(3000)]
    assert compared(spark, rows, rows[::-1]) == (3000, 3000, 0)
    assert compared(spark, rows, rows[1:]) == (3000, 2999, 1)
    assert compared(spark, [*rows, rows[5]], [*rows, rows[6]]) == (3001, 3001, 2)
    assert compared(spark, rows, []) == (3000, 0, 3000)
    assert compared(spark, [], []) == (0, 0, 0)
    assert compared(spark, [(None, "1", 0.0)], [(1, None, 0.0)]) == (1, 1, 2)
    assert compared(spark, [(1, None, -0.0), (2, "x", float("nan"))], [(1, None, 0.0), (2, "x", float("nan"))]) == (2, 2, 0)
    assert compared(spark, [([None, 1],)], [([1, None],)], "a array<int>") == (1, 1, 2)


def test_equal_sides_shuffle_no_rows(spark):
    rows = spark.range(50_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    plan = checks.equality(rows, rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan and "Range" not in plan
    assert tuple(checks.equality(rows, rows).first()) == (50_000, 50_000, 0)


def test_packed_streams_have_small_groups_of_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(prepare, "ROW_GROUP_BYTES", 1 << 16, raising=False)
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat(sha2(cast(id as string), 512), 40)").alias("text"))
    texts.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = prepare.document_stream(spark, str(tmp_path / "in"))
    prepare.prepare_stream(stream, str(tmp_path / "out"), ByteTokenizer(), 100).awaitTermination()
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "out" / "packed").rglob("*.parquet")]
    assert max(f.num_row_groups for f in files) > 1
    assert sum(r.token_count for r in prepare.streamed_shards(spark, str(tmp_path / "out")).select("token_count").collect()) == 400 * 5121


@pytest.mark.parametrize("d", [3, 64, 101])
def test_bounds_are_those_of_bit_planes_and_make_no_planes(d, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(d)
    rows, asked = rng.standard_normal((200, d)), rng.standard_normal((20, d))
    rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
    codes, norm, fit = nearest.encode(rows, rotation)
    sizes = []
    count = np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda x: sizes.append(x.size) or count(x))
    low, high = nearest.distance_bounds(asked, codes, norm, fit, rotation)
    assert max(sizes) <= codes.size  # once gave words of all pairs, for each of eight planes
    exact = ((asked[:, None] - rows[None]) ** 2).sum(2)
    assert (low <= high).all() and ((low <= exact) & (exact <= high)).mean() > 0.95
