"""What keeps plans, reads and batches bounded: how much is looked up, listed and held at once."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shardloom import ByteTokenizer, session
from shardloom.functions.shuffle import permuted, place_column, round_keys
from shardloom.operators.offsets import tokenize
from shardloom.operators.packing import pack_documents
from shardloom.plans import epochs
from shardloom.plans.epochs import EpochOrder, batch_ordinals, epoch_plan, shard_layout, total_plan
from shardloom.sources.tokenshard import BatchReader


def test_places_of_whole_batches(spark):
    rows = [(x, n, e) for n in (1, 5, 97) for e in (0, 3) for x in range(n)] + [(None, 5, 0)]
    frame = spark.createDataFrame(rows, "x bigint, n bigint, epoch int").coalesce(1)
    got = frame.select("x", "n", "epoch", place_column(F.col("x"), F.col("n"), 10, F.col("epoch")).alias("p")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.p == (None if r.x is None else int(permuted(np.array([r.x]), r.n, round_keys(10, r.epoch))[0]))


def test_plans_interpret_no_rounds(spark):
    totals = spark.createDataFrame([("train", 1_000), ("val", 30)], "split string, tokens bigint")
    for plan in (total_plan(totals, 10, 1, 4, epochs=2), epoch_plan(shard_layout(totals, 10), 1, 4, epochs=2)):
        told = plan._jdf.queryExecution().optimizedPlan().toString()
        assert "aggregate(" not in told and "ArrowEvalPython" in told


def test_a_plan_of_many_shards_is_not_one_task(spark):
    totals = spark.createDataFrame([("train", 40_000 * 10)], "split string, tokens bigint")
    plan = total_plan(totals, 10, 1, 4, epochs=2)
    assert batch_ordinals(plan, 1, 4).select(F.spark_partition_id()).distinct().count() > 1
    assert plan.select("epoch", "position").distinct().count() == 80_000


def test_a_short_read_looks_up_few_shards(monkeypatch):
    order, asked = EpochOrder("train", 100_000, 1_000, 100_000_000, 1, 10, seed=3), []
    monkeypatch.setattr(epochs, "permuted", lambda x, *a, **b: asked.append(np.size(x)) or permuted(x, *a, **b))
    pieces = list(order.segments(500, 500 + 990))
    assert sum(p[-1] for p in pieces) == 990 and max(asked) < 20


def test_long_reads_have_few_tasks():
    def draws(until, **more):
        return BatchReader({"path": "/none", "batchsize": 4, "sequencelength": 128, "untilordinal": until} | more).partitions()

    assert len(draws(5_000_000)) <= 1_000 and len(draws(5_000)) == 5 and len(draws(100, batchespertask=7)) == 15
    for until in (1, 5_000, 5_000_001):
        cut = draws(until)
        assert cut[0].low == 0 and cut[-1].high == until and all(a.high == b.low for a, b in zip(cut, cut[1:], strict=False))


def test_batches_of_shards_and_texts_are_bounded_by_bytes(spark):
    """Rows of 100,000 tokens: ten thousand of them must not come in one batch."""
    spark.conf.unset(session._BATCH_BYTES)
    texts = spark.range(400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 99_999).alias("text")).coalesce(1)
    tokens = tokenize(texts, ByteTokenizer())
    assert int(spark.conf.get(session._BATCH_BYTES)) <= session.BATCH_BYTES
    held = tokens.mapInArrow(lambda batches: (pa.record_batch([pa.array([b.nbytes])], ["n"]) for b in batches), "n bigint").agg(F.max("n")).first()[0]
    assert held < 4 * session.BATCH_BYTES
    spark.conf.unset(session._BATCH_BYTES)
    pack_documents(texts, ByteTokenizer(), 100_000)
    assert int(spark.conf.get(session._BATCH_BYTES)) <= session.BATCH_BYTES


def test_slabs_of_the_bpe_report_do_not_change_it(spark):
    bpe = pytest.importorskip("shardloom.llm.bpe")
    texts = spark.createDataFrame([(i, None if i % 50 == 7 else f"word{i % 13} and more, " * (i % 9)) for i in range(200)], "doc_id bigint, text string")
    whole, cut = (sorted(bpe.token_report(texts, keep_ids=True, slab=s).collect(), key=lambda r: r.doc_id) for s in (bpe.SLAB, 100))
    assert whole == cut and len(cut) == 200
