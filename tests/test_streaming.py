import json

import pytest

from shardloom import ByteTokenizer, BpeTokenizer, epoch_plan, batches, pack_documents, prepare_dataset, read_batches
from shardloom.operators.checks import difference
from shardloom.sources.shards import read_shards, write_shards
from shardloom.sources.tokenshard import BatchStreamReader
from shardloom.streaming.batches import batch_stream, draw_to_table
from shardloom.streaming.prepare import (
    document_stream, pack_micro_batch, position_of, prepare_stream, streamed_shards,
)

BYTES = ByteTokenizer()


def documents(spark, low=0, high=240):
    rows = [(i, f"document {i} " + "lorem ipsum " * (i % 7)) for i in range(low, high)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def arrive(spark, folder, low, high):
    documents(spark, low, high).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize("targets", [None, {"train": 4000, "val": 150}])
def test_stream_equals_batch(spark, tmp_path, targets):
    incoming, root = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 60), (60, 61), (61, 200), (200, 240)):
        arrive(spark, incoming, low, high)
        prepare_stream(document_stream(spark, incoming), root, BYTES, 128, targets).awaitTermination()
    whole = pack_documents(documents(spark), BYTES, 128, targets=targets)
    assert difference(whole, streamed_shards(spark, root)).count() == 0
    closed = streamed_shards(spark, root, include_open=False)
    assert closed.filter("token_count <> 128").count() == 0


def test_several_micro_batches_in_one_run(spark, tmp_path):
    incoming, root = str(tmp_path / "in"), str(tmp_path / "out")
    for low in range(0, 240, 80):
        arrive(spark, incoming, low, low + 80)
    bpe = BpeTokenizer(spark, {bytes([i]): i for i in range(256)})
    prepare_stream(document_stream(spark, incoming, 1), root, bpe, 100).awaitTermination()
    assert position_of(spark, root)["batch"] == 2
    assert difference(pack_documents(documents(spark), BYTES, 100), streamed_shards(spark, root)).count() == 0


def test_repeated_micro_batches_change_nothing(spark, tmp_path):
    root = str(tmp_path / "out")

    def run(batch, low, high):
        pack_micro_batch(documents(spark, low, high), batch, root, BYTES, 64, None, "doc_id", "text")

    run(0, 0, 50)
    run(0, 0, 50)
    before = (tmp_path / "out" / "position.json").read_text()
    run(1, 50, 90)
    # Killed after the shards of batch 1 were written, before its position was: it runs again.
    (tmp_path / "out" / "position.json").write_text(before)
    (tmp_path / "out" / ".position.json.crc").unlink(missing_ok=True)
    assert difference(pack_documents(documents(spark, 0, 50), BYTES, 64), streamed_shards(spark, root)).count() == 0
    run(1, 50, 90)
    assert difference(pack_documents(documents(spark, 0, 90), BYTES, 64), streamed_shards(spark, root)).count() == 0
    with pytest.raises(ValueError, match="out of order"):
        run(2, 10, 20)


@pytest.fixture
def shard_set(spark, tmp_path):
    path = str(tmp_path / "set")
    write_shards(pack_documents(documents(spark), BYTES, 300), path)
    return path


@pytest.mark.parametrize("split", ["train", "val"])
def test_drawn_batches_equal_planned_ones(spark, tmp_path, shard_set, split):
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    # Stopped at 10, gone on to 57: more than two epochs of val, in small tasks.
    for until in (10, 57):
        stream = batch_stream(spark, shard_set, split, 2, 8, seed=7, untilordinal=until, batchespertask=6)
        draw_to_table(stream, table, checkpoint)
    shards = read_shards(spark, shard_set, split)
    plan = epoch_plan(shards, 2, 8, seed=7, epochs=12)
    planned = batches(shards, plan, 2, 8, end=57)
    got = spark.read.parquet(table)
    assert got.count() == 2 * 57
    assert difference(planned, got).count() == 0


def test_a_complete_set_is_drawn_by_its_manifest(spark, tmp_path):
    path = str(tmp_path / "complete")
    prepare_dataset(documents(spark), path, BYTES, 100, {"train": 3000, "val": 100})
    stream = batch_stream(spark, path, "train", 2, 8, seed=3, untilordinal=400)
    draw_to_table(stream, str(tmp_path / "table"), str(tmp_path / "checkpoint"))
    shards = read_shards(spark, path, "train")
    planned = batches(shards, epoch_plan(shards, 2, 8, seed=3, epochs=4), 2, 8, end=400)
    assert difference(planned, spark.read.parquet(str(tmp_path / "table"))).count() == 0
    assert difference(planned, read_batches(spark, path, "train", 2, 8, seed=3, end=400, batchespertask=7)).count() == 0
    some = planned.filter("ordinal >= 250")
    assert difference(some, read_batches(spark, path, "train", 2, 8, seed=3, first=250, end=400)).count() == 0


def test_reading_by_position_moves_no_token_and_lists_no_shard(spark, tmp_path, monkeypatch):
    path = tmp_path / "large"
    path.mkdir()
    manifest = {"shard_size": 1000, "train_shards": 10**9, "train_tokens": 10**12, "validation_shards": 1, "validation_tokens": 9}
    (path / "manifest.json").write_text(json.dumps(manifest))
    rows = read_batches(spark, str(path), "train", 2, 8, first=10**10, end=10**10 + 5000)
    assert rows.rdd.getNumPartitions() == 5 and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    reader = BatchStreamReader({"path": str(path), "batchsize": "2", "sequencelength": "8", "untilordinal": str(10**10)})
    assert len(reader.partitions({"ordinal": 10**10 - 10_000}, {"ordinal": 10**10})) == 10


def test_uneven_sets_are_read_by_a_table_of_sizes(spark, tmp_path, shard_file):
    for i, n in ((1, 60), (2, 17), (5, 3), (7, 33)):
        shard_file(tmp_path / f"dataset_train_{i:06d}.bin", range(i * 100, i * 100 + n))
    shards = read_shards(spark, str(tmp_path), "train")
    planned = batches(shards, epoch_plan(shards, 1, 8, seed=2, epochs=3), 1, 8, end=30)
    assert difference(planned, read_batches(spark, str(tmp_path), "train", 1, 8, seed=2, end=30, batchespertask=4)).count() == 0
    with pytest.raises(ValueError, match="no complete data set"):
        read_batches(spark, str(tmp_path), "train", 1, 8)


def test_a_micro_batch_reads_what_is_open_only(spark, tmp_path):
    root = str(tmp_path / "out")
    for batch in range(4):
        pack_micro_batch(documents(spark, batch * 50, batch * 50 + 50), batch, root, BYTES, 64, None, "doc_id", "text")
        if batch == 2:  # what is closed is not needed again
            for old in range(2):
                (tmp_path / "out" / "packed" / f"batch={old}").rename(tmp_path / f"kept-{old}")
    for old in range(2):
        (tmp_path / f"kept-{old}").rename(tmp_path / "out" / "packed" / f"batch={old}")
    assert difference(pack_documents(documents(spark, 0, 200), BYTES, 64), streamed_shards(spark, root)).count() == 0


def test_paced_stream_goes_on_after_a_restart(spark, tmp_path, shard_set):
    table, checkpoint, progress = (str(tmp_path / n) for n in ("table", "checkpoint", "progress"))
    for until in (7, 20):
        stream = batch_stream(spark, shard_set, "train", 1, 8, batchespertrigger=3, progresspath=progress, untilordinal=until)
        query = (
            stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", table)
            .trigger(processingTime="0 seconds").start()
        )
        try:
            query.processAllAvailable()
            assert json.loads((tmp_path / "progress" / "next.json").read_text()) == {"ordinal": until}
        finally:
            query.stop()
    assert sorted(r.ordinal for r in spark.read.parquet(table).collect()) == list(range(20))


@pytest.mark.parametrize("options, message", [
    ({}, "untilordinal"), ({"batchespertrigger": 2}, "progresspath"), ({"untilordinal": 3, "split": "test"}, "split must be"),
])
def test_stream_options_are_checked(spark, tmp_path, shard_set, options, message):
    split = options.pop("split", "train")
    with pytest.raises(Exception, match=message):
        draw_to_table(batch_stream(spark, shard_set, split, 1, 8, **options), str(tmp_path / "t"), str(tmp_path / "c"))


def test_stream_needs_a_shard_that_holds_a_batch(spark, tmp_path, shard_set):
    with pytest.raises(Exception, match="No shard contains enough tokens"):
        draw_to_table(batch_stream(spark, shard_set, "train", 4, 128, untilordinal=1), str(tmp_path / "t"), str(tmp_path / "c"))
