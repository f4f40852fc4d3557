import json

import numpy as np
import pyarrow as pa
import pytest

from shardloom import BpeTokenizer, ByteTokenizer, prepare_dataset, read_shards, validate_shards
from shardloom.functions.names import index_from_name, shard_name, split_from_name
from shardloom.operators.checks import difference, missing_shards
from shardloom.sources.shards import require_valid, scan_headers, write_shards
from shardloom.sources.tokenshard import ShardFileWriter
from pyspark.sql import functions as F

TARGETS = {"train": 3_000, "val": 200}


@pytest.fixture
def documents(spark):
    rows = [(i, f"document {i} " + "lorem ipsum " * (i % 9)) for i in range(300)]
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def read_file(path):
    raw = path.read_bytes()
    return np.frombuffer(raw[:1024], "<i4"), np.frombuffer(raw[1024:], "<u2").tolist()


def test_files_are_byte_exact(spark, shard_table, tmp_path):
    folder = tmp_path / "nested" / "shards"
    write_shards(shard_table("train", {0: range(10), 1: [65535, 0]}).unionAll(shard_table("val", {3: [7]})), str(folder))
    names = ["dataset_train_000000.bin", "dataset_train_000001.bin", "dataset_val_000003.bin"]
    assert sorted(p.name for p in folder.iterdir() if not p.name.endswith(".crc")) == names
    for name, tokens in zip(names, [list(range(10)), [65535, 0], [7]], strict=True):
        header, payload = read_file(folder / name)
        assert header[:3].tolist() == [20240520, 1, len(tokens)] and not header[3:].any()
        assert payload == tokens and (folder / name).stat().st_size == 1024 + 2 * len(tokens)


@pytest.mark.parametrize("format", ["tokenshard", "parquet"])
def test_roundtrip_and_split(spark, shard_table, tmp_path, format):
    shards = shard_table("train", {0: range(10), 1: range(3)}).unionAll(shard_table("val", {0: [9]}))
    write_shards(shards, str(tmp_path / "set"), format)
    assert difference(shards, read_shards(spark, str(tmp_path / "set"), format=format)).count() == 0
    val = read_shards(spark, str(tmp_path / "set"), "val", format).collect()
    assert [(r.split, r.shard_index, r.tokens) for r in val] == [("val", 0, [9])]


@pytest.mark.parametrize("tokens, split", [([1, 65536], "train"), ([-1], "train"), ([1], "test")])
def test_writer_rejects_bad_rows(spark, shard_table, tmp_path, tokens, split):
    with pytest.raises(Exception, match="token id outside|split must be"):
        write_shards(shard_table(split, {0: tokens}), str(tmp_path / "set"))


def test_a_failed_job_leaves_nothing_and_can_be_repeated(spark, shard_table, tmp_path):
    folder = tmp_path / "set"
    good = shard_table("train", {i: range(5) for i in range(6)}).repartition(3, "shard_index")
    bad = good.unionAll(shard_table("train", {9: [70_000]}).coalesce(1))
    with pytest.raises(Exception, match="token id outside"):
        write_shards(bad, str(folder))
    assert not [p for p in folder.iterdir() if p.is_dir() or p.name.endswith(".bin")]
    write_shards(good, str(folder))
    assert sorted(p.name for p in folder.iterdir()) == [f"dataset_train_{i:06d}.bin" for i in range(6)]


def test_only_committed_attempts_are_seen(tmp_path):
    writer = ShardFileWriter({"path": str(tmp_path / "set")}, overwrite=False)
    rows = pa.record_batch({"split": ["val"], "shard_index": pa.array([0], pa.int32()), "tokens": pa.array([[1, 2]], pa.list_(pa.int32()))})
    first, second = writer.write(iter([rows])), writer.write(iter([rows]))  # a speculative attempt
    assert first.attempt != second.attempt and not list((tmp_path / "set").glob("*.bin"))
    writer.commit([None, second])
    assert [p.name for p in (tmp_path / "set").iterdir()] == ["dataset_val_000000.bin"]
    with pytest.raises(FileExistsError, match="written once"):
        ShardFileWriter({"path": str(tmp_path / "set")}, overwrite=False)
    twice = ShardFileWriter({"path": str(tmp_path / "twice")}, overwrite=False)
    with pytest.raises(RuntimeError, match="share a name"):
        twice.commit([twice.write(iter([rows, rows]))])
    twice.abort([])
    assert not list((tmp_path / "twice").iterdir())


def test_shard_sets_are_written_once(spark, shard_table, tmp_path):
    write_shards(shard_table("train", {0: [1]}), str(tmp_path / "set"))
    with pytest.raises(FileExistsError, match="written once"):
        write_shards(shard_table("train", {1: [1]}), str(tmp_path / "set"))
    with pytest.raises(Exception, match="written once"):
        shard_table("train", {1: [1]}).write.format("tokenshard").mode("overwrite").save(str(tmp_path / "set"))


def test_discovery_takes_only_the_split(spark, shard_file, tmp_path):
    shard_file(tmp_path / "dataset_train_000002.bin", range(20, 30))
    shard_file(tmp_path / "dataset_val_000000.bin", range(90, 100))
    shard_file(tmp_path / "dataset_train_000001.bin", range(10))
    shard_file(tmp_path / "dataset_train_1000000.bin", range(5))
    (tmp_path / "dataset_train_000003.bin.tmp").write_bytes(b"unfinished")
    train = {r.shard_index: r.tokens for r in read_shards(spark, str(tmp_path), "train").collect()}
    assert train == {1: list(range(10)), 2: list(range(20, 30)), 1_000_000: list(range(5))}
    with pytest.raises(ValueError, match="split must be"):
        read_shards(spark, str(tmp_path), "test")


def test_missing_split_is_an_error(spark, shard_file, tmp_path):
    shard_file(tmp_path / "dataset_val_000000.bin", range(10))
    with pytest.raises(Exception, match="No shards found"):
        read_shards(spark, str(tmp_path), "train").collect()
    with pytest.raises(ValueError, match="No shards found"):
        read_shards(spark, str(tmp_path / "absent"), "train", "parquet")


def test_split_filter_reaches_the_reader(spark, shard_file, tmp_path):
    for split in ("train", "val"):
        for i in range(3):
            shard_file(tmp_path / f"dataset_{split}_{i:06d}.bin", range(10))
    with_pushdown = {"pushdown": "true", "partitionBytes": "1"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        files = spark.read.format("tokenshard").options(**with_pushdown).load(str(tmp_path))
        assert files.rdd.getNumPartitions() == 6
        val = files.filter("split = 'val'")
        assert val.rdd.getNumPartitions() == 3 and val.count() == 3
        assert read_shards(spark, str(tmp_path)).filter("split = 'val' AND shard_index > 0").count() == 2
        for none in ("split = 'test'", "split = 'val' AND split = 'train'"):
            assert files.filter(none).count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_validation_finds_every_fault(spark, shard_file, tmp_path):
    faults = {
        "ok": {}, "magic": {"magic": 1}, "version": {"version": 2}, "zero": {"count": 0}, "negative": {"count": -5},
        "short": {"count": 11}, "words": {"words": 255},
    }
    names = {}
    for i, (fault, options) in enumerate(faults.items()):
        names[f"dataset_train_{i:06d}.bin"] = fault
        tokens = range(10) if fault != "words" else []
        shard_file(tmp_path / f"dataset_train_{i:06d}.bin", tokens, **options)
    shard_file(tmp_path / "dataset_val_000000.bin", range(10), count=4)  # bytes after the payload are tolerated
    rows = {names.get(r.shard_name, "trailing"): r for r in validate_shards(spark, str(tmp_path)).collect()}
    assert {fault for fault, r in rows.items() if r.valid} == {"ok", "trailing"}
    assert not rows["magic"].magic_ok and not rows["version"].version_ok and not rows["words"].header_ok
    assert all(r.found_ok for r in rows.values())
    assert not rows["zero"].count_ok and not rows["negative"].count_ok and rows["negative"].token_count == -5
    assert rows["short"].count_ok and not rows["short"].payload_ok
    assert read_shards(spark, str(tmp_path), "val").first().tokens == [0, 1, 2, 3]
    require_valid(spark, str(tmp_path), "val")
    with pytest.raises(ValueError, match="count_ok broken by 2, first dataset_train_000003.*payload_ok broken by 1"):
        require_valid(spark, str(tmp_path), "train")
    with pytest.raises(Exception, match="unreadable shard dataset_train_"):
        read_shards(spark, str(tmp_path), "train").collect()
    read = {r.shard_index: (r.fault, r.tokens) for r in read_shards(spark, str(tmp_path), "train", faults=True).collect()}
    rules = [None, "magic_ok", "version_ok", "count_ok", "count_ok", "payload_ok", "header_ok"]
    assert read == {i: (rule, None if rule else list(range(10))) for i, rule in enumerate(rules)}


def test_names(spark):
    rows = spark.createDataFrame([("train", 3), ("val", 1_234_567)], "split string, shard_index int")
    named = rows.select("split", "shard_index", shard_name(F.col("split"), F.col("shard_index")).alias("n"))
    for r in named.select("*", split_from_name(F.col("n")).alias("s"), index_from_name(F.col("n")).alias("i")).collect():
        assert (r.s, r.i) == (r.split, r.shard_index) and r.n == f"dataset_{r.split}_{r.shard_index:06d}.bin"
    other = spark.createDataFrame([("dataset_test_000001.bin",)], "n string").select(split_from_name(F.col("n"))).first()
    assert other[0] is None


@pytest.mark.parametrize("format", ["tokenshard", "parquet"])
def test_prepare_dataset(spark, documents, tmp_path, format):
    path = str(tmp_path / "set")
    manifest = prepare_dataset(documents, path, ByteTokenizer(), 256, TARGETS, format=format, first_wave=7)
    assert manifest == json.loads((tmp_path / "set" / "manifest.json").read_text())
    sizes = {s: sum(r.token_count for r in read_shards(spark, path, s, format).collect()) for s in ("train", "val")}
    assert (manifest["train_tokens"], manifest["validation_tokens"]) == (sizes["train"], sizes["val"])
    assert all(sizes[s] >= TARGETS[s] for s in sizes)
    assert manifest["train_shards"] == -(-sizes["train"] // 256)
    assert list(manifest) == [
        "source_dataset", "source_subset", "tokenizer", "split_method", "train_token_target", "train_tokens",
        "validation_token_target", "validation_tokens", "shard_size", "train_shards", "validation_shards",
    ]
    # A complete data set is left alone, whatever is asked for.
    assert prepare_dataset(documents.limit(0), path, ByteTokenizer(), 1, TARGETS) == manifest


def test_prepare_with_a_tokenizer_that_cannot_count(spark, documents, tmp_path):
    bpe = BpeTokenizer(spark, {bytes([i]): i for i in range(256)})
    first = prepare_dataset(documents, str(tmp_path / "a"), bpe, 256, TARGETS, first_wave=7)
    second = prepare_dataset(documents, str(tmp_path / "b"), ByteTokenizer(), 256, TARGETS)
    assert {**first, "tokenizer": ""} == {**second, "tokenizer": ""}
    assert difference(read_shards(spark, str(tmp_path / "a")), read_shards(spark, str(tmp_path / "b"))).count() == 0


def test_shortfall_and_leftovers_are_errors(spark, documents, tmp_path):
    with pytest.raises(RuntimeError, match=r"train has \d+ of 1000000000 tokens, val has \d+ of 1 "):
        prepare_dataset(documents, str(tmp_path / "set"), ByteTokenizer(), 256, {"train": 10**9, "val": 1})
    assert not (tmp_path / "set").exists()
    (tmp_path / "part").mkdir()
    (tmp_path / "part" / "dataset_train_000000.bin").write_bytes(b"")
    with pytest.raises(RuntimeError, match="without a manifest"):
        prepare_dataset(documents, str(tmp_path / "part"), ByteTokenizer(), 256, TARGETS)


def test_early_stop_reads_no_later_documents(spark, documents, tmp_path):
    # The text of a late document is null, which would fail the job that reads it.
    poisoned = documents.withColumn("text", F.when(F.col("doc_id") < 250, F.col("text")))
    manifest = prepare_dataset(poisoned, str(tmp_path / "set"), ByteTokenizer(), 256, TARGETS, first_wave=16)
    assert manifest["train_tokens"] >= TARGETS["train"]


def test_missing_shards(spark):
    saved = spark.createDataFrame([("a",), ("b",)], "shard_name string")
    assert [r.shard_name for r in missing_shards(saved, saved.filter("shard_name = 'a'")).collect()] == ["b"]


def test_header_scan_reads_signed_words(spark, shard_file, tmp_path):
    shard_file(tmp_path / "dataset_val_000000.bin", [1, 2], magic=-2, version=2147483647)
    row = scan_headers(spark, str(tmp_path)).first()
    assert (row.magic, row.version, row.token_count, row.length) == (-2, 2147483647, 2, 1028)


def test_a_complete_set_is_read_by_its_manifest(spark, documents, tmp_path):
    path = tmp_path / "set"
    manifest = prepare_dataset(documents, str(path), ByteTokenizer(), 64, TARGETS)
    (path / f"dataset_train_{manifest['train_shards']:06d}.bin").write_bytes(b"left over from elsewhere")
    rows = read_shards(spark, str(path)).select("split", "shard_index", "token_count").collect()
    assert sum(r.token_count for r in rows) == manifest["train_tokens"] + manifest["validation_tokens"]
    small = spark.read.format("tokenshard").option("partitionBytes", 3 * (1024 + 128)).load(str(path))
    assert small.rdd.getNumPartitions() == -(-len(rows) // 3) and small.count() == len(rows)
    (path / "dataset_train_000001.bin").rename(path / "elsewhere")
    with pytest.raises(Exception, match="Missing shard files: dataset_train_000001.bin"):
        read_shards(spark, str(path)).collect()
