"""

Parameters are the smoke settings of the job being rebuilt: shards of 10,000 tokens, 4 sequences of 128
tokens per batch, 4 batches per update, seed 10. ``documents`` is the corpus; run logs are derived from
``events`` (a user is a run, its events in time order are the steps).
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from shardloom.functions.names import index_from_name, shard_name, split_from_name  # noqa: E402
from shardloom.functions.schedule import learning_rate, tokens_seen  # noqa: E402
from shardloom.functions.shuffle import PRIME, ROUNDS  # noqa: E402
from shardloom.functions.splits import assign_split, hash_bucket  # noqa: E402
from shardloom.functions.tokenizers import BpeTokenizer, ByteTokenizer, fits_two_bytes  # noqa: E402
from shardloom.operators import checks, runlog, windows  # noqa: E402
from shardloom.operators.offsets import (  # noqa: E402
    apply_budget, count_tokens, counted_documents, split_totals, token_offsets, tokenize,
)
from shardloom.operators.ordered import range_blocks, running_sums  # noqa: E402
from shardloom.operators.packing import pack_documents  # noqa: E402
from shardloom.plans import epochs, state, steps  # noqa: E402
from shardloom.session import scratch, ship_code  # noqa: E402
from shardloom.sources import dataset, metrics, shards  # noqa: E402
from shardloom.sources.files import DriverFiles, arrow_fs  # noqa: E402
from shardloom.streaming import batches as batch_streams  # noqa: E402
from shardloom.streaming import prepare as prepare_streams  # noqa: E402

try:  # both may be taken away, or a library that only they use be missing; all else works without them
    import corpus_pipeline
    from shardloom.llm import queries as llm_queries
except ImportError as error:
    print(f"without the training-data operators: {error}", file=sys.stderr)
    corpus_pipeline = llm_queries = None

SHARD_SIZE, BATCH, LENGTH, SEED = 10_000, 4, 128, 10
TARGETS, PREPARED = {"train": 1_000_000, "val": 30_000}, {"train": 200_000, "val": 5_000}
ACCUMULATION, TOTAL_STEPS, EPOCHS, DRAWN = 4, 1120, 3, 1000
LOG_INTERVAL, EVAL_INTERVAL, EVAL_STEPS, CHECKPOINT_INTERVAL = 10, 20, 5, 200
BYTES = ByteTokenizer()


# ---------------------------------------------------------------- shared parts


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.scan_documents(spark, f"{sf_dir}/documents.parquet")


def digest(column: str):
    return F.sha2(F.array_join(F.col(column).cast("array<string>"), ","), 256)


def counted(spark, sf_dir) -> DataFrame:
    return counted_documents(documents(spark, sf_dir), BYTES)


def offsets(spark, sf_dir) -> DataFrame:
    return token_offsets(counted(spark, sf_dir))


def taken(spark, sf_dir) -> DataFrame:
    return apply_budget(offsets(spark, sf_dir), TARGETS)


def budget_totals(spark, sf_dir) -> DataFrame:
    return split_totals(taken(spark, sf_dir), SHARD_SIZE, TARGETS)


def totals(spark, sf_dir) -> DataFrame:
    """Totals of the whole corpus, which also tell its shards and batches."""
    return split_totals(counted(spark, sf_dir), SHARD_SIZE)


def layout(spark, sf_dir) -> DataFrame:
    return epochs.shard_layout(totals(spark, sf_dir), SHARD_SIZE)


def packed(spark, sf_dir) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), BYTES, SHARD_SIZE)


def plan(spark, sf_dir, count: int = EPOCHS) -> DataFrame:
    return epochs.total_plan(totals(spark, sf_dir), SHARD_SIZE, BATCH, LENGTH, SEED, count)


def order(spark, sf_dir, split: str = "train") -> epochs.EpochOrder:
    return epochs.EpochOrder.of_totals(totals(spark, sf_dir), split, SHARD_SIZE, BATCH, LENGTH, SEED)


def steps_of(spark, sf_dir) -> DataFrame:
    ordinals = epochs.batch_ordinals(plan(spark, sf_dir).filter("split = 'train'"), BATCH, LENGTH)
    return steps.step_plan(ordinals, ACCUMULATION, BATCH, LENGTH, TOTAL_STEPS)


def updates(spark, sf_dir) -> DataFrame:
    batches = EPOCHS * order(spark, sf_dir).per_epoch
    return steps.counted_updates(spark, batches, ACCUMULATION, BATCH, LENGTH, TOTAL_STEPS, total_steps=TOTAL_STEPS)


def written_set(spark, sf_dir) -> str:
    """The whole corpus as shard files with their manifest."""
    path = scratch(spark, "shards")
    dataset.write_dataset(packed(spark, sf_dir), path, SHARD_SIZE, None, "documents", "all", BYTES.name)
    return path


def with_digests(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.select(*keys, digest("inputs").alias("inputs_sha"), digest("targets").alias("targets_sha"))


def run_log(spark, sf_dir) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(
        F.coalesce(F.col("user_id").cast("string"), F.lit("")).alias("run_id"), "ts", "event_id", "event_type", "value",
        F.lit(1).cast("bigint").alias("one"),
    )
    # A user may own a third of all events: number them over key ranges, not over whole users.
    blocked = range_blocks(rows, ["run_id", "ts", "event_id"])
    numbered = running_sums(blocked, ["run_id"], "block", ["ts", "event_id"], {"before": "one"})
    step = (F.col("before") + 1).alias("step")
    log = numbered.select("run_id", step, "event_type", "value")
    return log.select(
        "run_id", "step", tokens_seen(F.col("step"), ACCUMULATION, BATCH, LENGTH).alias("tokens"),
        F.col("value").alias("train_loss"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("val_loss"),
    )


def saved_steps(log: DataFrame) -> DataFrame:
    return log.groupBy("run_id").agg(F.call_function("div", F.max("step"), F.lit(2)).alias("saved_step"))


def losses(log: DataFrame) -> DataFrame:
    return log.select("run_id", (F.col("step") - 1).alias("ordinal"), F.col("train_loss").alias("loss"))


# ---------------------------------------------------------------- queries


def q_document_scan(spark, sf_dir):
    return documents(spark, sf_dir)


def q_assign_split(spark, sf_dir):
    return assign_split(documents(spark, sf_dir)).select("doc_id", hash_bucket(F.col("text")).alias("bucket"), "split")


def q_split_filter(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return assign_split(rows).filter(F.col("split") == "val").select("doc_id", "lang", "split")


def q_tokenize(spark, sf_dir):
    tokens = tokenize(documents(spark, sf_dir), BYTES)
    return tokens.select("doc_id", "n_tokens", F.element_at("tokens", -1).alias("last_token"), digest("tokens").alias("tokens_sha"))


def q_tokenize_native(spark, sf_dir):
    """The same by built-in expressions."""
    tokens = tokenize(documents(spark, sf_dir), ByteTokenizer(engine="native"))
    return tokens.select("doc_id", "n_tokens", F.element_at("tokens", -1).alias("last_token"), digest("tokens").alias("tokens_sha"))


def q_bpe_tokenize(spark, sf_dir):
    """Byte-pair encoding with the 256 single bytes as its only ranks must give the byte ids."""
    bpe = BpeTokenizer(spark, {bytes([i]): i for i in range(256)}, name="bytes-as-bpe")
    tokens = tokenize(documents(spark, sf_dir), bpe)
    return tokens.select("doc_id", "n_tokens", F.element_at("tokens", -1).alias("last_token"), digest("tokens").alias("tokens_sha"))


def q_token_counts(spark, sf_dir):
    return count_tokens(documents(spark, sf_dir), BYTES).select("doc_id", "n_tokens")


def q_token_offsets(spark, sf_dir):
    return offsets(spark, sf_dir)


def q_token_budget(spark, sf_dir):
    return taken(spark, sf_dir)


def q_split_totals(spark, sf_dir):
    return budget_totals(spark, sf_dir)


def q_dataset_manifest(spark, sf_dir):
    return dataset.manifest_row(budget_totals(spark, sf_dir), SHARD_SIZE, TARGETS, "documents", "all", BYTES.name)


def q_prepared_dataset(spark, sf_dir):
    """The whole preparation: early stop, budget, shards and the manifest, as its file and its shards tell."""
    path = scratch(spark, "prepared")
    dataset.prepare_dataset(documents(spark, sf_dir), path, BYTES, SHARD_SIZE, PREPARED, first_wave=16)
    written = spark.read.option("multiLine", True).json(f"{path}/manifest.json")
    found = shards.read_shards(spark, path).agg(F.count("*").alias("files"), F.sum("token_count").alias("tokens"))
    return _one_row(written, found)


def q_budget_shortfall(spark, sf_dir):
    """A corpus that cannot meet its budget: what is missing, and that nothing was written."""
    path, targets = scratch(spark, "short"), {s: 10**12 for s in TARGETS}
    try:
        dataset.prepare_dataset(documents(spark, sf_dir), path, BYTES, SHARD_SIZE, targets)
    except dataset.Shortfall as error:
        rows = [(s, t, error.reached[s], t - error.reached[s], DriverFiles(spark, path).exists()) for s, t in targets.items()]
    return spark.createDataFrame(rows, "split string, target bigint, tokens bigint, missing bigint, written boolean")


def q_write_once(spark, sf_dir):
    """A complete set is left as it is, whatever is asked for; a folder that holds shards without a manifest is refused."""
    complete, partial = written_set(spark, sf_dir), scratch(spark, "partial")
    shards.write_shards(packed(spark, sf_dir).filter("split = 'val'"), partial)
    rows = []
    for case, path in (("complete", complete), ("partial", partial)):
        try:
            manifest = dataset.prepare_dataset(documents(spark, sf_dir), path, BYTES, 1, {"train": 1, "val": 1})
            outcome = f"kept shards of {manifest['shard_size']}"
        except RuntimeError:
            outcome = "refused"
        rows.append(shards.scan_headers(spark, path).agg(
            F.lit(case).alias("case"), F.lit(outcome).alias("outcome"), F.count("*").alias("files"), F.sum("token_count").alias("tokens")
        ))
    return rows[0].unionAll(rows[1])


def q_token_id_guard(spark, sf_dir):
    """Ids moved up by 256 times a number of the document: which documents still fit two bytes."""
    tokens = tokenize(documents(spark, sf_dir).withColumn("up", F.col("doc_id") % 300 * 256), BYTES)
    moved = tokens.select("doc_id", F.transform(F.slice("tokens", F.lit(2), F.size("tokens")), lambda t: (t + F.col("up")).cast("int")).alias("ids"))
    return moved.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.array_max("ids").alias("largest"), fits_two_bytes(F.col("ids")).alias("fits"))


def q_pack_shards(spark, sf_dir):
    return packed(spark, sf_dir).select("split", "shard_index", "token_count", digest("tokens").alias("tokens_sha"))


def q_shard_write_roundtrip(spark, sf_dir):
    read = shards.read_shards(spark, written_set(spark, sf_dir))
    return read.select("split", "shard_index", "token_count", digest("tokens").alias("tokens_sha"))


def q_shard_table_roundtrip(spark, sf_dir):
    path = scratch(spark, "table")
    shards.write_shards(packed(spark, sf_dir), path, "parquet")
    read = shards.read_shards(spark, path, format="parquet")
    return read.select("split", "shard_index", "token_count", digest("tokens").alias("tokens_sha"))


def q_shard_header_scan(spark, sf_dir):
    return shards.scan_headers(spark, written_set(spark, sf_dir))


def q_shard_discovery(spark, sf_dir):
    return shards.scan_headers(spark, written_set(spark, sf_dir), "train").select("shard_name", "split", "shard_index")


def spoiled_set(spark, sf_dir) -> str:
    """The whole corpus as shard files, of which six in seven are then broken in one way each, by number."""
    path = written_set(spark, sf_dir)

    def spoil(batches):
        fs, folder = arrow_fs(path)
        for batch in batches:
            for name, index in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                file, way = f"{folder}/{name}", index % 7
                with fs.open_input_file(file) as stream:
                    raw = stream.read()
                if way in (1, 2, 3):  # magic, version, count
                    at = 4 * (way - 1)
                    raw = raw[:at] + b"\0\0\0\0" + raw[at + 4 :]
                elif way in (4, 5):  # payload, header
                    raw = raw[: len(raw) - 1 if way == 4 else 1000]
                if way == 6:
                    fs.delete_file(file)
                elif way:
                    with fs.open_output_stream(file) as stream:
                        stream.write(raw)
            yield batch

    ship_code()
    names = layout(spark, sf_dir).select(shard_name(F.col("split"), F.col("shard_index")).alias("shard_name"), "shard_index")
    names.mapInArrow(spoil, "shard_name string, shard_index int").write.format("noop").mode("overwrite").save()
    return path


def q_shard_validation(spark, sf_dir):
    valid = shards.validate_shards(spark, spoiled_set(spark, sf_dir))
    return valid.select("shard_name", "found_ok", "header_ok", "magic_ok", "version_ok", "count_ok", "payload_ok", "valid")


def q_shard_faults(spark, sf_dir):
    """Reading a set of which most files are broken: the others are read, and each broken one tells its fault."""
    read = shards.read_shards(spark, spoiled_set(spark, sf_dir), faults=True)
    return read.select("split", "shard_index", "token_count", digest("tokens").alias("tokens_sha"), "fault")


def q_shard_names(spark, sf_dir):
    named = layout(spark, sf_dir).select(shard_name(F.col("split"), F.col("shard_index")).alias("shard_name"))
    name = F.col("shard_name")
    return named.select(name, split_from_name(name).alias("split"), index_from_name(name).alias("shard_index"))


def q_undersized_shards(spark, sf_dir):
    return windows.undersized_shards(layout(spark, sf_dir), BATCH, LENGTH)


def q_missing_shards(spark, sf_dir):
    """A state saved on the whole corpus, restored on the budgeted data set."""
    name = shard_name(F.col("split"), F.col("shard_index")).alias("shard_name")
    budgeted = epochs.shard_layout(budget_totals(spark, sf_dir), SHARD_SIZE)
    return checks.missing_shards(layout(spark, sf_dir).select(name), budgeted.select(name))


def q_token_windows(spark, sf_dir):
    rows = windows.token_windows(packed(spark, sf_dir), BATCH, LENGTH)
    return with_digests(rows, "split", "shard_index", "batch_in_shard", "row")


def q_epoch_plan(spark, sf_dir):
    return plan(spark, sf_dir)


def q_epoch_plan_general(spark, sf_dir):
    """The same plan by running sums over the sizes of the shards, as sets of uneven shards need."""
    return epochs.epoch_plan(layout(spark, sf_dir), BATCH, LENGTH, SEED, EPOCHS)


def q_epoch_plan_numpy(spark, sf_dir):
    return epochs.epoch_plan(layout(spark, sf_dir), BATCH, LENGTH, SEED, EPOCHS, mode="numpy")


def q_batch_ordinals(spark, sf_dir):
    return epochs.batch_ordinals(plan(spark, sf_dir), BATCH, LENGTH)


def q_batches(spark, sf_dir):
    """An epoch of both splits, read by position from the files."""
    path = written_set(spark, sf_dir)
    train, val = (shards.read_batches(spark, path, split, BATCH, LENGTH, SEED) for split in ("train", "val"))
    return with_digests(train.unionAll(val), "split", "epoch", "ordinal", "row")


def q_table_batches(spark, sf_dir):
    """The same from the table of shards, where a shard's batches are numbered without a join."""
    table = packed(spark, sf_dir)
    train, val = (epochs.batches_in_order(table, order(spark, sf_dir, split)) for split in ("train", "val"))
    return with_digests(train.unionAll(val), "split", "epoch", "ordinal", "row")


def q_eval_batches(spark, sf_dir):
    """More validation batches than an epoch has: the next epoch's follow."""
    val = order(spark, sf_dir, "val")
    rows = steps.eval_batches(packed(spark, sf_dir), val, val.per_epoch + EVAL_STEPS)
    return with_digests(rows, "split", "epoch", "ordinal", "row")


def q_batch_export(spark, sf_dir):
    path = written_set(spark, sf_dir)
    rows = windows.export_batches(shards.read_batches(spark, path, "train", BATCH, LENGTH, SEED))
    wide = rows.withColumns({"first_input": F.element_at("inputs", 1), "last_target": F.element_at("targets", -1)})
    return with_digests(wide, "ordinal", "row", "first_input", "last_target")


def q_step_plan(spark, sf_dir):
    return steps_of(spark, sf_dir).select("epoch", "ordinal", "shard_index", "update_step", "micro_step", "tokens")


def q_step_cadence(spark, sf_dir):
    due = steps.step_cadence(updates(spark, sf_dir), LOG_INTERVAL, EVAL_INTERVAL, CHECKPOINT_INTERVAL, TOTAL_STEPS)
    return due.select("update_step", "micro_steps", "log_due", "eval_due", "checkpoint_due")


def q_lr_schedule(spark, sf_dir):
    return updates(spark, sf_dir).select("update_step", "tokens", F.round("learning_rate", 12).alias("learning_rate"))


def q_schedule_alignment(spark, sf_dir):
    """Every record beside the update that the corpus's plan has for its step. Runs of odd users were started with half the warmup, every third one with half the
    accumulation; the log holds rates of six digits."""
    log = run_log(spark, sf_dir)
    user = F.col("run_id").cast("bigint")
    rate = F.when(user % 2 == 1, learning_rate(F.col("step"), warmup_steps=50)).otherwise(learning_rate(F.col("step")))
    seen = F.when(user % 3 == 0, F.call_function("div", F.col("tokens"), F.lit(2))).otherwise(F.col("tokens"))
    log = log.withColumns({"learning_rate": F.round(rate, 6), "tokens": seen})
    aligned = runlog.align_schedule(log, ACCUMULATION, BATCH, LENGTH, updates(spark, sf_dir))
    return aligned.select(
        "run_id", "step", "train_loss", F.round("planned_rate", 12).alias("planned_rate"), F.round("rate_drift", 12).alias("rate_drift"), "token_drift",
        "micro_steps",
    )


def resumed(spark, path: str) -> int:
    """Save a state after ``DRAWN`` batches and restore it; the number of the batch that follows."""
    sizes = shards.scan_headers(spark, path)
    saved = state.loader_state(sizes, "train", BATCH, LENGTH, DRAWN, SEED)
    _, following = state.resume_order(sizes, state.LoaderState.from_json(saved.to_json()), "train", BATCH, LENGTH)
    return following


def q_resume_batches(spark, sf_dir):
    path = written_set(spark, sf_dir)
    end = EPOCHS * order(spark, sf_dir).per_epoch
    rows = shards.read_batches(spark, path, "train", BATCH, LENGTH, SEED, resumed(spark, path), end)
    return with_digests(rows, "split", "epoch", "ordinal", "row")


def q_resume_equivalence(spark, sf_dir):
    path = written_set(spark, sf_dir)
    end = EPOCHS * order(spark, sf_dir).per_epoch

    def draw(first: int, end: int) -> DataFrame:
        return with_digests(shards.read_batches(spark, path, "train", BATCH, LENGTH, SEED, first, end), "epoch", "ordinal", "row")

    return checks.equality(draw(0, end), draw(0, DRAWN).unionAll(draw(resumed(spark, path), end)))


def _one_row(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row aggregates side by side."""
    one = F.lit(1).alias("one")
    return left.withColumn("one", one).join(right.withColumn("one", one), "one").drop("one")


def q_split_leakage(spark, sf_dir):
    return checks.split_leakage(assign_split(documents(spark, sf_dir)))


def q_metrics_trim(spark, sf_dir):
    log = run_log(spark, sf_dir)
    return runlog.trim(log, saved_steps(log))


def q_metrics_roundtrip(spark, sf_dir):
    """Append a log, trim it in place as a resumed run does, and read what is left."""
    log = run_log(spark, sf_dir)
    none = F.lit(None).cast("double")
    path = scratch(spark, "metrics")
    metrics.append_metrics(log.withColumns({"learning_rate": none, "gradient_norm": none}), path)
    written = metrics.read_metrics(spark, path)
    metrics.sync_metrics(spark, path, saved_steps(written))
    return metrics.read_metrics(spark, path).select("run_id", "step", "tokens", "train_loss", "val_loss")


def q_interval_loss(spark, sf_dir):
    means = runlog.interval_loss(run_log(spark, sf_dir), LOG_INTERVAL)
    return means.select("run_id", "end_step", F.round("mean_loss", 9).alias("mean_loss"))


def q_latest_losses(spark, sf_dir):
    latest = runlog.latest_losses(run_log(spark, sf_dir), LOG_INTERVAL)
    return latest.select("run_id", "step", F.round("latest_avg_loss", 9).alias("latest_avg_loss"), "latest_val_loss")


def q_run_bounds(spark, sf_dir):
    return runlog.run_bounds(run_log(spark, sf_dir))


def q_validation_curve(spark, sf_dir):
    return runlog.validation_curve(run_log(spark, sf_dir))


def q_eval_mean(spark, sf_dir):
    means = runlog.eval_mean(losses(run_log(spark, sf_dir)), EVAL_STEPS)
    return means.select("run_id", F.round("mean_loss", 9).alias("mean_loss"), "batches")


def q_update_loss_mean(spark, sf_dir):
    means = runlog.update_loss_mean(losses(run_log(spark, sf_dir)), ACCUMULATION)
    return means.select("run_id", "update_step", F.round("mean_loss", 9).alias("mean_loss"))


def q_stream_pack(spark, sf_dir):
    """Documents arrive in four parts; the stream is stopped and restarted after each."""
    rows, root = documents(spark, sf_dir), scratch(spark, "stream")
    keys = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    width = (keys.high - keys.low) // 4 + 1
    for part in range(4):
        low = keys.low + part * width
        dataset.key_range(rows, "doc_id", low, low + width).write.mode("append").parquet(f"{root}/incoming")
        incoming = prepare_streams.document_stream(spark, f"{root}/incoming", max_files_per_trigger=1_000_000)
        prepare_streams.prepare_stream(incoming, f"{root}/out", BYTES, SHARD_SIZE).awaitTermination()
    return prepare_streams.streamed_shards(spark, f"{root}/out").select("split", "shard_index", "token_count", digest("tokens").alias("tokens_sha"))


def q_stream_batches(spark, sf_dir):
    """One epoch and a bit drawn as a stream, stopped and restarted in the middle."""
    path, root = written_set(spark, sf_dir), scratch(spark, "draw")
    per_epoch = order(spark, sf_dir).per_epoch
    for until in (per_epoch // 2, per_epoch + per_epoch // 4):
        stream = batch_streams.batch_stream(spark, path, "train", BATCH, LENGTH, SEED, untilordinal=until)
        batch_streams.draw_to_table(stream, f"{root}/table", f"{root}/checkpoint")
    return with_digests(spark.read.parquet(f"{root}/table"), "split", "epoch", "ordinal", "row")


def entry(spark: SparkSession) -> DataFrame:
    """From raw text to training sequences: split, tokenize, pack, cut into next-token windows."""
    return windows.token_windows(packed(spark, "/root/testdata/sf0.001"), BATCH, LENGTH)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {name[2:]: made for name, made in globals().items() if name.startswith("q_")}
    return own | (llm_queries.QUERIES | {"pipeline": corpus_pipeline.run} if llm_queries else {})


# ---------------------------------------------------------------- SQL to check against

DOCS = """docs AS (
  SELECT doc_id, text, (('0x' || substr(sha256(text), 1, 16))::UBIGINT % 32)::INT AS bucket,
    CASE WHEN ('0x' || substr(sha256(text), 1, 16))::UBIGINT % 32 = 0 THEN 'val' ELSE 'train' END AS split,
    (strlen(text) + 1)::BIGINT AS n_tokens
  FROM documents)"""
OFFSETS = f"""{DOCS}, offs AS (
  SELECT doc_id, split, n_tokens, coalesce(sum(n_tokens) OVER (PARTITION BY split ORDER BY doc_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM docs)"""
TAKEN = f"""{OFFSETS}, taken AS (
  SELECT * FROM offs WHERE start < CASE split WHEN 'train' THEN {TARGETS['train']} ELSE {TARGETS['val']} END)"""
TOTALS = f"""{TAKEN}, totals AS (
  SELECT split, count(*)::BIGINT AS documents, sum(n_tokens)::BIGINT AS tokens,
    ((sum(n_tokens) + {SHARD_SIZE} - 1) // {SHARD_SIZE})::BIGINT AS shards,
    (sum(n_tokens) - CASE split WHEN 'train' THEN {TARGETS['train']} ELSE {TARGETS['val']} END)::BIGINT AS overshoot
  FROM taken GROUP BY split)"""


def _layout_sql(tokens_from: str, name: str) -> str:
    return f"""{name} AS (
  SELECT split, i::INT AS shard_index, least({SHARD_SIZE}, tokens - i * {SHARD_SIZE})::INT AS token_count,
    printf('dataset_%s_%06d.bin', split, i) AS shard_name
  FROM (SELECT split, tokens, unnest(range(0, ((tokens + {SHARD_SIZE} - 1) // {SHARD_SIZE})::BIGINT)) AS i
        FROM {tokens_from}))"""


ALL_TOTALS = "(SELECT split, sum(n_tokens)::BIGINT AS tokens FROM docs GROUP BY split)"
LAYOUT = f"{DOCS}, {_layout_sql(ALL_TOTALS, 'layout')}"
BUDGETED = f"{TOTALS}, {_layout_sql(ALL_TOTALS, 'layout')}, {_layout_sql('totals', 'budgeted')}"
STEP = BATCH * LENGTH


def _squared(x: str) -> str:
    return f"((({x}) % {PRIME}) * (({x}) % {PRIME}) % {PRIME})"


def _places_sql(count: int) -> str:
    """Places of ``sized`` shards in each epoch: train shards swap or not with their partner in every round."""
    hexes = f"sha256('{SEED}:' || epoch)"
    key_a, key_b = (f"('0x' || substr({hexes}, {at}, 7))::BIGINT" for at in (1, 8))
    partner, bit = _squared(f"{_squared('a + r * 40503')} + b"), _squared(f"{_squared('b + r * 69069')} + a")
    other = f"(((key >> 31) % n - x) % n + n) % n"
    mixed = _squared(f"{_squared(f'greatest(x, {other}) + (key & {PRIME})')} + 1")
    return f"""keys AS (
  SELECT epoch, list_transform(range(0, {ROUNDS}), lambda r: {partner} * 2147483648 + {bit}) AS keys
  FROM (SELECT epoch, {key_a} AS a, {key_b} AS b FROM (SELECT unnest(range(0, {count})) AS epoch))),
placed AS (
  SELECT s.*, k.epoch::INT AS epoch, CASE WHEN s.split = 'val' THEN s.shard_index::BIGINT ELSE
    list_reduce(list_prepend(s.shard_index::BIGINT, k.keys),
      lambda x, key: CASE WHEN ({mixed} >> 15) & 1 = 1 THEN {other} ELSE x END) END AS position
  FROM (SELECT *, count(*) OVER (PARTITION BY split) AS n FROM sized) s CROSS JOIN keys k)"""


def _plan_sql(count: int) -> str:
    return f"""{LAYOUT}, sized AS (
  SELECT *, ((token_count - 1) // {STEP})::BIGINT AS n_batches FROM layout),
{_places_sql(count)},
plan AS (
  SELECT split, epoch, position, shard_index, shard_name, token_count, n_batches,
    (epoch * (sum(n_batches) OVER (PARTITION BY split, epoch)) + coalesce(sum(n_batches) OVER (PARTITION BY split, epoch ORDER BY position
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS first_ordinal
  FROM placed),
ordinals AS (
  SELECT split, epoch, (first_ordinal + k)::BIGINT AS ordinal, shard_index, k::BIGINT AS batch_in_shard,
    (k * {STEP})::BIGINT AS token_position
  FROM (SELECT *, unnest(range(0, n_batches)) AS k FROM plan))"""


def _tokens_sql(source: str) -> str:
    """Tokens of the documents in ``source``, and the shards their stream is cut into."""
    return f"""tokens AS (
  SELECT d.doc_id, d.split, list_prepend(50256::INT, list_transform(
    regexp_extract_all(hex(encode(d.text)), '..'), lambda x: ('0x' || x)::INT)) AS tokens
  FROM docs d SEMI JOIN {source} s ON s.doc_id = d.doc_id),
streams AS (SELECT split, flatten(list(tokens ORDER BY doc_id)) AS all_t FROM tokens GROUP BY split),
shards AS (
  SELECT split, i::INT AS shard_index, len(part)::INT AS token_count, part AS tokens
  FROM (SELECT split, i, all_t[(i * {SHARD_SIZE} + 1)::BIGINT:((i + 1) * {SHARD_SIZE})::BIGINT] AS part
        FROM (SELECT split, all_t, unnest(range(0, (len(all_t) + {SHARD_SIZE} - 1) // {SHARD_SIZE})) AS i FROM streams)))"""


WINDOWS = f"""win AS (
  SELECT split, shard_index, k::BIGINT AS batch_in_shard, r::INT AS "row",
    tokens[(k * {STEP} + r * {LENGTH} + 1)::BIGINT:(k * {STEP} + (r + 1) * {LENGTH})::BIGINT] AS inputs,
    tokens[(k * {STEP} + r * {LENGTH} + 2)::BIGINT:(k * {STEP} + (r + 1) * {LENGTH} + 1)::BIGINT] AS targets
  FROM (SELECT *, unnest(range(0, {BATCH})) AS r FROM
    (SELECT *, unnest(range(0, (token_count - 1) // {STEP})) AS k FROM shards)))"""
SHAS = """sha256(array_to_string(inputs, ',')) AS inputs_sha, sha256(array_to_string(targets, ',')) AS targets_sha"""


def _batches_sql(count: int) -> str:
    return f"""{_plan_sql(count)}, {_tokens_sql('docs')}, {WINDOWS}, drawn AS (
  SELECT o.split, o.epoch, o.ordinal, w."row", w.inputs, w.targets
  FROM ordinals o JOIN win w ON w.split = o.split AND w.shard_index = o.shard_index AND w.batch_in_shard = o.batch_in_shard)"""


def _rate_sql(warmup: int, step: str = "step") -> str:
    """The schedule at a step."""
    return f"""CASE WHEN {step} <= {warmup} THEN {step} * (CAST(0.0003 AS DOUBLE) / {warmup})
      WHEN {step} >= {TOTAL_STEPS} THEN CAST(0.00003 AS DOUBLE)
      ELSE CAST(0.00003 AS DOUBLE) + CAST(0.5 AS DOUBLE) * (1 + cos(pi() * ({step} - {warmup})::DOUBLE / {TOTAL_STEPS - warmup}))
        * (CAST(0.0003 AS DOUBLE) - CAST(0.00003 AS DOUBLE)) END"""


STEPS = f"""{_plan_sql(EPOCHS)}, step_rows AS (
  SELECT epoch, ordinal, shard_index, (ordinal // {ACCUMULATION} + 1)::BIGINT AS update_step,
    (ordinal % {ACCUMULATION})::INT AS micro_step, ((ordinal // {ACCUMULATION} + 1) * {ACCUMULATION * STEP})::BIGINT AS tokens
  FROM ordinals WHERE split = 'train' AND ordinal // {ACCUMULATION} + 1 <= {TOTAL_STEPS}),
updates AS (
  SELECT update_step, tokens, count(*)::BIGINT AS micro_steps, {_rate_sql(100, 'update_step')} AS learning_rate
  FROM step_rows GROUP BY update_step, tokens)"""
LOG = f"""log AS (
  SELECT user_id::VARCHAR AS run_id, step, (step * {ACCUMULATION * STEP})::BIGINT AS tokens, value AS train_loss,
    CASE WHEN event_type = 'purchase' THEN value END AS val_loss
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events))"""
TRIMMED = f"""WITH {LOG} SELECT l.run_id, l.step, l.tokens, l.train_loss, l.val_loss
  FROM log l JOIN (SELECT run_id, max(step) // 2 AS saved_step FROM log GROUP BY run_id) s ON s.run_id = l.run_id
  WHERE l.step <= s.saved_step"""
MEANS = f"""{LOG}, means AS (
  SELECT run_id, (step - 1) // {LOG_INTERVAL} AS i, sum(train_loss) / {LOG_INTERVAL} AS mean_loss
  FROM log GROUP BY run_id, (step - 1) // {LOG_INTERVAL} HAVING count(*) = {LOG_INTERVAL})"""
TOKENIZED = f"""WITH {DOCS}, {_tokens_sql('docs')}
  SELECT doc_id, len(tokens)::BIGINT AS n_tokens, tokens[len(tokens)] AS last_token,
    sha256(array_to_string(tokens, ',')) AS tokens_sha FROM tokens"""
PACKED = f"""WITH {DOCS}, {_tokens_sql('docs')}
  SELECT split, shard_index, token_count, sha256(array_to_string(tokens, ',')) AS tokens_sha FROM shards"""


def oracle_sql() -> dict[str, str]:
    return (llm_queries.SQL if llm_queries else {}) | {
        "document_scan": "SELECT doc_id, text FROM documents",
        "assign_split": f"WITH {DOCS} SELECT doc_id, bucket, split FROM docs",
        "split_filter": f"WITH {DOCS} SELECT d.doc_id, o.lang, d.split FROM docs d JOIN documents o ON o.doc_id = d.doc_id "
                        "WHERE d.split = 'val'",
        "tokenize": TOKENIZED,
        "tokenize_native": TOKENIZED,
        "bpe_tokenize": TOKENIZED,
        "token_counts": "SELECT doc_id, (strlen(text) + 1)::BIGINT AS n_tokens FROM documents",
        "token_offsets": f"WITH {OFFSETS} SELECT * FROM offs",
        "token_budget": f"WITH {TAKEN} SELECT * FROM taken",
        "split_totals": f"WITH {TOTALS} SELECT * FROM totals",
        "dataset_manifest": f"""WITH {TOTALS}
  SELECT 'documents' AS source_dataset, 'all' AS source_subset, 'bytes' AS tokenizer,
    'sha256(text), bucket 0 of 32 is validation' AS split_method,
    {TARGETS['train']}::BIGINT AS train_token_target, coalesce(sum(tokens) FILTER (split = 'train'), 0)::BIGINT AS train_tokens,
    {TARGETS['val']}::BIGINT AS validation_token_target,
    coalesce(sum(tokens) FILTER (split = 'val'), 0)::BIGINT AS validation_tokens, {SHARD_SIZE}::BIGINT AS shard_size,
    coalesce(sum(shards) FILTER (split = 'train'), 0)::BIGINT AS train_shards,
    coalesce(sum(shards) FILTER (split = 'val'), 0)::BIGINT AS validation_shards
  FROM totals""",
        "pack_shards": PACKED,
        "stream_pack": PACKED,
        "shard_write_roundtrip": PACKED,
        "shard_table_roundtrip": PACKED,
        "shard_header_scan": f"""WITH {LAYOUT} SELECT shard_name, split, shard_index, (1024 + 2 * token_count)::BIGINT AS length,
    20240520::BIGINT AS magic, 1::BIGINT AS version, token_count::BIGINT AS token_count FROM layout""",
        "shard_discovery": f"WITH {LAYOUT} SELECT shard_name, split, shard_index FROM layout WHERE split = 'train'",
        "shard_validation": f"""WITH {LAYOUT} SELECT shard_name, w <> 6 AS found_ok, w < 5 AS header_ok, w NOT IN (1, 6) AS magic_ok,
    w NOT IN (2, 6) AS version_ok, w NOT IN (3, 6) AS count_ok, w < 4 AS payload_ok, w = 0 AS valid
  FROM (SELECT *, shard_index % 7 AS w FROM layout)""",
        "shard_faults": f"""WITH {DOCS}, {_tokens_sql('docs')}
  SELECT split, shard_index, CASE WHEN w = 0 THEN token_count END AS token_count,
    CASE WHEN w = 0 THEN sha256(array_to_string(tokens, ',')) END AS tokens_sha,
    CASE w WHEN 1 THEN 'magic_ok' WHEN 2 THEN 'version_ok' WHEN 3 THEN 'count_ok' WHEN 4 THEN 'payload_ok' WHEN 5 THEN 'header_ok'
      WHEN 6 THEN 'found_ok' END AS fault
  FROM (SELECT *, shard_index % 7 AS w FROM shards)""",
        "prepared_dataset": f"""WITH {OFFSETS}, taken AS (
  SELECT * FROM offs WHERE start < CASE split WHEN 'train' THEN {PREPARED['train']} ELSE {PREPARED['val']} END),
t AS (SELECT split, sum(n_tokens)::BIGINT AS tokens, ((sum(n_tokens) + {SHARD_SIZE} - 1) // {SHARD_SIZE})::BIGINT AS shards
  FROM taken GROUP BY split)
  SELECT 'documents' AS source_dataset, 'all' AS source_subset, 'bytes' AS tokenizer,
    'sha256(text), bucket 0 of 32 is validation' AS split_method, {PREPARED['train']}::BIGINT AS train_token_target,
    (sum(tokens) FILTER (split = 'train'))::BIGINT AS train_tokens, {PREPARED['val']}::BIGINT AS validation_token_target,
    (sum(tokens) FILTER (split = 'val'))::BIGINT AS validation_tokens, {SHARD_SIZE}::BIGINT AS shard_size,
    (sum(shards) FILTER (split = 'train'))::BIGINT AS train_shards, (sum(shards) FILTER (split = 'val'))::BIGINT AS validation_shards,
    sum(shards)::BIGINT AS files, sum(tokens)::BIGINT AS tokens FROM t""",
        "budget_shortfall": f"""WITH {DOCS} SELECT s AS split, 1000000000000::BIGINT AS target, coalesce(sum(n_tokens), 0)::BIGINT AS tokens,
    (1000000000000 - coalesce(sum(n_tokens), 0))::BIGINT AS missing, false AS written
  FROM (SELECT unnest(['train', 'val']) AS s) LEFT JOIN docs ON docs.split = s GROUP BY s""",
        "write_once": f"""WITH {LAYOUT} SELECT 'complete' AS case, 'kept shards of {SHARD_SIZE}' AS outcome, count(*) AS files,
    sum(token_count)::BIGINT AS tokens FROM layout
  UNION ALL SELECT 'partial', 'refused', count(*), sum(token_count)::BIGINT FROM layout WHERE split = 'val'""",
        "token_id_guard": """SELECT doc_id, len(ids)::BIGINT AS n_ids, list_max(ids) AS largest, coalesce(list_max(ids) <= 65535, true) AS fits FROM (
  SELECT doc_id, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: (('0x' || x)::INT + doc_id % 300 * 256)::INT) AS ids
  FROM documents)""",
        "shard_names": f"WITH {LAYOUT} SELECT shard_name, split, shard_index FROM layout",
        "undersized_shards": f"WITH {LAYOUT} SELECT split, shard_index, token_count FROM layout WHERE token_count < {STEP + 1}",
        "missing_shards": f"WITH {BUDGETED} SELECT w.shard_name FROM layout w ANTI JOIN budgeted l ON l.shard_name = w.shard_name",
        "token_windows": f"""WITH {DOCS}, {_tokens_sql('docs')}, {WINDOWS}
  SELECT split, shard_index, batch_in_shard, "row", {SHAS} FROM win""",
        "epoch_plan": f"WITH {_plan_sql(EPOCHS)} SELECT * FROM plan",
        "epoch_plan_general": f"WITH {_plan_sql(EPOCHS)} SELECT * FROM plan",
        "batch_ordinals": f"WITH {_plan_sql(EPOCHS)} SELECT * FROM ordinals",
        "batches": f'WITH {_batches_sql(1)} SELECT split, epoch, ordinal, "row", {SHAS} FROM drawn',
        "table_batches": f'WITH {_batches_sql(1)} SELECT split, epoch, ordinal, "row", {SHAS} FROM drawn',
        "eval_batches": f"""WITH {_batches_sql(1 + EVAL_STEPS)} SELECT split, epoch, ordinal, "row", {SHAS} FROM drawn
  WHERE split = 'val' AND ordinal < {EVAL_STEPS} + (SELECT sum(n_batches) FROM sized WHERE split = 'val')""",
        "batch_export": f"""WITH {_batches_sql(1)} SELECT ordinal, "row", inputs[1]::BIGINT AS first_input,
    targets[{LENGTH}]::BIGINT AS last_target, {SHAS} FROM drawn WHERE split = 'train'""",
        "step_plan": f"WITH {STEPS} SELECT * FROM step_rows",
        "step_cadence": f"""WITH {STEPS} SELECT update_step, micro_steps, update_step % {LOG_INTERVAL} = 0 AS log_due,
    update_step % {EVAL_INTERVAL} = 0 AS eval_due,
    update_step % {CHECKPOINT_INTERVAL} = 0 OR update_step = {TOTAL_STEPS} AS checkpoint_due FROM updates""",
        "lr_schedule": f"WITH {STEPS} SELECT update_step, tokens, round(learning_rate, 12) AS learning_rate FROM updates",
        "schedule_alignment": f"""WITH {STEPS}, {LOG}, rates AS (
  SELECT run_id, step, train_loss, coalesce(u.learning_rate, {_rate_sql(100)}) AS planned, coalesce(u.tokens, l.tokens) AS planned_tokens,
    CASE WHEN run_id::BIGINT % 2 = 1 THEN {_rate_sql(50)} ELSE {_rate_sql(100)} END AS used, l.tokens, u.micro_steps
  FROM log l LEFT JOIN updates u ON u.update_step = l.step)
  SELECT run_id, step, train_loss, round(planned, 12) AS planned_rate, round(round(used, 6) - planned, 12) AS rate_drift,
    (CASE WHEN run_id::BIGINT % 3 = 0 THEN tokens // 2 ELSE tokens END - planned_tokens)::BIGINT AS token_drift, micro_steps FROM rates""",
        "resume_batches": f"""WITH {_batches_sql(EPOCHS)} SELECT split, epoch, ordinal, "row", {SHAS} FROM drawn
  WHERE split = 'train' AND ordinal >= {DRAWN}""",
        "resume_equivalence": f"""WITH {_plan_sql(EPOCHS)} SELECT (count(*) * {BATCH})::BIGINT AS left_rows,
    (count(*) * {BATCH})::BIGINT AS right_rows, 0::BIGINT AS differing_rows FROM ordinals WHERE split = 'train'""",
        "stream_batches": f"""WITH {_batches_sql(2)},
  size AS (SELECT count(*) // 2 AS per_epoch FROM ordinals WHERE split = 'train')
  SELECT split, epoch, ordinal, "row", {SHAS} FROM drawn, size
  WHERE split = 'train' AND ordinal < per_epoch + per_epoch // 4""",
        "split_leakage": f"""WITH {DOCS} SELECT count(DISTINCT sha256(text)) FILTER (split = 'train') AS train_texts,
    count(DISTINCT sha256(text)) FILTER (split = 'val') AS val_texts,
    (SELECT count(*) FROM (SELECT sha256(text) FROM docs WHERE split = 'train' INTERSECT
      SELECT sha256(text) FROM docs WHERE split = 'val')) AS shared_texts
  FROM docs""",
        "metrics_trim": TRIMMED,
        "metrics_roundtrip": TRIMMED,
        "interval_loss": f"""WITH {MEANS} SELECT run_id, ((i + 1) * {LOG_INTERVAL})::BIGINT AS end_step,
    round(mean_loss, 9) AS mean_loss FROM means""",
        "latest_losses": f"""WITH {MEANS}, known AS (
  SELECT l.run_id, l.step, l.val_loss, m.mean_loss FROM log l LEFT JOIN means m
    ON m.run_id = l.run_id AND l.step % {LOG_INTERVAL} = 0 AND m.i = l.step // {LOG_INTERVAL} - 1)
  SELECT run_id, step, round(last_value(mean_loss IGNORE NULLS) OVER w, 9) AS latest_avg_loss,
    last_value(val_loss IGNORE NULLS) OVER w AS latest_val_loss
  FROM known WINDOW w AS (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
        "run_bounds": f"""WITH {LOG} SELECT run_id, min(step) AS first_step, max(step) AS last_step,
    arg_min(tokens, step) AS first_tokens, arg_min(train_loss, step) AS first_train_loss,
    max(CASE WHEN step = 1 THEN val_loss END) AS first_val_loss,
    arg_max(tokens, step) AS last_tokens, arg_max(train_loss, step) AS last_train_loss,
    max(CASE WHEN step = n THEN val_loss END) AS last_val_loss
  FROM (SELECT *, count(*) OVER (PARTITION BY run_id) AS n FROM log) GROUP BY run_id""",
        "validation_curve": f"WITH {LOG} SELECT run_id, step, val_loss FROM log WHERE val_loss IS NOT NULL",
        "eval_mean": f"""WITH {LOG} SELECT run_id, round(avg(train_loss), 9) AS mean_loss, count(train_loss) AS batches
  FROM log WHERE step - 1 < {EVAL_STEPS} GROUP BY run_id""",
        "update_loss_mean": f"""WITH {LOG} SELECT run_id, ((step - 1) // {ACCUMULATION} + 1)::BIGINT AS update_step,
    round(avg(train_loss), 9) AS mean_loss
  FROM log GROUP BY run_id, (step - 1) // {ACCUMULATION} HAVING count(*) = {ACCUMULATION}""",
    }
