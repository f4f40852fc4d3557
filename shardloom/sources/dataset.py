"""Preparing a data set once: guard, budget, shards, manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.splits import SPLITS
from shardloom.operators.offsets import split_totals
from shardloom.operators.packing import assemble, document_counts, pieces, place_documents
from shardloom.session import scratch
from shardloom.sources.files import DriverFiles
from shardloom.sources.shards import MANIFEST, read_shards, scan_headers, write_shards

# Width of the first range of order keys that is counted, and how much wider each next one is.
FIRST_WAVE = 1 << 20
WAVE_GROWTH = 4


class Shortfall(RuntimeError):
    """All documents together do not meet the budget; ``reached`` has the tokens of each split."""

    def __init__(self, reached: dict[str, int], targets: dict[str, int]):
        self.reached, self.targets = dict(reached), dict(targets)
        super().__init__("too few documents: " + ", ".join(f"{s} has {reached[s]} of {targets[s]} tokens" for s in SPLITS))


def scan_documents(spark, path: str) -> DataFrame:
    """Documents as ``doc_id, text``; other columns are not read."""
    return spark.read.parquet(path).select("doc_id", "text")


def check_write_once(files: DriverFiles) -> bool:
    """True if the data set is complete; an error if the folder holds something without a manifest."""
    if files.exists(MANIFEST):
        return True
    if files.has_entries():
        raise RuntimeError("the folder holds a data set without a manifest, or something else")
    return False


def manifest_row(
    totals: DataFrame, shard_size: int, targets: dict[str, int], source: str, subset: str, tokenizer: str,
    num_buckets: int = 32,
) -> DataFrame:
    """The manifest as one row, from totals per split."""
    def of(split: str, column: str):
        return F.coalesce(F.sum(F.when(F.col("split") == split, F.col(column))), F.lit(0)).cast("bigint")

    return totals.agg(
        F.lit(source).alias("source_dataset"),
        F.lit(subset).alias("source_subset"),
        F.lit(tokenizer).alias("tokenizer"),
        F.lit(f"sha256(text), bucket 0 of {num_buckets} is validation").alias("split_method"),
        F.lit(targets["train"]).cast("bigint").alias("train_token_target"),
        of("train", "tokens").alias("train_tokens"),
        F.lit(targets["val"]).cast("bigint").alias("validation_token_target"),
        of("val", "tokens").alias("validation_tokens"),
        F.lit(shard_size).cast("bigint").alias("shard_size"),
        of("train", "shards").alias("train_shards"),
        of("val", "shards").alias("validation_shards"),
    )


def key_range(documents: DataFrame, order_key: str, low: int, high: int) -> DataFrame:
    """Documents ``low <= key < high``. The literal bounds reach the scan, which skips files and row groups."""
    return documents.filter((F.col(order_key) >= F.lit(low)) & (F.col(order_key) < F.lit(high)))


def prepare_dataset(
    documents: DataFrame,
    path: str,
    tokenizer,
    shard_size: int = 1_000_000,
    targets: dict[str, int] | None = None,
    order_key: str = "doc_id",
    text: str = "text",
    source: str = "documents",
    subset: str = "all",
    format: str = "tokenshard",
    first_wave: int = FIRST_WAVE,
) -> dict:
    """Split, tokenize, cut the budget, pack and write; the manifest comes last and marks success.

    Ranges of the order key, each wider than the one before, are counted until both budgets are met;
    later documents are never read again, nor tokenized at all. Counts are stored on the way, or the tokens of a
    tokenizer that cannot count, so that every document is hashed and tokenized once.
    """
    spark = documents.sparkSession
    targets = {"train": 60_000_000, "val": 2_000_000} if targets is None else targets
    if set(targets) != set(SPLITS):
        raise ValueError("need a target for train and for val")
    if shard_size < 1 or first_wave < 1:
        raise ValueError("shard_size and first_wave must be at least 1")
    files = DriverFiles(spark, path)
    if check_write_once(files):
        return json.loads(files.read(MANIFEST))

    documents = documents.select(order_key, text)
    bounds = documents.agg(F.min(order_key).alias("low"), F.max(order_key).alias("high")).first()
    counted = scratch(spark, "counts")
    reached = dict.fromkeys(SPLITS, 0)
    low = high = bounds.low if bounds.low is not None else 0
    end = bounds.high + 1 if bounds.high is not None else 0
    width = first_wave
    while high < end and any(reached[s] < targets[s] for s in SPLITS):
        high = min(end, low + width)
        open_splits = [s for s in SPLITS if reached[s] < targets[s]]
        rows = document_counts(key_range(documents, order_key, low, high), tokenizer, order_key, text)
        rows = rows.filter(F.col("split").isin(open_splits))
        rows.write.mode("append").parquet(counted)
        wave = key_range(spark.read.schema(rows.schema).parquet(counted), order_key, low, high)
        for row in wave.groupBy("split").agg(F.sum("n_tokens").alias("tokens")).collect():
            reached[row.split] += row.tokens
        low, width = high, width * WAVE_GROWTH
    if any(reached[s] < targets[s] for s in SPLITS):
        raise Shortfall(reached, targets)

    needed = key_range(documents, order_key, bounds.low, high) if bounds.low is not None else documents
    counts = spark.read.schema(document_counts(documents, tokenizer, order_key, text).schema).parquet(counted)
    shards = assemble(pieces(place_documents(needed, counts, tokenizer, order_key, text, targets), shard_size))
    return write_dataset(shards, path, shard_size, targets, source, subset, tokenizer.name, format)


def write_dataset(
    shards: DataFrame, path: str, shard_size: int, targets: dict[str, int | None] | None, source: str, subset: str, tokenizer: str,
    format: str = "tokenshard",
) -> dict:
    """Write shards and, once they are all there, the manifest. A complete set is left as it is. Without ``targets`` the set
    is a whole corpus, and the manifest names none."""
    spark = shards.sparkSession
    files = DriverFiles(spark, path)
    if check_write_once(files):
        return json.loads(files.read(MANIFEST))
    write_shards(shards, path, format)
    written = scan_headers(spark, path) if format == "tokenshard" else read_shards(spark, path, format=format)
    totals = split_totals(written.select("split", F.col("token_count").cast("bigint").alias("n_tokens")), shard_size)
    row = manifest_row(totals, shard_size, targets or dict.fromkeys(SPLITS), source, subset, tokenizer).first()
    manifest = row.asDict()
    files.publish(MANIFEST, json.dumps(manifest, indent=2))
    return manifest
