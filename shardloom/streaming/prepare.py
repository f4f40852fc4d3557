"""Packing a stream of documents into shards, micro-batch by micro-batch.

Under ``root``: ``packed/batch=<id>/closed=<bool>/split=<split>`` holds the shards each micro-batch
finished and the open one it left; ``position.json`` names the last complete micro-batch and the tokens
so far. It is renamed into place after the shards are written, so a repeated micro-batch either finds its
own number there and does nothing, or overwrites what it had begun.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardloom.functions.splits import SPLITS
from shardloom.functions.tokenizers import pack_ids
from shardloom.operators.packing import assemble, pieces, place_documents, stored_counts
from shardloom.session import freed_shuffles
from shardloom.sources.files import DriverFiles

POSITION = "position.json"
ROW_GROUP_BYTES = 8 << 20
SHARDS = "shard_index int, token_count int, tokens array<int>, closed boolean, split string"
PACKED_SCHEMA = f"{SHARDS}, batch bigint"


def batch_folder(root: str, batch: int) -> str:
    return f"{root}/packed/batch={batch}"


def open_shards(spark: SparkSession, root: str, position: dict) -> DataFrame | None:
    """The shards that the last micro-batch left open, found by path alone; at most one for each split."""
    name = f"{batch_folder('', position['batch'])}/closed=false".lstrip("/")
    if position["batch"] < 0 or not DriverFiles(spark, root).exists(name):
        return None
    folder = f"{root}/{name}"
    return spark.read.schema("shard_index int, token_count int, tokens array<int>, split string").option("basePath", folder).parquet(folder)


def document_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Documents from a folder that files are added to in order of their keys."""
    return (
        spark.readStream.schema("doc_id bigint, text string")
        .option("maxFilesPerTrigger", max_files_per_trigger)
        .parquet(path)
    )


def position_of(spark: SparkSession, root: str) -> dict:
    files = DriverFiles(spark, root)
    if not files.exists(POSITION):
        return {"batch": -1, "last_key": None, "tokens": dict.fromkeys(SPLITS, 0)}
    return json.loads(files.read(POSITION))


def pack_micro_batch(
    documents: DataFrame, batch_id: int, root: str, tokenizer, shard_size: int, targets: dict[str, int] | None,
    order_key: str, text: str,
) -> None:
    """Pack the documents of one micro-batch behind those before it. What came before is two totals and, by path, the shards
    the last micro-batch left open, so the cost does not grow with what has been packed. Documents are read twice."""
    spark = documents.sparkSession
    position = position_of(spark, root)
    done = targets is not None and all(position["tokens"][s] >= targets[s] for s in SPLITS)
    if position["batch"] >= batch_id or done:
        return
    counts = stored_counts(documents, tokenizer, order_key, text)
    keys = counts.agg(F.min(order_key).alias("low"), F.max(order_key).alias("high")).first()
    if keys.low is None:
        return
    if position["last_key"] is not None and keys.low <= position["last_key"]:
        raise ValueError(f"documents out of order: key {keys.low} after {position['last_key']}")

    left = None if targets is None else {s: targets[s] - position["tokens"][s] for s in SPLITS}
    placed = place_documents(documents, counts, tokenizer, order_key, text, left)
    base = F.when(F.col("split") == "train", position["tokens"]["train"]).otherwise(position["tokens"]["val"])
    cut = pieces(placed.withColumn("start", F.col("start") + base), shard_size)
    still_open = open_shards(spark, root, position)
    if still_open is not None:
        # The open shard of each split, less than one shard of tokens, goes first.
        carried = still_open.select("split", "shard_index", F.lit(0).alias("lo"), pack_ids(F.col("tokens")).alias("piece"))
        cut = cut.unionByName(carried)
    shards = assemble(cut).withColumn("closed", F.col("token_count") == shard_size)
    # Rows of a group of rows are decoded together: small groups, or thousands of shards would be held as 32-bit numbers at once.
    with freed_shuffles(spark):
        shards.write.mode("overwrite").option("parquet.block.size", ROW_GROUP_BYTES).partitionBy("closed", "split").parquet(batch_folder(root, batch_id))

    end = F.max(F.col("shard_index").cast("bigint") * shard_size + F.col("token_count"))
    written = spark.read.schema(SHARDS).parquet(batch_folder(root, batch_id))
    totals = {r.split: r.tokens for r in written.groupBy("split").agg(end.alias("tokens")).collect()}
    position = {
        "batch": batch_id,
        "last_key": keys.high,
        "tokens": {s: totals.get(s, position["tokens"][s]) for s in SPLITS},
    }
    DriverFiles(spark, root).publish(POSITION, json.dumps(position))


def prepare_stream(
    documents: DataFrame,
    root: str,
    tokenizer,
    shard_size: int,
    targets: dict[str, int] | None = None,
    order_key: str = "doc_id",
    text: str = "text",
    **trigger,
) -> StreamingQuery:
    """Start packing a document stream under ``root``; by default until all that is there is packed.

    Documents must arrive in order of their keys from one micro-batch to the next; within one, they may
    come in any order. Once all budgets are met, further documents are passed over.
    """
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")

    def process(frame: DataFrame, batch_id: int) -> None:
        pack_micro_batch(frame, batch_id, root, tokenizer, shard_size, targets, order_key, text)

    return (
        documents.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def streamed_shards(spark: SparkSession, root: str, include_open: bool = True) -> DataFrame:
    """Shards packed so far; with the open one of each split, as at the end of a stream, or without."""
    last = position_of(spark, root)["batch"]
    wanted = F.col("closed") & (F.col("batch") <= last)
    if include_open:
        wanted = wanted | (~F.col("closed") & (F.col("batch") == last))
    return spark.read.schema(PACKED_SCHEMA).parquet(f"{root}/packed").filter(wanted).select("split", "shard_index", "token_count", "tokens")
