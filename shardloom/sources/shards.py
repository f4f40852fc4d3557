"""Reading, writing and validating shard sets."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.names import header_word
from shardloom.functions.splits import check_split
from shardloom.operators.checks import shard_validity
from shardloom.plans.epochs import EpochOrder
from shardloom.session import freed_shuffles, scratch
from shardloom.sources.files import DriverFiles
from shardloom.sources.tokenshard import register

MANIFEST = "manifest.json"
TABLE_SCHEMA = "shard_index int, token_count int, tokens array<int>, split string"


def _source(spark: SparkSession, path: str, split: str | None, **options: str):
    register(spark)
    options["pushdown"] = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    if split is not None:
        options["split"] = check_split(split)
    return spark.read.format("tokenshard").options(**options).load(path)


def write_shards(shards: DataFrame, path: str, format: str = "tokenshard") -> None:
    """Write shards as binary files, or as Parquet partitioned by split."""
    columns = shards.select("split", "shard_index", "token_count", "tokens")
    if DriverFiles(shards.sparkSession, path).has_entries():
        raise FileExistsError(f"shard sets are written once; {path} is not empty")
    if format == "parquet":
        columns.write.mode("append").partitionBy("split").parquet(path)
    elif format == "tokenshard":
        register(shards.sparkSession)
        with freed_shuffles(shards.sparkSession):
            columns.write.format("tokenshard").mode("append").save(path)
    else:
        raise ValueError("format must be 'tokenshard' or 'parquet'")


def read_shards(
    spark: SparkSession, path: str, split: str | None = None, format: str = "tokenshard", faults: bool = False
) -> DataFrame:
    """``split, shard_index, token_count, tokens``, of one split or both; an error if there is none.

    With ``faults`` an unreadable file is no error but a row without tokens whose ``fault`` names the rule it breaks.
    """
    if split is not None:
        check_split(split)
    if format == "tokenshard":
        return _source(spark, path, split, **({"faults": "true"} if faults else {}))
    if format != "parquet":
        raise ValueError("format must be 'tokenshard' or 'parquet'")
    if not DriverFiles(spark, path).exists(f"split={split}" if split else ""):
        raise ValueError(f"No shards found in {path}")
    # The manifest lies in the same folder, hence the filter.
    table = spark.read.schema(TABLE_SCHEMA).option("pathGlobFilter", "*.parquet").parquet(path)
    table = table if split is None else table.filter(F.col("split") == split)
    return table.select("split", "shard_index", "token_count", "tokens")


def _batch_options(spark: SparkSession, path: str, split: str, batch_size: int, sequence_length: int, seed: int) -> dict:
    """Options that name the batches of a set. For one without a manifest the sizes of its shards are stored as a table."""
    register(spark)
    options = {"split": check_split(split), "batchsize": batch_size, "sequencelength": sequence_length, "seed": seed}
    if not DriverFiles(spark, path).exists(MANIFEST):
        options["sizespath"] = scratch(spark, "sizes")
        scan_headers(spark, path, split).select("split", "shard_index", "token_count").write.parquet(options["sizespath"])
    return options


def read_batches(
    spark: SparkSession, path: str, split: str, batch_size: int, sequence_length: int, seed: int = 32, first: int = 0, end: int | None = None, **options
) -> DataFrame:
    """Batches ``first <= ordinal < end`` (by default the first epoch of a complete set) of shard files, over as many epochs as that
    takes: ``split, epoch, ordinal, row, inputs, targets``.

    Tasks are ranges of batch numbers, which they resolve to byte offsets, so no token is shuffled and no plan is made.
    """
    fixed = _batch_options(spark, path, split, batch_size, sequence_length, seed)
    if end is None:
        end = EpochOrder.of_manifest(manifest_of(spark, path), split, batch_size, sequence_length, seed).per_epoch
    return spark.read.format("tokenshard").options(**fixed, firstordinal=first, untilordinal=end, **options).load(path)


def batch_stream(
    spark: SparkSession, path: str, split: str, batch_size: int, sequence_length: int, seed: int = 32, **options
) -> DataFrame:
    """The endless stream of these batches. Restarting with the same checkpoint goes on after the last batch drawn; see
    :class:`~shardloom.sources.tokenshard.BatchStreamReader` for ``options``.
    """
    fixed = _batch_options(spark, path, split, batch_size, sequence_length, seed)
    return spark.readStream.format("tokenshard").options(**fixed, **options).load(path)


def manifest_of(spark: SparkSession, path: str) -> dict:
    """The manifest of a complete set."""
    files = DriverFiles(spark, path)
    if not files.exists(MANIFEST):
        raise ValueError(f"no complete data set in {path}")
    return json.loads(files.read(MANIFEST))


def scan_headers(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Header fields of every shard file, from its first 1,024 bytes only. A file that cannot be read, or is missing from a
    complete set, is a row without length: no single file ends the scan."""
    raw = _source(spark, path, split, headers="true")
    return raw.select(
        "shard_name", "split", "shard_index", "length",
        header_word(F.col("header"), 0).alias("magic"), header_word(F.col("header"), 1).alias("version"),
        header_word(F.col("header"), 2).alias("token_count"),
    )


def validate_shards(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Validity of every shard, all checked up front."""
    return shard_validity(scan_headers(spark, path, split))


def require_valid(spark: SparkSession, path: str, split: str | None = None) -> None:
    """An error that counts all broken files by rule, and names the first one of each; None if every shard is sound."""
    checked = validate_shards(spark, path, split)
    rules = [c for c in checked.columns if c.endswith("_ok")]
    broken = F.coalesce(*(F.when(~F.col(rule), F.lit(rule)) for rule in rules))
    found = checked.filter("NOT valid").groupBy(broken.alias("rule")).agg(F.count("*").alias("files"), F.min("shard_name").alias("first"))
    rows = sorted(found.collect())  # one for each rule
    if rows:
        raise ValueError("unreadable shards: " + "; ".join(f"{r.rule} broken by {r.files}, first {r['first']}" for r in rows))
