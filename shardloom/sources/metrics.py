"""Metric logs: JSON lines. A trainer's log is a folder per run; what is written here holds many runs in a file, whose records
name theirs, so the number of files and folders grows with the records and not with the runs.

A log that has been trimmed is a version: a folder of its own under ``_log``, which the file ``_current`` names. Trimming writes a new
version and then replaces that file, in one step; so a reader finds the old log or the new one, wherever a trim stops.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.operators.runlog import trim
from shardloom.sources.files import DriverFiles

RECORD_SCHEMA = (
    "step bigint, tokens bigint, train_loss double, val_loss double, learning_rate double, gradient_norm double"
)
# Steps of a run per written file.
FILE_STEPS = 1_000_000
RECORD_COLUMNS = [field.split()[0] for field in RECORD_SCHEMA.split(", ")]


CURRENT, VERSIONS = "_current", "_log"
# Field of a record that names its run, and what a run without a name is called.
RUN, NAMELESS = "_run", "__HIVE_DEFAULT_PARTITION__"


def current_log(spark: SparkSession, path: str) -> str:
    """Folder of the version in use: ``path`` itself as long as nothing was trimmed."""
    files = DriverFiles(spark, path)
    return f"{path.rstrip('/')}/{VERSIONS}/{files.read(CURRENT)}" if files.exists(CURRENT) else path


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Records of all runs under ``path`` (``<run>/*.jsonl``, or files Spark wrote: of any runs, or under ``run_id=<run>``), with
    ``run_id``. Other files of a run's folder, such as its config, are passed over.

    Blank lines are skipped; a malformed line fails the read.
    """
    lines = (
        spark.read.schema(f"{RUN} string, {RECORD_SCHEMA}")
        .options(mode="FAILFAST", recursiveFileLookup="true", pathGlobFilter="{*.jsonl,part-*.json*}")
        .json(current_log(spark, path))
    )
    # The path is an encoded URI; in it, Spark's own partition folders are encoded once more.
    folder = _decoded(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]*$", 1))
    value = _decoded(F.regexp_replace(folder, "^run_id=", ""))
    return lines.select(F.coalesce(RUN, F.when(folder.startswith("run_id="), value).otherwise(folder)).alias("run_id"), *RECORD_COLUMNS)


def _decoded(text):
    """Percent-decoded text. ``url_decode`` reads forms, where a plus is a space; in paths it is a plus."""
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def append_metrics(records: DataFrame, path: str) -> None:
    """Append records to the logs of their runs. A missing loss is written as null."""
    name = F.when(F.col("run_id") != "", F.col("run_id")).otherwise(NAMELESS).alias(RUN)
    rows = records.select(name, *RECORD_COLUMNS)
    # A run lies in few files, yet no run whole in one task.
    rows = rows.repartition(RUN, F.call_function("div", F.col("step"), F.lit(FILE_STEPS)))
    rows.write.mode("append").option("ignoreNullFields", "false").json(current_log(records.sparkSession, path))


def sync_metrics(spark: SparkSession, path: str, saved: DataFrame) -> str | None:
    """Drop records past the saved step of their run, as a resumed run must. 0 empties a run's log.

    The trimmed log is written as a new version, which then takes the old one's place at once. A trim that was stopped leaves a
    version that nothing names; trimming again starts afresh. Returns the folder of the old version; None if there was no log.
    """
    files = DriverFiles(spark, path)
    if not files.exists():
        return None
    before, version = current_log(spark, path), uuid.uuid4().hex
    append_metrics(trim(read_metrics(spark, path), saved), f"{path.rstrip('/')}/{VERSIONS}/{version}")
    files.publish(CURRENT, version)
    return before
