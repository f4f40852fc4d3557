"""Session-level helpers: a local session for tests and bench, and the shared scratch folder."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_BYTES, _BATCH_BYTES = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def ship_code() -> None:
    """Let this package's functions travel with the plan, so that workers need not have it installed."""
    cloudpickle.register_pickle_by_value(sys.modules["shardloom"])


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python tasks get by bytes: rows may be whole shards or long texts, and ten thousand of them
    come in a batch otherwise. A lower setting is kept."""
    held = spark.conf.get(_BATCH_BYTES, None) or ""
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """What is written inside removes its shuffle files once it is done: they would stay until the driver collects its garbage."""
    held = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if held is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, held)


def release_memory() -> None:
    """Give a task's freed memory back: an idle worker would keep it beside those that work."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # no GNU library: memory stays with the worker
        pass


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("shardloom")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        # Call sites of column functions, kept for error messages, take longer to find than most plans to run.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a local one only for local sessions without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="shardloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created there yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
