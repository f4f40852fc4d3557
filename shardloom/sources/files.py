"""Small files and folders: Hadoop file systems on the driver, Arrow file systems inside Python tasks."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark import SparkContext
from pyspark.sql import SparkSession


class DriverFiles:
    """The few driver-side file operations around a job, on whatever file system Spark reads."""

    def __init__(self, spark: SparkSession, folder: str):
        self._jvm = spark.sparkContext._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(folder)
        self._fs = self._folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(self._folder, name) if name else self._folder

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self.path(name))

    def has_entries(self) -> bool:
        return self.exists() and self._fs.listStatusIterator(self._folder).hasNext()

    def remove(self) -> None:
        self._fs.delete(self._folder, True)

    def read(self, name: str) -> str:
        stream = self._fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write beside the target, then rename over it: readers see the old file or the new one."""
        temporary = self.path(f".{name}.{uuid.uuid4().hex}.tmp")
        stream = self._fs.create(temporary, False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = SparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        context.rename(temporary, self.path(name), options)


def arrow_fs(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named by URI or absolute path; usable on any executor."""
    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    if "://" not in folder and not folder.startswith("/"):
        raise ValueError(f"need an absolute path or URI, got {folder!r}")
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, path.rstrip("/")
