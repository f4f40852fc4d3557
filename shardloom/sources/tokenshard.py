"""``format("tokenshard")``: the binary shard files as a Spark data source, batch and streaming.

Batch reads give one row per shard; ``headers=true`` gives the raw header instead and reads only
1,024 bytes per file. With ``batchsize`` rows are next-token batches, read by position: a partition is a range of batch
numbers, which its task resolves to files and offsets. A stream draws such batches endlessly over epochs.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition,
    WriterCommitMessage,
)

from shardloom.functions.names import (
    HEADER_BYTES, HEADER_WORDS, MAGIC, NAME_FORMAT, NAME_PATTERN, TOKEN_BYTES, VERSION,
)
from shardloom.functions.shuffle import permuted, round_keys
from shardloom.functions.splits import SPLITS, check_split
from shardloom.functions.tokenizers import MAX_TOKEN_ID
from shardloom.plans.epochs import EpochOrder
from shardloom.session import bound_batches, ship_code
from shardloom.sources.files import arrow_fs

SHARD_SCHEMA = "split string, shard_index int, token_count int, tokens array<int>"
FAULT_SCHEMA = SHARD_SCHEMA + ", fault string"
HEADER_SCHEMA = "shard_name string, split string, shard_index int, length bigint, header binary"
BATCH_SCHEMA = "split string, epoch int, ordinal bigint, row int, inputs array<int>, targets array<int>"
PARTITION_BYTES = 32 << 20
# Batches of a task, if not given: this many, or more where a read would have more tasks than this.
TASK_BATCHES, TASKS = 1024, 1000
HEADERS_PER_TASK = 256
WRITING = "_writing"


@dataclass(frozen=True)
class IndexRange:
    """Shards ``low <= index < high`` of a split."""

    split: str
    low: int
    high: int


def complete_set(folder: str) -> dict | None:
    """The manifest of a complete set. It tells which shards there are, so no folder need be listed."""
    fs, path = arrow_fs(folder)
    if fs.get_file_info(f"{path}/manifest.json").type != pafs.FileType.File:
        return None
    with fs.open_input_file(f"{path}/manifest.json") as stream:
        return json.loads(stream.read())


def manifest_shards(manifest: dict, split: str) -> tuple[int, int]:
    """Number of shards and of tokens of a split."""
    prefix = "train" if split == "train" else "validation"
    return manifest[f"{prefix}_shards"], manifest[f"{prefix}_tokens"]


def list_indexes(folder: str, split: str) -> list[int]:
    """Shard numbers of a split, from a listing of the folder."""
    fs, path = arrow_fs(folder)
    found = []
    for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        match = re.fullmatch(NAME_PATTERN.rstrip("$"), info.base_name)
        if match and info.is_file and match[1] == split:
            found.append(int(match[2]))
    return sorted(found)


def open_shard(fs: pafs.FileSystem, path: str, name: str):
    try:
        return fs.open_input_file(f"{path}/{name}")
    except FileNotFoundError:
        raise FileNotFoundError(f"Missing shard files: {name}") from None


def header_fault(raw: bytes, length: int) -> str | None:
    """The rule a shard's header breaks, by its name in ``header_checks``; None for a sound one."""
    if len(raw) < HEADER_BYTES:
        return "header_ok"
    magic, version, count = np.frombuffer(raw, dtype="<i4", count=3)
    if magic != MAGIC:
        return "magic_ok"
    if version != VERSION:
        return "version_ok"
    if count <= 0:
        return "count_ok"
    return "payload_ok" if length < HEADER_BYTES + TOKEN_BYTES * int(count) else None


FAULTS = {
    "header_ok": "its header is cut short", "magic_ok": "it does not begin as shards do", "version_ok": "its version is unknown",
    "count_ok": "its token count is below 1", "payload_ok": "it holds fewer tokens than its header says",
}


def header_of(raw: bytes, length: int, name: str) -> int:
    """Token count of a shard, or the reason why it cannot be read."""
    fault = header_fault(raw, length)
    if fault:
        raise ValueError(f"unreadable shard {name}: {FAULTS[fault]}")
    return int(np.frombuffer(raw, dtype="<i4", count=3)[2])


class ShardGroup(InputPartition):
    def __init__(self, ranges: list[IndexRange]):
        self.ranges = ranges


def index_runs(split: str, indexes: list[int]) -> list[IndexRange]:
    """Consecutive numbers as ranges."""
    runs = []
    for _, run in groupby(enumerate(indexes), lambda pair: pair[1] - pair[0]):
        held = [index for _, index in run]
        runs.append(IndexRange(split, held[0], held[-1] + 1))
    return runs


class ShardReader(DataSourceReader):
    """Shards or headers. With ``faults`` an unreadable file gives a row that names the broken rule, instead of an error."""

    def __init__(self, options: dict, headers: bool):
        self.folder = options["path"]
        self.splits = SPLITS if options.get("split") is None else (check_split(options["split"]),)
        self.target = int(options.get("partitionbytes", PARTITION_BYTES))
        self.headers, self.faults = headers, options.get("faults", "false").lower() == "true"

    def partitions(self) -> list[ShardGroup]:
        """Runs of shards of about ``partitionbytes``; of a complete set, without listing its files."""
        if not self.splits:
            return [ShardGroup([])]
        manifest = complete_set(self.folder)
        if manifest:
            size = HEADER_BYTES + TOKEN_BYTES * manifest["shard_size"]
            runs = [IndexRange(s, 0, manifest_shards(manifest, s)[0]) for s in self.splits]
        else:
            fs, path = arrow_fs(self.folder)
            runs = [run for s in self.splits for run in index_runs(s, list_indexes(self.folder, s))]
            size = fs.get_file_info(f"{path}/{NAME_FORMAT % (runs[0].split, runs[0].low)}").size if runs else 1
        runs = [run for run in runs if run.high > run.low]
        if not runs:
            raise ValueError(f"No shards found in {self.folder}")
        each = HEADERS_PER_TASK if self.headers else max(1, self.target // size)
        groups, room = [], 0
        for run in runs:
            low = run.low
            while low < run.high:
                if not room:
                    groups.append(ShardGroup([]))
                    room = each
                high = min(run.high, low + room)
                groups[-1].ranges.append(IndexRange(run.split, low, high))
                low, room = high, room - (high - low)
        return groups

    def read(self, partition: ShardGroup) -> Iterator[pa.RecordBatch]:
        fs, path = arrow_fs(self.folder)
        wanted = ((r.split, index) for r in partition.ranges for index in range(r.low, r.high))
        if self.headers:
            yield from self._headers(fs, path, wanted)
            return
        for split, index in wanted:
            name = NAME_FORMAT % (split, index)
            fault, count, ids = None, None, None
            try:
                with open_shard(fs, path, name) as stream:
                    raw = stream.read(HEADER_BYTES)
                    fault = header_fault(raw, stream.size()) if self.faults else None
                    if not fault:
                        count = header_of(raw, stream.size(), name)
                        ids = np.frombuffer(stream.read(TOKEN_BYTES * count), dtype="<u2").astype(np.int32)
            except OSError:
                if not self.faults:
                    raise
                fault = "found_ok"
            one_list = pa.array([None], pa.list_(pa.int32())) if ids is None else pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), pa.array(ids))
            columns = [pa.array([split]), pa.array([index], pa.int32()), pa.array([count], pa.int32()), one_list]
            names = ["split", "shard_index", "token_count", "tokens"]
            if self.faults:
                columns, names = [*columns, pa.array([fault], pa.string())], [*names, "fault"]
            yield pa.record_batch(columns, names=names)

    def _headers(self, fs: pafs.FileSystem, path: str, wanted) -> Iterator[pa.RecordBatch]:
        rows = {"shard_name": [], "split": [], "shard_index": [], "length": [], "header": []}
        for split, index in wanted:
            name = NAME_FORMAT % (split, index)
            try:
                with open_shard(fs, path, name) as stream:
                    values = name, split, index, stream.size(), stream.read(HEADER_BYTES)
            except OSError:  # missing or unreadable: a row without length and header
                values = name, split, index, None, None
            for column, value in zip(rows.values(), values, strict=True):
                column.append(value)
        types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.binary())
        yield pa.record_batch([pa.array(v, t) for v, t in zip(rows.values(), types, strict=True)], names=list(rows))


class PushdownShardReader(ShardReader):
    """Takes a filter on the split. Spark refuses readers with this method unless its setting allows them."""

    def pushFilters(self, filters):
        for item in filters:
            if isinstance(item, EqualTo) and item.attribute == ("split",):
                self.splits = tuple(s for s in self.splits if s == item.value)
            else:
                yield item


@dataclass
class Written(WriterCommitMessage):
    """What one task wrote, and the folder of its attempt that holds it."""

    attempt: str
    shards: int
    tokens: int


class ShardFileWriter(DataSourceArrowWriter):
    """One file per row, in two phases: each attempt of a task writes into a folder of its own; ``commit`` moves the files of
    the attempts that count into place, ``abort`` removes all. So a failed job leaves nothing behind, and neither a
    repeated nor a speculative attempt can be seen. What makes the set complete is the manifest, written after the job.

    Stores that move by copying write files in place: their content follows from the row alone, and a file shows only
    once it is closed.
    """

    def __init__(self, options: dict, overwrite: bool):
        if overwrite:
            raise ValueError("shard sets are written once; use mode('append') into an empty folder")
        self.folder, self.job = options["path"], uuid.uuid4().hex
        fs, path = arrow_fs(self.folder)
        if any(list_indexes(self.folder, split) for split in SPLITS):
            raise FileExistsError(f"shard sets are written once; {self.folder} holds one")
        fs.create_dir(path, recursive=True)

    @staticmethod
    def _moves(fs: pafs.FileSystem) -> bool:
        return isinstance(fs, (pafs.LocalFileSystem, pafs.HadoopFileSystem))

    def _job_folder(self, path: str) -> str:
        return f"{path}/{WRITING}-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, path = arrow_fs(self.folder)
        attempt = uuid.uuid4().hex
        target = path
        if self._moves(fs):
            target = f"{self._job_folder(path)}/{attempt}"
            fs.create_dir(target, recursive=True)
        shards = tokens = 0
        for batch in iterator:
            splits, indexes = batch.column("split").to_pylist(), batch.column("shard_index").to_pylist()
            lists = batch.column("tokens")
            for row, (split, index) in enumerate(zip(splits, indexes, strict=True)):
                ids = np.asarray(lists[row].values)
                check_split(split)
                if not len(ids):
                    continue
                if ids.min() < 0 or ids.max() > MAX_TOKEN_ID:
                    raise ValueError("token id outside 0..65535")
                header = np.zeros(HEADER_WORDS, dtype="<i4")
                header[:3] = MAGIC, VERSION, len(ids)
                with fs.open_output_stream(f"{target}/{NAME_FORMAT % (split, index)}") as stream:
                    stream.write(header.tobytes())
                    stream.write(ids.astype("<u2").tobytes())
                shards, tokens = shards + 1, tokens + len(ids)
        return Written(attempt, shards, tokens)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = arrow_fs(self.folder)
        if not self._moves(fs):
            return
        with ThreadPoolExecutor(32) as pool:
            for message in filter(None, messages):
                folder = f"{self._job_folder(path)}/{message.attempt}"
                names = [i.base_name for i in fs.get_file_info(pafs.FileSelector(folder)) if re.fullmatch(NAME_PATTERN, i.base_name)]
                if len(names) != message.shards:
                    raise RuntimeError(f"attempt {message.attempt} holds {len(names)} of {message.shards} shards: two rows share a name")
                list(pool.map(lambda name, folder=folder: fs.move(f"{folder}/{name}", f"{path}/{name}"), names))
        fs.delete_dir(self._job_folder(path))

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = arrow_fs(self.folder)
        if self._moves(fs):
            if fs.get_file_info(self._job_folder(path)).type == pafs.FileType.Directory:
                fs.delete_dir(self._job_folder(path))
            return
        for split in SPLITS:  # the folder held no shard before
            for index in list_indexes(self.folder, split):
                fs.delete_file(f"{path}/{NAME_FORMAT % (split, index)}")


class UnevenOrder:
    """Order of the batches of a split whose shards have any sizes: needs the size of each. Only tasks make one."""

    def __init__(self, indexes: np.ndarray, counts: np.ndarray, split: str, seed: int):
        self.indexes, self.counts, self.split, self.seed = indexes, counts, split, seed
        self.per_epoch = int(counts.sum())

    def name(self, shard: int) -> str:
        return NAME_FORMAT % (self.split, shard)

    def segments(self, start: int, end: int) -> Iterator[tuple[int, int, int, int, int]]:
        while start < end:
            epoch, at = divmod(start, self.per_epoch)
            order = np.arange(len(self.indexes))
            if self.split == "train":
                order = permuted(order, len(order), round_keys(self.seed, epoch), inverse=True)
            starts = np.concatenate([[0], np.cumsum(self.counts[order])])
            place = int(np.searchsorted(starts, at, side="right")) - 1
            while start < end and place < len(order):
                take = min(int(starts[place + 1]) - at, end - start)
                if take > 0:
                    yield int(self.indexes[order[place]]), epoch, start, at - int(starts[place]), take
                start, at, place = start + take, at + take, place + 1


def order_of(folder: str, sizes: str | None, split: str, size: int, length: int, seed: int) -> EpochOrder | UnevenOrder:
    """Order of a set: from its manifest alone, or else from a table of the sizes of its shards."""
    manifest = complete_set(folder)
    if manifest:
        return EpochOrder.of_manifest(manifest, split, size, length, seed)
    if not sizes:
        raise ValueError(f"{folder} has no manifest: give a table of shard sizes as sizespath")
    fs, path = arrow_fs(sizes)
    table = pads.dataset(path, filesystem=fs, format="parquet").to_table(columns=["shard_index", "token_count"], filter=pads.field("split") == split)
    if not len(table):
        raise ValueError(f"No shards found in {folder}")
    indexes, tokens = (table[c].to_numpy().astype(np.int64) for c in table.column_names)
    counts = np.maximum(tokens - 1, 0) // (size * length)
    if not counts.any():
        raise ValueError(f"No shard contains enough tokens for a batch of size {size * length + 1}")
    by_number = np.argsort(indexes)
    return UnevenOrder(indexes[by_number], counts[by_number], split, seed)


@dataclass
class Draw(InputPartition):
    """Batches ``low <= ordinal < high``."""

    low: int
    high: int


class BatchOptions:
    """What batch and streaming reads of batches share. The driver holds two numbers for each task, whatever the set's size."""

    def __init__(self, options: dict):
        self.folder, self.split = options["path"], check_split(options.get("split", "train"))
        self.size, self.length = int(options["batchsize"]), int(options["sequencelength"])
        if self.size < 1 or self.length < 1:
            raise ValueError("batchsize and sequencelength must be at least 1")
        self.first = int(options.get("firstordinal", 0))
        self.until = int(options["untilordinal"]) if "untilordinal" in options else None
        self.per_task = int(options["batchespertask"]) if "batchespertask" in options else None
        if (self.per_task is not None and self.per_task < 1) or self.first < 0:
            raise ValueError("batchespertask must be at least 1 and firstordinal 0 or more")
        self.seed = int(options.get("seed", 32))
        self.sizes = options.get("sizespath")

    def draws(self, low: int, high: int) -> list[Draw]:
        most = max(TASK_BATCHES, PARTITION_BYTES // (TOKEN_BYTES * self.size * self.length))
        each = self.per_task or min(max(TASK_BATCHES, -(-(high - low) // TASKS)), most)
        return [Draw(at, min(at + each, high)) for at in range(low, high, each)]

    def read(self, partition: Draw) -> Iterator[pa.RecordBatch]:
        fs, path = arrow_fs(self.folder)
        size, length = self.size, self.length
        step = size * length
        order = order_of(self.folder, self.sizes, self.split, size, length, self.seed)
        for shard, epoch, ordinal, first, batches in order.segments(partition.low, partition.high):
            name = order.name(shard)
            with open_shard(fs, path, name) as stream:
                count = header_of(stream.read(HEADER_BYTES), stream.size(), name)
                if count < (first + batches) * step + 1:
                    raise ValueError(f"{name} holds fewer tokens than the data set was planned with")
                stream.seek(HEADER_BYTES + TOKEN_BYTES * first * step)
                raw = stream.read(TOKEN_BYTES * (batches * step + 1))
            ids = np.frombuffer(raw, dtype="<u2").astype(np.int32)
            rows = batches * size
            bounds = pa.array(np.arange(rows + 1, dtype=np.int32) * length)
            yield pa.record_batch(
                [
                    pa.array([self.split] * rows),
                    pa.array(np.full(rows, epoch, np.int32)),
                    pa.array(ordinal + np.repeat(np.arange(batches, dtype=np.int64), size)),
                    pa.array(np.tile(np.arange(size, dtype=np.int32), batches)),
                    pa.ListArray.from_arrays(bounds, pa.array(ids[:-1])),
                    pa.ListArray.from_arrays(bounds, pa.array(ids[1:])),
                ],
                names=["split", "epoch", "ordinal", "row", "inputs", "targets"],
            )


class BatchReader(BatchOptions, DataSourceReader):
    """Batches ``firstordinal <= ordinal < untilordinal``."""

    def partitions(self) -> list[Draw]:
        if self.until is None or self.until < self.first:
            raise ValueError("give an untilordinal of firstordinal or more")
        return self.draws(self.first, self.until) or [Draw(self.first, self.first)]


class BatchStreamReader(BatchOptions, DataSourceStreamReader):
    """Endless batches. The offset is the ordinal of the next batch.

    A run ends at ``untilordinal`` if given. With ``batchespertrigger`` every micro-batch takes that many
    batches; where the last one ended is then kept in ``progresspath``, as a reader is not told where a
    restarted query stands before it must name the next offset.
    """

    def __init__(self, options: dict):
        super().__init__(options)
        self.pace = int(options["batchespertrigger"]) if "batchespertrigger" in options else None
        self.progress = options.get("progresspath")
        if self.until is None and self.pace is None:
            raise ValueError("give untilordinal, batchespertrigger or both")
        if self.pace is not None and not self.progress:
            raise ValueError("batchespertrigger needs progresspath")

    def _planned(self) -> int:
        fs, path = arrow_fs(self.progress)
        if fs.get_file_info(f"{path}/next.json").type == pafs.FileType.NotFound:
            return self.first
        with fs.open_input_file(f"{path}/next.json") as stream:
            return json.loads(stream.read())["ordinal"]

    def initialOffset(self) -> dict:
        return {"ordinal": self.first}

    def latestOffset(self) -> dict:
        end = self.until
        if self.pace is not None:
            end = self._planned() + self.pace
            end = end if self.until is None else min(end, self.until)
        return {"ordinal": max(end, self.first)}

    def partitions(self, start: dict, end: dict) -> list[Draw]:
        if self.progress:
            fs, path = arrow_fs(self.progress)
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/.next.json.tmp") as stream:
                stream.write(json.dumps(end).encode())
            fs.move(f"{path}/.next.json.tmp", f"{path}/next.json")
        return self.draws(start["ordinal"], end["ordinal"])


class TokenShardSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenshard"

    def __init__(self, options):
        # Option names arrive as the user wrote them; Spark treats them as case-insensitive.
        self.options = {k.lower(): v for k, v in dict(options).items()}

    @property
    def headers(self) -> bool:
        return self.options.get("headers", "false").lower() == "true"

    def schema(self) -> str:
        if "batchsize" in self.options:
            return BATCH_SCHEMA
        if self.headers:
            return HEADER_SCHEMA
        return FAULT_SCHEMA if self.options.get("faults", "false").lower() == "true" else SHARD_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        if "batchsize" in self.options:
            return BatchReader(self.options)
        pushdown = self.options.get("pushdown", "false").lower() == "true"
        return (PushdownShardReader if pushdown else ShardReader)(self.options, self.headers)

    def writer(self, schema, overwrite: bool) -> ShardFileWriter:
        return ShardFileWriter(self.options, overwrite)

    def streamReader(self, schema) -> BatchStreamReader:
        return BatchStreamReader(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("tokenshard")`` known to a session."""
    ship_code()
    bound_batches(spark)
    spark.dataSource.register(TokenShardSource)
