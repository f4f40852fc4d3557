"""Token-id files in bit planes: compact, exact, readable by chunk.

A file holds the ids of consecutive documents. Ids are cut into chunks of fixed size; a chunk is transposed
into bit planes (plane ``j`` has bit ``j`` of every id), each compressed by zstandard on its own, since high planes
are nearly constant and low ones nearly random. Behind the chunks stand the documents' keys and id counts, the
index of the chunks (offset, ids, size of each plane), its own length, and a magic number, so a reader needs
the end of a file and whatever chunks it wants.

Files are in key order: quantiles of the key, from a scan of that column alone, bound the parts, so tokens move
once, packed, and each part is one file. Files are written under another name and then moved, so a repeated task leaves
the same file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.bpe import SLAB, vocabulary
from shardloom.llm.tables import load, map_arrow, shuffle_partitions, stored
from shardloom.llm.words import slabs
from shardloom.session import scratch
from shardloom.sources.files import arrow_fs

PACKED = "part int, key bigint, data binary"
MAGIC, CHUNK, LEVEL = b"SLBITPL1", 1 << 16, 1
_NO_KEY = np.iinfo(np.int64).min


def pack_planes(ids: np.ndarray) -> list[bytes]:
    """Compressed bit planes of unsigned 32-bit ids, lowest bit first; as many as the largest id needs."""
    squeeze = zstandard.ZstdCompressor(level=LEVEL)
    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    kind = np.uint16 if width <= 16 else np.uint32
    bits = np.unpackbits(ids.astype(kind).view(np.uint8).reshape(len(ids), -1), axis=1, bitorder="little", count=width)
    return [squeeze.compress(p.tobytes()) for p in np.packbits(bits.T, axis=1, bitorder="little")]


def unpack_planes(planes: list[bytes], count: int) -> np.ndarray:
    open_ = zstandard.ZstdDecompressor()
    bits = np.array([np.unpackbits(np.frombuffer(open_.decompress(p), np.uint8), bitorder="little", count=count) for p in planes])
    out = np.zeros((count, 32), np.uint8)
    out[:, : len(planes)] = bits.T
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


class FileWriter:
    """One file, written as documents come."""

    def __init__(self, folder: str, name: str):
        self.fs, base = arrow_fs(folder)
        self.temporary, self.path = f"{base}/.{name}.{uuid.uuid4().hex}", f"{base}/{name}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.held, self.size, self.at = [], 0, 0
        self.chunks: list[list] = []
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.tokens = 0

    def add(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.held.append(ids)
        self.size += len(ids)
        self.tokens += len(ids)
        if self.size >= CHUNK:
            ids = np.concatenate(self.held)
            whole = len(ids) // CHUNK * CHUNK
            for i in range(0, whole, CHUNK):
                self._chunk(ids[i : i + CHUNK])
            self.held, self.size = [ids[whole:]], len(ids) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = pack_planes(ids)
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        self._write(b"".join(planes))

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> tuple[int, int, int]:
        if self.size:
            self._chunk(np.concatenate(self.held))
        keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        tables = [squeeze.compress(x.astype("<i8").tobytes()) for x in (keys, counts)]
        index = {"chunks": self.chunks, "documents": len(keys), "tokens": self.tokens, "tables": [self.at, *map(len, tables)]}
        self._write(b"".join(tables))
        raw = squeeze.compress(json.dumps(index).encode())
        self._write(raw + struct.pack("<Q", len(raw)) + MAGIC)
        self.out.close()
        self.fs.move(self.temporary, self.path)
        return len(keys), self.tokens, self.at


def read_index(fs, path: str) -> dict:
    with fs.open_input_file(path) as file:
        size = file.size()
        length, magic = struct.unpack("<Q8s", file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        return json.loads(zstandard.ZstdDecompressor().decompress(file.read_at(length, size - 16 - length)))


def read_file(fs, path: str, batch: int = 1 << 20):
    """``keys, starts, counts, ids`` of a file's documents, several at a time; ``starts`` count ids from the file's first."""
    index = read_index(fs, path)
    expand = zstandard.ZstdDecompressor()
    with fs.open_input_file(path) as file:
        at, *sizes = index["tables"]
        keys, counts = (
            np.frombuffer(expand.decompress(file.read_at(n, at + sum(sizes[:i]))), "<i8") for i, n in enumerate(sizes)
        )
        ends = np.cumsum(counts)
        held, have, done, doc = [], 0, 0, 0
        for offset, n, planes in index["chunks"] + [[0, 0, []]]:
            if n:
                raw, cut = file.read_at(sum(planes), offset), np.r_[0, np.cumsum(planes)]
                held.append(unpack_planes([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], n))
                have += n
            if have < batch and n:
                continue
            upto = int(np.searchsorted(ends, done + have, side="right"))
            if upto > doc:
                ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
                used = int(ends[upto - 1] - done)
                yield keys[doc:upto], (ends - counts)[doc:upto], counts[doc:upto], ids[:used]
                held, have, done, doc = [ids[used:]], have - used, done + used, upto


def _packed(keys: pa.Array, lists: list[np.ndarray], bounds: list[int]) -> pa.RecordBatch:
    """Part, key and ids of documents; ids take two bytes each where all of a document's fit, behind a byte that says so."""
    data = []
    for x in lists:
        small = not len(x) or int(x.max()) < 1 << 16
        data.append((b"\x02" if small else b"\x04") + x.astype("<u2" if small else "<u4").tobytes())
    keys = (keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys).fill_null(_NO_KEY)
    part = np.searchsorted(np.array(bounds, np.int64), keys.to_numpy(), side="right")
    return pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "key": keys, "data": pa.array(data, pa.binary())})


def pack_ids(tokens: DataFrame, bounds: list[int], key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Rows for :func:`write_packed` from lists of ids; ``bounds`` are ascending keys at which a new part begins."""

    def task(batches):
        for batch in batches:
            column = batch.column(1)
            flat, at = column.flatten().to_numpy(), column.offsets.to_numpy().astype(np.int64) - column.offsets[0].as_py()
            yield _packed(batch.column(0), [flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], bounds)

    return map_arrow(tokens.select(F.col(key).cast("bigint").alias("key"), ids), task, PACKED)


def pack_texts(docs: DataFrame, bounds: list[int], key: str, text: str, end: int, path: str | None) -> DataFrame:
    """The same from texts, encoded on the way, each with ``end`` behind it."""

    def task(batches):
        words = vocabulary(path)
        for rest, texts in slabs(batches, text, SLAB):
            ids, counts = words.encode(texts)
            at = np.r_[0, np.cumsum(counts)]
            yield _packed(rest.column(0), [np.append(ids[a:b], end) for a, b in zip(at[:-1], at[1:], strict=True)], bounds)

    return map_arrow(docs.select(F.col(key).cast("bigint").alias("key"), text), task, PACKED)


def write_packed(packed: DataFrame, folder: str, parts: int) -> DataFrame:
    """Write packed rows to ``folder`` in key order (null keys first, ties by ids) and return one row for each file:
    ``part, name, documents, tokens, bytes``."""
    arrow_fs(folder)[0].create_dir(arrow_fs(folder)[1], recursive=True)

    def write(batches):
        file, part = None, None

        def closed():
            documents, count, size = file.close()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "name": [file.path.rpartition("/")[2]], "documents": [documents], "tokens": [count], "bytes": [size]})

        for batch in batches:
            owner, keys, data = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            lists = [np.frombuffer(d, "<u2" if d[0] == 2 else "<u4", offset=1) for d in data]
            cuts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else []
            for a, b in zip(cuts, [*cuts[1:], len(owner)], strict=True):
                if owner[a] != part:
                    if file:
                        yield closed()
                    part = int(owner[a])
                    file = FileWriter(folder, f"part-{part:06d}.slbp")
                file.add(keys[a:b], np.array([len(x) for x in lists[a:b]]), np.concatenate(lists[a:b]).astype(np.uint32))
        if file:
            yield closed()

    placed = packed.repartition(parts, "part").sortWithinPartitions("part", "key", "data")
    return stored(map_arrow(placed, write, "part int, name string, documents bigint, tokens bigint, bytes bigint"), "files")


def read_token_files(files: DataFrame, folder: str) -> DataFrame:
    """``key, start, ids`` of every document in the files; ``start`` counts all ids before it, over all files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row for each file
    based = files.select("part", "name", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"))
    parts = shuffle_partitions(files)

    def task(batches):
        fs, base = arrow_fs(folder)
        for batch in batches:
            for row in batch.to_pylist():
                for keys, starts, counts, ids in read_file(fs, f"{base}/{row['name']}"):
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids.astype(np.int64)))
                    keyed = pa.array(keys, mask=keys == _NO_KEY)
                    yield from pa.table({"key": keyed, "start": starts + row["base"], "ids": lists}).to_batches(max_chunksize=4096)

    return map_arrow(based.repartition(parts, "part"), task, "key bigint, start bigint, ids array<bigint>")


def tokens_to_files(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "text", end: int = 0, path: str | None = None) -> DataFrame:
    """Encode all texts, add ``end`` to each, and write them. Null and empty texts are the end id alone. Returns the files."""
    parts = shuffle_partitions(docs)
    cuts = docs.agg(F.percentile_approx(F.col(key).cast("bigint"), [i / parts for i in range(1, parts)], 20 * parts).alias("q")).first().q if parts > 1 else []
    return write_packed(pack_texts(docs, sorted(set(cuts or [])), key, text, end, path), folder, parts)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "tokens")
    files = tokens_to_files(load(spark, sf_dir, "documents", "doc_id", "text"), folder)

    def digest(batches):
        for batch in batches:
            column = batch.column(2)
            raw, at = column.flatten().to_numpy().astype("<u4").tobytes(), column.offsets.to_numpy().astype(np.int64)
            at = (at - at[0]).tolist()
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), "start": batch.column(1), "n_tokens": np.diff(at).astype(np.int64),
                "ids_crc32": pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
            })

    return map_arrow(read_token_files(files, folder), digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
