"""Removal of repeated passages: every window of ``width`` words whose sequence also starts earlier.

Every window is hashed (Rabin-Karp, from prefix sums). Within a slab of texts only the first place of a hash
is open; its later places are repeated whatever other tasks hold, so a hot passage sends one row per slab, not
one per text. Open places go to the bucket of their hash in packed form: hashes as they are, texts and
places as differences in byte planes, which compress to little; that is about ten bytes a window instead of
the thirty-odd of a row. Each bucket finds the first place of every hash; the other places go back to their
texts, where overlapping windows merge into maximal intervals.

Two different windows of one hash would be taken for repeats. Windows are told apart by 64 bits of one hash and by their
bucket, which an independent hash chooses: among ``w`` windows in ``b`` buckets about ``w**2 / (2**65 * b)`` are false, some
0.003 on 30 GB (5e9 windows, 200 buckets); as buckets grow with the input, the share of false windows does not.

Texts that lose nothing, most of them, are not shuffled: a bit map tells them from those that meet their removals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.tables import BitMap, bit_map, free_name, from_planes, load, map_arrow, planes, shuffle_partitions, stored
from shardloom.llm.words import SPACED, mix, slabs, split_words

WIDTH = 20
_NO_KEY = np.iinfo(np.int64).min
PACKED = pa.schema([
    ("bucket", pa.int32()), ("hashes", pa.binary()), ("keys", pa.binary()), ("tags", pa.binary()), ("counts", pa.binary()), ("places", pa.binary()),
])
PACKED_DDL = "bucket int, hashes binary, keys binary, tags binary, counts binary, places binary"


def pack(bucket, hashes, keys, tags, places):
    """One row for each bucket, of entries ordered by bucket, key, tag and place. ``hashes`` may be None."""
    if not len(bucket):
        return
    cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
        k, t, p = keys[a:b], tags[a:b], places[a:b]
        new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (t[1:] != t[:-1])])
        row = [
            int(bucket[a]), None if hashes is None else hashes[a:b].tobytes(), planes(np.diff(k[new], prepend=np.int64(0))), planes(t[new]),
            planes(np.diff(np.r_[new, b - a]).astype(np.uint32)), planes(np.diff(p, prepend=0).astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, PACKED, strict=True)], schema=PACKED)


def unpack(held: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, tags and places of the entries of several rows."""
    counts = [from_planes(r["counts"], np.uint32).astype(np.int64) for r in held]
    keys = np.concatenate([np.repeat(np.cumsum(from_planes(r["keys"], np.int64)), c) for r, c in zip(held, counts, strict=True)])
    tags = np.concatenate([np.repeat(from_planes(r["tags"], np.int64), c) for r, c in zip(held, counts, strict=True)])
    return keys, tags, np.concatenate([np.cumsum(from_planes(r["places"], np.int32)) for r in held])


def grouped(batches, keep):
    """Rows of a task, sorted by bucket, as one list for each bucket; ``keep`` gives the rows of a batch to take."""
    held, bucket = [], None
    for batch in batches:
        for row in keep(batch).to_pylist():
            if row["bucket"] != bucket and held:
                yield held
                held = []
            bucket = row["bucket"]
            held.append(row)
    if held:
        yield held


def text_tags(keys: np.ndarray, texts: list[bytes], repeated: BitMap) -> np.ndarray:
    """Tells different texts of one key apart: 64 bits of a digest. Texts of a key that no other row has need none."""
    out = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero(repeated.holds(mix(keys.view(np.uint64)))):
        out[i] = int.from_bytes(hashlib.blake2b(texts[i], digest_size=8).digest(), "little", signed=True)
    return out


def repeated_keys(docs: DataFrame, key: str) -> BitMap:
    """Keys of several rows. Only the key column is read."""
    k = F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY)).alias("key")

    def hashed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], names=["h"])

    several = docs.select(k).groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return bit_map(stored(map_arrow(several, hashed, "h bigint"), "repeated"))


def text_hash(keys: np.ndarray, tags: np.ndarray) -> np.ndarray:
    return mix(keys.view(np.uint64) ^ mix(tags.view(np.uint64)))


def _by_text(keys, tags, starts, buckets: int):
    """Packed rows of starts, bucketed by text; input in any order."""
    bucket = (text_hash(keys, tags) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.lexsort((starts, tags, keys, bucket))
    yield from pack(bucket[order], None, keys[order], tags[order], starts[order])


def _repeats(hashes, keys, tags, places) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the first place of each hash, and of all places that are later than the first of theirs."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = np.r_[False, ranked[1:] == ranked[:-1]]
    several = same.copy()
    several[:-1] |= same[1:]
    alone = order[~several]
    if not several.any():
        return alone, np.zeros(0, np.int64)
    some = order[several]
    some = some[np.lexsort((places[some], tags[some], keys[some], hashes[some]))]
    new = np.r_[True, hashes[some][1:] != hashes[some][:-1]]
    first = some[new][np.cumsum(new) - 1]
    place = (keys[some] == keys[first]) & (tags[some] == tags[first]) & (places[some] == places[first])
    return np.concatenate([alone, some[new]]), some[~new & ~place]


def repeated_windows(docs: DataFrame, key: str, text: str, width: int, repeated: Broadcast) -> DataFrame:
    """``key, tag, h, starts``: windows (first words as 32-bit numbers, ascending) that also start earlier; a row for each text with any."""
    buckets = shuffle_partitions(docs, 2.0)

    def scan(batches):
        for rest, texts in slabs(batches, text):
            slab = split_words(texts, SPACED, lower=False)
            begin, hashes = slab.windows(width)
            if not len(begin):
                continue
            doc_keys = rest.column(0).combine_chunks().fill_null(_NO_KEY).to_numpy()
            doc_tags = text_tags(doc_keys, texts, repeated.value)
            doc, places = slab.doc[begin], begin - slab.first[slab.doc[begin]]
            first, later = _repeats(hashes, doc_keys[doc], doc_tags[doc], places)
            yield from _by_text(doc_keys[doc[later]], doc_tags[doc[later]], places[later], buckets)
            first.sort()
            bucket = (mix(slab.other_hashes(begin[first], width)) >> np.uint64(33)).astype(np.int64) % buckets
            by_bucket = np.argsort(bucket, kind="stable")
            first, bucket = first[by_bucket], bucket[by_bucket]
            yield from pack(bucket, hashes[first], doc_keys[doc[first]], doc_tags[doc[first]], places[first])

    def join(batches):
        passing = []

        def keep(batch):
            passing.append(batch.filter(batch.column("hashes").is_null()))
            return batch.filter(batch.column("hashes").is_valid())

        for held in grouped(batches, keep):
            yield from passing
            passing.clear()
            keys, tags, places = unpack(held)
            later = _repeats(np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in held]), keys, tags, places)[1]
            yield from _by_text(keys[later], tags[later], places[later], buckets)
        yield from passing

    def gather(batches):
        for held in grouped(batches, lambda batch: batch):
            keys, tags, starts = unpack(held)
            order = np.lexsort((starts, tags, keys))
            keys, tags, starts = keys[order], tags[order], starts[order].astype(np.int32)
            new = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (tags[1:] != tags[:-1])])
            offsets = (np.r_[new, len(keys)] * 4).astype(np.int32)
            data = pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(offsets), pa.py_buffer(starts)])
            hashes = text_hash(keys[new], tags[new]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[new]), pa.array(tags[new]), pa.array(hashes), data], names=["key", "tag", "h", "starts"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), text)
    places = map_arrow(rows, scan, PACKED_DDL).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    texts = map_arrow(places, join, PACKED_DDL).repartition(buckets, "bucket").sortWithinPartitions("bucket")
    return map_arrow(texts, gather, "key bigint, tag bigint, h bigint, starts binary")


def covered_words(counts: np.ndarray, starts: list[bytes | None], width: int) -> np.ndarray:
    """Mask over the words of a slab: those within a window that begins at one of ``starts``."""
    first = np.r_[0, np.cumsum(counts)]
    change = np.zeros(first[-1] + 1, np.int64)
    for base, data in zip(first[:-1], starts, strict=True):
        if data:
            at = base + np.unique(np.frombuffer(data, np.int32))
            change[at] += 1
            change[at + width] -= 1
    return np.cumsum(change[:-1]) > 0


def with_starts(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """``docs`` and a last column, ``_starts`` or the like: all removed windows of the text, null for none.

    Texts that a bit map rules out stay where they are; the others are joined with their windows."""
    k, t, mark, maybe, starts = (free_name(docs, n) for n in ("_k", "_t", "_tag", "_maybe", "_starts"))
    context = docs.sparkSession.sparkContext
    repeated = context.broadcast(repeated_keys(docs, key))
    found = stored(repeated_windows(docs, key, text, width, repeated), "windows")
    touched = context.broadcast(bit_map(found.select("h")))
    names = [f.name for f in docs.schema]
    side = found.select(F.col("key").alias(k), F.col("tag").alias(t), F.col("starts").alias(starts))

    def tag(batches):
        for batch in batches:
            texts = [t or b"" for t in batch.column(text).cast(pa.binary()).to_pylist()]
            keys = batch.column(key).cast(pa.int64()).fill_null(_NO_KEY).to_numpy()
            tags = text_tags(keys, texts, repeated.value)
            arrays = [*batch.columns, pa.array(tags), pa.array(touched.value.holds(text_hash(keys, tags)))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, mark, maybe])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    tagged = map_arrow(docs, tag, f"{fields}, {mark} bigint, {maybe} boolean")
    same = (F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_KEY)) == F.col(k)) & (F.col(mark) == F.col(t))
    columns = [F.col("`" + n.replace("`", "``") + "`") for n in names]
    joined = tagged.where(maybe).join(side, same, "left").select(*columns, starts)
    return tagged.where(~F.col(maybe)).select(*columns, F.lit(None).cast("binary").alias(starts)).unionAll(joined)


def removal_report(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """Per row: ``key``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``intervals`` (removed words as
    ``[first, last)`` pairs, maximal and ascending).

    Words are ``[^\\x20\\x09-\\x0D]+``. Null texts have no words; texts under ``width`` words lose none. Earlier means
    a smaller key (null keys first), then for different texts of one key the smaller digest, then the earlier
    start; identical repeated rows are one text. Other columns are not read.
    """

    def task(batches):
        for rest, texts in slabs(batches, text):
            slab = split_words(texts, SPACED, lower=False, hashed=False)
            gone = covered_words(slab.counts, rest.column(1).to_pylist(), width)
            out = {"key": rest.column(0), "n_words": slab.counts, "n_removed": np.add.reduceat(np.r_[gone, False], slab.first[:-1]) * (slab.counts > 0), "kept": [], "intervals": []}
            raw = slab.data.tobytes()
            for d in range(len(texts)):
                a, b = slab.first[d], slab.first[d + 1]
                mask = gone[a:b]
                at = slice(a, b) if not mask.any() else a + np.flatnonzero(~mask)
                kept = b" ".join(raw[s:e] for s, e in zip(slab.start[at].tolist(), slab.end[at].tolist(), strict=True))
                out["kept"].append(hashlib.sha256(kept).hexdigest())
                edges = np.flatnonzero(np.diff(np.r_[False, mask, False])).tolist()
                out["intervals"].append([{"first": x, "last": y} for x, y in zip(edges[0::2], edges[1::2], strict=True)])
            spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
            yield from pa.table({
                "key": out["key"], "n_words": out["n_words"].astype(np.int64), "n_removed": out["n_removed"].astype(np.int64),
                "kept_sha256": out["kept"], "intervals": pa.array(out["intervals"], spans),
            }).to_batches()

    rows = with_starts(docs.select(key, text), key, text, width).select(F.col(key).alias("key"), "_starts", text)
    schema = f"key {docs.schema[key].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string, intervals array<struct<first: int, last: int>>"
    return map_arrow(rows, task, schema).withColumnRenamed("key", key)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_report(load(spark, sf_dir, "documents", "doc_id", "text")).drop("intervals")


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with repeated words taken out of ``text``: each removed interval goes with the space before it, all else
    stays byte for byte. Texts that lose nothing, null texts among them, are untouched. Rows stay, even with no word left."""

    def task(batches):
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, starts = batch.column(at).cast(pa.binary()).to_pylist(), batch.columns[-1].to_pylist()
            for i, data in enumerate(starts):
                if data:
                    slab = split_words([texts[i]], SPACED, lower=False, hashed=False)
                    gone = covered_words(slab.counts, [data], width)
                    # From the end of the word before to the end of the last removed word.
                    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
                    keep, last = [], 0
                    for a, b in zip(edges[0::2], edges[1::2], strict=True):
                        keep.append(texts[i][last : slab.end[a - 1] if a else slab.start[0]])
                        last = slab.end[b - 1]
                    texts[i] = b"".join([*keep, texts[i][last:]])
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if j == at else c for j, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(with_starts(docs, key, text, width), task, fields)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 20 words or more go from the texts; their first place stays, and so does every row."""
    return remove_repeats(docs)
