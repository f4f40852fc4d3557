"""Language ID by mixtures: each text is a mixture of languages, whose proportions EM estimates.

A language is a distribution of letter trigrams (of UTF-8 bytes, hashed to 65,536 cells), counted over all
labelled texts by Spark. Given a set of languages, EM finds the proportions under which a text's trigrams are
most likely. The set grows from the best single language by the next strongest one as long as the likelihood
gains more than a penalty that grows with the logarithm of the text's length. All texts of a slab run together.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.tables import load, map_arrow
from shardloom.llm.words import ALNUM, slabs

CELLS, BLOCK = 1 << 16, 1 << 12
SMOOTHING, PENALTY, ROUNDS = 0.5, 3.0, 8
#: Each language costs 256 KB on the driver and in every worker, so a column that is no language is an error.
MOST_LANGUAGES = 1000
UNKNOWN = "und"
_TABLE = np.where(ALNUM, np.arange(256), 0x20).astype(np.uint8)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[48:58] = 0x20


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``doc, cell, count`` of the distinct trigrams around each letter, ordered by text."""
    data = _TABLE[np.frombuffer(b"\x20" + b"\x20".join(texts) + b"\x20", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1
    at = np.flatnonzero(data != 0x20)
    code = data[at - 1].astype(np.uint32) << 16 | data[at].astype(np.uint32) << 8 | data[at + 1]
    cell = (code * np.uint32(2654435761) >> np.uint32(16)).astype(np.int64)
    doc = np.searchsorted(ends, at, side="right")
    keys, counts = np.unique(doc << 16 | cell, return_counts=True)
    return keys >> 16, keys & 0xFFFF, counts


def has_letter(text: bytes) -> bool:
    return any(unicodedata.category(c)[0] == "L" for c in text.decode())


def _letters(texts: list[bytes]) -> np.ndarray:
    return np.array([t.isascii() and not t.isalpha() and any(c.isalpha() for c in t.decode()) or has_letter(t) for t in texts], bool)


def language_counts(docs: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """Trigram counts of each language, summed by Spark over all given rows (null languages aside)."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def out():
            for name, cells in sums.items():
                for i, part in enumerate(cells.reshape(-1, BLOCK)):
                    if part.any():
                        yield pa.RecordBatch.from_pydict({"lang": [name], "block": pa.array([i], pa.int32()), "data": [part.tobytes()]})
            sums.clear()

        for rest, texts in slabs(batches, text):
            doc, cell, n = trigrams(texts)
            names = np.array(rest.column(0).to_pylist(), object)
            for name in set(names.tolist()):
                mine = (names == name)[doc]
                held = sums.setdefault(name, np.zeros(CELLS, np.int64))
                held += np.bincount(cell[mine], n[mine], CELLS).astype(np.int64)
            if len(sums) > 64:
                yield from out()
        yield from out()

    def add(batches):
        held, sums = None, np.zeros(BLOCK, np.int64)

        def out():
            return pa.RecordBatch.from_pydict({"lang": [held[0]], "block": pa.array([held[1]], pa.int32()), "data": [sums.tobytes()]})

        for batch in batches:
            for name, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is not None and (name, block) != held:
                    yield out()
                    sums = np.zeros(BLOCK, np.int64)
                held = (name, block)
                sums = sums + np.frombuffer(data, np.int64)
        if held is not None:
            yield out()

    schema = "lang string, block int, data binary"
    known = docs.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), text)
    parts = map_arrow(known, count, schema).repartition("lang", "block").sortWithinPartitions("lang", "block")
    out: dict[str, np.ndarray] = {}
    for row in map_arrow(parts, add, schema).toLocalIterator():
        if row.lang not in out and len(out) == MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages in {lang}")
        out.setdefault(row.lang, np.zeros(CELLS, np.int64))[row.block * BLOCK : (row.block + 1) * BLOCK] = np.frombuffer(row.data, np.int64)
    names = sorted(out)
    return names, np.array([out[n] for n in names]).reshape(len(names), CELLS)


def mixtures(texts: list[bytes], chance: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Proportions of the languages (columns) in each text; rows of texts without trigrams are zero.
    ``chance[cell, language]`` are the trigram probabilities."""
    doc, cell, count = trigrams(texts)
    out = np.zeros((len(texts), chance.shape[1]))
    if not len(doc) or not chance.shape[1]:
        return out
    rows, first = np.unique(doc, return_index=True)
    total = np.add.reduceat(count, first).astype(float)
    p, c = chance[cell], count.astype(np.float64)[:, None]
    which = np.repeat(np.arange(len(rows)), np.diff(np.r_[first, len(doc)]))

    def estimate(start: np.ndarray, p, c, which, first, total) -> tuple[np.ndarray, np.ndarray]:
        theta = start
        for _ in range(ROUNDS):
            share = theta[which] * p
            share *= c / share.sum(1, keepdims=True)
            theta = np.add.reduceat(share, first) / total[:, None]
        likely = np.log((theta[which] * p).sum(1)) * c[:, 0]
        return theta, np.add.reduceat(likely, first)

    single = np.add.reduceat(np.log(p) * c, first)
    best = single.argmax(1)
    score = single[np.arange(len(rows)), best]
    theta = np.zeros_like(single)
    theta[np.arange(len(rows)), best] = 1.0
    if chance.shape[1] > 1:
        free, _ = estimate(np.full(single.shape, 1 / chance.shape[1]), p, c, which, first, total)
        open_ = np.arange(len(rows))
        while len(open_):
            left = np.where(theta[open_] > 0, -1.0, free[open_])
            add = left.argmax(1)
            open_ = open_[left.max(1) > 0]
            add = add[left.max(1) > 0]
            if not len(open_):
                break
            chosen = theta[open_] > 0
            chosen[np.arange(len(open_)), add] = True
            start = chosen / chosen.sum(1, keepdims=True)
            mine = np.zeros(len(rows), bool)
            mine[open_] = True
            mine = mine[which]
            number = np.full(len(rows), -1)
            number[open_] = np.arange(len(open_))
            inner = number[which[mine]]
            sub = np.flatnonzero(np.r_[True, inner[1:] != inner[:-1]])
            tried, gained = estimate(start, p[mine], c[mine], inner, sub, total[open_])
            better = gained - score[open_] > penalty * np.log(total[open_] + 1)
            theta[open_[better]], score[open_[better]] = tried[better], gained[better]
            open_ = open_[better]
    out[rows] = theta
    return out


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Judge:
    """The learnt languages, and what they say of texts: best language, its share, all shares, and whether there is a verdict."""

    def __init__(self, names: list[str], chance: Broadcast):
        self.names, self.chance = names, chance
        self.limit = max(1 << 16, (8 << 20) // max(len(names), 4))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        shares = mixtures(texts, self.chance.value)
        top = shares.argmax(1) if self.names else np.zeros(len(texts), np.int64)
        sure = _letters(texts) & (shares.sum(1) > 0)
        score = np.where(sure, shares[np.arange(len(texts)), top] if self.names else 0.0, 0.0)
        return top, score, shares, sure


def learned(labelled: DataFrame, text: str, lang: str) -> Judge:
    names, counts = language_counts(labelled.select(text, lang), text, lang)
    chance = ((counts + SMOOTHING) / (counts + SMOOTHING).sum(1, keepdims=True)).T.astype(np.float32) if names else np.zeros((CELLS, 0), np.float32)
    return Judge(names, labelled.sparkSession.sparkContext.broadcast(np.ascontiguousarray(chance)))


def predict_languages(docs: DataFrame, labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per row of ``docs``: ``key``, ``lang_pred``, ``score`` (the predicted language's share) and ``languages``, all
    shares above 0 by language. ``labelled`` has ``text`` and ``lang`` to learn from.

    Null texts, texts without a letter, and all texts if nothing is labelled are ``und`` with score 0. Ties go to the first
    language in alphabetical order. Rows are judged one by one, so repeated rows are alike; other columns are not read.
    """
    judge = learned(labelled, text, lang)

    def task(batches):
        for rest, texts in slabs(batches, text, judge.limit):
            top, score, shares, sure = judge(texts)
            names = judge.names
            yield from pa.table({
                "key": rest.column(0), "lang_pred": [names[t] if s else UNKNOWN for t, s in zip(top, sure, strict=True)], "score": np.clip(score, 0.0, 1.0),
                "languages": pa.array([[(names[j], float(row[j])) for j in np.flatnonzero(row > 0)] if s else [] for row, s in zip(shares, sure, strict=True)], pa.map_(pa.string(), pa.float64())),
            }).to_batches()

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), text)
    return map_arrow(rows, task, f"key {kind}, lang_pred string, score double, languages map<string, double>").withColumnRenamed("key", key)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents", "doc_id", "text", "lang")
    found = predict_languages(docs, docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in which no language is found (``und``) go; the others stay as they are. Learns from the labelled rows of ``docs``.

    Each row is judged by its whole text where it lies: nothing is shuffled, and rows that share a ``doc_id`` are judged one by one.
    """
    judge = learned(docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()), "text", "lang")
    names = docs.columns

    def task(batches):
        for rest, texts in slabs(batches, "text", judge.limit):
            sure = judge(texts)[3]
            if sure.any():
                kept = rest.filter(pa.array(sure))
                text = pa.array([t for t, s in zip(texts, sure, strict=True) if s], pa.binary()).cast(pa.string())
                yield from kept.add_column(names.index("text"), "text", text).to_batches()

    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema)
    return map_arrow(docs, task, fields)
