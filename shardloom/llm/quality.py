"""Quality scores by a generalised additive model with pairwise interactions: a sum of lookup tables, one a feature or pair.

Features describe the whole text: shares of byte classes, words, lines and repeats. Each is a number from 0 to ``CELLS - 1``,
so counts of them are exact. Over all labelled rows Spark counts these cells, which cut every feature into bins of about
equal weight, and merges equal rows into one with a weight. The model is fitted in bags, one task each: features take
turns, and for each a shallow tree over its bins is fitted to what the others leave unexplained and added, damped, to the
feature's table. The pairs of features with most left to explain then get tables of their own in the same way. The model is the
mean of the bags; a score is a sum of looked-up numbers for all rows of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.tables import load, map_arrow, stored
from shardloom.llm.words import SPACED, slabs, split_words

CELLS, BINS, COARSE = 1 << 12, 32, 8
#: Fitted on about this many different labelled rows, chosen by hash where there are more, in bags of about so many.
TRAINING_ROWS, BAG_ROWS = 200_000, 25_000
ROUNDS, PAIRS, RATE, RIDGE, LEAST_GAIN = 50, 6, 0.15, 1.0, 1e-9

_BYTES = np.arange(256)


def _bytes_of(chars: str) -> np.ndarray:
    return np.isin(_BYTES, list(chars.encode()))


_UPPER, _LOWER, _DIGIT, _HIGH = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57), (_BYTES >= 128) & (_BYTES < 255)
_LETTER, _BLANK, _STOP = _UPPER | _LOWER | _HIGH, ~SPACED, _bytes_of(".,;:'\"-")
_SYMBOL = ~(_LETTER | _DIGIT | _BLANK | _STOP) & (_BYTES < 128)
#: Shares of a text's bytes.
CLASSES = {
    "letters": _LETTER, "upper": _UPPER, "high": _HIGH, "digits": _DIGIT, "blanks": _BLANK, "stops": _STOP, "symbols": _SYMBOL,
    "calls": _bytes_of("!?"), "bars": _bytes_of("|"), "markup": _bytes_of("<>/{}[]=\\"), "control": (_BYTES < 32) & SPACED,
}
NAMES = [
    *CLASSES, "size", "entropy", "common_symbol", "words", "word_bytes", "long_words", "short_words", "wordless", "odd_ends", "shouted",
    "different_words", "echoes", "lines", "different_lines",
]
_LINE = np.arange(256) != 0x0A


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.r_[0, np.cumsum(values, dtype=np.float64)]
    return total[first[1:]] - total[first[:-1]]


def _different(doc: np.ndarray, hashes: np.ndarray, texts: int) -> np.ndarray:
    """How many different hashes each text has."""
    order = np.lexsort((hashes, doc))
    new = np.r_[True, (np.diff(doc[order]) != 0) | (hashes[order][1:] != hashes[order][:-1])] if len(order) else np.zeros(0, bool)
    return np.bincount(doc[order][new], minlength=texts)


def text_cells(texts: list[bytes]) -> np.ndarray:
    """Feature cells ``[text, feature]`` of whole texts, in the order of ``NAMES``."""
    words = split_words(texts, SPACED, lower=False)
    lines = split_words(texts, _LINE, lower=False)
    data, n = words.data, len(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    bounds = np.r_[0, np.cumsum(sizes + 1)]
    histogram = np.zeros((n, 256), np.int64)
    # Runs of texts at a time, as the counted pairs of text and byte take eight bytes each.
    run = np.minimum(np.searchsorted(bounds, np.arange(0, bounds[-1] + (2 << 22), 1 << 22)), n)
    for a, b in zip(run, run[1:], strict=False):
        if b > a:
            doc = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
            histogram[a:b] = np.bincount(doc * 256 + data[bounds[a] : bounds[b]], minlength=(b - a) * 256).reshape(-1, 256)
    histogram[:, 255] = 0  # what separates texts
    out = {name: _share(histogram[:, mask].sum(1), sizes) for name, mask in CLASSES.items()}
    p = _share(histogram, sizes[:, None])
    out["entropy"] = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(1) / 8
    out["size"] = np.log1p(sizes) / 20
    out["common_symbol"] = _share((histogram * _SYMBOL).max(1), sizes)

    inside = np.r_[0, np.cumsum(_LETTER[data])]
    upper = np.r_[0, np.cumsum(_UPPER[data])]
    length, letters = words.end - words.start, inside[words.end] - inside[words.start]
    counts, first = words.counts, words.first
    ends = data[words.end - 1] if len(words.end) else np.zeros(0, np.uint8)
    echo = np.zeros(len(length), bool)
    echo[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    out["words"] = np.log1p(counts) / 16
    out["word_bytes"] = _share(_sums(length, first), counts) / 32
    for name, which in {
        "long_words": length > 12, "short_words": length <= 3, "wordless": letters == 0, "odd_ends": _SYMBOL[ends],
        "shouted": (letters > 1) & (upper[words.end] - upper[words.start] == letters), "echoes": echo,
    }.items():
        out[name] = _share(_sums(which, first), counts)
    out["different_words"] = _share(_different(words.doc, words.hashes, n), counts)
    out["lines"] = _share(lines.counts, counts)
    out["different_lines"] = _share(_different(lines.doc, lines.hashes, n), lines.counts)
    values = np.stack([out[name] for name in NAMES], axis=1)
    return np.floor(np.clip(values, 0, 1) * (CELLS - 1)).astype(np.uint16)


def feature_cells(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key, cells`` (16 bits a feature), stored: texts are read once."""

    def task(batches):
        for rest, texts in slabs(batches, text):
            cells = text_cells(texts)
            yield from pa.table({"key": rest.column(0), "cells": pa.array([row.tobytes() for row in cells], pa.binary())}).to_batches()

    rows = docs.select(F.col(key).alias("key"), text)
    return stored(map_arrow(rows, task, f"key {docs.schema[key].dataType.simpleString()}, cells binary"), "features")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), len(NAMES))


def cell_counts(weighted: DataFrame) -> np.ndarray:
    """Weight of each cell of each feature, ``[feature, cell]``, over all rows of ``cells, weight``."""

    def task(batches):
        counts = np.zeros((len(NAMES), CELLS), np.int64)
        for batch in batches:
            cells, weight = _matrix(batch.column(0)), batch.column(1).to_numpy()
            for f in range(len(NAMES)):
                counts[f] += np.bincount(cells[:, f], weight, CELLS).astype(np.int64)
        feature, cell = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(feature.astype(np.int32)), "cell": pa.array(cell.astype(np.int32)), "n": counts[feature, cell]})

    out = np.zeros((len(NAMES), CELLS), np.int64)
    rows = map_arrow(weighted.select("cells", "weight"), task, "feature int, cell int, n bigint").groupBy("feature", "cell").agg(F.sum("n").alias("n"))
    for row in rows.collect():  # at most one for each cell
        out[row.feature, row.cell] = row.n
    return out


def cut_bins(counts: np.ndarray, bins: int) -> np.ndarray:
    """Bin of each cell, so that the bins of a feature hold about equal weight."""
    before = np.cumsum(counts, axis=1) - counts
    return np.minimum(before * bins // np.maximum(counts.sum(1, keepdims=True), 1), bins - 1).astype(np.int64)


def _gain(gradient: np.ndarray, weight: np.ndarray) -> np.ndarray:
    return gradient**2 / (weight + RIDGE)


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, depth: int = 2) -> np.ndarray:
    """Step of each bin by a tree of at most ``2**depth`` leaves, each a range of bins."""
    total, mass = gradient.sum(), weight.sum()
    if depth and len(gradient) > 1:
        left, left_mass = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        gain = _gain(left, left_mass) + _gain(total - left, mass - left_mass)
        at = int(gain.argmax()) + 1
        if gain[at - 1] - _gain(total, mass) > LEAST_GAIN:
            return np.r_[shallow_tree(gradient[:at], weight[:at], depth - 1), shallow_tree(gradient[at:], weight[at:], depth - 1)]
    return np.full(len(gradient), -total / (mass + RIDGE))


def quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of two features at once: its gain and the step of each pair of bins."""
    def parts(table):
        low = table.cumsum(0).cumsum(1)
        top, side, all_ = low[:-1, -1:], low[-1:, :-1], low[-1, -1]
        corner = low[:-1, :-1]
        return np.stack([corner, top - corner, side - corner, all_ - top - side + corner])

    g, w = parts(gradient), parts(weight)
    gain = _gain(g, w).sum(0)
    a, b = np.unravel_index(gain.argmax(), gain.shape)
    step = -g[:, a, b] / (w[:, a, b] + RIDGE)
    out = np.empty(gradient.shape)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = step
    return float(gain[a, b] - _gain(gradient.sum(), weight.sum())), out


@dataclass
class Model:
    """``bins`` and ``coarse`` give the bin of each feature's cell, ``tables`` the summand of each bin; ``pairs`` those of pairs."""

    bins: np.ndarray
    coarse: np.ndarray
    intercept: float = 0.0
    tables: np.ndarray = field(default_factory=lambda: np.zeros((len(NAMES), BINS)))
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def scores(self, cells: np.ndarray) -> np.ndarray:
        total = np.full(len(cells), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[self.bins[f]][cells[:, f]]
        for (f, g), table in self.pairs.items():
            total += table[self.coarse[f][cells[:, f]], self.coarse[g][cells[:, g]]]
        return 1 / (1 + np.exp(-total))


def boost(cells: np.ndarray, label: np.ndarray, weight: np.ndarray, model: Model, pairs: int = PAIRS, rounds: int = ROUNDS) -> Model:
    """Fits one bag: single features in turn, round after round, then the pairs that leave most to explain."""
    yes, no = float(weight[label == 1].sum()), float(weight[label == 0].sum())
    out = Model(model.bins, model.coarse, float(np.log((yes + 1) / (no + 1))))
    if not yes or not no:
        return out
    # Copies share one row: the loss is a mean, so that ridge and gain mean the same for any number of rows.
    weight = weight * (len(weight) / weight.sum())
    total = np.full(len(label), out.intercept)
    codes = np.stack([model.bins[f][cells[:, f]] for f in range(len(NAMES))])
    coarse = np.stack([model.coarse[f][cells[:, f]] for f in range(len(NAMES))])

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        chance = 1 / (1 + np.exp(-total))
        return weight * (chance - label), weight * chance * (1 - chance)

    for _ in range(rounds):
        for f in range(len(NAMES)):
            gradient, mass = slopes()
            step = RATE * shallow_tree(np.bincount(codes[f], gradient, BINS), np.bincount(codes[f], mass, BINS))
            out.tables[f] += step
            total += step[codes[f]]

    def cross(f: int, g: int) -> tuple[float, np.ndarray]:
        at = coarse[f] * COARSE + coarse[g]
        return quadrants(*(np.bincount(at, v, COARSE**2).reshape(COARSE, COARSE) for v in (gradient, mass)))

    gradient, mass = slopes()
    ranked = sorted(combinations(range(len(NAMES)), 2), key=lambda p: (-cross(*p)[0], p))
    for _ in range(rounds):
        for f, g in ranked[:pairs]:
            gradient, mass = slopes()
            step = RATE * cross(f, g)[1]
            out.pairs[f, g] = out.pairs.get((f, g), 0.0) + step
            total += step[coarse[f], coarse[g]]
    return out


def fit(labelled: DataFrame, training_rows: int = TRAINING_ROWS, bag_rows: int = BAG_ROWS) -> Model:
    """The mean model of all bags. ``labelled`` has ``cells``, ``label`` (0 or 1) and ``weight``; equal rows have been merged.

    All rows decide the bins. Where there are more than ``training_rows``, those of the smallest hashes are fitted."""
    spark = labelled.sparkSession
    counts = cell_counts(labelled)
    model = Model(cut_bins(counts, BINS), cut_bins(counts, COARSE))
    total = labelled.count()
    bags = max(1, -(-min(total, training_rows) // bag_rows))
    chance = F.shiftrightunsigned(F.xxhash64("cells", "label"), 11) / float(1 << 53)
    some = labelled if total <= training_rows else labelled.where(chance < training_rows / total)
    dealt = some.withColumn("bag", F.pmod(F.xxhash64("label", "cells"), F.lit(bags)).cast("int"))
    shared = spark.sparkContext.broadcast(model)

    def task(batches):
        rows = ((bag, batch.slice(i, 1)) for batch in batches for i, bag in enumerate(batch.column(3).to_pylist()))
        for _, mine in groupby(rows, lambda r: r[0]):
            held = pa.Table.from_batches([r[1] for r in mine]).combine_chunks()
            fitted = boost(_matrix(held.column(0).combine_chunks()), held.column(1).to_numpy(), held.column(2).to_numpy().astype(float), shared.value)
            pairs = [(f, g, table.ravel().tolist()) for (f, g), table in fitted.pairs.items()]
            yield pa.RecordBatch.from_pylist([{"first": -1, "second": f, "table": t.tolist()} for f, t in enumerate(fitted.tables)])
            yield pa.RecordBatch.from_pylist([{"first": f, "second": g, "table": t} for f, g, t in [(-1, -1, [fitted.intercept]), *pairs]])

    parts = dealt.select("cells", "label", "weight", "bag").repartition(bags, "bag").sortWithinPartitions("bag", "cells", "label")
    fitted = map_arrow(parts, task, "first bigint, second bigint, table array<double>")
    rows = sorted(fitted.collect())  # a few tables of fixed size for each bag
    found = max(sum(r.second == -1 for r in rows), 1)
    for f, g, table in rows:
        if g < 0:
            model.intercept += table[0] / found
        elif f < 0:
            model.tables[g] += np.array(table) / found
        else:
            model.pairs[f, g] = model.pairs.get((f, g), 0.0) + np.array(table).reshape(COARSE, COARSE) / found
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, learn: Column | None = None, key: str = "doc_id", text: str = "text",
    label_key: str = "doc_id", label: str = "quality", training_rows: int = TRAINING_ROWS,
) -> DataFrame:
    """Per row of ``docs``: ``key``, ``score`` (chance of label 1) and ``predicted`` (1 if the score is 0.5 or more, else 0).

    Learns from the rows of ``docs`` that ``labels`` gives a 0 or 1 and for which ``learn``, a condition on ``key``, holds (all, if
    there is none). Only the text enters a score; null texts count as empty, and empty ones have a score as any other. Equal labelled
    rows are one with a weight; a key with both labels is learnt from as both. Null keys and null labels teach nothing. Without
    labelled rows every score is 0.5, and with one label only, its smoothed share. Other columns are not read.
    """
    features = feature_cells(docs, key, text)
    marked = labels.select(F.col(label_key).alias("k"), F.col(label).cast("int").alias("label")).where("label IN (0, 1)")
    marked = marked.groupBy("k", "label").agg(F.count("*").alias("m"))
    known = features if learn is None else features.select(F.col("key").alias(key), "cells").where(learn).select(F.col(key).alias("key"), "cells")
    # Copies are merged before they meet their labels, so that one key of very many rows is few.
    known = known.where(F.col("key").isNotNull()).groupBy("key", "cells").agg(F.count("*").alias("n"))
    rows = known.join(marked, F.col("key") == F.col("k")).groupBy("cells", "label").agg(F.sum(F.col("n") * F.col("m")).alias("weight"))
    model = docs.sparkSession.sparkContext.broadcast(fit(stored(rows, "labelled"), training_rows))

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                score = model.value.scores(_matrix(batch.column(1)))
                columns = [batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(features, task, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "labels", "doc_id", "quality")
    scored = quality_scores(docs, labels, ~held_out(F.col("doc_id")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
