"""Features against plain Python, trees against all cuts, scores against labels that were held out."""

import itertools
import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from shardloom.llm import quality
from shardloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.01"
TEXTS = ["", " \n", "one", "A b a a\nA b a a\n\nC!! | ### d4rk ÄÖ 你好", "the fox " * 70_000, "X" * 50_000, "\x00\x01 <a>{}", "é, è; ê."]


def plain_cells(text):
    raw, words = text.encode(), [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", text.encode()) if w]
    lines = [line for line in raw.split(b"\n") if line]
    letter = lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 128
    symbol = lambda b: b < 128 and not letter(b) and not 48 <= b <= 57 and b not in b" \t\n\v\f\r.,;:'\"-"
    share = lambda part, whole: part / max(whole, 1)
    counts = Counter(raw)
    of = lambda test: share(sum(n for b, n in counts.items() if test(b)), len(raw))
    told = lambda test: share(sum(map(test, words)), len(words))
    values = {
        "letters": of(letter), "upper": of(lambda b: 65 <= b <= 90), "high": of(lambda b: b >= 128), "digits": of(lambda b: 48 <= b <= 57),
        "blanks": of(lambda b: b in b" \t\n\v\f\r"), "stops": of(lambda b: b in b".,;:'\"-"), "symbols": of(symbol), "calls": of(lambda b: b in b"!?"),
        "bars": of(lambda b: b in b"|"), "markup": of(lambda b: b in b"<>/{}[]=\\"), "control": of(lambda b: b < 32 and b not in b"\t\n\v\f\r"),
        "size": math.log1p(len(raw)) / 20, "entropy": -sum(n / len(raw) * math.log2(n / len(raw)) for n in counts.values()) / 8,
        "common_symbol": share(max([n for b, n in counts.items() if symbol(b)], default=0), len(raw)), "words": math.log1p(len(words)) / 16,
        "word_bytes": share(sum(map(len, words)), len(words)) / 32, "long_words": told(lambda w: len(w) > 12), "short_words": told(lambda w: len(w) <= 3),
        "wordless": told(lambda w: not any(map(letter, w))), "odd_ends": told(lambda w: symbol(w[-1])),
        "shouted": told(lambda w: sum(map(letter, w)) > 1 and all(65 <= b <= 90 for b in w if letter(b))),
        "different_words": share(len(set(words)), len(words)), "echoes": share(sum(a == b for a, b in zip(words, words[1:])), len(words)),
        "lines": share(len(lines), len(words)), "different_lines": share(len(set(lines)), len(lines)),
    }
    return [min(max(values[n], 0), 1) * (quality.CELLS - 1) for n in quality.NAMES]


def test_features_are_those_of_whole_texts():
    want = np.array([plain_cells(t) for t in TEXTS])
    got = quality.text_cells([t.encode() for t in TEXTS])
    assert (np.abs(got - want) < 1.001).all()  # rounded down; the last digits of logarithms may differ
    assert (quality.text_cells([TEXTS[3].encode()])[0] == got[3]).all()


def test_tree_takes_the_best_cut():
    rng = np.random.default_rng(1)
    for _ in range(20):
        g, w = rng.normal(size=9), rng.random(9)
        gain = lambda a, b: g[a:b].sum() ** 2 / (w[a:b].sum() + quality.RIDGE)
        best = max(range(1, 9), key=lambda i: gain(0, i) + gain(i, 9))
        step = quality.shallow_tree(g, w, depth=1)
        assert step[0] == pytest.approx(-g[:best].sum() / (w[:best].sum() + quality.RIDGE)) and len(set(step.round(12))) == 2
    g, w = rng.normal(size=(5, 5)), rng.random((5, 5))
    value = {}
    for a, b in itertools.product(range(1, 5), repeat=2):
        value[a, b] = sum(x.sum() ** 2 / (y.sum() + quality.RIDGE) for s in (slice(0, a), slice(a, 5)) for t in (slice(0, b), slice(b, 5)) for x, y in [(g[s, t], w[s, t])])
    a, b = max(value, key=value.get)
    gain, step = quality.quadrants(g, w)
    assert gain == pytest.approx(value[a, b] - g.sum() ** 2 / (w.sum() + quality.RIDGE))
    assert step[0, 0] == pytest.approx(-g[:a, :b].sum() / (w[:a, :b].sum() + quality.RIDGE)) and step[a, b] == step[-1, -1]


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(2)
    cells = rng.integers(0, quality.CELLS, (4000, len(quality.NAMES))).astype(np.uint16)
    half = quality.CELLS // 2
    label = ((cells[:, 2] < half) ^ (cells[:, 7] < half)).astype(np.int64)
    even = np.ones((len(quality.NAMES), quality.CELLS), np.int64)
    model = quality.Model(quality.cut_bins(even, quality.BINS), quality.cut_bins(even, quality.COARSE))
    hit = lambda m: np.mean((m.scores(cells[2000:]) >= 0.5) == label[2000:])
    weight = np.ones(2000)
    assert hit(quality.boost(cells[:2000], label[:2000], weight, model, pairs=0)) < 0.6
    fitted = quality.boost(cells[:2000], label[:2000], weight, model)
    assert (2, 7) in fitted.pairs and hit(fitted) > 0.95
    # A row of weight 3 is three rows.
    more = quality.boost(np.r_[cells[:500], cells[:250], cells[:250]], np.r_[label[:500], label[:250], label[:250]], np.ones(1000), model, rounds=3)
    held = quality.boost(cells[:500], label[:500], np.r_[np.full(250, 3.0), np.ones(250)], model, rounds=3)
    assert np.corrcoef(more.scores(cells), held.scores(cells))[0, 1] > 0.97


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_held_out_labels(spark):
    found = {r.doc_id: r for r in QUERIES["op12_quality"](spark, SF_DIR).collect()}
    assert len(found) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for k, r in found.items())
    marked = [(found[r.doc_id], r.quality) for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()]
    out = [(r.score, r.predicted, q) for r, q in marked if r.held_out]
    assert np.mean([p == q for _, p, q in out]) > 0.95
    good, bad = ([s for s, _, q in out if q == v] for v in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.97


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS key", "2 AS cells", "3 AS label", "4 AS k", "5 AS weight", "6 AS score")


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int").selectExpr("*", "1 AS label", "2 AS k", "3 AS m")


def test_hard_rows(spark):
    good, bad = "a calm line of plain words here", "### !!! $$$ BUY | NOW ||| %%%"
    rows = [(None, good), (None, None), (1, None), (2, ""), (3, good), (3, good), (3, bad), *((i, f"{good} {i}") for i in range(4, 40)), *((i, f"{bad} {i}") for i in range(40, 80))]
    rows += [(80, good * 20_000), (81, bad * 20_000), (82, None)]
    marks = [(None, 1), (3, 1), (3, 1), (3, 0), (1, None), (2, 7), (5000, 1), (82, 0), *((i, 1) for i in range(4, 35)), *((i, 0) for i in range(45, 80))]
    found = quality.quality_scores(frame(spark, rows).repartition(3), labels_of(spark, marks)).collect()
    assert Counter(r.doc_id for r in found) == Counter(k for k, _ in rows)
    told = {r.doc_id: r.predicted for r in found if r.doc_id not in (None, 3)}
    assert all(told[i] == 1 for i in range(4, 40)) and all(told[i] == 0 for i in range(40, 80)) and {80, 81} <= set(told)
    empty = {r.score for r in found if r.doc_id in (1, 2, 82)}
    assert len(empty) == 1  # null and empty texts are alike


def test_few_or_no_labels(spark):
    rows = [(1, "a b"), (2, None)]
    score = lambda docs, marks: {r.score for r in quality.quality_scores(frame(spark, docs), labels_of(spark, marks)).collect()}
    assert score(rows, []) == {0.5} and score([], [(1, 1)]) == set()
    assert {round(s, 12) for s in score(rows, [(1, 1), (2, 1)])} == {0.75}


def test_sample_and_bags_are_bounded(spark):
    rng = np.random.default_rng(4)
    cells = rng.integers(0, quality.CELLS, (400, len(quality.NAMES))).astype(np.uint16)
    rows = spark.createDataFrame([(bytearray(c.tobytes()), int(c[0] < 2048), 1) for c in cells], "cells binary, label int, weight bigint")
    model = quality.fit(rows, training_rows=200, bag_rows=70)
    again = quality.fit(rows.repartition(7), training_rows=200, bag_rows=70)
    assert (model.tables == again.tables).all() and model.intercept == again.intercept
    assert np.mean((model.scores(cells) >= 0.5) == (cells[:, 0] < 2048)) > 0.9
