"""Cases that once gave wrong results or crashed, and plain versions of what SQL cannot check."""

import importlib.util
import math
import os
import re
import sys
from collections import Counter

import numpy as np
import pytest

from shardloom.llm import bpe, decontaminate, jaccard_join, language, licenses, sharding, substring_dedup, url_filter, words
from shardloom.llm.queries import QUERIES
from shardloom.llm.tables import bit_map

SF_DIR = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")


def thue_morse(n, one, two):
    return "".join((one, two)[i.bit_count() & 1] for i in range(n))


#: Words that every polynomial modulo a power of two with an odd base takes for one.
ONE, TWO = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_hashes_are_polynomials_modulo_a_prime(monkeypatch):
    prime = (1 << 61) - 1
    rng = np.random.default_rng(0)
    a, b = (np.r_[rng.integers(0, prime, 500, dtype=np.uint64), np.array([0, 1, prime - 1], np.uint64)] for _ in range(2))
    assert words.times(a, b).tolist() == [int(x) * int(y) % prime for x, y in zip(a, b)]
    texts = [ONE.encode(), TWO.encode(), b"ab cd " * 50, b"q" * 1000 + b" q " + b"q" * 999, b"", b"cd ab"]
    whole = words.split_words(texts, words.SPACED, False)
    monkeypatch.setattr(words, "_BLOCK", 64)  # longer words are summed in pieces
    monkeypatch.setattr(words, "_bytes_powers", words.Powers(words._BASE))
    pieces = words.split_words(texts, words.SPACED, False)
    assert (whole.hashes == pieces.hashes).all()
    by_word = {}
    for s, e, h in zip(whole.start, whole.end, whole.hashes):
        by_word.setdefault(whole.data[s:e].tobytes(), set()).add(int(h))
    assert all(len(h) == 1 for h in by_word.values()) and len(set.union(*by_word.values())) == len(by_word)


def test_thue_morse_words_are_told_apart(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    found = {r.doc_id: r.ids for r in bpe.encode_texts(docs_of(spark, [ONE, TWO]).coalesce(1)).collect()}
    assert found == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate((ONE, TWO))}
    long = [" ".join([w] * 24) for w in (ONE, TWO)]
    assert {r.doc_id: r.n_removed for r in substring_dedup.removal_report(docs_of(spark, long)).collect()} == {0: 23, 1: 23}
    assert {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs_of(spark, long)).collect()} == {0: 0, 1: 1}
    items = spark.createDataFrame([(1, TWO)], "item_id bigint, text string")
    assert [r.doc_id for r in decontaminate.contained_items(docs_of(spark, [ONE, TWO, "x " + TWO]), items).collect() if r.item_id] != [0]
    assert {r.doc_id for r in decontaminate.contained_items(docs_of(spark, [ONE, TWO, "x " + TWO]), items).collect()} == {1, 2}


def test_encoding_makes_no_python_calls_for_each_word():
    rng = np.random.default_rng(3)
    letters = rng.integers(97, 123, (20_000, 9), dtype=np.uint8)
    text = b" ".join(x.tobytes()[: 3 + i % 7] for i, x in enumerate(letters))
    vocabulary, calls = bpe.Vocabulary(bpe.vocabulary_path()), 0
    vocabulary.encode([b"one"])

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        vocabulary.encode([text])
    finally:
        sys.setprofile(None)
    assert calls < 20_000


def test_words_are_encoded_alike_when_known_forgotten_or_overwritten(monkeypatch):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    texts = ["the cat's hat, the dog's 12 dögs", "", "你好<|endoftext|><|endoftext|> the 🙂🙂 cat", "x" * 300 + " qzxjv" * 20, " \n\n  the"]
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(bpe, "_PLACES", 8)
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    vocabulary = bpe.Vocabulary(bpe.vocabulary_path())
    for some in ([0, 1, 2, 3, 4], [4, 3], [2], [1], [0, 0, 2]):
        ids, counts = vocabulary.encode([texts[i].encode() for i in some])
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [want[i] for i in some]


def test_op7_many_texts_of_one_key(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    rows = [(None, f"n{i} {passage}" if i % 3 == 0 else " ".join(f"{i}x{j}" for j in range(22))) for i in range(300)] + [(1, passage), (2, "z " + passage)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = Counter((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.removal_report(frame).collect())
    assert found == Counter({(None, 26, 25): 99, (None, 26, 0): 1, (None, 22, 0): 200, (1, 25, 25): 1, (2, 26, 25): 1})


def test_op7_texts_without_removals_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.createDataFrame([(i, " ".join(f"{i}w{j}" for j in range(30))) for i in range(50)] + [(50, " ".join(f"3w{j}" for j in range(30)))], "doc_id bigint, text string").write.parquet(path)
    frame = substring_dedup.with_starts(spark.read.parquet(path), "doc_id", "text", 20)
    assert {r.doc_id for r in frame.where("_starts IS NOT NULL").collect()} == {50}
    assert "Union" in frame._jdf.queryExecution().optimizedPlan().toString()


def test_op1_rows_of_one_item_add_up(spark):
    own = [f"w{i}" for i in range(156)]
    halves = [(1, " ".join(own[:80])), (1, " ".join(own[76:])), (2, "lone item")]
    items = spark.createDataFrame(halves, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): (r.n_shingles, r.n_found) for r in decontaminate.contained_items(docs_of(spark, [" ".join(own[14:141]), " ".join(own[:100])]), items).collect()}
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    item = shingles(own[:80]) | shingles(own[76:])
    both = len(item & shingles(own[14:141]))
    assert both >= 0.8 * len(item) and found == {(0, 1): (len(item), both)}


def test_op1_sketches_of_every_size(spark):
    rng = np.random.default_rng(8)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, n))) for i, n in enumerate([1, 2, 4, 5, 6, 9, 17, 40, 90, 300] * 3)]
    noise = lambda n: list(rng.choice(vocabulary, n))
    texts = []
    for _, text in items:
        held = text.split()
        cut = len(held) // 12
        texts.append(" ".join(noise(200) + held[cut:] + noise(100)))
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(docs_of(spark, texts), frame).collect()}

    def shingles(w, wide):
        return {tuple(w[i : i + wide]) for i in range(len(w) - wide + 1)}

    want = set()
    for i, text in items:
        w = text.split()
        wide = min(5, len(w))
        for d, t in enumerate(texts):
            mine = shingles(w, wide)
            if 100 * len(mine & shingles(t.split(), wide)) >= 80 * len(mine):
                want.add((d, i))
    assert found == want


@pytest.mark.parametrize("text, places", [
    ("x \u00a0cc by nc y", 0), ("cc by nc\u3000y", 0), ("under the mit license\u2003y", 0), ("cc by nc\u00a0", 0), ("a cc by nc b", 1),
    ("  cc by nc", 1), ("cc-by\nnc", 1),
])
def test_op3_blanks_beyond_ascii_are_letters(spark, text, places):
    row = licenses.scan_licenses(docs_of(spark, [text])).first()
    assert sum(d.base for d in row.detections) == places


def test_op3_suppression_by_priority_and_containment():
    listed = [licenses.Rule("a", 1000, 1.0, ("x",), "x"), licenses.Rule("b", 90, 1.0, ("x",), "x"), licenses.Rule("b", 40, 1.0, ("x",), "x"), licenses.Rule("c", 40, 1.0, ("x",), "x")]
    settle = lambda *found: licenses.settle(list(found), listed)
    assert settle((0, 10, 1), (2, 8, 3)) == [(0, 10, 1)]  # lower priority inside another label goes
    assert settle((0, 10, 1), (8, 20, 3)) == [(0, 10, 1)]  # so does one that overlaps
    assert settle((0, 10, 1), (2, 8, 2)) == [(0, 10, 1)]  # contained in one of its own label
    assert settle((0, 10, 1), (5, 15, 2)) == [(0, 10, 1), (5, 15, 2)]  # the same label may overlap
    assert settle((0, 10, 1), (10, 15, 3)) == [(0, 10, 1), (10, 15, 3)]
    assert settle((0, 10, 1), (3, 5, 0)) == [(3, 5, 0)]  # base places always stay, and win
    assert settle((0, 5, 3), (0, 5, 2)) == [(0, 5, 2)]  # equal priority and length: the earlier rule


@needs_data
def test_op4_shards_are_those_of_the_smallest_cost(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text")
    weights = [1.0, 2.0, 0.5]
    def best(weights):
        costs = [sharding.shard_cost(docs["doc_id"], i, w) for i, w in enumerate(weights)]
        return {r[0]: min(range(len(weights)), key=lambda i: r[i + 1]) for r in docs.select("doc_id", *costs).collect()}

    now, grown = best(weights), best([*weights, 1.5])
    rows = sharding.assign_shards(docs, weights=weights, new_weight=1.5).collect()
    assert {r.doc_id: (r.shard, r.grown_shard) for r in rows} == {k: (now[k], grown[k]) for k in now}
    assert all(grown[k] in (now[k], 3) for k in now) and 3 in grown.values()


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]+", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host):]).group()


@needs_data
def test_op6_parts_and_rules_on_all_pages(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op6_url_filter"](spark, SF_DIR).collect()
    assert len(rows) == len(pages)
    for r in rows:
        host, path = plain_parts(pages[r.page_id])
        fit = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule = max(fit, key=lambda x: len(x[0]), default=(None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule[0]) and r.verdict in ([rule[1]] if rule[1] else ["allow", "block"])


def test_op6_few_urls_repeated_very_often(spark):
    urls = ["http://a.org/x", "http://b.com/de/1", "http://c.com/fr/2"]
    pages = spark.range(200_000).selectExpr("id AS page_id", f"array('{urls[0]}', '{urls[1]}', '{urls[2]}')[CAST(id % 3 AS INT)] AS url")
    verdicts = url_filter.judge_urls(pages).groupBy("host", "verdict").count().collect()
    assert {(r.host, r.verdict) for r in verdicts} == {("a.org", "allow"), ("b.com", "block"), ("c.com", "allow")}


def test_op6_trees_learn_from_labelled_urls(spark):
    rng = np.random.default_rng(1)
    urls = [f"https://s{rng.integers(99)}.com/{'de' if i % 2 else 'fr'}/{'?a=1&b=22&c=333' if i % 2 else 'page'}{i}" for i in range(600)]
    urls += [f"https://s{rng.integers(99)}.net/x/{'?a=1&b=22&c=333' if i % 2 else 'page'}{i}" for i in range(200)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    rows = [r for r in url_filter.judge_urls(pages, training_rows=300).collect() if r.rule is None]
    assert len(rows) == 200 and np.mean([(r.verdict == "block") == (r.page_id % 2 == 1) for r in rows]) > 0.95


def test_op9_shares_of_mixed_texts():
    rng = np.random.default_rng(2)
    alphabet = {"x": "abcde", "y": "fghij", "z": "klmno"}
    speak = lambda lang, n: "".join(rng.choice(list(alphabet[lang]), n)).encode()
    counts = np.zeros((3, language.CELLS))
    for i, lang in enumerate(alphabet):
        _, cell, n = language.trigrams([speak(lang, 60_000)])
        counts[i, cell] += n
    chance = ((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True)).T.astype(np.float32)
    shares = language.mixtures([speak("x", 600) + b" " + speak("y", 300), speak("z", 200), b"", b"123"], chance)
    assert shares[0] == pytest.approx([2 / 3, 1 / 3, 0], abs=0.03) and shares[1].tolist() == [0, 0, 1] and not shares[2:].any()
    # The set of languages is chosen by penalised likelihood: a stray word does not add one.
    stray = speak("x", 3000) + b" " + speak("y", 1)
    assert language.mixtures([stray], chance)[0].tolist() == [1, 0, 0]
    assert (language.mixtures([speak("x", 600) + b" " + speak("y", 300)], chance, penalty=1e9)[0] > 0).sum() == 1


def test_op10_large_regions_are_split(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 2)
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(60):
        w = list(base) if i % 2 else [f"{i % 6}c{j}" for j in range(40)] + base[:6]
        for _ in range(int(rng.integers(0, 3))):
            w[int(rng.integers(len(w)))] = f"r{rng.integers(1000)}"
        texts.append(" ".join(w))
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs_of(spark, texts), region_limit=2).collect()}
    sets = [{tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert found == dict(enumerate(root)) and len(set(root)) > 2


def test_bit_maps_grow_with_their_values(spark):
    rows = spark.range(20_000).selectExpr("xxhash64(id) AS h")
    held = np.array([r.h for r in rows.collect()], np.int64)
    found = bit_map(rows)
    assert found.bits == math.ceil(math.log2(16 * 20_000)) and found.holds(held).all()
    assert found.holds(words.mix(np.arange(100_000, dtype=np.uint64)).view(np.int64)).mean() < 0.03
    none = bit_map(rows.where("false"))
    assert not none.holds(held).any()


@needs_data
@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages_on_no_rows_and_on_null_texts(spark):
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    none = spark.createDataFrame([], schema)
    hard = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, None), (None, "some words here", "en", "s", 3), (3, "\n\t", "en", "s", 1), (4, "other words of a text to learn from", "en", "s", 7), (5, "still more of them in a line", "en", "s", 6)], schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, none, SF_DIR)
        assert empty.count() == 0, name
        out = stage(spark, hard, SF_DIR)
        assert out.columns == empty.columns and (name == "bpe" or out.columns == none.columns)
        kept = sorted((r.doc_id is None, r.doc_id or 0) for r in out.select("doc_id").collect())
        assert kept == [(False, k) for k in range(4 if name == "language_id" else 1, 6)] + [(True, 0)], name
