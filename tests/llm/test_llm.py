"""Each operator against a brute-force version on all documents of the smallest scale, and on hard rows."""

import hashlib
import importlib.util
import os
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest

from shardloom.llm import bpe, decontaminate, jaccard_join, language, licenses, nearest, sharding, substring_dedup, token_files, url_filter
from shardloom.llm.queries import QUERIES
from shardloom.session import scratch

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")

SPACED, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PASSAGE = " ".join(f"w{i}" for i in range(60))
#: Null key, null text, empty, no words, few words, repeated rows, one key twice, a long text, near copies.
HARD = [
    (None, PASSAGE), (1, None), (2, ""), (3, " \n\t"), (4, "one"), (4, "one"), (5, PASSAGE), (5, PASSAGE + " x"), (6, "Ä ß 你好 \u2028 🙂 !?"),
    (7, "under the MIT license, Apache License, Version 2 and CC-BY-NC"), (8, "the quick brown fox jumps over the lazy dog " * 30_000), (9, "one"), (10, PASSAGE.upper()),
]
EXTRA = "key int, h int, bucket int, _tag int, _starts int, _kept int, _bad int, _gone int, k int, slot int, size int, ids int, component_id int"


def frame(spark, rows, text="string"):
    names = ", ".join(EXTRA.split(", "))
    columns = ", ".join(f"7 AS {n.split()[0]}" for n in names.split(", "))
    return spark.createDataFrame(rows, f"doc_id bigint, text {text}, lang string").selectExpr("*", *columns.split(", "))


@pytest.fixture(scope="module")
def hard(spark):
    return frame(spark, [(k, t, "en") for k, t in HARD]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def removal(rows, width=20):
    """Removed words of each text, texts in order of doc_id."""
    seen, out = set(), {}
    for key, text in sorted(rows):
        words = re.findall(SPACED, text)
        gone = np.zeros(len(words), bool)
        for i in range(len(words) - width + 1):
            window = tuple(words[i : i + width])
            if window in seen:
                gone[i : i + width] = True
            seen.add(window)
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[key] = (len(words), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
    return out


def components(rows, width=4, percent=85):
    sets, root = {}, {}
    for key, text in rows:
        words = re.findall(SPACED, lower(text))
        sets[key] = {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()
        root[key] = key

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, links = {}, Counter()
    for key in sorted(sets):
        for s in sets[key]:
            holders.setdefault(s, []).append(key)
    for held in holders.values():
        links.update((a, b) for i, a in enumerate(held) for b in held[i + 1 :])
    for (a, b), both in links.items():
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {key: (len(s), find(key)) for key, s in sets.items()}


def by_key(rows, *names):
    return {r[0]: tuple(r[n] for n in names) for r in rows}


def test_op7_matches_brute_force(spark, texts):
    rows = QUERIES["op7_substring_dedup"](spark, SF_DIR).collect()
    assert by_key(rows, "n_words", "n_removed", "kept_sha256") == removal(texts.items())


def test_op7_hard_rows(hard, empty):
    rows = substring_dedup.removal_report(hard).collect()
    assert len(rows) == len(HARD) and substring_dedup.removal_report(empty).count() == 0
    gone = {(r.doc_id, r.n_words): r.n_removed for r in rows}
    assert gone[None, 60] == 0 and gone[5, 60] == 60 and gone[5, 61] == 60 and gone[4, 1] == 0 and gone[10, 60] == 0
    assert gone[8, 270_000] == 270_000 - 9  # a cycle of nine words: only the first nine windows are new
    out = substring_dedup.stage(None, hard, "")
    assert out.columns == hard.columns and out.count() == len(HARD)
    assert {r.doc_id: r.text for r in out.where("doc_id IN (6, 7)").collect()} == dict(HARD[8:10])


def test_op7_without_any_repeat(spark):
    rows = frame(spark, [(i, " ".join(f"{i}a{j}" for j in range(30)), None) for i in range(5)])
    assert {r.n_removed for r in substring_dedup.removal_report(rows).collect()} == {0}


def test_op10_matches_brute_force(spark, texts):
    rows = QUERIES["op10_jaccard_join"](spark, SF_DIR).collect()
    assert by_key(rows, "n_shingles", "component_id") == components(texts.items())


def test_op10_hard_rows(spark, hard, empty):
    rows = jaccard_join.jaccard_components(hard).collect()
    assert jaccard_join.jaccard_components(empty).count() == 0
    root = {r.doc_id: r.component_id for r in rows}
    assert root[4] == root[9] == 4 and root[1] == 1 and root[2] == 2 and root[3] == 3
    kept = jaccard_join.stage(spark, hard, "")
    assert kept.columns == hard.columns and {1, 2, 3, 4, 6, 7, 8} <= {r.doc_id for r in kept.collect()}


def test_op5_and_op8_match_the_library(spark, texts):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    library.no_truncation(), library.no_padding()
    ids = {k: e.ids for k, e in zip(texts, library.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    packed = lambda x: struct.pack(f"<{len(x)}I", *x)
    want = {k: (len(i), digest(packed(i)), digest(library.decode(i, skip_special_tokens=False).encode())) for k, i in ids.items()}
    assert by_key(QUERIES["op5_bpe"](spark, SF_DIR).collect(), "n_tokens", "ids_sha256", "decoded_sha256") == want
    start, files = 0, {}
    for k in sorted(ids):
        files[k] = (start, len(ids[k]) + 1, zlib.crc32(packed([*ids[k], 0])))
        start += len(ids[k]) + 1
    assert by_key(QUERIES["op8_token_files"](spark, SF_DIR).collect(), "start", "n_tokens", "ids_crc32") == files


def test_op5_and_op8_hard_rows(spark, hard, empty):
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(bpe.vocabulary_path())
    got = Counter((r.doc_id, tuple(r.ids)) for r in bpe.encode_texts(hard).collect())
    want = Counter((k, tuple(library.encode(t or "", add_special_tokens=False).ids)) for k, t in HARD)
    assert got == want
    back = bpe.decode_ids(bpe.encode_texts(hard.where("doc_id = 6"))).first()
    assert back.text == HARD[8][1]
    assert bpe.token_report(empty).count() == 0
    folder = scratch(spark, "files")
    found = token_files.read_token_files(token_files.tokens_to_files(hard, folder), folder).collect()
    assert Counter((r[0], tuple(r.ids)) for r in found) == Counter({(k, (*i, 0)): n for (k, i), n in want.items()})
    folder = scratch(spark, "files")
    assert token_files.read_token_files(token_files.tokens_to_files(empty, folder), folder).count() == 0


def test_op1_hard_rows(spark, hard, empty):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(10, 30))), (2, None), (3, ""), (4, "quick brown"), (4, "quick brown"), (None, "one")], "item_id bigint, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contained_items(hard, items).collect()}
    assert found == {(None, 1), (5, 1), (10, 1), (8, 4), (4, None), (9, None)}
    assert decontaminate.contained_items(empty, items).count() == 0
    assert decontaminate.contained_items(hard, items.where("false")).count() == 0
    out = decontaminate.stage(spark, hard, SF_DIR)
    assert out.columns == hard.columns and out.count() == len(HARD)


def test_op9_held_out_accuracy(spark, docs):
    found = QUERIES["op9_language_id"](spark, SF_DIR).where("held_out").join(docs, "doc_id").where("lang IS NOT NULL").collect()
    assert np.mean([r.lang_pred == r.lang for r in found]) > 0.95


def test_op9_hard_rows(spark, hard, empty, docs):
    found = language.predict_languages(hard, docs).collect()
    assert len(found) == len(HARD) and {r.lang_pred for r in found if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in language.predict_languages(hard, empty).collect()} == {"und"}
    assert language.predict_languages(empty, docs).count() == 0
    kept = language.stage(spark, hard, "")
    assert kept.columns == hard.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}


def test_op3_base_places(spark, texts):
    rows = {r.doc_id: r for r in QUERIES["op3_license_scan"](spark, SF_DIR).collect()}
    for key, text in texts.items():
        words = re.findall(ALNUM, lower(text))
        places = {(i, label) for p, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()}
        r = rows[key]
        starts = [i for i, _ in places] or [None]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min(starts), max(starts))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def test_op3_hard_rows(hard, empty):
    found = licenses.scan_licenses(hard).collect()
    assert len(found) == len(HARD) and licenses.scan_licenses(empty).count() == 0
    labels = {d.label for r in found if r.doc_id == 7 for d in r.detections}
    assert {"mit", "apache-2", "cc-by-nc"} <= labels


@pytest.mark.parametrize("weights", [None, [1.0, 3.0]])
def test_op4_slots_and_growth(docs, texts, weights):
    rows = sharding.assign_shards(docs, weights=weights).collect()
    shards = len(weights or [0] * 24)
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(data) + 8, zlib.crc32(data)) and r.grown_shard in (r.shard, shards)
    for s in range(shards):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
    if weights:
        assert 0.68 < sum(r.shard == 1 for r in rows) / len(rows) < 0.82


def test_op4_hard_rows(hard, empty):
    rows = sharding.assign_shards(hard).collect()
    assert len(rows) == len(HARD) == len({(r.shard, r.slot) for r in rows}) and sharding.assign_shards(empty).count() == 0


def test_op6_parts_rules_and_edges(spark):
    cases = {
        1: ("https://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"), 2: ("http://b.org", "b.org", "", None, None),
        3: ("http://b.org/x", "b.org", "/x", "org/", "allow"), 4: ("http://x.com/de/1#a", "x.com", "/de/1", "com/de/", "block"),
        5: ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"), 6: ("nothing", "", "", None, None), 7: (None, "", "", None, None),
        8: ("", "", "", None, None), 9: ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        10: ("http://example.org/en/12?a=://b", "example.org", "/en/12", "example.org/en/1", "block"), 11: ("x://" + "a" * 100_000, "a" * 100_000, "", None, None),
    }
    pages = spark.createDataFrame([(k, v[0], 1) for k, v in cases.items()], "page_id bigint, url string, host int")
    rows = url_filter.judge_urls(pages).collect()
    assert len(rows) == len(cases)
    for r in rows:
        _, host, path, rule, verdict = cases[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ([verdict] if verdict else ["allow", "block"])
    assert url_filter.judge_urls(pages.where("false")).count() == 0


def test_op2_recall_and_scores(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    usable = [(r.vec_id, r.embedding) for r in rows if r.embedding is not None and len(r.embedding) and None not in r.embedding]
    usable = [(k, np.array(v, float)) for k, v in usable if np.isfinite(np.array(v, float)).all() and np.any(v)]
    ids, data = np.array([k for k, _ in usable]), np.array([v for _, v in usable])
    at = {int(k): i for i, k in enumerate(ids)}
    found, hits = {}, []
    for r in QUERIES["op2_nearest"](spark, SF_DIR).collect():
        assert r.score == pytest.approx(np.linalg.norm(data[at[r.query_id]] - data[at[r.vec_id]]), rel=1e-12, abs=1e-12)
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    assert set(found) == {k for k in at if k % 100 == 0}
    for query, got in found.items():
        got.sort()
        assert [g[0] for g in got] == list(range(1, 11)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        far = np.linalg.norm(data - data[at[query]], axis=1)
        order = [int(ids[i]) for i in np.lexsort((ids, far)) if ids[i] != query][:10]
        hits.append(len(set(order) & {g[2] for g in got}) / 10)
    assert np.mean(hits) >= 0.9


def test_op2_hard_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 2.0]), (8, [3.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS id", "2 AS v")
    found = nearest.nearest(table, table.where("vec_id % 100 = 0")).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in found] == [(0, 1, 6, 0.0), (0, 2, 7, 0.0), (0, 3, 8, 2.0)]
    assert nearest.nearest(table.where("false"), table.where("false")).count() == 0


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.stored(stage(spark, now, SF_DIR), name)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in now.collect()}, {r.doc_id: r.text for r in out.collect()}
        if name == "near_duplicates":
            root = components(((k, t or "") for k, t in before.items()), 5, 80)
            assert set(after) == {k for k, (_, r) in root.items() if r == k}
        if name == "repeated_passages":
            want = removal((k, t or "") for k, t in before.items())
            assert {k: len(re.findall(SPACED, t or "")) for k, t in after.items()} == {k: w - g for k, (w, g, _) in want.items()}
        now = out
    assert corpus_pipeline.STAGES[-1][1](spark, now, SF_DIR).count() == now.count()
