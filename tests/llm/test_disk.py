"""What operators leave on disk while and after they run."""

import os
import random
import time
import uuid

import numpy as np
import pytest

import corpus_pipeline
from shardloom.llm import jaccard_join, tables
from shardloom.llm.tables import stored


@pytest.fixture
def folder(tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "scratch", lambda spark, label: f"{tmp_path}/{label}-{uuid.uuid4().hex}")
    return tmp_path


def labels(folder):
    return sorted(name.split("-")[0] for name in os.listdir(folder))


def near_copies(spark, count=60):
    rng = random.Random(3)
    texts = []
    for i in range(count):
        words = texts[rng.randrange(i)].split() if i % 3 else [f"w{rng.randrange(500)}" for _ in range(rng.randrange(5, 200))]
        texts.append(" ".join(w for w in words if rng.random() > 0.005))
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), texts


@pytest.mark.parametrize("limit", [2, 1000])
def test_components_leave_only_what_they_return(spark, folder, limit):
    rows, texts = near_copies(spark)
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(rows, region_limit=limit).collect()}
    assert not {"prefixes", "shared", "counted", "members", "narrowed", "wanted", "sets", "sizes"} & set(labels(folder))
    sets = [{tuple(w[i : i + 4]) for i in range(max(len(w) - 3, 1))} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]) and root[a] != root[b]:
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = [new if r == old else r for r in root]
    assert found == dict(enumerate(root)) and len(set(root)) < len(root)


def test_shuffle_files_go_with_their_query(spark, folder):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for d in manager.localDirs() for _, _, names in os.walk(str(d)) for f in names if f.endswith(".data")}
    before = files()
    found = stored(spark.range(1000).repartition(4, "id"), "rows")
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not {f for f in left if f.startswith("shuffle_")}
    assert found.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_the_pipeline_deletes_what_the_next_stage_has_read(spark, folder, monkeypatch):
    spark.range(10).write.parquet(f"{folder}/documents.parquet")
    steps = [(name, lambda spark, docs, _, n=n: docs.where(f"id > {n}")) for n, name in enumerate(("first", "second", "third"))]
    monkeypatch.setattr(corpus_pipeline, "STAGES", steps)
    assert corpus_pipeline.run(spark, str(folder)).count() == 7
    assert labels(folder) == ["documents.parquet", "third"]


def test_sketches_rule_out_no_link_and_most_others():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in rng.integers(1, 600, 40)]
    sets += [np.r_[s[: int(len(s) * share)], rng.integers(0, 1 << 63, 3, dtype=np.uint64)] for s in sets[:30] for share in (0.9, 1.0)]
    sets = [np.unique(s) for s in sets]
    for percent in (30, 80, 85, 100):
        group = jaccard_join.possible_groups(np.array([len(s) for s in sets]), [jaccard_join.sketch(s) for s in sets], percent)
        for a in range(len(sets)):
            for b in range(a):
                inter = len(np.intersect1d(sets[a], sets[b]))
                if 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                    assert group[a] == group[b]
    assert len(set(group[30:40])) == 10
