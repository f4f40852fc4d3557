"""The trie against a plain one made of Python tuples."""

import hashlib
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from shardloom.llm import trie
from shardloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(rows, rebuilt):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in own.items()}
    if not rebuilt:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = abs(c) // 100 * 100 * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(rows, rebuilt=True):
    convs = conversations(rows, rebuilt)
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, held in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(held) - 1) * len(node[-1][1]) if node else 0
    return sorted(
        (m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest())
        for n, m in members.items()
    )


def got(frame):
    assert frame.columns == COLUMNS
    return sorted(tuple(r) for r in frame.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS depth", "2 AS name", "3 AS t1", "4 AS block", "5 AS id")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_query_matches_plain_trie(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_prefix_trie"](spark, SF_DIR)) == plain(rows)


def test_hard_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(c, int(t), str(rng.choice(["user", "bot"])), str(rng.choice(["a", "bb", "ä🙂"]))) for c in range(-150, 260, 3) for t in range(int(rng.integers(1, 7)))]
    rows += [(c, t, "user", "same") for c in range(1000, 1100) for t in range(3)]
    rows += [(None, 1, "user", "lost"), (5000, None, "user", "first"), (5000, 0, None, None), (5000, 0, "", ""), (5000, 0, None, ""), (5001, 1, "u", "ser")]
    rows += [(5001, 2, "us", "er"), (7, 9, "user", "x" * 200_000), (9223372036854775807, 0, "user", "end"), (-9223372036854775808, 0, "user", "end")]
    rows += rows[:40]
    # Turns of one number are ordered by digest: leave such ties to equal rows here.
    seen, kept = {}, []
    for r in rows:
        if seen.setdefault(r[:2], (r[2] or "", r[3] or "")) == (r[2] or "", r[3] or ""):
            kept.append(r)
    frame = table(spark, kept).repartition(5)
    assert got(trie.prefix_trie(frame, rebuilt=True)) == plain(kept)
    assert got(trie.prefix_trie(frame)) == plain(kept, rebuilt=False)


def test_long_conversations_go_on_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "STRETCH", 16)
    base = [str(i % 7) for i in range(600)]
    long = {0: base, 1: base[:8], 2: base[:16], 3: base[:9] + ["x"], 4: base[:64], 5: base[:512], 6: base[:513], 7: base[:511] + ["y"] * 40, 8: base[:520], 9: base, 10: base[:65] + ["z"]}
    rows = [(c, t, "user", text) for c, turns in long.items() for t, text in enumerate(turns)]
    assert got(trie.prefix_trie(table(spark, rows))) == plain(rows, rebuilt=False)
    assert got(trie.prefix_trie(table(spark, rows), rebuilt=True)) == plain(rows)


def test_hot_nodes_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 16)
    rows = [(c, 0, "user", "hi") for c in range(0, 4000, 10)] + [(c, 0, "user", "no") for c in range(1, 32)]
    assert got(trie.prefix_trie(table(spark, rows).repartition(7))) == plain(rows, rebuilt=False)


def test_ties_are_ordered_alike_everywhere(spark):
    one = [(1, 0, "user", t) for t in "abc"] + [(2, 0, "user", t) for t in "cab"]
    nodes = got(trie.prefix_trie(table(spark, one).repartition(3)))
    assert [n[1] for n in nodes] == [0, 1, 2, 3] and {n[3] for n in nodes} == {2}


def test_no_rows(spark):
    assert got(trie.prefix_trie(table(spark, []), rebuilt=True)) == []
    assert got(trie.prefix_trie(table(spark, [(None, 1, "user", "x")]))) == []
