"""Codes, errors and codebooks against a plain version of the rounds in Python's whole numbers."""

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pytest

from shardloom.llm import vector_codes
from shardloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


def plain(rows, parts=8, entries=16, rounds=6):
    kept = [(k, l, [math.floor(4096 * x) for x in v]) for k, l, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], '<i4').tobytes()))
    width = len(kept[0][2])
    bounds = [(width * i // parts, width * (i + 1) // parts) for i in range(parts)]
    books = [[r[2][a:b] for r in kept[:entries]] for a, b in bounds]

    def near(part, book):
        return min((sum((x - y) ** 2 for x, y in zip(part, entry)), i) for i, entry in enumerate(book))

    for _ in range(rounds):
        for j, (a, b) in enumerate(bounds):
            found = [near(r[2][a:b], books[j])[1] for r in kept]
            for i in set(found):
                mine = [r[2][a:b] for r, f in zip(kept, found) if f == i]
                books[j][i] = [sum(c) // len(mine) for c in zip(*mine)]
    out, totals = [], Counter()
    for k, l, q in kept:
        pairs = [near(q[a:b], book) for (a, b), book in zip(bounds, books)]
        out.append((k, l, "".join(f"{i:02x}" for _, i in pairs), sum(d for d, _ in pairs)))
        totals[l] += out[-1][3]
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return Counter((k, c, e, totals[l], digest) for k, l, c, e in out)


def coded(found):
    table, books = found
    return Counter((r.vec_id, r.codes.hex(), r.error, r.label_error, vector_codes.books_digest(books)) for r in table.collect())


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
def test_query_matches_plain_rounds(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    found = QUERIES["op13_vector_codes"](spark, SF_DIR).collect()
    assert Counter(tuple(r) for r in found) == plain(rows)


def table_of(spark, rows):
    frame = spark.createDataFrame([(k, v, l) for k, l, v in rows], "vec_id bigint, embedding array<double>, label int")
    return frame.selectExpr("*", "1 AS key", "2 AS salt", "3 AS numbers", "4 AS l", "5 AS codes")


def test_hard_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(rng.integers(3)), rng.normal(size=19).round(3).tolist()) for i in range(60)]
    same = rows[5][2]
    rows += [(None, None, same), (None, 1, same), (7, None, same), (7, None, same), (61, 0, None), (62, 0, []), (63, 0, [None] * 19), (64, 0, [float("inf")] * 19)]
    rows += [(65, 2, [float("nan"), *same[1:]]), (66, 2, same[:3])]
    want = plain([r for r in rows if r[2] is None or len(r[2]) == 19])
    assert coded(vector_codes.compress(table_of(spark, rows).repartition(5))) == want


def test_few_empty_and_tied_rows(spark):
    few = [(2, 1, [0.5] * 8), (1, 1, [0.25] * 8), (3, None, [0.375] * 8)]  # the last is halfway between two entries
    assert coded(vector_codes.compress(table_of(spark, few), rounds=0)) == plain(few, rounds=0)
    assert coded(vector_codes.compress(table_of(spark, few[:2]), entries=16)) == plain(few[:2])
    table, books = vector_codes.compress(table_of(spark, few).where("false"))
    assert table.count() == 0 and table.columns == ["vec_id", "label", "codes", "error", "label_error"]
    blank, _ = vector_codes.compress(table_of(spark, [(1, 1, []), (2, 1, [])]))
    assert [(r.codes, r.error) for r in blank.collect()] == [(bytes(8), 0)] * 2
    with pytest.raises(Exception, match="31 bits"):
        vector_codes.compress(table_of(spark, [(1, 1, [1e9] * 8)]))


def test_cells_never_lose_the_nearest_entry():
    rng = np.random.default_rng(0)
    for shift in (0, 3, 8, 14):
        part, book = rng.integers(-5000, 5000, (500, 4)), rng.integers(-5000, 5000, (16, 4))
        book[3] = book[9]
        part[:50] = (book[1] + book[2]) // 2
        entry, least = vector_codes.Memory(book, shift).nearest(part)
        far = ((part[:, None] - book) ** 2).sum(2)
        assert (entry == far.argmin(1)).all() and (least == far.min(1)).all()
    assert vector_codes.open_entries(np.array([[0, 0]]), 4, np.array([[0, 0], [1000, 0]])).tolist() == [[True, False]]
