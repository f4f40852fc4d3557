"""Vector compression to short codes: each vector is cut into parts, each part names the nearest of a few entries.

Vectors are whole numbers (components times ``scale``, rounded down), so every distance, sum and mean is exact and no
order of rows or tasks changes a result. Codebooks start as the parts of the smallest keys and are refined by rounds of
assigning and averaging: one pass over the stored numbers a round, whose sums for each entry Spark adds up; only
codebooks reach the driver.

Nearest entries are found through memoised grid cells. A part lies in a cell of a coarse grid (its components shifted
right). Over the box of a cell each entry has a smallest and a largest distance; an entry whose smallest distance is
beyond another's largest is nearer nowhere in the box. The entries that remain are remembered by cell, and for each
part of that cell only they are measured. Ties go to the lower index, which the box cannot decide, so entries that
may tie remain.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.tables import load, map_arrow, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Cells remembered for each part in one task; a fuller memory is emptied, and cells are worked out again.
CELLS = 1 << 16
#: Rows that share a salt meet in one task when totals of their label return to them.
SALTS = 1 << 12


def whole_vectors(rows: DataFrame, key: str, vector: str, label: str, scale: int) -> DataFrame:
    """``key, label, numbers`` (32-bit components) of rows whose vector has finite components only, stored."""

    def task(batches):
        for batch in batches:
            column = batch.column(2)
            sizes = pc.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            numbers = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ends = np.cumsum(sizes)
            bad = np.r_[0, np.cumsum(~np.isfinite(numbers))]
            keep = column.is_valid().to_numpy(zero_copy_only=False) & (bad[ends] == bad[ends - sizes])
            whole = np.floor(np.where(np.isfinite(numbers), numbers, 0.0) * scale)
            if len(whole) and np.abs(whole).max() >= 1 << 30:
                raise ValueError(f"a component times {scale} does not fit 31 bits")
            data = whole.astype(np.int32)
            raw = [data[e - s : e].tobytes() for e, s in zip(ends[keep].tolist(), sizes[keep].tolist(), strict=True)]
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(mask), batch.column(1).filter(mask), pa.array(raw, pa.binary())], names=["key", "label", "numbers"]
            )

    kinds = ", ".join(f"{n} {rows.schema[c].dataType.simpleString()}" for n, c in (("key", key), ("label", label)))
    return stored(map_arrow(rows.select(key, label, vector), task, f"{kinds}, numbers binary"), "vectors")


def part_bounds(width: int, parts: int) -> list[tuple[int, int]]:
    return [(width * i // parts, width * (i + 1) // parts) for i in range(parts)]


def open_entries(cells: np.ndarray, shift: int, book: np.ndarray) -> np.ndarray:
    """Mask ``[cell, entry]`` of the entries that may be nearest to some point of the cell's box."""
    low = (cells.astype(np.int64) << shift)[:, None, :]
    high = low + ((1 << shift) - 1)
    below, above = low - book, book - high
    nearest = (np.maximum(np.maximum(below, above), 0) ** 2).sum(2)
    farthest = (np.maximum(-below, -above) ** 2).sum(2)
    return nearest <= farthest.min(1, keepdims=True)


class Memory:
    """Open entries by cell, of one part and one codebook."""

    def __init__(self, book: np.ndarray, shift: int):
        self.book, self.shift, self.known = book, shift, {}

    def masks(self, part: np.ndarray) -> np.ndarray:
        cells = np.ascontiguousarray(part >> self.shift, dtype=np.int32)
        if not cells.shape[1]:
            return np.ones((len(part), len(self.book)), bool)
        _, first, back = np.unique(cells.view(np.dtype((np.void, cells.itemsize * cells.shape[1]))).ravel(), return_index=True, return_inverse=True)
        different = cells[first]
        names = [c.tobytes() for c in different]
        new = [i for i, name in enumerate(names) if name not in self.known]
        found = dict(zip((names[i] for i in new), open_entries(different[new], self.shift, self.book), strict=True))
        masks = np.array([found[n] if n in found else self.known[n] for n in names])
        if len(self.known) + len(found) > CELLS:
            self.known.clear()
        self.known.update(found if len(found) <= CELLS else {})
        return masks[back]

    def nearest(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and its squared distance, for each row."""
        row, entry = np.nonzero(self.masks(part))
        distance = ((part[row] - self.book[entry]) ** 2).sum(1)
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(distance, first)
        hit = np.flatnonzero(distance == least[row])
        hit = hit[np.r_[True, row[hit][1:] != row[hit][:-1]]]
        return entry[hit], least


class Coder:
    """Assigns whole vectors to the entries of given codebooks."""

    def __init__(self, books: list[np.ndarray], shift: int):
        self.books, self.shift = books, shift
        self.width = sum(b.shape[1] for b in books)

    def run(self, batches):
        """Per batch: the batch, its numbers, and for each part the assigned entries and distances."""
        memories = [Memory(book, self.shift) for book in self.books]
        at = np.cumsum([0, *(b.shape[1] for b in self.books)])
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = b"".join(batch.column(batch.schema.get_field_index("numbers")).to_pylist())
            numbers = np.frombuffer(raw, np.int32).astype(np.int64).reshape(batch.num_rows, self.width)
            yield batch, numbers, [m.nearest(numbers[:, a:b]) for m, a, b in zip(memories, at, at[1:], strict=False)]


def first_books(rows: DataFrame, bounds: list[tuple[int, int]], entries: int) -> list[np.ndarray]:
    first = rows.select("key", "numbers").orderBy(F.col("key").asc_nulls_last(), "numbers").limit(entries).collect()
    numbers = np.array([np.frombuffer(r.numbers, np.int32) for r in first], np.int64).reshape(len(first), bounds[-1][1])
    return [numbers[:, a:b] for a, b in bounds]


def next_books(rows: DataFrame, books: list[np.ndarray], shift: int) -> list[np.ndarray]:
    """Codebooks after one round: each entry becomes the floor of the mean of its parts; unused ones stay."""
    coder = Coder(books, shift)

    def task(batches):
        counts = [np.zeros(len(b), np.int64) for b in coder.books]
        sums = [np.zeros(b.shape, np.int64) for b in coder.books]
        at = np.cumsum([0, *(b.shape[1] for b in coder.books)])
        for _, numbers, found in coder.run(batches):
            for j, (entry, _) in enumerate(found):
                counts[j] += np.bincount(entry, minlength=len(counts[j]))
                order = np.argsort(entry, kind="stable")
                used, first = np.unique(entry[order], return_index=True)
                sums[j][used] += np.add.reduceat(numbers[order, at[j] : at[j + 1]], first, axis=0)
        for j, (count, total) in enumerate(zip(counts, sums, strict=True)):
            table = np.c_[count, total]
            entry, place = np.nonzero(table)
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.full(len(entry), j, np.int32)), "entry": pa.array(entry.astype(np.int32)),
                "place": pa.array(place.astype(np.int32)), "total": pa.array(table[entry, place]),
            })

    totals = map_arrow(rows.select("numbers"), task, "part int, entry int, place int, total bigint").groupBy("part", "entry", "place")
    tables = [np.zeros((len(b), b.shape[1] + 1), object) for b in books]
    for part, entry, place, total in totals.agg(F.sum("total")).collect():  # as many as the codebooks have numbers
        tables[part][entry, place] = total
    out = []
    for book, table in zip(books, tables, strict=True):
        book = book.copy()
        for e in np.flatnonzero(table[:, 0]):
            book[e] = [total // table[e, 0] for total in table[e, 1:]]
        out.append(book)
    return out


def cell_shift(rows: DataFrame) -> int:
    """Grid width as a power of two, about half the root mean square component. The width changes no result, only how
    many entries a cell leaves open (8 of 16 on random vectors, 15 at twice the width) and how many cells there are."""

    def task(batches):
        total, count = 0.0, 0
        for batch in batches:
            numbers = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32).astype(np.float64)
            total, count = total + float((numbers**2).sum()), count + len(numbers)
        yield pa.RecordBatch.from_pydict({"total": [total], "count": [count]})

    sums = map_arrow(rows.select("numbers"), task, "total double, count bigint").agg(F.sum("total").alias("total"), F.sum("count").alias("n")).first()
    return max(0, round(0.5 * np.log2(max((sums.total or 0.0) / max(sums.n or 0, 1), 1.0))) - 1)


def compress(
    rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all vectors, and the final codebooks (an array ``[entry, component]`` for each part).

    Rows: ``key``, ``label``, ``codes`` (an entry index a part), ``error`` (squared distances summed over parts),
    ``label_error`` (``error`` summed over equal labels, nulls together).

    Vectors that are null or hold null or non-finite components take no part. All vectors are taken to have the most
    frequent length (the longer one, if two are equally frequent); others take no part either. Parts are equal if the length
    divides by ``parts``, else they differ by one component. Null keys come after all others when codebooks start; rows of one
    key are ordered by the bytes of their numbers, and repeated rows are rows of their own. Fewer rows than entries make smaller codebooks;
    without any row the result is empty. Components that do not fit the exact arithmetic (beyond 2**30 after scaling, or
    whose distances exceed 64 bits) are an error. Other columns are not read.
    """
    if not 1 <= entries <= 256 or parts < 1:
        raise ValueError("entries must lie in 1..256 and parts must be positive")
    whole = whole_vectors(rows, key, vector, label, scale)
    lengths = whole.groupBy(F.octet_length("numbers").alias("length")).agg(F.count("*").alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    width = common.length // 4 if common else 0
    whole = whole.where(F.octet_length("numbers") == 4 * width)
    bounds = part_bounds(width, parts)
    books = first_books(whole, bounds, entries)
    shift = cell_shift(whole)
    for _ in range(rounds if common else 0):
        books = next_books(whole, books, shift)

    coder = Coder(books, shift)

    def task(batches):
        done = 0
        for batch, numbers, found in coder.run(batches):
            error = np.sum([distance for _, distance in found], axis=0)
            largest = 2 * max(int(np.abs(numbers).max(initial=0)), *(int(np.abs(b).max(initial=0)) for b in coder.books))
            if coder.width * largest**2 >= 1 << 62:
                raise ValueError("components are too large for distances of 64 bits")
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            n = len(error)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error.astype(np.int64)),
                pa.array(((done + np.arange(n)) % SALTS).astype(np.int32)),
            ], names=["key", "label", "codes", "error", "salt"])
            done += n

    kinds = ", ".join(f"{n} {whole.schema[n].dataType.simpleString()}" for n in ("key", "label"))
    coded = stored(map_arrow(whole, task, f"{kinds}, codes binary, error bigint, salt int"), "codes")
    # A label may hold most rows: totals return to it by label and salt, so that no task gets all of them.
    salted = coded.groupBy("label", "salt").agg(F.sum("error").alias("error"))
    totals = salted.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error"))
    spread = salted.select("label", "salt").join(totals, F.col("label").eqNullSafe(F.col("l"))).select("l", F.col("salt").alias("s"), "label_error")
    joined = coded.join(spread, F.col("label").eqNullSafe(F.col("l")) & (F.col("salt") == F.col("s")))
    return joined.select(F.col("key").alias(key), F.col("label").alias(label), "codes", "error", "label_error"), books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return coded.select(
        "vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256")
    )


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same rounds as DuckDB SQL: one table of nearest entries and one of codebooks for each round."""
    ctes = [
        f"""whole AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, q) AS r, * FROM (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)))""",
        f"""cut AS (SELECT r, j, q[(len(q) // {parts} * j + 1)::BIGINT:(len(q) // {parts} * (j + 1))::BIGINT] AS p
  FROM (SELECT r, q, unnest(range({parts})) AS j FROM whole))""",
        f"book0 AS (SELECT j, (r - 1)::BIGINT AS e, p AS c FROM cut WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"""near{i} AS (SELECT r, j, min(d) AS d, arg_min(e, (d, e)) AS e FROM (
  SELECT r, cut.j, e, list_sum(list_transform(range(1, len(p) + 1), lambda i: (p[i] - c[i]) * (p[i] - c[i])))::BIGINT AS d
  FROM cut JOIN book{i} ON book{i}.j = cut.j) GROUP BY r, j)""")
        if i < rounds:
            ctes.append(f"""book{i + 1} AS (SELECT b.j, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN (
  SELECT j, e, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM (
    SELECT j, e, i, sum(x)::BIGINT AS s, count(*) AS n FROM (
      SELECT cut.j, near{i}.e, unnest(p) AS x, unnest(range(len(p))) AS i FROM cut JOIN near{i} ON near{i}.r = cut.r AND near{i}.j = cut.j)
    GROUP BY j, e, i) GROUP BY j, e) m ON m.j = b.j AND m.e = b.e)""")
    ctes.append(f"""coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY j) AS code, sum(d)::BIGINT AS error
  FROM near{rounds} GROUP BY r)""")
    return f"""WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY j, e)) FROM book{rounds}) AS codebooks_sha256
  FROM coded JOIN whole ON whole.r = coded.r"""


SQL = _sql()
