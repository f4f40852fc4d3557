"""Benchmark decontamination: which documents hold (nearly) all of a test item, however long they are.

Containment of an item is the share of its shingles that the document has. Items are partitioned by size, as
the sketch that finds them depends on it: of ``q`` shingles, ``ceil(threshold * q)`` must be there, so one of any
``q - ceil(threshold * q) + 1`` is. An item's MinHash sketch is that many shingles, the ones of smallest hash; each
size class also tells the largest hash that any of its sketches uses, so larger hashes need no look. A document
that holds an item holds one of its sketch, so none is missed, which sketches of fixed size for both sides
would do when the document is a thousand times longer. Candidates are then verified by their full shingles.

Shingles of the items, and the sketches of each size class, reach the tasks as bit maps sized by their number, up to 16 MB;
a bit that is set by chance costs a row, as what passes is joined with the real values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardloom.llm.tables import bit_map, free_name, load, map_arrow, stored
from shardloom.llm.words import ALNUM, mix, slabs, split_words

WIDTH, PERCENT = 5, 80


def _distinct(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return doc[new], hashes[new]


def item_sketches(items: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Rows ``item, width, q, size_class, h, sketched`` for every distinct shingle of every item, stored. ``h`` orders shingles
    at random; ``width`` is smaller than asked for items of fewer words, which are one shingle. Rows of one key are one item:
    its size and sketch are those of all its shingles."""

    def task(batches):
        for rest, texts in slabs(batches, text):
            slab = split_words(texts, ALNUM, lower=True)
            begin, hashes = slab.windows(width, short=True)
            doc, hashes = _distinct(slab.doc[begin], mix(hashes))
            yield from pa.table({
                "item": rest.column(0).take(pa.array(doc)), "width": np.minimum(slab.counts[doc], width).astype(np.int32), "h": hashes.view(np.int64),
            }).to_batches()

    rows = items.select(F.col(key).cast("bigint").alias("key"), text)
    shingles = map_arrow(rows, task, "item bigint, width int, h bigint").groupBy("item", "h").agg(F.min("width").alias("width"))
    own = Window.partitionBy("item")
    ranked = shingles.withColumns({"q": F.count("*").over(own), "rank": F.row_number().over(own.orderBy(_unsigned(F.col("h"))))})
    needed = F.ceil(F.col("q") * percent / 100)
    return stored(ranked.select(
        "item", "width", "q", F.floor(F.log2("q")).cast("int").alias("size_class"), "h", (F.col("rank") <= F.col("q") - needed + 1).alias("sketched"),
    ), "items")


def _unsigned(h: Column) -> Column:
    """Orders 64-bit hashes as unsigned numbers."""
    return h.bitwiseXOR(F.lit(-(1 << 63)))


def contained_items(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
    width: int = WIDTH, percent: int = PERCENT,
) -> DataFrame:
    """Per document and item with at least ``percent`` of the item's shingles in the document: ``key``, ``item_key``,
    ``n_shingles``, ``n_found`` and ``containment``.

    Shingles are ``width`` consecutive words, lower-cased, punctuation aside; an item of fewer words is one shingle of all of
    them. Items and documents without words (null and empty ones among them) take no part. Rows that repeat a key are one
    document, or item, with the shingles of all of them; null keys are one key. Other columns are not read.
    """
    spark = docs.sparkSession
    shingles = item_sketches(items, item_key, item_text, width, percent)
    sketch = shingles.where("sketched")
    # Each size class has a bound of its own, the largest hash that its sketches use, and a map of its own.
    classes = [
        (r.width, r.top + (1 << 63), bit_map(sketch.where((F.col("width") == r.width) & (F.col("size_class") == r.size_class))))
        for r in sketch.groupBy("width", "size_class").agg(F.max(_unsigned(F.col("h"))).alias("top")).collect()
    ]
    shared = spark.sparkContext.broadcast((bit_map(shingles), classes))

    def task(batches):
        full, asked = shared.value
        for rest, texts in slabs(batches, text):
            slab = split_words(texts, ALNUM, lower=True)
            found_doc, found = [], []
            for wide in sorted({w for w, _, _ in asked}):
                begin, hashes = slab.windows(wide)
                hashes = mix(hashes)
                hit = np.flatnonzero(full.holds(hashes))
                candidate = np.zeros(len(texts), bool)
                for w, top, sketched in asked:
                    low = hit[hashes[hit] <= np.uint64(top)] if w == wide else hit[:0]
                    candidate[slab.doc[begin[low[sketched.holds(hashes[low])]]]] = True
                hit = hit[candidate[slab.doc[begin[hit]]]]
                found_doc.append(slab.doc[begin[hit]])
                found.append(hashes[hit])
            if found and sum(map(len, found)):
                doc, hashes = _distinct(np.concatenate(found_doc), np.concatenate(found))
                yield from pa.table({"key": rest.column(0).take(pa.array(doc)), "h": hashes.view(np.int64)}).to_batches()

    rows = docs.select(F.col(key).cast("bigint").alias("key"), text)
    hits = stored(map_arrow(rows, task, "key bigint, h bigint").distinct(), "hits")
    # Sides are named apart; null keys are equal. Frequent shingles make skewed joins, which Spark splits. Only shingles of
    # candidates are looked up, so a phrase of all items makes no row for each document and item.
    candidates = stored(hits.join(sketch.select("item", "h").distinct(), "h").select(F.col("key").alias("_k"), F.col("item").alias("_c")).distinct(), "candidates")
    whole = shingles.select("item", F.col("q").alias("n_shingles"), F.col("h").alias("_h"))
    wanted = candidates.join(whole, F.col("_c").eqNullSafe(F.col("item")))
    same = F.col("key").eqNullSafe(F.col("_k")) & (F.col("h") == F.col("_h"))
    pairs = wanted.join(hits, same).groupBy("_k", "item", "n_shingles").agg(F.count("*").alias("n_found"))
    sure = pairs.where(F.col("n_found") * 100 >= F.col("n_shingles") * percent)
    return sure.select(F.col("_k").alias(key), F.col("item").alias(item_key), "n_shingles", "n_found", (F.col("n_found") / F.col("n_shingles")).alias("containment"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(load(spark, sf_dir, "documents", "doc_id", "text"), load(spark, sf_dir, "benchmark", "item_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; all others stay, null and empty ones among them."""
    found = contained_items(docs, load(spark, sf_dir, "benchmark", "item_id", "text"))
    name = free_name(docs, "_bad")
    bad = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(name)), "left_anti")


_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SHINGLES = "list_distinct(list_transform(range(1, len(w) - {1} + 2), lambda i: array_to_string(w[i:i + {1} - 1], ' ')))"
SQL = f"""WITH i AS (SELECT item_id, {_WORDS.format('text')} AS w FROM benchmark),
items AS (SELECT item_id, least(len(w), {WIDTH}) AS wide, unnest({_SHINGLES.format('', f'least(len(w), {WIDTH})')}) AS s FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
shingles AS (SELECT doc_id, x.wide, unnest({_SHINGLES.format('', 'x.wide')}) AS s
  FROM d, (SELECT DISTINCT wide FROM items) x WHERE len(w) >= x.wide),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id)
SELECT s.doc_id, i.item_id, z.n AS n_shingles, count(*) AS n_found, count(*)::DOUBLE / z.n AS containment
FROM shingles s JOIN items i ON i.s = s.s AND i.wide = s.wide JOIN sizes z ON z.item_id = i.item_id
GROUP BY s.doc_id, i.item_id, z.n HAVING count(*) * 100 >= z.n * {PERCENT}"""
