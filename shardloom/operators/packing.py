"""Cut the ordered token stream of each split into shards of fixed size.

Documents are counted first; their numbers are stored as a narrow table, which also keeps their split, so a text is hashed
once and read twice. Positions come from the narrow table and return to the texts by key. Tokens travel to their
shard as two bytes each and become numbers only once a shard is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.splits import assign_split
from shardloom.functions.tokenizers import pack_ids, packed_slice, packed_tokens, unpack_ids
from shardloom.operators.offsets import apply_budget, count_tokens, token_offsets
from shardloom.session import bound_batches, scratch


def document_counts(documents: DataFrame, tokenizer, order_key: str, text: str) -> DataFrame:
    """``order_key, split, n_tokens`` of every document; also ``packed`` tokens if the tokenizer cannot count."""
    bound_batches(documents.sparkSession)
    split = assign_split(documents.select(order_key, text), text)
    if hasattr(tokenizer, "count"):
        return count_tokens(split, tokenizer, text).select(order_key, "split", "n_tokens")
    rows = split.select(order_key, "split", packed_tokens(tokenizer, F.col(text)).alias("packed"))
    return rows.withColumn("n_tokens", F.call_function("div", F.octet_length("packed").cast("bigint"), F.lit(2)))


def stored_counts(documents: DataFrame, tokenizer, order_key: str, text: str) -> DataFrame:
    """:func:`document_counts`, stored: texts are hashed once, and tokenized at most once."""
    return stored(document_counts(documents, tokenizer, order_key, text), "counts")


def stored(rows: DataFrame, label: str) -> DataFrame:
    path = scratch(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def pieces(placed: DataFrame, shard_size: int) -> DataFrame:
    """One row per document and shard it reaches into: ``split, shard_index, lo, piece`` (packed ids), from ``split, start,
    n_tokens, packed``.

    Exploding and slicing compile into one loop, which copies a document's tokens once in all,
    however many shards it spans.
    """
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    first = F.expr(f"CAST(start DIV {shard_size} AS BIGINT)")
    last = F.expr(f"CAST((start + n_tokens - 1) DIV {shard_size} AS BIGINT)")
    # An empty document has no pieces; sequence() would count down from its start.
    shard = F.explode(F.when(F.col("n_tokens") > 0, F.sequence(first, last)))
    reached = placed.select("split", "start", "n_tokens", "packed", shard.alias("shard"))
    low = F.greatest(F.col("shard") * shard_size, F.col("start"))
    high = F.least((F.col("shard") + 1) * shard_size, F.col("start") + F.col("n_tokens"))
    return reached.select(
        "split",
        F.col("shard").cast("int").alias("shard_index"),
        (low - F.col("shard") * shard_size).cast("int").alias("lo"),
        packed_slice(F.col("packed"), low - F.col("start"), high - low).alias("piece"),
    )


def assemble(cut: DataFrame) -> DataFrame:
    """Join pieces to shards: ``split, shard_index, token_count, tokens``. Groups hold one shard each."""
    bound_batches(cut.sparkSession)
    ordered = F.sort_array(F.collect_list(F.struct("lo", "piece")))
    shards = cut.groupBy("split", "shard_index").agg(ordered["piece"].alias("pieces"))
    tokens = shards.select("split", "shard_index", unpack_ids(F.col("pieces")).alias("tokens"))
    return tokens.select("split", "shard_index", F.size("tokens").alias("token_count"), "tokens")


def _within(offsets: DataFrame, payload: DataFrame, order_key: str, targets: dict[str, int] | None) -> DataFrame:
    """Payload beside its place, for documents taken under the budget. Under one, the scan of the payload ends at the last key
    taken."""
    if targets is not None:
        offsets = stored(apply_budget(offsets, targets), "offsets")
        last = offsets.agg(F.max(order_key)).first()[0]
        payload = payload.filter(F.col(order_key) <= F.lit(last))
    return offsets.join(payload, order_key)


def pack_shards(
    tokenized: DataFrame, shard_size: int, order_key: str = "doc_id", targets: dict[str, int] | None = None
) -> DataFrame:
    """Shards from ``order_key, split, tokens`` (and ``n_tokens`` if at hand). Store the result of a costly tokenizer first."""
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    if "n_tokens" not in tokenized.columns:
        tokenized = tokenized.withColumn("n_tokens", F.size("tokens").cast("bigint"))
    payload = tokenized.select(order_key, pack_ids(F.col("tokens")).alias("packed"))
    placed = _within(token_offsets(tokenized, order_key), payload, order_key, targets)
    return assemble(pieces(placed, shard_size))


def place_documents(
    documents: DataFrame, counts: DataFrame, tokenizer, order_key: str, text: str, targets: dict[str, int] | None
) -> DataFrame:
    """``split, start, n_tokens, packed`` of the documents taken, from their stored ``counts``. Only they are tokenized."""
    offsets = token_offsets(counts, order_key)
    if "packed" in counts.columns:
        return _within(offsets, counts.select(order_key, "packed"), order_key, targets)
    placed = _within(offsets, documents.select(order_key, text), order_key, targets)
    return placed.select("split", "start", "n_tokens", packed_tokens(tokenizer, F.col(text)).alias("packed"))


def pack_documents(
    documents: DataFrame,
    tokenizer,
    shard_size: int,
    order_key: str = "doc_id",
    text: str = "text",
    targets: dict[str, int] | None = None,
) -> DataFrame:
    """Shards straight from raw text. The documents are counted at once, tokenized when the shards are used."""
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    counts = stored_counts(documents, tokenizer, order_key, text)
    return assemble(pieces(place_documents(documents, counts, tokenizer, order_key, text, targets), shard_size))
