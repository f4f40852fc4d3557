"""Positions of documents in the token stream of their split, budgets and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.splits import assign_split, check_split
from shardloom.functions.tokenizers import tokens_of
from shardloom.operators.ordered import key_block, running_sums
from shardloom.session import bound_batches


def tokenize(documents: DataFrame, tokenizer, text: str = "text") -> DataFrame:
    """Replace the text by ``tokens`` and their number. Ids that do not fit two bytes raise."""
    bound_batches(documents.sparkSession)
    rest = [c for c in documents.columns if c != text]
    tokens = documents.select(*rest, tokens_of(tokenizer, F.col(text)).alias("tokens"))
    return tokens.withColumn("n_tokens", F.size("tokens").cast("bigint"))


def count_tokens(documents: DataFrame, tokenizer, text: str = "text") -> DataFrame:
    """``n_tokens`` per document, without tokenizing where the tokenizer can count."""
    if hasattr(tokenizer, "count"):
        return documents.withColumn("n_tokens", tokenizer.count(F.col(text)))
    return documents.withColumn("n_tokens", F.size(tokenizer.tokens(F.col(text))).cast("bigint"))


def token_offsets(counted: DataFrame, order_key: str = "doc_id") -> DataFrame:
    """Start of every document in its split's token stream: ``order_key, split, n_tokens, start``.

    ``counted`` has ``order_key`` (unique 64-bit integers in source order), ``split`` and ``n_tokens``. One
    narrow shuffle by blocks of the order key; no window ever covers more than one block.
    """
    rows = counted.select(order_key, "split", "n_tokens", key_block(F.col(order_key)).alias("block"))
    return running_sums(rows, ["split"], "block", [order_key], {"start": "n_tokens"}).drop("block")


def target_of(split: Column, targets: dict[str, int]) -> Column:
    target = F.lit(None).cast("bigint")
    for name, tokens in targets.items():
        target = F.when(split == check_split(name), F.lit(int(tokens)).cast("bigint")).otherwise(target)
    return target


def apply_budget(offsets: DataFrame, targets: dict[str, int]) -> DataFrame:
    """Documents taken under a token budget per split: those with fewer tokens before them than the target.

    The last one taken overshoots and is kept whole. Splits without a target are dropped.
    """
    return offsets.filter(F.col("start") < target_of(F.col("split"), targets))


def split_totals(taken: DataFrame, shard_size: int, targets: dict[str, int] | None = None) -> DataFrame:
    """Documents, tokens, shards and overshoot per split; ``taken`` has ``split`` and ``n_tokens``."""
    if shard_size < 1:
        raise ValueError("shard_size must be at least 1")
    totals = taken.groupBy("split").agg(F.count("*").alias("documents"), F.sum("n_tokens").alias("tokens"))
    shards = F.expr(f"(tokens + {shard_size} - 1) div {shard_size}").cast("bigint")
    over = F.lit(0).cast("bigint") if targets is None else F.col("tokens") - target_of(F.col("split"), targets)
    return totals.select("split", "documents", "tokens", shards.alias("shards"), over.alias("overshoot"))


def counted_documents(documents: DataFrame, tokenizer, order_key: str = "doc_id", text: str = "text") -> DataFrame:
    """``order_key, split, n_tokens`` of raw documents."""
    split = assign_split(documents.select(order_key, text), text)
    return count_tokens(split, tokenizer, text).select(order_key, "split", "n_tokens")
