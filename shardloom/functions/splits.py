"""Deterministic train/val assignment by a hash of the document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardloom.functions.checks import required

SPLITS = ("train", "val")


def check_split(split: str) -> str:
    if split not in SPLITS:
        raise ValueError(f"split must be 'train' or 'val', got {split!r}")
    return split


def hash_bucket(text: Column, num_buckets: int = 32) -> Column:
    """First 8 bytes of SHA-256 of the text as an unsigned big-endian number, modulo ``num_buckets``."""
    if num_buckets < 1:
        raise ValueError("num_buckets must be at least 1")
    digest = F.sha2(text, 256)
    if num_buckets & (num_buckets - 1) == 0 and num_buckets <= 1 << 32:
        # Modulo a power of two depends on the low bits only, so the last hex digits suffice.
        digits = max(1, -(-(num_buckets.bit_length() - 1) // 4))
        low = F.conv(F.substring(digest, 17 - digits, digits), 16, 10).cast("bigint")
        return (low % num_buckets).cast("int")
    word = F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")
    return (word % F.lit(num_buckets).cast("decimal(20,0)")).cast("int")


def split_of(text: Column, num_buckets: int = 32, val_bucket: int = 0) -> Column:
    """'val' for one bucket, 'train' for the others. Null text is an error, empty text is valid."""
    bucket = hash_bucket(required(text, "document text is null", ""), num_buckets)
    return F.when(bucket == val_bucket, F.lit("val")).otherwise(F.lit("train"))


def assign_split(documents: DataFrame, text: str = "text", num_buckets: int = 32, val_bucket: int = 0) -> DataFrame:
    if not 0 <= val_bucket < num_buckets:
        raise ValueError("val_bucket must lie in [0, num_buckets)")
    return documents.withColumn("split", split_of(F.col(text), num_buckets, val_bucket))
