"""Shard file names and the fixed binary header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the shard format: 256 little-endian int32 header words, then uint16 tokens.
MAGIC = 20240520
VERSION = 1
HEADER_WORDS = 256
HEADER_BYTES = 1024
TOKEN_BYTES = 2
NAME_FORMAT = "dataset_%s_%06d.bin"
NAME_PATTERN = r"dataset_(train|val)_(\d{6,})\.bin$"


def shard_name(split: Column, shard_index: Column) -> Column:
    return F.format_string(NAME_FORMAT, split, shard_index)


def split_from_name(name: Column) -> Column:
    """Split in a shard name or path; null when the name is not a shard's."""
    return F.nullif(F.regexp_extract(name, NAME_PATTERN, 1), F.lit(""))


def index_from_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, NAME_PATTERN, 2), F.lit("")).cast("int")


def header_word(content: Column, word: int) -> Column:
    """Little-endian int32 number ``word`` of a binary column, by its bytes; null if the file is too short."""
    at = 4 * word
    # Byte order is turned by taking the four bytes from last to first; the top bit is the sign.
    digits = F.concat(*(F.hex(F.substring(content, at + i, 1)) for i in (4, 3, 2, 1)))
    value = F.conv(digits, 16, 10).cast("bigint")
    value = F.when(value >= 1 << 31, value - (1 << 32)).otherwise(value)
    return F.when(F.octet_length(content) >= at + 4, value)


def header_checks(magic: Column, version: Column, token_count: Column, length: Column) -> dict[str, Column]:
    """One boolean per rule of a readable shard. Bytes after the payload are tolerated; a missing file has no length."""
    return {
        "found_ok": length.isNotNull(),
        "header_ok": F.coalesce(length >= HEADER_BYTES, F.lit(False)),
        "magic_ok": F.coalesce(magic == MAGIC, F.lit(False)),
        "version_ok": F.coalesce(version == VERSION, F.lit(False)),
        "count_ok": F.coalesce(token_count > 0, F.lit(False)),
        "payload_ok": F.coalesce(length >= HEADER_BYTES + TOKEN_BYTES * token_count, F.lit(False)),
    }
