"""Tokenizers as column expressions. Every document starts with an end-of-text id."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from shardloom.functions.checks import required
from shardloom.session import release_memory, ship_code

# GPT-2's end-of-text id, and the largest id two bytes hold.
END_OF_TEXT = 50256
MAX_TOKEN_ID = 65535


def fits_two_bytes(tokens: Column) -> Column:
    """Whether every id fits an unsigned 16-bit integer; of no ids, yes."""
    return F.coalesce((F.array_max(tokens) <= MAX_TOKEN_ID) & (F.array_min(tokens) >= 0), tokens.isNotNull())


def check_token_ids(tokens: Column) -> Column:
    """The tokens, or an error if an id does not fit an unsigned 16-bit integer.

    For ids from elsewhere; the tokenizers here know their largest id when they are made.
    """
    return F.when(fits_two_bytes(tokens), tokens).otherwise(F.raise_error(F.lit("token id outside 0..65535")).cast("array<int>"))


def present(text: Column) -> Column:
    return required(text, "document text is null", "")


def byte_ids(texts: pa.Array, eot: int, kind: type = np.int32) -> tuple[np.ndarray, np.ndarray]:
    """``[eot, *bytes]`` of every text in one pass over the buffers of the whole batch: ids, and where each text's begin."""
    raw = pa.array(texts).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, 8 * raw.offset)
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    starts = offsets - offsets[0] + np.arange(len(raw) + 1)
    ids = np.full(starts[-1], eot, kind)
    is_byte = np.ones(starts[-1], bool)
    is_byte[starts[:-1]] = False
    ids[is_byte] = data
    return ids, starts


def tokens_of(tokenizer, text: Column) -> Column:
    """Tokens of a text, their ids checked unless the tokenizer vouches for them with ``max_id``."""
    tokens = tokenizer.tokens(text)
    safe = 0 <= getattr(tokenizer, "max_id", MAX_TOKEN_ID + 1) <= MAX_TOKEN_ID
    return tokens if safe else check_token_ids(tokens)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of 16-bit ids as binary values; ``ends`` counts ids."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(2 * ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())


def array_udf(task: Callable[[pa.Array], pa.Array], kind: str):
    """An Arrow UDF of whole batches whose worker gives its memory back after each task."""

    def released(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for batch in batches:
                yield task(batch)
        finally:
            release_memory()

    ship_code()
    return F.arrow_udf(released, kind)


def pack_ids(tokens: Column) -> Column:
    """Ids as two bytes each, little-endian; an id that does not fit is an error. ``binary_slice`` and ``unpack_ids`` read it."""

    def pack(lists: pa.Array) -> pa.Array:
        if lists.null_count:
            raise ValueError("tokens are null")
        ids = lists.flatten().to_numpy(zero_copy_only=False)
        if len(ids) and (ids.min() < 0 or ids.max() > MAX_TOKEN_ID):
            raise ValueError("token id outside 0..65535")
        ends = lists.offsets.to_numpy().astype(np.int64)
        return _binary(np.ascontiguousarray(ids, "<u2"), ends - ends[0])

    return array_udf(pack, "binary")(tokens)


def packed_tokens(tokenizer, text: Column) -> Column:
    """Tokens of a text as packed ids; straight from its bytes where the tokenizer can."""
    return tokenizer.packed(text) if hasattr(tokenizer, "packed") else pack_ids(tokenizer.tokens(text))


def packed_slice(packed: Column, first: Column, count: Column) -> Column:
    return F.substring(packed, (2 * first + 1).cast("int"), (2 * count).cast("int"))


def unpack_ids(pieces: Column) -> Column:
    """Ids of an array of packed pieces, one after the other."""

    def unpack(lists: pa.Array) -> pa.Array:
        values = lists.flatten().cast(pa.large_binary())
        ends = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, 8 * values.offset)
        data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ids = np.frombuffer(data.tobytes(), "<u2").astype(np.int32)
        bounds = (ends - ends[0])[lists.offsets.to_numpy() - lists.offsets[0].as_py()] // 2
        return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))

    return array_udf(unpack, "array<int>")(pieces)


@dataclass(frozen=True)
class ByteTokenizer:
    """One id per UTF-8 byte: byte-pair encoding without merges.

    ``engine="native"`` uses built-in expressions only. The default is an Arrow UDF over whole batches:
    higher-order functions are interpreted element by element, and it needs a quarter of their CPU time.
    """

    eot: int = END_OF_TEXT
    name: str = "bytes"
    engine: str = "arrow"

    def __post_init__(self):
        if not 0 <= self.eot <= MAX_TOKEN_ID:
            raise ValueError("token id outside 0..65535")
        if self.engine not in ("native", "arrow"):
            raise ValueError("engine must be 'native' or 'arrow'")

    @property
    def max_id(self) -> int:
        return max(255, self.eot)

    def count(self, text: Column) -> Column:
        """Length of ``tokens(text)`` without tokenizing."""
        return (F.octet_length(present(text)) + 1).cast("bigint")

    def tokens(self, text: Column) -> Column:
        if self.engine == "arrow":
            eot = self.eot

            def encode(batch: pa.Array) -> pa.Array:
                ids, starts = byte_ids(batch, eot)
                return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))

            return array_udf(encode, "array<int>")(present(text))
        # Latin-1 has one character per byte, numbered like the byte.
        text = present(text)
        chars = F.split(F.decode(text.cast("binary"), "ISO-8859-1"), "")
        ids = F.transform(chars, lambda c: F.ascii(c))
        head = F.array(F.lit(self.eot))
        return F.when(F.length(text) > 0, F.concat(head, ids)).otherwise(head)

    def packed(self, text: Column) -> Column:
        """``tokens`` as two bytes each, without 32-bit ids in between."""
        if self.engine == "native":
            return pack_ids(self.tokens(text))
        eot = self.eot

        def encode(batch: pa.Array) -> pa.Array:
            return _binary(*byte_ids(batch, eot, np.dtype("<u2")))

        return array_udf(encode, "binary")(present(text))


class BpeTokenizer:
    """Byte-pair encoding with user-supplied ranks, as an Arrow UDF.

    ``ranks`` maps token bytes to ids (``from_file`` reads a ``.tiktoken`` rank file). The table goes
    to each executor once, as a broadcast; each Python worker builds its encoder once. Special-token
    text inside a document is ordinary text.
    """

    def __init__(
        self, spark: SparkSession, ranks: dict[bytes, int], pattern: str | None = None,
        eot: int = END_OF_TEXT, name: str = "bpe",
    ):
        if eot > MAX_TOKEN_ID or eot < 0 or (ranks and max(ranks.values()) > MAX_TOKEN_ID):
            raise ValueError("token id outside 0..65535")
        if pattern is None:
            from tiktoken_ext.openai_public import r50k_pat_str as pattern
        self.eot, self.name = eot, name
        self.max_id = max([eot, *ranks.values()])
        shared = spark.sparkContext.broadcast((pattern, ranks))

        def encode(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import tiktoken

            pattern, ranks = shared.value
            encoding = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            for batch in texts:
                ids = [[eot, *encoding.encode_ordinary(text)] for text in batch.to_pylist()]
                yield pa.array(ids, pa.list_(pa.int32()))

        ship_code()
        self._encode = F.arrow_udf(encode, "array<int>")

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, **options) -> BpeTokenizer:
        from tiktoken.load import load_tiktoken_bpe

        return cls(spark, load_tiktoken_bpe(path), **options)

    def tokens(self, text: Column) -> Column:
        return self._encode(present(text))
