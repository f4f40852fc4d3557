"""Words of many texts at once, as numpy arrays: where they stand and a hash of each.

All operators on words share this. A *slab* is a run of consecutive texts of one task, a few MB long (one
longer text makes a longer slab). Its UTF-8 bytes are classified by a 256-entry table, so a word is a
maximal run of word bytes; texts are separated by a byte that belongs to no word. A word's hash is the
value of its bytes as a polynomial modulo the prime 2**61 - 1, mixed to 64 bits; windows
of words are hashed the same way one level up. Prefix sums give every hash from two entries, which is
the Rabin-Karp recurrence for all positions at once. Modulo a prime two different words of ``n`` bytes agree for at
most ``n`` of the 2**61 bases; modulo a power of two some words agree for every base.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLAB_BYTES = 2 << 20

_U = np.uint64
_P, _LOW31, _LOW30 = _U((1 << 61) - 1), _U((1 << 31) - 1), _U((1 << 30) - 1)
_BASE, _WORD_BASE, _OTHER_BASE = 0x1E3779B97F4A7C15, 0x1342543DE82EF95, 0x0F1357AEA2E62A9C


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & _P) + (x >> _U(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo 2**61 - 1 of numbers below it, by halves: 2**61 is 1 and 2**62 is 2."""
    a1, a0, b1, b0 = a >> _U(31), a & _LOW31, b >> _U(31), b & _LOW31
    middle = a1 * b0 + a0 * b1
    return _reduced(((a1 * b1) << _U(1)) + (middle >> _U(30)) + ((middle & _LOW30) << _U(31)) + a0 * b0)


class Powers:
    """Powers of a base and of its inverse modulo 2**61 - 1, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, int(_P))
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        for name, base in (("up", self.base), ("down", self.inverse)):
            held = getattr(self, name)
            while len(held) < n:
                held = np.r_[held, times(held, _U(pow(base, len(held), int(_P))))]
            setattr(self, name, held)

    def halves(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Upper and lower 31 bits of the first ``n`` powers of a block."""
        if not hasattr(self, "_halves"):
            self.grow(_BLOCK)
            self._halves = self.up[:_BLOCK] >> _U(31), self.up[:_BLOCK] & _LOW31
        return self._halves[0][:n], self._halves[1][:n]


_bytes_powers, _word_powers, _other_powers = Powers(_BASE), Powers(_WORD_BASE), Powers(_OTHER_BASE)

Prefix = tuple[np.ndarray, np.ndarray]


#: Numbers hashed at a time: what a step holds besides its result stays small, however long the texts.
_BLOCK = 1 << 18


def prefix_hash(values: np.ndarray, powers: Powers) -> Prefix:
    """Prefix sums of the polynomial's terms, as sums of their upper and of their lower halves; ``values`` lie below 2**61 - 1."""
    powers.grow(len(values) + 1)
    upper, lower = np.zeros((2, len(values) + 1), np.uint64)
    for a in range(0, len(values), _BLOCK):
        b = min(a + _BLOCK, len(values))
        terms = times(values[a:b], powers.up[a:b])
        upper[a + 1 : b + 1] = np.cumsum(terms >> _U(31)) + upper[a]
        lower[a + 1 : b + 1] = np.cumsum(terms & _LOW31) + lower[a]
    return upper, lower


def _block_prefix(values: np.ndarray, powers: Powers) -> Prefix:
    """:func:`prefix_hash` of one block. Products of numbers below 2**14 need no reduction before they are summed."""
    if not len(values) or int(values.max()) >> 14:
        return prefix_hash(values, powers)
    upper, lower = np.zeros((2, len(values) + 1), np.uint64)
    for out, half in zip((upper, lower), powers.halves(len(values)), strict=True):
        np.cumsum(values * half, out=out[1:])
    return upper, lower


def range_values(prefix: Prefix, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """The polynomial of ``values[start:end]`` for each pair, as if it stood at 0."""
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), _BLOCK):
        some = slice(a, a + _BLOCK)
        upper, lower = (_reduced(half[end[some]] - half[start[some]]) for half in prefix)
        out[some] = times(_reduced(times(upper, _U(1 << 31)) + lower), powers.down[start[some]])
    return out


def _with_length(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mix(values + lengths.astype(np.uint64) * _U(0xA24BAED4963EE407))


def range_hash(prefix: Prefix, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for each pair; the length takes part."""
    return _with_length(range_values(prefix, start, end, powers), end - start)


def hash_ranges(values: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers) -> np.ndarray:
    """:func:`range_hash` of ascending, disjoint ranges of small numbers, block by block; a longer range is summed in pieces."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        low = int(start[at])
        to = int(np.searchsorted(end, low + _BLOCK, side="right"))
        if to > at:
            prefix = _block_prefix(values[low : end[to - 1]].astype(np.uint64) + _U(1), powers)
            out[at:to] = range_hash(prefix, start[at:to] - low, end[at:to] - low, powers)
        else:
            to, total, one = at + 1, 0, np.zeros(1, np.int64)
            for a in range(low, int(end[at]), _BLOCK):
                piece = values[a : min(a + _BLOCK, int(end[at]))].astype(np.uint64) + _U(1)
                value = int(range_values(prefix_hash(piece, powers), one, one + len(piece), powers)[0])
                total = (total + value * pow(powers.base, a - low, int(_P))) % int(_P)
            out[at] = _with_length(np.array([total], np.uint64), end[at : at + 1] - start[at : at + 1])[0]
        at = to
    return out


def _table(word: list[tuple[int, int]]) -> np.ndarray:
    out = np.zeros(256, bool)
    for low, high in word:
        out[low : high + 1] = True
    return out


def _all_but(*gaps: tuple[int, int]) -> np.ndarray:
    out = np.ones(256, bool)
    for low, high in gaps:
        out[low : high + 1] = False
    return out


#: ``[^\x20\x09-\x0D]+``
SPACED = _all_but((0x20, 0x20), (0x09, 0x0D))
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of lower-cased text
ALNUM = _all_but((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Stands between texts; no UTF-8 text holds it.
_GAP = 0xFF


@dataclass
class Slab:
    """Words of ``rows`` texts. Word ``i`` is ``data[start[i]:end[i]]`` and belongs to text ``doc[i]``;
    text ``d`` has words ``first[d]`` to ``first[d + 1]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def position(self) -> np.ndarray:
        return np.arange(len(self.doc)) - self.first[self.doc]

    def windows(self, width: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every window of ``width`` words within a text. ``short``: a text of
        fewer words, but at least one, gives one window of all of them."""
        room = self.first[self.doc + 1] - np.arange(len(self.doc))
        begin = np.flatnonzero(room >= width)
        end = begin + width
        if short:
            few = np.flatnonzero((self.counts < width) & (self.counts > 0))
            begin, end = np.concatenate([begin, self.first[few]]), np.concatenate([end, self.first[few + 1]])
            order = np.argsort(begin, kind="stable")
            begin, end = begin[order], end[order]
        if not len(begin):
            return begin, np.zeros(0, np.uint64)
        return begin, range_hash(prefix_hash(self.hashes >> _U(4), _word_powers), begin, end, _word_powers)

    def other_hashes(self, begin: np.ndarray, width: int) -> np.ndarray:
        """A second hash of windows of ``width`` words, with a base of its own: 61 more bits that tell them apart."""
        return range_values(prefix_hash(self.hashes >> _U(4), _other_powers), begin, begin + width, _other_powers)


def split_words(texts: list[bytes], word: np.ndarray, lower: bool, hashed: bool = True) -> Slab:
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])  # one past each text's separator
    if lower:
        data = _LOWER[data]
    inside = word[data]
    inside[ends - 1] = False
    change = np.flatnonzero(np.diff(inside, prepend=False))
    start, end = change[0::2], change[1::2]
    doc = np.searchsorted(ends, start, side="right")
    first = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(texts)))]
    slab = Slab(data, start, end, doc, first)
    if hashed:
        slab.hashes = hash_ranges(data, start, end, _bytes_powers)
    return slab


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, nulls as empty."""
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def slabs(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLAB_BYTES) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Rows of a task in slabs of about ``limit`` bytes of text: the other columns, and the texts."""
    rows: list[pa.RecordBatch] = []
    held: list[bytes] = []
    size = 0

    def out() -> tuple[pa.Table, list[bytes]]:
        return pa.Table.from_batches(rows), held

    for batch in batches:
        at = batch.schema.get_field_index(text)
        texts = text_bytes(batch.column(at))
        rest = batch.select([c for i, c in enumerate(batch.schema.names) if i != at])
        begin = 0
        for i, t in enumerate(texts):
            if size and size + len(t) > limit:
                rows.append(rest.slice(begin, i - begin))
                held.extend(texts[begin:i])
                yield out()
                rows, held, size, begin = [], [], 0, i
            size += len(t) + 1
        rows.append(rest.slice(begin))
        held.extend(texts[begin:])
    if held:
        yield out()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[0] .. starts[0] + lengths[0] - 1, starts[1] ..`` as one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)
