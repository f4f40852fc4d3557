"""A keyed permutation of ``0 .. n-1`` that is computed for one number at a time, and undone the same way.

Swap or not: each round pairs every number ``x`` with ``(k - x) mod n`` and a pseudo-random bit of the pair says whether its two
swap places. A round undoes itself, so the inverse is the same rounds backwards, and any ``n`` works without walking cycles.
The same integer arithmetic is given three times: as a column expression, for numpy arrays, and (beside the queries) as SQL.
Plans take the arrays (``place_column``): the expression is interpreted for each row and round.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from shardloom.session import ship_code

# A round's key is two numbers below PRIME in one: the partner's and the bit's.
PRIME = (1 << 31) - 1
KEY_BITS = 31
ROUNDS = 90
# Largest n: pairs are told apart modulo PRIME.
MOST = PRIME


def _squared(x):
    return (x % PRIME) * (x % PRIME) % PRIME


def round_keys(seed: int, epoch: int, rounds: int = ROUNDS) -> np.ndarray:
    digest = hashlib.sha256(f"{seed}:{epoch}".encode()).hexdigest()
    a, b = int(digest[:7], 16), int(digest[7:14], 16)
    r = np.arange(rounds, dtype=np.int64)
    return (_squared(_squared(a + r * 40503) + b) << KEY_BITS) + _squared(_squared(b + r * 69069) + a)


def round_keys_column(seed: int, epoch: Column, rounds: int = ROUNDS) -> Column:
    """Keys of all rounds as ``array<bigint>``, for an epoch that is a column."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string")), 256)
    a, b = (F.conv(F.substring(digest, at, 7), 16, 10).cast("bigint") for at in (1, 8))

    def key(r: Column) -> Column:
        r = r.cast("bigint")
        return _squared(_squared(a + r * 40503) + b) * (1 << KEY_BITS) + _squared(_squared(b + r * 69069) + a)

    return F.transform(F.sequence(F.lit(0), F.lit(rounds - 1)), key)


def check_domain(n: int) -> int:
    if not 1 <= n <= MOST:
        raise ValueError(f"need a number of shards in 1..{MOST}")
    return n


def permuted(x: np.ndarray, n: int, keys: np.ndarray, inverse: bool = False) -> np.ndarray:
    """Places of the numbers ``x`` under the permutation, or the numbers at the places ``x``."""
    check_domain(n)
    return _swapped(np.array(x, np.int64), n, (keys[::-1] if inverse else keys).tolist())


def _swapped(x: np.ndarray, n, keys) -> np.ndarray:
    """``x`` after a round for each of ``keys``; ``n`` and every key are numbers, or arrays beside ``x``."""
    for key in keys:
        partner = (key >> KEY_BITS) % n - x
        partner += (partner < 0) * n
        bit = _squared(_squared(np.maximum(x, partner) + (key & PRIME)) + 1) >> 15 & 1
        x = np.where(bit == 1, partner, x)
    return x


def place_column(x: Column, n: Column, seed: int, epoch: Column) -> Column:
    """Places of the numbers ``x`` in an epoch of a seed, a batch of rows at a time; ``n`` and ``epoch`` may differ by row."""

    def place(x: pa.Array, n: pa.Array, epoch: pa.Array) -> pa.Array:
        null = x.is_null().to_numpy(zero_copy_only=False)
        x, n, epoch = (a.fill_null(other).to_numpy(zero_copy_only=False) for a, other in ((x, 0), (n, 1), (epoch, 0)))
        if len(n):
            check_domain(int(n.min()))
            check_domain(int(n.max()))
        epochs, at = np.unique(epoch, return_inverse=True)
        keys = np.array([round_keys(seed, e) for e in epochs.tolist()], np.int64).reshape(len(epochs), ROUNDS)
        rounds = keys[0].tolist() if len(epochs) == 1 else (key[at] for key in keys.T)
        return pa.array(_swapped(x, n, rounds), pa.int64(), mask=null)

    ship_code()
    return F.arrow_udf(place, "bigint")(x.cast("bigint"), n.cast("bigint"), epoch.cast("bigint"))


def permuted_column(x: Column, n: Column, keys: Column, inverse: bool = False) -> Column:
    """:func:`permuted` as a column; ``n`` may differ by row."""
    n = n.cast("bigint")

    def swap(x: Column, key: Column) -> Column:
        partner = F.pmod(F.shiftright(key, KEY_BITS) % n - x, n)
        t = _squared(_squared(F.greatest(x, partner) + key.bitwiseAND(F.lit(PRIME).cast("bigint"))) + 1)
        return F.when(F.shiftright(t, 15).bitwiseAND(F.lit(1).cast("bigint")) == 1, partner).otherwise(x)

    return F.aggregate(F.reverse(keys) if inverse else keys, x.cast("bigint"), swap)
