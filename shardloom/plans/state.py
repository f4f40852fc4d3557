"""Saving and restoring the position in the endless batch stream."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardloom.functions.names import NAME_FORMAT, shard_name
from shardloom.functions.splits import check_split
from shardloom.operators.windows import batch_count, check_shape
from shardloom.plans.epochs import EpochOrder, epoch_plan

# A shard set is digested over at most this many ranges of shard numbers.
LEAVES = 256
_LOW = (1 << 32) - 1


@dataclass(frozen=True)
class SetDigest:
    """What a state knows of its shards: how many lie in each range of ``2**bits`` numbers, and sums of the halves of a
    64-bit hash of number and size. Sums do not depend on order; the size of a digest does not depend on the set's."""

    bits: int
    first: int
    last: int
    counts: tuple[int, ...]
    low_sums: tuple[int, ...]
    high_sums: tuple[int, ...]

    @property
    def shards(self) -> int:
        return sum(self.counts)

    def bounds(self, leaf: int) -> tuple[int, int]:
        """Shard numbers of a range that can exist, as a half-open interval."""
        return max(leaf << self.bits, self.first), min((leaf + 1) << self.bits, self.last + 1)

    def full(self, leaf: int) -> bool:
        """Whether the range held every number between the set's first and last."""
        low, high = self.bounds(leaf)
        return self.counts[leaf] == high - low


@dataclass(frozen=True)
class LoaderState:
    """Position after some batches were drawn.

    The position is lazy: after batch ``k`` of a shard it stays in that shard at ``(k+1)*B*S`` and moves
    on only when the next batch is drawn. ``shards`` digests the set, whatever its length.
    """

    split: str
    batch_size: int
    sequence_length: int
    epoch: int
    current_shard: int
    token_position: int
    seed: int
    shards: SetDigest

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> LoaderState:
        fields = json.loads(text)
        digest = {k: tuple(v) if isinstance(v, list) else v for k, v in fields["shards"].items()}
        return cls(**{**fields, "shards": SetDigest(**digest)})


def shard_facts(shards: DataFrame, split: str, batch_size: int, sequence_length: int):
    """One row about the shards of a split: number, tokens, batches an epoch, first and last number, largest and last size."""
    own, count = shards.filter(F.col("split") == check_split(split)), F.col("token_count").cast("bigint")
    return own.agg(
        F.count("*").alias("shards"), F.sum(count).alias("tokens"), F.min("shard_index").alias("first"), F.max("shard_index").alias("last"),
        F.max(count).alias("size"), F.max_by(count, "shard_index").alias("last_size"),
        F.sum(batch_count(count, batch_size, sequence_length)).alias("batches"),
    ).first()


def require_batches(shards: DataFrame, split: str, batch_size: int, sequence_length: int):
    """:func:`shard_facts`, or an error if the split has no shard, or none that holds a batch."""
    facts = shard_facts(shards, split, batch_size, sequence_length)
    if not facts.shards:
        raise ValueError(f"No shards found for split {split}")
    if not facts.batches:
        raise ValueError(f"No shard contains enough tokens for a batch of size {batch_size * sequence_length + 1}")
    return facts


def even_order(facts, split: str, batch_size: int, sequence_length: int, seed: int) -> EpochOrder | None:
    """The closed-form order of the set, if it is cut evenly: numbers from 0 without gaps, all sizes but the last alike."""
    even = facts.first == 0 and facts.last == facts.shards - 1 and facts.tokens == (facts.shards - 1) * facts.size + facts.last_size
    return EpochOrder(split, facts.shards, facts.size, facts.tokens, batch_size, sequence_length, seed) if even else None


def set_digest(shards: DataFrame, split: str, first: int, last: int, bits: int | None = None) -> SetDigest:
    """Digest of the shards of a split numbered ``first`` to ``last``. At most ``LEAVES`` rows reach the driver."""
    bits = max(last.bit_length() - LEAVES.bit_length() + 1, 0) if bits is None else bits
    h = F.xxhash64(F.col("shard_index").cast("bigint"), F.col("token_count").cast("bigint"))
    leaf = F.shiftright(F.col("shard_index").cast("bigint"), bits)
    own = shards.filter((F.col("split") == split) & F.col("shard_index").between(first, last))
    rows = own.groupBy(leaf.alias("leaf")).agg(
        F.count("*").alias("n"), F.sum(h.bitwiseAND(F.lit(_LOW))).alias("low"), F.sum(F.shiftrightunsigned(h, 32)).alias("high")
    )
    leaves = {r.leaf: r for r in rows.collect()}
    numbers = range((last >> bits) + 1)
    columns = [tuple(leaves[i][c] if i in leaves else 0 for i in numbers) for c in ("n", "low", "high")]
    return SetDigest(bits, first, last, *columns)


def loader_state(
    shards: DataFrame, split: str, batch_size: int, sequence_length: int, drawn: int, seed: int = 32
) -> LoaderState:
    """State of a loader that has drawn ``drawn`` batches from the start."""
    check_split(split)
    step = check_shape(batch_size, sequence_length)
    if drawn < 0:
        raise ValueError("drawn must be 0 or more")
    facts = require_batches(shards, split, batch_size, sequence_length)
    last = max(drawn - 1, 0)
    order = even_order(facts, split, batch_size, sequence_length, seed)
    if order:
        epoch, place, batch = order.locate(last)
    else:
        epoch = last // facts.batches
        here = (F.col("first_ordinal") <= last) & (F.col("first_ordinal") + F.col("n_batches") > last)
        at = epoch_plan(shards.filter(F.col("split") == split), batch_size, sequence_length, seed, 1, epoch).filter(here).first()
        place, batch = at.position, last - at.first_ordinal
    shard, position = (place, (batch + 1) * step) if drawn else (0, 0)
    digest = set_digest(shards, split, facts.first, facts.last)
    return LoaderState(split, batch_size, sequence_length, int(epoch), int(shard), int(position), seed, digest)


def differing_ranges(shards: DataFrame, state: LoaderState) -> list[tuple[int, int, int, int]]:
    """Ranges of shard numbers whose shards are not those of the state: ``low, high, saved, found`` (numbers of shards)."""
    saved = state.shards
    found = set_digest(shards, state.split, saved.first, saved.last, saved.bits)
    pairs = zip(zip(saved.counts, saved.low_sums, saved.high_sums, strict=True), zip(found.counts, found.low_sums, found.high_sums, strict=True), strict=True)
    return [(*saved.bounds(i), s[0], f[0]) for i, (s, f) in enumerate(pairs) if s != f]


def missing_of_state(shards: DataFrame, state: LoaderState) -> DataFrame:
    """``shard_name`` of every shard that the state was saved with and that is no longer there.

    Names follow from numbers in every range that had no gap when it was saved; of the others only counts are known.
    """
    spark, saved = shards.sparkSession, state.shards
    ranges = [(low, high) for low, high, was, now in differing_ranges(shards, state) if now < was and was == high - low]
    rows = spark.createDataFrame(ranges, "low bigint, high bigint")
    expected = rows.select(F.explode(F.sequence("low", F.col("high") - 1)).alias("shard_index"))
    own = shards.filter(F.col("split") == state.split).select(F.col("shard_index").cast("bigint"))
    gone = expected.join(own, "shard_index", "left_anti")
    return gone.select(shard_name(F.lit(state.split), F.col("shard_index")).alias("shard_name"))


def check_state(shards: DataFrame, state: LoaderState, split: str, batch_size: int, sequence_length: int) -> None:
    """Every check a restore needs, before anything is changed. Errors name all ranges that differ."""
    if (state.split, state.batch_size, state.sequence_length) != (split, batch_size, sequence_length):
        raise ValueError("split, batch size or sequence length mismatch between state and loader")
    if not state.shards.shards:
        raise ValueError("the state was saved without any shards")
    different = differing_ranges(shards, state)
    told = ", ".join(f"{NAME_FORMAT % (split, low)} to {high - 1} ({found} of {saved} there)" for low, high, saved, found in different)
    if any(found < saved for _, _, saved, found in different):
        raise FileNotFoundError(f"shards are missing (missing_of_state lists them): {told}")
    if different:
        raise ValueError(f"shards differ from those of the saved state: {told}")
    beyond = shards.filter((F.col("split") == split) & ~F.col("shard_index").between(state.shards.first, state.shards.last))
    if beyond.limit(1).count():
        raise ValueError("shards differ from those of the saved state: there are others before or after its own")
    if not 0 <= state.current_shard < state.shards.shards:
        raise ValueError("the state's shard index lies outside its set")
    if state.token_position < 0 or state.token_position % check_shape(batch_size, sequence_length):
        raise ValueError("the state's token position is no multiple of a batch")


def resume_order(
    shards: DataFrame, state: LoaderState, split: str, batch_size: int, sequence_length: int
) -> tuple[EpochOrder | None, int]:
    """Order of the set (None if it is not cut evenly), and the number of the next batch to draw."""
    check_state(shards, state, split, batch_size, sequence_length)
    facts = require_batches(shards, split, batch_size, sequence_length)
    order = even_order(facts, split, batch_size, sequence_length, state.seed)
    if order:
        first = order.first_ordinal(state.current_shard, state.epoch)
        is_last = int(order.shard_at(state.current_shard, state.epoch)) == order.shards - 1
        size = facts.last_size if is_last else facts.size
    else:
        plan = epoch_plan(shards.filter(F.col("split") == split), batch_size, sequence_length, state.seed, 1, state.epoch)
        here = plan.filter(F.col("position") == state.current_shard).first()
        first, size = here.first_ordinal, here.token_count
    if state.token_position > size:
        raise ValueError("the state's token position lies beyond its shard")
    return order, first + state.token_position // (batch_size * sequence_length)


def resume_from(
    shards: DataFrame, state: LoaderState, split: str, batch_size: int, sequence_length: int, epochs: int = 1
) -> tuple[DataFrame, int]:
    """Plan of this and the next epochs, and the ordinal of the next batch to draw from it."""
    _, following = resume_order(shards, state, split, batch_size, sequence_length)
    own = shards.filter(F.col("split") == split)
    return epoch_plan(own, batch_size, sequence_length, state.seed, epochs, state.epoch), following
