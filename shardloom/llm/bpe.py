"""Byte-pair encoding by speculation: guess by greedy longest match, verify all adjacent pairs, mend the rest.

A sequence of tokens is what the merges give for its bytes if and only if every adjacent pair is, taken alone
(given that every token is what the merges give for its own bytes; tokens that are not are never guessed). A
pair is tested by undoing the later of the two merges at the boundary, step by step: if a merge across the
boundary would have come earlier, the guess is wrong. The test runs on all pairs of all new words at once;
words with a bad pair are merged exactly. A worker remembers words by hash, so few are encoded twice. Words stay in
numpy arrays from text to ids: no step runs Python code for each word, but for very long ones.

Texts are cut into words by runs of character classes, computed for a whole slab at once, which gives what the
vocabulary's pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` gives.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardloom.llm.tables import load, map_arrow
from shardloom.llm.words import Powers, hash_ranges, ragged, slabs

VOCABULARY = "byte_bpe_50k.json"
SLAB = 2 << 20
_NEVER, _LONG = 1 << 40, 64
REMEMBERED = 1 << 18  # words a worker remembers before it forgets all; results do not depend on it
_PLACES = 1 << 20  # where it remembers them: of two words with one place the later one stays
OTHER, LETTER, NUMBER, SPACE, SPECIAL = range(5)
_SPECIAL_AT = 0x110000  # code points from here on stand for special tokens
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_powers = Powers(0x11357AEA2E62A9C5)


@cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(_SPECIAL_AT)), np.uint8, _SPECIAL_AT)
    out[_SPACES] = SPACE
    return np.r_[out, np.full(1 << 16, SPECIAL, np.uint8)]


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary file lies; every executor resolves it on its own machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes as: visible bytes as themselves, others from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level vocabulary file, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        vocab = spec["model"]["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for name, i in vocab.items():
            self.bytes_of[i] = bytes(letters[c] for c in name)
        for name, i in self.specials.items():
            self.bytes_of[i] = name.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        # By token: the merge that makes it (-1 for single bytes) and its halves.
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        first = np.unique(made, return_index=True)
        self.rank[first[0]] = first[1]
        self.left[first[0]], self.right[first[0]] = left[first[1]], right[first[1]]
        keys = left << 32 | right
        order = np.argsort(keys)
        self.pair_index, self.pair_ranks, self.made = pd.Index(keys[order]), order, made
        self.merges = {int(k): (r, int(m)) for r, (k, m) in enumerate(zip(keys, made, strict=True))}
        # Only tokens that their own bytes give may be guessed.
        whole = np.flatnonzero(self.rank >= 0)
        sound = np.ones(size, bool)
        sound[whole] = self.compatible(self.left[whole], self.right[whole], self.rank[whole])
        for t in whole[np.argsort(self.rank[whole])]:
            sound[t] &= sound[self.left[t]] and sound[self.right[t]]
        self.ids = {self.bytes_of[i]: i for i in vocab.values() if sound[i]}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.steps, self.token_at = _trie(list(self.ids), np.array(list(self.ids.values()), np.int64))
        self.data = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([len(b) for b in self.bytes_of], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.special_ids = list(self.specials.values())
        self.forget()

    def forget(self) -> None:
        self.known, self.known_slot = np.zeros(_PLACES, np.uint64), np.full(_PLACES, -1, np.int32)
        self.starts, self.counts = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.arena = np.zeros(1 << 18, np.int32)
        self.used = self.words = 0

    # ------------------------------------------------------------ words

    def compatible(self, a: np.ndarray, b: np.ndarray, bound: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges leave each pair of tokens as it is; ``bound``: merges from there on do not count."""
        a, b = a.copy(), b.copy()
        bound = np.full(len(a), 1 << 40) if bound is None else bound.copy()
        out, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y = a[open_], b[open_]
            bad = self.pair_rank(x, y) < bound[open_]
            out[open_[bad]] = False
            undo_x = self.rank[x] > self.rank[y]
            undo_y = ~undo_x & (self.rank[y] >= 0)
            bound[open_] = np.where(undo_x, self.rank[x], self.rank[y] + 1)
            a[open_[undo_x]] = self.right[x[undo_x]]
            b[open_[undo_y]] = self.left[y[undo_y]]
            open_ = open_[~bad & (undo_x | undo_y)]
        return out

    def guess(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match for all words at once, whose bytes stand in a row: tokens in a row, and how many each word has.
        All words walk the tree of tokens a byte a step; a word's next token starts where its last one ends."""
        at, end, word = np.cumsum(sizes) - sizes, np.cumsum(sizes), np.arange(len(sizes))
        found_word, found_at, found = [], [], []
        while len(at):
            token = np.full(len(at), -1)
            walk, node, here = np.arange(len(at)), np.zeros(len(at), np.int64), at
            while len(walk):
                node = self.steps.get_indexer(node << 8 | data[here]) + 1
                on = node > 0
                walk, node, here = walk[on], node[on], here[on] + 1
                made = self.token_at[node]
                token[walk[made >= 0]] = made[made >= 0]
                on = here < end[walk]
                walk, node, here = walk[on], node[on], here[on]
            found_word.append(word)
            found_at.append(at)
            found.append(token)
            at = at + self.size[token]
            more = at < end
            at, end, word = at[more], end[more], word[more]
        order = np.argsort(np.concatenate(found_at), kind="stable")
        return np.concatenate(found)[order], np.bincount(np.concatenate(found_word), minlength=len(sizes))

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = self.pair_index.get_indexer(a << 32 | b)
        return np.where(slot >= 0, self.pair_ranks[slot], _NEVER)

    def merge_all(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The merges themselves for all words at once, a merge of each word a round: the lowest rank, leftmost first."""
        tokens = np.array(self.single)[data]
        word = np.repeat(np.arange(len(sizes)), sizes)
        rank = np.full(len(tokens), _NEVER)  # of the pair that starts here
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank[inside] = self.pair_rank(tokens[inside], tokens[inside + 1])
        done_word, done_at, done = [], [], []
        place = np.arange(len(tokens))
        while len(tokens):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lowest = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(tokens)])
            open_ = np.repeat(lowest < _NEVER, size)
            done_word.append(word[~open_])
            done_at.append(place[~open_])
            done.append(tokens[~open_])
            tokens, word, rank, place = tokens[open_], word[open_], rank[open_], place[open_]
            if not len(tokens):
                break
            low = np.repeat(lowest, size)[open_]
            hit = np.flatnonzero(rank == low)
            hit = hit[np.r_[True, word[hit[1:]] != word[hit[:-1]]]]
            tokens[hit] = self.made[rank[hit]]
            keep = np.ones(len(tokens), bool)
            keep[hit + 1] = False
            moved = (np.cumsum(keep) - 1)[hit]
            tokens, word, rank, place = tokens[keep], word[keep], rank[keep], place[keep]
            for at in (moved, moved[moved > 0] - 1):
                last = np.minimum(at + 1, len(word) - 1)
                fits = (at + 1 < len(word)) & (word[last] == word[at])
                rank[at] = np.where(fits, self.pair_rank(tokens[at], tokens[last]), _NEVER)
        order = np.argsort(np.concatenate(done_at), kind="stable")
        return np.concatenate(done)[order], np.bincount(np.concatenate(done_word), minlength=len(sizes))

    def merge(self, word: bytes) -> list[int]:
        """The merges themselves: always the lowest rank, leftmost first."""
        tokens, n = [self.single[b] for b in word], len(word)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (found := self.merges.get(tokens[i] << 32 | tokens[j])):
                heapq.heappush(heap, (found[0], i, tokens[i], tokens[j], found[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if tokens[i] != x or j >= n or tokens[j] != y:
                continue
            tokens[i], tokens[j], after[i] = made, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in tokens if t >= 0]

    def learn(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Encode new words, whose bytes stand in a row, and give the number each is kept under."""
        flat, counts = self.guess(data, sizes)
        word = np.repeat(np.arange(len(sizes)), counts)
        inside = np.flatnonzero(word[1:] == word[:-1])
        codes, pairs = pd.factorize(flat[inside] << 32 | flat[inside + 1])
        good = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[codes] if len(pairs) else np.ones(0, bool)
        right = np.ones(len(sizes), bool)
        right[word[inside[~good]]] = False
        if not right.all():
            first, failing = np.cumsum(sizes) - sizes, np.flatnonzero(~right)
            far = sizes[failing] > _LONG
            long, near = failing[far], failing[~far]
            mended = [self.merge(data[a:b].tobytes()) for a, b in zip(first[long].tolist(), (first + sizes)[long].tolist(), strict=True)]
            short, many = self.merge_all(data[ragged(first[near], sizes[near])], sizes[near]) if len(near) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            order = np.concatenate([np.flatnonzero(right), long, near])
            new = np.concatenate([flat[np.repeat(right, counts)], np.array([t for m in mended for t in m], np.int64), short])
            made = np.concatenate([counts[right], np.array([len(m) for m in mended], np.int64), many])
            back = np.argsort(order)
            flat, counts = new[ragged((np.cumsum(made) - made)[back], made[back])], made[back]
        self.keep(flat, counts)
        return np.arange(self.words - len(sizes), self.words)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The number each word is kept under; -1: not known."""
        place = (hashes & np.uint64(len(self.known) - 1)).astype(np.int64)
        return np.where(self.known[place] == hashes, self.known_slot[place], -1).astype(np.int64)

    def remember(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        place, last = np.unique((hashes & np.uint64(len(self.known) - 1))[::-1], return_index=True)
        place, last = place.astype(np.int64), len(hashes) - 1 - last
        self.known[place], self.known_slot[place] = hashes[last], slots[last]

    def keep(self, flat: np.ndarray, counts: np.ndarray) -> None:
        """Remember the tokens of more words."""

        def grown(held: np.ndarray, need: int) -> np.ndarray:
            return held if need <= len(held) else np.r_[held, np.zeros(max(len(held), need - len(held)), held.dtype)]

        self.arena = grown(self.arena, self.used + len(flat))
        self.starts, self.counts = (grown(x, self.words + len(counts)) for x in (self.starts, self.counts))
        self.arena[self.used : self.used + len(flat)] = flat
        new = slice(self.words, self.words + len(counts))
        self.starts[new], self.counts[new] = self.used + np.cumsum(counts) - counts, counts
        self.used += len(flat)
        self.words += len(counts)

    # ------------------------------------------------------------ texts

    def code_points(self, text: str) -> list[np.ndarray]:
        """Pieces of a text: runs between special tokens, and each special token as one code point beyond Unicode."""
        pieces = [text]
        for number, name in enumerate(self.specials):
            cut = []
            for p in pieces:
                if isinstance(p, str) and name in p:
                    for i, q in enumerate(p.split(name)):
                        cut += [_SPECIAL_AT + number] * (i > 0) + [q]
                else:
                    cut.append(p)
            pieces = cut
        return [np.frombuffer(p.encode("utf-32-le"), np.uint32) if isinstance(p, str) else np.array([p], np.uint32) for p in pieces]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        strings = [t.decode() for t in texts]
        if any(name in s for name in self.specials for s in strings):
            parts = [self.code_points(s) for s in strings]
            sizes = np.array([sum(map(len, p)) for p in parts])
            pieces = np.array([len(x) for p in parts for x in p])
            cp = np.concatenate([x for p in parts for x in p]) if parts else np.zeros(0, np.uint32)
        else:
            sizes = pieces = np.array([len(s) for s in strings])
            cp = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(sizes)
        if not len(cp):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        begin = np.zeros(len(cp) + 1, bool)
        begin[np.cumsum(pieces) - pieces] = True
        start = word_starts(cp, begin)
        end = np.r_[start[1:], len(cp)]
        hashes = hash_ranges(cp, start, end, _powers)
        codes, unique = pd.factorize(hashes)
        if self.words > REMEMBERED:
            self.forget()
        slots = self.slots(unique)
        new = np.flatnonzero(slots < 0)
        if len(new):
            where = np.full(len(unique), -1)
            where[codes[::-1]] = np.arange(len(codes))[::-1]
            where = where[new]
            special = cp[start[where]] >= _SPECIAL_AT
            for i, c in zip(new[special].tolist(), cp[start[where[special]]].tolist(), strict=True):
                slots[i] = self._special_slot(c - _SPECIAL_AT)
            if not special.all():
                sizes_8 = np.add.reduceat(self._width(cp), start, dtype=np.int64)
                plain, where = new[~special], where[~special]
                data = np.frombuffer(b"".join(texts), np.uint8)[ragged((np.cumsum(sizes_8) - sizes_8)[where], sizes_8[where])]
                slots[plain] = self.learn(data, sizes_8[where])
            self.remember(unique[new], slots[new])
        slot = slots[codes]
        counts = self.counts[slot]
        ids = self.arena[ragged(self.starts[slot], counts)]
        total = np.r_[0, np.cumsum(counts)]
        return ids, total[np.searchsorted(start, ends)] - total[np.searchsorted(start, ends - sizes)]

    def _width(self, cp: np.ndarray) -> np.ndarray:
        """Bytes of each code point in UTF-8; a special token has those of its name."""
        out = (cp >= 0x80).astype(np.int32)
        out += cp >= 0x800
        out += cp >= 0x10000
        out += 1
        special = np.flatnonzero(cp >= _SPECIAL_AT)
        if len(special):
            out[special] = np.array([len(name.encode()) for name in self.specials])[cp[special] - _SPECIAL_AT]
        return out

    def _special_slot(self, number: int) -> int:
        self.keep(np.array([self.special_ids[number]]), np.array([1]))
        return self.words - 1

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text; ids outside the vocabulary are left out, broken characters become U+FFFD."""
        known = (ids >= 0) & (ids < len(self.size))
        at = np.r_[0, np.cumsum(counts)]
        sizes = np.where(known, self.size[np.where(known, ids, 0)], 0)
        cut = np.r_[0, np.cumsum(sizes)][at]
        raw = self.data[ragged(self.first[np.where(known, ids, 0)], sizes)].tobytes()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]


def _trie(tokens: list[bytes], ids: np.ndarray) -> tuple[pd.Index, np.ndarray]:
    """The tree of all prefixes of tokens: the steps ``node << 8 | byte``, where step ``i`` leads to node ``i + 1``, and each
    node's token (-1: a prefix only). The root is node 0."""
    sizes = np.array([len(t) for t in tokens])
    data, first = np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(sizes) - sizes
    node, steps, held = np.zeros(len(tokens), np.int64), [], 0
    for depth in range(int(sizes.max())):
        some = np.flatnonzero(sizes > depth)
        codes, taken = pd.factorize(node[some] << 8 | data[first[some] + depth])
        node[some] = codes + held + 1
        held += len(taken)
        steps.append(taken)
    token_at = np.full(held + 1, -1)
    token_at[node] = ids
    return pd.Index(np.concatenate(steps)), token_at


def word_starts(cp: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start; ``begin`` marks the starts of pieces (one entry more than ``cp``)."""
    kind = _classes()[cp]
    special = kind == SPECIAL
    begin[:-1] |= special
    begin[1:] |= special
    begin[-1] = True
    edge = begin[:-1].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(edge)
    end = np.r_[run[1:], len(cp)]
    what = kind[run]
    followed = ~begin[end]
    is_space = (what == SPACE) & followed
    start = edge
    # Of spaces before other characters the last one stands apart; a plain one goes with what follows.
    start[end[is_space & (end - run > 1)] - 1] = True
    joins = is_space & (cp[end - 1] == 0x20)
    start[end[joins]] = False
    joined = np.r_[False, joins[:-1]]
    quote = np.flatnonzero((what == OTHER) & (end - run == 1) & (cp[run] == 0x27) & ~joined & followed)
    quote = quote[what[np.minimum(quote + 1, len(what) - 1)] == LETTER]
    if len(quote):
        at, stop = end[quote], end[quote + 1]
        one = np.isin(cp[at], [ord(c) for c in "stmd"])
        second = cp[np.minimum(at + 1, len(cp) - 1)]
        two = np.zeros(len(at), bool)
        for pair in ("re", "ve", "ll"):
            two |= (cp[at] == ord(pair[0])) & (second == ord(pair[1])) & (stop - at >= 2)
        size = np.where(one, 1, np.where(two, 2, 0))
        hit = size > 0
        start[at[hit]] = False
        longer = hit & (stop - at > size)
        start[at[longer] + size[longer]] = True
    return np.flatnonzero(start)


@cache
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path or vocabulary_path())


# ---------------------------------------------------------------- Spark


def encode_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """Per row: ``key`` and ``ids array<int>``. Null and empty texts have no ids. Repeated rows and null keys stay as they
    are, other columns are not read. ``path``: a vocabulary file on every executor; by default the public one."""

    def task(batches):
        words = vocabulary(path)
        for rest, texts in slabs(batches, text, SLAB):
            ids, counts = words.encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
            yield from pa.table({"key": rest.column(0), "ids": lists}).to_batches()

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("key"), text), task, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.fill_null([]) if column.null_count else column
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def decode_ids(rows: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """Per row: ``key`` and ``text``, special tokens written out. Null lists give empty texts."""

    def task(batches):
        words = vocabulary(path)
        for batch in batches:
            texts = words.decode(*_lists(batch.column(1)))
            yield pa.RecordBatch.from_pydict({"key": batch.column(0), "text": pa.array(texts, pa.binary()).cast(pa.string())})

    kind = rows.schema[key].dataType.simpleString()
    return map_arrow(rows.select(F.col(key).alias("key"), ids), task, f"key {kind}, text string").withColumnRenamed("key", key)


def token_report(
    docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, keep_ids: bool = False, slab: int = SLAB
) -> DataFrame:
    """Encode, then decode the ids again. Per row: ``key``, ``n_tokens``, ``ids_sha256`` (ids as little-endian 32-bit numbers),
    ``decoded_sha256`` of the text that the ids decode to, and ``ids`` if asked for. Both steps run in one Python task, so that
    one worker holds the vocabulary. Nulls, repeats and other columns as in :func:`encode_texts`."""

    def report(words: Vocabulary, rest: pa.Table, texts: list[bytes]) -> pa.Table:
        ids, counts = words.encode(texts)
        raw, at = ids.astype("<u4").tobytes(), (4 * np.r_[0, np.cumsum(counts)]).tolist()
        out = {
            "key": rest.column(0), "n_tokens": counts,
            "ids_sha256": [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)],
            "decoded_sha256": [hashlib.sha256(t).hexdigest() for t in words.decode(ids, counts)],
        }
        if keep_ids:
            out["ids"] = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids, pa.int32()))
        return pa.table(out)

    def task(batches):
        words = vocabulary(path)
        for rest, texts in slabs(batches, text, slab):
            yield from report(words, rest, texts).to_batches()  # the arrays of a slab are gone before the next one

    kind = docs.schema[key].dataType.simpleString()
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(F.col(key).alias("key"), text), task, schema).withColumnRenamed("key", key)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_report(load(spark, sf_dir, "documents", "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left as token ids, with the digests that show that they decode to the text: one row for each document. Null texts
    count as empty and have no ids; rows that repeat a ``doc_id`` stay rows of their own. A text is encoded in one slab, however
    long, which takes some 60 bytes of memory a character."""
    # Beside what an executor holds after four stages, half a slab.
    return token_report(docs, keep_ids=True, slab=SLAB // 2)
