"""Byte-pair encoding, decoding and token counts over whole texts.

Two engines work on one public vocabulary file:

* ``SegmentTreeEncoder`` keeps the ranks of adjacent pairs in a segment tree whose root holds the leftmost pair of
  lowest rank; each merge updates two or three leaves in logarithmic time, until the root holds no mergeable pair.
  Pre-tokens that a slice brings anew are merged together: their trees are columns of one array, every step makes the next
  merge of each of them, and the levels of all trees are renewed by whole-array minima.
* ``HeapCounter`` only counts: a heap of ranked pairs over a doubly linked list of symbols; the count is the number
  of starting symbols less the merges, and no identifier is made.

Pre-tokens repeat, so both keep a bounded memo, which ends with the task. Texts stay whole. A null text counts as empty; empty
texts have no tokens. Special strings inside a text become their own token, as the tokenizer file says. Very long texts are a
slice of their own; repeated rows get repeated results; an empty table gives an empty result; columns that are not named are
not read, and a column to keep that is named like a column of the result is left out.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from parcelyard.llm.shared import bounded_batches
from parcelyard.llm.text import slices

#: Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of the younger half of a memo; a full half becomes the older one. The two hold some 50 MB, and what one slice may add.
MEMO = 100_000
#: Longer pre-tokens are not kept in the memo.
MEMO_BYTES = 64
#: Pre-tokens of at most so many bytes are merged together, if there are so many of about their length; the others one by one.
TOGETHER_BYTES, TOGETHER = 256, 24
#: Leaves of trees that are renewed at once; their arrays stay in a core's cache.
LEAVES = 1 << 16


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 0
    for b in range(256):
        out.append(chr(b if b in plain else 256 + extra))
        extra += b not in plain
    return out


class Vocabulary:
    """Ids of the byte symbols, pair ranks and bytes of each id, read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        symbols = byte_symbols()
        self.first = [vocab[s] for s in symbols]
        #: Rank of a pair of ids, keyed by left << 32 | right, and the id that each rank makes.
        self.rank = {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.merged = [vocab[a + b] for a, b in pairs]
        back = {s: b for b, s in enumerate(symbols)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = {i: bytes(back[c] for c in s) for s, i in vocab.items() if s not in self.special}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pieces(self, text: str) -> Iterator[tuple[int, list[str]]]:
        """Parts of the text: (id of a special token, []) or (-1, pre-tokens)."""
        if self.split is None or not any(s in text for s in self.special):
            yield -1, pre_tokens(text)
            return
        for k, part in enumerate(self.split.split(text)):
            if k % 2:
                yield self.special[part], []
            elif part:
                yield -1, pre_tokens(part)


_PRECISE = regex.compile(PATTERN)
#: Characters for which the plain classes of _QUICK say the same as PATTERN: ASCII and the accented Latin letters.
_UNUSUAL = re.compile("[^\x00-\x7f\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]")
_QUICK = re.compile(
    " ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)"
    "| ?[^ \t-\rA-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
)


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of PATTERN; texts of common characters take an equal pattern of the faster library."""
    return (_PRECISE if _UNUSUAL.search(text) else _QUICK).findall(text)


class Memo:
    """What a task has found for pre-tokens, in two halves: what the younger lacks is taken over from the older."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.memo, self.older = vocabulary, {}, {}

    def turn(self) -> None:
        """Called between texts or slices of texts: a full younger half becomes the older one."""
        if len(self.memo) >= MEMO:
            self.memo, self.older = {}, self.memo

    def word(self, piece: str):
        """The finding for a pre-token that the younger half lacks."""
        found = self.older.get(piece)
        if found is None:
            found = self.find(piece)
        if len(piece) <= MEMO_BYTES:
            self.memo[piece] = found
        return found


class PairRanks:
    """Ranks of whole arrays of pairs: a table in which a pair stands at its hash or in the next free place after it."""

    EMPTY = -2

    def __init__(self, rank: dict[int, int]):
        keys, values = (np.fromiter(x, np.int64, len(rank)) for x in (rank.keys(), rank.values()))
        bits = max(4, (4 * len(rank)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, self.EMPTY, np.int64), np.full(1 << bits, -1, np.int32)
        places, todo = self.hash(keys), np.arange(len(keys))
        while len(todo):
            _, first = np.unique(places[todo], return_index=True)
            placed = todo[first]
            placed = placed[self.keys[places[placed]] == self.EMPTY]
            self.keys[places[placed]], self.values[places[placed]] = keys[placed], values[placed]
            todo = np.setdiff1d(todo, placed, assume_unique=True)
            places[todo] = places[todo] + 1 & self.mask

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids; -1 for pairs without one, also where an id is -1."""
        keys = left.astype(np.int64) << 32 | right
        places = self.hash(keys)
        there = self.keys[places]
        hit = there == keys
        ranks = np.where(hit, self.values[places], np.int32(-1))
        todo = np.flatnonzero(~hit & (there != self.EMPTY))
        while len(todo):
            places[todo] = at = places[todo] + 1 & self.mask
            there = self.keys[at]
            hit = there == keys[todo]
            ranks[todo[hit]] = self.values[at[hit]]
            todo = todo[~hit & (there != self.EMPTY)]
        return ranks


class SegmentTreeEncoder(Memo):
    """Encodes pre-tokens by repeated leftmost lowest-rank merges found at the root of a segment tree."""

    NONE = 1 << 62
    #: The same in the 32 bits of a tree that is a column.
    NONE_32 = np.int32((1 << 31) - 1)

    def __init__(self, vocabulary: Vocabulary):
        super().__init__(vocabulary)
        self.ranks = PairRanks(vocabulary.rank)
        self.first, self.merged = np.array(vocabulary.first, np.int32), np.array(vocabulary.merged, np.int32)
        # One object for each id, whatever the number of findings that hold it.
        self.same = list(range(max(vocabulary.bytes) + 1))
        # Keys of 32 bits hold a rank and a place.
        self.together = TOGETHER_BYTES if len(self.merged) < (1 << 31) // TOGETHER_BYTES - 1 else 0

    def find(self, piece: str) -> tuple[int, ...]:
        first = self.v.first
        return self.merge([first[b] for b in piece.encode("utf-8")])

    def merge(self, ids: list[int]) -> tuple[int, ...]:
        last = len(ids) - 1
        if last < 1:
            return tuple(ids)
        rank, merged, none = self.v.rank.get, self.v.merged, self.NONE
        bits = (last - 1).bit_length()
        size, mask = 1 << bits, (1 << bits) - 1
        # A leaf holds the rank of the pair that starts there, then its place: the least key is the leftmost lowest rank.
        tree = [none] * (2 * size)
        for i in range(last):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[size + i] = r << bits | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        left, right = list(range(-1, last)), list(range(1, last + 2))
        while (root := tree[1]) != none:
            i = root & mask
            j = right[i]
            new = ids[i] = merged[root >> bits]
            ids[j] = -1
            after = right[i] = right[j]
            low = high = size + i
            tree[low] = none
            if j < last:
                high = size + j
                tree[high] = none
            if after <= last:
                left[after] = i
                r = rank(new << 32 | ids[after])
                if r is not None:
                    tree[low] = r << bits | i
            before = left[i]
            if before >= 0:
                low = size + before
                r = rank(ids[before] << 32 | new)
                tree[low] = none if r is None else r << bits | before
            # The two or three changed leaves lie close together, so their paths to the root are walked as one.
            low >>= 1
            high >>= 1
            while low:
                for k in range(low, high + 1):
                    a, b = tree[2 * k], tree[2 * k + 1]
                    tree[k] = a if a < b else b
                low >>= 1
                high >>= 1
        return tuple([x for x in ids if x >= 0])

    def merge_together(self, data: list[bytes], size: int) -> Iterator[tuple[int, ...]]:
        """The ids of each of the byte strings, which are of at most ``size`` bytes, a power of two."""
        n, none, mask = len(data), self.NONE_32, size - 1
        bits = mask.bit_length()
        lengths = np.array([len(d) for d in data])
        # Symbols stand at 1 to their number, and -1 before and behind them; the pair that starts at a place has its leaf.
        ids = np.full((size + 2, n), -1, np.int32)
        ids[1:-1] = self.first[np.array(data, f"S{size}").view(np.uint8).reshape(n, size).T]
        ids[1:-1][np.arange(size)[:, None] >= lengths] = -1
        left, right = (np.repeat(np.arange(k, size + 2 + k, dtype=np.int32), n) for k in (-1, 1))
        # A last row takes what is written for the place behind the last leaf.
        tree = np.full((2 * size + 1, n), none, np.int32)
        r = self.ranks.find(ids[1:size].ravel(), ids[2 : size + 1].ravel()).reshape(size - 1, n)
        tree[size + 1 : 2 * size] = np.where(r >= 0, r << bits | np.arange(1, size, dtype=np.int32)[:, None], none)
        symbols, leaves = ids.reshape(-1), tree[size:].reshape(-1)
        while True:
            k = size
            while k > 1:
                np.minimum(tree[k : 2 * k : 2], tree[k + 1 : 2 * k : 2], out=tree[k >> 1 : k])
                k >>= 1
            column = np.flatnonzero(tree[1] != none)
            if not len(column):
                break
            root = tree[1][column]
            i = root & mask
            at = i * n + column
            gone = right[at] * n + column
            new = self.merged[root >> bits]
            after = right[gone]
            before = left[at]
            next_at, before_at = after * n + column, before * n + column
            symbols[at], symbols[gone] = new, -1
            right[at], left[next_at] = after, i
            leaves[gone] = none
            r = self.ranks.find(np.concatenate([new, symbols[before_at]]), np.concatenate([symbols[next_at], new]))
            made = np.where(r >= 0, r << bits | np.concatenate([i, before]), none)
            leaves[at], leaves[before_at] = made[: len(i)], made[len(i) :]
        kept = ids.T >= 0
        flat = list(map(self.same.__getitem__, ids.T[kept].tolist()))
        ends = np.cumsum(kept.sum(axis=1)).tolist()
        return (tuple(flat[a:b]) for a, b in zip([0, *ends], ends))

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the findings for pre-tokens into the younger half of the memo."""
        groups: dict[int, list[str]] = {}
        for piece in pieces:
            found = self.older.get(piece)
            if found is not None:
                self.memo[piece] = found
            else:
                size = len(piece) if piece.isascii() else len(piece.encode("utf-8"))
                groups.setdefault((max(size, 8) - 1).bit_length(), []).append(piece)
        for bits, group in groups.items():
            if len(group) < TOGETHER or 1 << bits > self.together:
                self.memo.update((piece, self.find(piece)) for piece in group)
                continue
            for k in range(0, len(group), LEAVES >> bits):
                part = group[k : k + (LEAVES >> bits)]
                self.memo.update(zip(part, self.merge_together([p.encode("utf-8") for p in part], 1 << bits)))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; what the texts bring anew is learnt together."""
        self.turn()
        parts = [list(self.v.pieces(text)) for text in texts]
        new = set().union(*(pieces for text in parts for _, pieces in text)).difference(self.memo)
        self.learn(new)
        found, out = self.memo.__getitem__, []
        for text in parts:
            ids: list[int] = []
            for special, pieces in text:
                if special >= 0:
                    ids.append(special)
                ids += chain.from_iterable(map(found, pieces))
            out.append(ids)
        for piece in new:
            if len(piece) > MEMO_BYTES:
                del self.memo[piece]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        table = self.v.bytes
        return b"".join(map(table.__getitem__, ids)).decode("utf-8", errors="replace")


class HeapCounter(Memo):
    """Counts the tokens of pre-tokens with a heap of ranked pairs over a linked list."""

    def find(self, piece: str) -> int:
        return self.count(piece.encode("utf-8"))

    def count(self, data: bytes) -> int:
        n = len(data)
        if n < 2:
            return n
        rank, merged, first, pop, push = self.v.rank.get, self.v.merged, self.v.first, heapq.heappop, heapq.heappush
        ids = [first[b] for b in data]
        bits = n.bit_length()
        mask = (1 << bits) - 1
        # An entry is the rank, then the place of a pair; it is out of date when the place has another rank by now.
        now = [rank(a << 32 | b) for a, b in zip(ids, ids[1:])]
        heap = [r << bits | i for i, r in enumerate(now) if r is not None]
        now.append(None)
        heapq.heapify(heap)
        left, right, merges = list(range(-1, n - 1)), list(range(1, n + 1)), 0
        while heap:
            key = pop(heap)
            i, r = key & mask, key >> bits
            if now[i] != r:
                continue
            j = right[i]
            new = ids[i] = merged[r]
            after = right[i] = right[j]
            now[j] = None
            merges += 1
            if after < n:
                left[after] = i
                r = now[i] = rank(new << 32 | ids[after])
                if r is not None:
                    push(heap, r << bits | i)
            else:
                now[i] = None
            before = left[i]
            if before >= 0:
                r = rank(ids[before] << 32 | new)
                if r != now[before]:
                    now[before] = r
                    if r is not None:
                        push(heap, r << bits | before)
        return n - merges

    def tokens(self, text: str) -> int:
        self.turn()
        total, memo, word = 0, self.memo.get, self.word
        for special, pieces in self.v.pieces(text):
            total += special >= 0
            for piece in pieces:
                total += memo(piece) or word(piece)
        return total


def encode(docs: DataFrame, path: str, with_ids: bool = True, keep: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text: id column, columns to keep, n_tokens, token_ids (if asked for), ids_sha256, decoded_sha256, round_trip.

    No shuffle; one pass over the texts. Null texts are encoded as empty ones: no ids, digest of the empty string.
    """
    bounded_batches(docs.sparkSession)
    made = ["n_tokens"] + ["token_ids"] * with_ids + ["ids_sha256", "decoded_sha256", "round_trip"]
    keep = tuple(c for c in keep if c not in (*made, id_col))
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(docs[c].alias(f"k{k}") for k, c in enumerate(keep)))

    def run(batches):
        encoder, sha = SegmentTreeEncoder(Vocabulary(path)), hashlib.sha256
        decimal = list(map(str, encoder.same)).__getitem__
        for batch in slices(batches, 1):
            ends, flat, ids_sha, text_sha, same = [0], array("i"), [], [], []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for text, ids in zip(texts, encoder.encode_all(texts)):
                decoded = encoder.decode(ids)
                ends.append(ends[-1] + len(ids))
                if with_ids:
                    flat.extend(ids)
                ids_sha.append(sha(",".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(sha(decoded.encode("utf-8")).hexdigest())
                same.append(decoded == text)
            ends = np.array(ends, np.int32)
            cols = [batch.column(0), *batch.columns[2:], pa.array(np.diff(ends).astype(np.int64))]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, np.int32))))
            cols += [pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, [id_col, *keep, *made])

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *keep)) + ", n_tokens bigint, " + "token_ids array<int>, " * with_ids + "ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return rows.mapInArrow(run, schema)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Count the tokens of every text: id column, n_bytes, n_tokens, over_limit (n_tokens > limit). Null counts as empty. One pass, no shuffle."""

    def run(batches):
        counter = HeapCounter(Vocabulary(path))
        for batch in slices(batches, 1):
            sizes, counts = [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                sizes.append(len(text.encode("utf-8")))
                counts.append(counter.tokens(text))
            over = [c > limit for c in counts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(over, pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
