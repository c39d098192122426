"""Vectorised byte work shared by the operators: Arrow columns as byte arrays, words and their 64-bit hashes.

Hashes are polynomial in a fixed 64-bit ring over a fixed random byte table, so they are the same on every executor
and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes handled at once inside a task; bounds the memory of the temporary arrays.
CHUNK = 1 << 18
ASCII_SPACE = (9, 10, 11, 12, 13, 32)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(max(n, CHUNK), base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def as_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and len(off) else np.empty(0, np.uint8)
    return raw, off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK):
    """Consecutive row ranges of about ``size`` bytes; one long row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def slices(batches, column: int, rows: int = 2000, size: int = 4 * CHUNK) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows and about so many bytes of a text column; a longer text is a slice of its own.

    What a task holds besides the batch that Spark sends then doesn't follow the batch.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        for i, j in chunks(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), size):
            for k in range(i, j, rows):
                yield batch.slice(k, min(rows, j - k))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def word_table(separators) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of word bytes; runs end at row ends."""
    inside = is_word[data]
    if not len(inside):
        empty = np.empty(0, np.int64)
        return empty, empty, empty
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    after[-1], after[:-1] = False, inside[1:]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of ``values`` (bytes, or 64-bit names)."""
    up, down = powers(len(values) + 1)
    terms = (_TABLE[values] if values.dtype == np.uint8 else values) * up[: len(values)]
    sums = np.empty(len(values) + 1, U64)
    sums[0] = 0
    np.cumsum(terms, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def strings(values) -> pa.Array:
    return pa.array(values, pa.string())
