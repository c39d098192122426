"""Document fingerprints by locally consistent parsing.

Every level collapses runs, then labels each symbol by deterministic coin tossing: the lowest bit in which it differs
from its left neighbour, and that bit, repeated until few labels remain. Local maxima of the labels start the phrases,
and a phrase's hash is its name on the next level. Labels depend on a few neighbours only, so equal substrings get equal
interior phrases wherever they stand. A fingerprint is the bottom-k sketch of a text's phrase names on two levels;
the second occurrence of a name counts as another name, so repetition is compared too.

Defined results: null counts as the empty text, whose fingerprint is the empty string; two empty fingerprints are alike
with 1, an empty and another one with 0. Equal texts have equal fingerprints. Ids are whole numbers; null ids come first and
repeated ids are ordered by a hash of their text. Very long texts are parsed whole. Other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.text import CHUNK, U64, as_bytes, chunks, mix, slices, span_hashes

#: Names kept of a text, and the levels whose names count (a phrase of level 2 has about 8 bytes, one of level 3 about 25).
SKETCH = 64
LEVELS = (2, 3)
#: Rows between two neighbouring documents' range boundaries, and the largest number of ranges.
RANGE_ROWS, MAX_RANGES = 1000, 100_000


def _coin(now: np.ndarray, before: np.ndarray) -> np.ndarray:
    differ = now ^ before
    low = differ & (~differ + differ.dtype.type(1))
    place = np.bitwise_count(low - differ.dtype.type(1))
    return (place * np.uint8(2) + ((now & low) != 0)).astype(np.uint8)


def _level(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of one level and the offsets of the rows among them."""
    n = len(symbols)
    first = np.zeros(n, bool)
    first[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    # Runs of a symbol become one symbol, so that neighbours differ.
    head = first.copy()
    head[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(head)
    runs = np.diff(np.append(at, n))
    names = symbols[at]
    if (runs > 1).any():
        long = runs > 1
        names = names.astype(U64)
        names[long] = mix(names[long] * U64(0xA24BAED4963EE407) + runs[long].astype(U64) + U64(1 << 40))
    rows = np.searchsorted(at, offsets)
    start = first[at]
    label = names
    for _ in range(4 if names.dtype == U64 else 3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[start] = ~label[start]  # a row's first symbol differs in its lowest bit
        label = _coin(label, before)
    left, right = np.zeros(len(label), np.int16), np.full(len(label), -1, np.int16)
    left[1:], right[:-1] = label[:-1], label[1:]
    cut = (label > left) & (label > right) | start
    starts = np.flatnonzero(cut)
    ends = np.append(starts[1:], len(label))
    return span_hashes(names if names.dtype == U64 else names.astype(U64) + U64(0x51ED27), starts, ends), np.searchsorted(starts, rows)


def sketches(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """For each row the sorted least SKETCH distinct 32-bit names of its phrases."""
    out: list[np.ndarray] = []
    for i, j in chunks(offsets):
        off = offsets[i : j + 1] - offsets[i]
        symbols, kept = data[offsets[i] : offsets[j]], []
        for level in range(1, max(LEVELS) + 1):
            symbols, off = _level(symbols, off) if len(symbols) else (symbols.astype(U64), off)
            if level in LEVELS:
                kept.append((symbols + U64(level), off))
        for k in range(j - i):
            names = np.sort(np.concatenate([s[o[k] : o[k + 1]] for s, o in kept]))
            new = np.ones(len(names), bool)
            new[1:] = names[1:] != names[:-1]
            which = np.arange(len(names)) - np.flatnonzero(new)[np.cumsum(new) - 1]  # number of the name's earlier occurrences
            out.append(np.unique((mix(names + which.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(32)).astype(np.uint32))[:SKETCH])
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bottom-k estimate of the share of common phrases."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = np.intersect1d(a, b, assume_unique=True)
    union = np.union1d(a, b)
    if len(a) >= SKETCH or len(b) >= SKETCH:
        union = union[:SKETCH]
    return float(np.isin(union, common, assume_unique=True).mean())


def _hex(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _of(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size < 4 * CHUNK):
            size += len(texts[j])
            j += 1
        out += sketches(*as_bytes(pa.array(texts[i:j], pa.large_string())))
        i = j
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every row's text: id column, fingerprint (hex). One pass, no shuffle."""

    def run(batches):
        for batch in slices(batches, 1):
            found = sketches(*as_bytes(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_hex(x) for x in found], pa.string())], [id_col, "fingerprint"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (range, place, id, text): each range holds consecutive ids in order and, last, a copy of the row that follows.

    Range boundaries are approximate quantiles of the ids (at most MAX_RANGES, a bounded array on the driver); the texts
    are shuffled once, by range. No window spans the table. The rows of an id that is a boundary are dealt among the ranges
    that it bounds by their text's hash, so an id with very many rows takes several ranges.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    n = rows.count()
    ranges = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    cuts = []
    if ranges > 1:
        marks = [k / ranges for k in range(1, ranges)]
        cuts = sorted(rows.agg(F.percentile_approx("id", marks, max(10_000, 4 * ranges)).alias("q")).first().q or [])
    spark = docs.sparkSession
    edges = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    def place(batches):
        for batch in batches:
            ids = batch.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(edges.value, ids, side="left"), np.searchsorted(edges.value, ids, side="right")
            share = batch.column(1).to_numpy() / 2.0**64 + 0.5
            at = np.minimum(low + (share * (high - low + 1)).astype(np.int64), high)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *batch.columns], ["range", *batch.schema.names])

    kinds = "range bigint, id bigint, h bigint"
    found = rows.select("id", "h").mapInArrow(place, kinds)
    firsts = {r.range: (r.id, r.h) for r in found.groupBy("range").agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id", "h")).alias("m")).select("range", "m.id", "m.h").collect()}
    order = sorted(firsts)
    # The first row of each range also goes, as a copy, to the range before; that of the first range to the last one.
    back = spark.sparkContext.broadcast({(at, *firsts[at]): order[k - 1] for k, at in enumerate(order)})

    def copy(batches):
        for batch in place(slices(batches, 2)):
            names = ["range", "place", "id", "h", "text"]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.zeros(batch.num_rows, np.int32)), *batch.columns[1:]], names)
            keys = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            hits = [k for k, key in enumerate(keys) if key in back.value]
            if hits:
                to = pa.array([back.value[keys[k]] for k in hits], pa.int64())
                yield pa.RecordBatch.from_arrays([to, pa.array([1] * len(hits), pa.int32()), *(batch.column(k).take(pa.array(hits)) for k in (1, 2, 3))], names)

    dealt = rows.mapInArrow(copy, "range bigint, place int, id bigint, h bigint, text string")
    return dealt.repartition("range").sortWithinPartitions("range", "place", F.col("id").asc_nulls_first(), "h", "text").drop("h")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; the edit takes from the document that follows.

    The edited text's last quarter (rounded down, in code points) is replaced by as many first code points of the next
    document in ascending id (all, if it has fewer); after the last document comes the first.
    """

    def finish(rows):
        texts, following = [r[1] for r in rows], [r[2] for r in rows]
        edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following)]
        m = len(rows)
        found = _of(texts + following[-1:])
        own, after = found[:m], found[1:]
        # within a range the next document is the next row
        changed = _of(edited)
        cols = [
            pa.array([r[0] for r in rows], pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8")).hexdigest() for e in edited], pa.string()),
            pa.array([_hex(x) for x in own], pa.string()),
            pa.array([_hex(x) for x in changed], pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, changed)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    def run(batches):
        pending, rows, size = None, [], 0  # pending: (range, place, id, text) of the row before
        for batch in slices(batches, 3):
            for at, place, key, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if pending and pending[1] == 0 and pending[0] == at:
                    rows.append((pending[2], pending[3], text))
                    size += len(pending[3])
                pending = (at, place, key, text)
                if rows and (place == 1 or size > 2 * CHUNK):
                    yield finish(rows)
                    rows, size = [], 0
        if rows:
            yield finish(rows)

    schema = f"`{id_col}` bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = with_next(docs, id_col, text_col).mapInArrow(run, schema)
    return out.withColumn(id_col, F.col(id_col).cast(dict(docs.dtypes)[id_col]))
