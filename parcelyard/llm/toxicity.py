"""Toxicity by a factorisation machine over hashed terms.

score = sigmoid(w0 + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed words of a text. The factors let two terms
that are harmless alone count together. Terms that say little about the label in the training sample, alone or in a pair,
are screened out, so that long texts do not add up noise. Training is plain Adam in numpy on a bounded sample of labelled
rows.

Defined results: null, empty and wordless texts have the score of the bias; very long texts are whole sets of terms; equal
texts have equal scores; of an id that repeats among the labels the largest label counts, of one that repeats among the
documents the text of least hash is learned from; other columns are not read; without labelled rows every score is low.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.shared import Scratch, bounded_batches
from parcelyard.llm.text import U64, as_bytes, chunks, lower_ascii, mix, slices, span_hashes, word_table, words

#: Base buckets; TIMES: a term stands for "at least so often in the text", so a bucket is a base and a place in TIMES.
BASE_BITS = 19
BASES = 1 << BASE_BITS
TIMES = (1, 2, 4)
BUCKETS = BASES * len(TIMES)
#: Besides whole words, their first so many bytes are terms, which catches inflected and compound forms.
BEGINNINGS = (4, 5, 6, 7)
#: Labelled documents that the machine is fitted on, at most.
TRAIN_ROWS = 20_000
#: Terms kept after screening, at most, and the least number of training documents a kept term is in.
TERMS, LEAST_DOCUMENTS = 4096, 4
#: Most frequent terms whose pairs are tried, the largest share of documents that such a term is in, the least number of
#: documents of a case that counts, and by how much the statistic of a pair's four cases must exceed those of its terms.
PAIRED, PAIRED_SHARE, LEAST_CASES, PAIR_GAIN = 1024, 0.7, 16, 40
FACTORS, EPOCHS, BATCH, RATE, L2 = 8, 30, 256, 0.03, 2e-4
#: Words: everything but ASCII characters that are neither digits nor letters.
_WORDS = word_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])


@dataclass
class Machine:
    terms: np.ndarray  # sorted buckets
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def wanted(self) -> np.ndarray:
        """Which base buckets the machine's terms are made of."""
        out = np.zeros(BASES, bool)
        out[self.terms // len(TIMES)] = True
        return out

    def scores(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        """Probability for each of n rows, given distinct (row, bucket) pairs."""
        if not len(self.terms):
            return np.full(n, _sigmoid(np.array(self.bias)))
        place = np.minimum(np.searchsorted(self.terms, buckets), len(self.terms) - 1)
        known = self.terms[place] == buckets
        return _sigmoid(self.logits(rows[known], place[known], n))

    def logits(self, rows: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
        z = self.bias + np.bincount(rows, self.weights[place], n)
        for f in range(self.factors.shape[1]):
            v = self.factors[place, f]
            z += 0.5 * (np.bincount(rows, v, n) ** 2 - np.bincount(rows, v * v, n))
        return z


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def hashed_terms(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, bucket) pairs of a batch: every word and its beginnings, hashed, for each of TIMES it occurs as often.

    Words are lower-cased in ASCII. With ``wanted``, base buckets outside of it are left out.
    """
    data, offsets = as_bytes(column)
    data = lower_ascii(data)
    out_rows, out = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, row = words(part, off, _WORDS)
        if not len(starts):
            continue
        size, found = ends - starts, []
        for length in (0, *BEGINNINGS):
            at = slice(None) if not length else size > length
            names = span_hashes(part, starts[at], ends[at] if not length else starts[at] + length)
            base = (mix(names + U64(length)) >> U64(64 - BASE_BITS)).astype(np.int64)
            keys = (row[at] + i) * np.int64(BASES) + base
            found.append(keys if wanted is None else keys[wanted[base]])
        keys, counts = np.unique(np.concatenate(found), return_counts=True)
        rows, base = np.divmod(keys, BASES)
        for level, least in enumerate(TIMES):
            enough = counts >= least
            out_rows.append(rows[enough])
            out.append(base[enough] * len(TIMES) + level)
    return np.concatenate(out_rows), np.concatenate(out)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = TRAIN_ROWS) -> Machine:
    """Fit on at most ``most`` labelled documents, chosen by the hash of their ids.

    The chosen ids (bounded by ``most``) are broadcast and one text of each is stored. Document counts of the terms and of
    their pairs are summed on the executors for screening; only the screened terms of the chosen texts come to the driver.
    """
    bounded_batches(docs.sparkSession)
    truth = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    chosen = truth.orderBy(F.xxhash64("id"), "id").limit(most)
    with Scratch(docs.sparkSession) as scratch:
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(scratch.store(chosen)), "id")
        first = texts.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
        sample = scratch.store(first.select("label", "t.text"))

        def tally(batches):
            for batch in slices(batches, 1):
                rows, buckets = hashed_terms(batch.column(1))
                label = batch.column(0).to_numpy(zero_copy_only=False)
                all_docs, toxic = np.bincount(buckets, minlength=BUCKETS), np.bincount(buckets, label[rows], BUCKETS)
                at = np.flatnonzero(all_docs)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(all_docs[at], pa.int64()), pa.array(toxic[at].astype(np.int64))], ["bucket", "n", "toxic"])

        sums = sample.mapInArrow(tally, "bucket int, n bigint, toxic bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= LEAST_DOCUMENTS)
        size = sample.agg(F.count("*").alias("n"), F.sum("label").alias("toxic")).first()
        stats = sums.toPandas().sort_values("bucket")
        buckets, with_term = stats["bucket"].to_numpy(np.int64), stats["n"].to_numpy(float)
        alone = screen(buckets, with_term, stats["toxic"].to_numpy(float), size.n, float(size.toxic or 0))
        tried = frequent(buckets, with_term, size.n)
        # Terms that tell nothing alone stay only if a pair of theirs does.
        terms = np.union1d(alone, tried[telling(*pair_counts(sample, tried), size.n, float(size.toxic or 0))])
        wanted = Machine(terms, 0.0, terms, terms).wanted()

        def run(batches):
            for batch in slices(batches, 1):
                rows, place = _placed(batch.column(1), terms, wanted)
                cuts = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts), pa.array(place.astype(np.int32)))], ["label", "terms"])

        table = sample.mapInArrow(run, "label int, terms array<int>").toArrow()
    y, lists = table.column("label").to_numpy().astype(float), table.column("terms").combine_chunks()
    rows = np.repeat(np.arange(len(y), dtype=np.int32), lists.value_lengths().to_numpy(zero_copy_only=False))
    return fit(y, rows, lists.flatten().to_numpy(), terms)


def _placed(column: pa.Array, terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, place in terms) pairs of a batch's terms, by row."""
    rows, buckets = hashed_terms(column, wanted)
    place = np.minimum(np.searchsorted(terms, buckets), max(0, len(terms) - 1))
    known = terms[place] == buckets if len(terms) else np.zeros(len(buckets), bool)
    rows, place = rows[known], place[known]
    by = np.lexsort((place, rows))
    return rows[by], place[by]


def pair_counts(sample: DataFrame, tried: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tables [tried, tried]: documents of the sample (label, text) that have both terms, and how many of them are labelled.

    Counted in tasks and summed row by row of the table, whose size is fixed.
    """
    m = len(tried)
    wanted = Machine(tried, 0.0, tried, tried).wanted()

    def run(batches):
        both, toxic = np.zeros((m, m), np.int32), np.zeros((m, m), np.int32)
        for batch in slices(batches, 1):
            rows, place = _placed(batch.column(1), tried, wanted)
            x = np.zeros((batch.num_rows, m), np.float32)
            x[rows, place] = 1
            y = batch.column(0).to_numpy(zero_copy_only=False).astype(np.float32)
            both += (x.T @ x).astype(np.int32)
            toxic += (x.T @ (x * y[:, None])).astype(np.int32)
        packed = [pa.array([zlib.compress(r.tobytes(), 1) for r in t], pa.binary()) for t in (both, toxic)]
        yield pa.RecordBatch.from_arrays([pa.array(range(m), pa.int32()), *packed], ["term", "pairs", "toxic"])

    def add(part: pa.Table) -> pa.Table:
        sums = [pa.array([zlib.compress(sum(np.frombuffer(zlib.decompress(x.as_py()), np.int32) for x in part.column(c)).tobytes(), 1)], pa.binary()) for c in ("pairs", "toxic")]
        return pa.table([part.column("term").slice(0, 1), *sums], ["term", "pairs", "toxic"])

    both, toxic = np.zeros((m, m), np.int32), np.zeros((m, m), np.int32)
    if m:
        kind = "term int, pairs binary, toxic binary"
        for r in sample.mapInArrow(run, kind).groupBy("term").applyInArrow(add, kind).collect():
            both[r.term], toxic[r.term] = (np.frombuffer(zlib.decompress(x), np.int32) for x in (r.pairs, r.toxic))
    return both, toxic


def frequent(buckets: np.ndarray, with_term: np.ndarray, n: int) -> np.ndarray:
    """The PAIRED most frequent terms (of at most PAIRED_SHARE of the n documents) whose pairs are tried: bounded, so all pairs can be."""
    usual = (with_term <= PAIRED_SHARE * n) & (buckets % len(TIMES) == 0)
    best = np.lexsort((buckets[usual], -with_term[usual]))[:PAIRED]
    return np.sort(buckets[usual][best])


def telling(both: np.ndarray, both_toxic: np.ndarray, n: int, positive: float) -> np.ndarray:
    """Which terms are in a pair whose joint presence says more about the label than both terms alone, by pair_counts.

    The chi-squared statistic of the four cases (both, one, the other, none) against the label, less those of the two terms.
    """
    out = np.zeros(len(both), bool)
    if not positive or positive >= n:
        return out
    share, alone, alone_toxic = positive / n, np.diag(both), np.diag(both_toxic)

    def gain(count, toxic):
        return np.where(count < LEAST_CASES, 0, (toxic - count * share) ** 2 / np.maximum(count * share * (1 - share), 1e-9))

    single = gain(alone, alone_toxic) + gain(n - alone, positive - alone_toxic)
    for k in range(len(both)):  # one term against all
        b, bt = both[k], both_toxic[k]
        one, one_toxic, other, other_toxic = alone[k] - b, alone_toxic[k] - bt, alone - b, alone_toxic - bt
        joint = gain(b, bt) + gain(one, one_toxic) + gain(other, other_toxic) + gain(n - b - one - other, positive - bt - one_toxic - other_toxic) - single - single[k]
        joint[k] = 0
        out[k] = (joint > PAIR_GAIN).any()
    return out


def screen(buckets: np.ndarray, with_term: np.ndarray, toxic_with: np.ndarray, n: int, positive: float) -> np.ndarray:
    """The TERMS buckets (sorted) that say most about the label, by the chi-squared statistic of term and label."""
    if not positive or positive >= n:
        return np.empty(0, np.int64)
    expected = with_term * positive / n
    spread = np.maximum(expected * (1 - positive / n) * (1 - with_term / n), 1e-9)
    gain = (toxic_with - expected) ** 2 / spread
    best = np.lexsort((buckets, -gain))[:TERMS]
    return np.sort(buckets[best[gain[best] > 8]])


def fit(y: np.ndarray, rows: np.ndarray, cols: np.ndarray, terms: np.ndarray) -> Machine:
    """Fit the machine to (row, term place) pairs; rows are put in a fixed order, so equal samples give equal machines."""
    n, positive, cols = len(y), float(y.sum()), cols.astype(np.int64)
    if not len(terms):
        bias = np.log((positive + 0.5) / (n - positive + 0.5)) if n else -6.0
        return Machine(np.empty(0, np.int64), float(bias), np.empty(0), np.empty((0, FACTORS)))
    # A canonical order of rows (by label and content), then a seeded shuffle.
    digest = np.bincount(rows, (cols * 2654435761 % 1000003).astype(float), n) + y * 1e9
    order = np.argsort(digest, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.random.default_rng(7).permutation(n)
    y_new = np.empty(n)
    y_new[rank] = y
    rows = rank[rows]
    by = np.lexsort((cols, rows))
    rows, cols, y = rows[by], cols[by], y_new
    cuts = np.searchsorted(rows, np.arange(0, n + BATCH, BATCH))
    rng = np.random.default_rng(11)
    m, k = len(terms), FACTORS
    theta = np.concatenate([[np.log(positive / (n - positive))], np.zeros(m), rng.normal(0, 0.02, m * k)])
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(EPOCHS):
        for b in rng.permutation(len(cuts) - 1):
            r, c = rows[cuts[b] : cuts[b + 1]] - b * BATCH, cols[cuts[b] : cuts[b + 1]]
            target = y[b * BATCH : (b + 1) * BATCH]
            size = len(target)
            if not size:
                continue
            v = theta[1 + m :].reshape(m, k)[c]
            sums = np.stack([np.bincount(r, v[:, f], size) for f in range(k)], 1)
            squares = np.bincount(r, (v * v).sum(1), size)
            z = theta[0] + np.bincount(r, theta[1 + c], size) + 0.5 * ((sums**2).sum(1) - squares)
            error = (_sigmoid(z) - target) / size
            grad = np.empty_like(theta)
            grad[0] = error.sum()
            grad[1 : 1 + m] = np.bincount(c, error[r], m)
            inner = error[r][:, None] * (sums[r] - v)
            grad[1 + m :] = np.stack([np.bincount(c, inner[:, f], m) for f in range(k)], 1).ravel()
            grad[1:] += L2 * theta[1:]
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            theta = theta - RATE * (1 - 0.9 * epoch / EPOCHS) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Machine(terms, float(theta[0]), theta[1 : 1 + m].copy(), theta[1 + m :].reshape(m, k).copy())


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, score_col: str = "score") -> DataFrame:
    """Score every text: id column and score; with ``keep`` all columns of docs and the score. One pass, no shuffle.

    Null and empty texts have the score of the bias. A column of docs named like ``score_col`` is left out.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(machine)
    wanted = docs.sparkSession.sparkContext.broadcast(machine.wanted())
    rows = docs.drop(score_col) if keep else docs.select(id_col, text_col)
    at = rows.columns.index(text_col)

    def run(batches):
        for batch in slices(batches, at):
            pairs = hashed_terms(batch.column(at), wanted.value)
            found = pa.array(sent.value.scores(*pairs, batch.num_rows))
            if keep:
                yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, score_col])
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), found], [id_col, score_col])

    kept = rows.dtypes if keep else [(id_col, dict(rows.dtypes)[id_col])]
    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in kept) + f", `{score_col}` double")
