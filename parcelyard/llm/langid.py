"""Language identification by multilingual mixture inference.

Each learned language has byte-trigram likelihoods (hashed, smoothed). A document is a mixture: expectation-maximisation
estimates the language proportions that make its trigrams likeliest. Languages leave the set one by one while that
lowers the penalised likelihood (a fixed share of log n for each language kept); the largest proportion is the prediction.

Defined results: null texts and texts without a letter (Unicode category L) are ``und``; very long texts count whole;
repeated rows are learned from once and judged alike; of equal proportions the alphabetically first language is predicted;
other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelyard.llm.text import U64, slices

BUCKETS = 1 << 15
#: Documents of each language that the likelihoods are learned from, at most.
SAMPLE_PER_LANGUAGE = 400
#: Languages that are learned at most: those of most documents.
LANGUAGES = 100
#: How many times as many rows as wanted the choice of the sample is dealt.
MARGIN = 2
ITERATIONS = 12
#: Penalty of each language in the set, times log of the number of trigrams.
PENALTY = 1.5
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_GAP, _ASCII_GAP = regex.compile(r"\P{L}+"), re.compile("[^a-z]+")


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte trigrams of the lower-cased letters (other characters count as one space), and their counts."""
    text = text.lower()
    data = np.frombuffer(f" {(_ASCII_GAP if text.isascii() else _GAP).sub(' ', text).strip()} ".encode(), np.uint8).astype(U64)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0)
    key = (data[:-2] << U64(16)) | (data[1:-1] << U64(8)) | data[2:]
    bucket = ((key * U64(0x9E3779B97F4A7C15)) >> U64(49)).astype(np.int64)
    counts = np.bincount(bucket, minlength=BUCKETS)
    at = np.flatnonzero(counts)
    return at, counts[at].astype(np.float64)


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, languages: int = LANGUAGES) -> tuple[list[str], np.ndarray]:
    """Languages and their trigram likelihoods [BUCKETS, languages] from a bounded, hash-ordered sample of labelled rows.

    Languages are counted first (combined before the shuffle), so that only rows whose hash is low enough to be among the
    first ``per_language`` are dealt by language, however many a language has; rows that repeat count as one. At most
    ``languages`` languages are learned. Trigrams are counted on the executors and summed before they reach the driver: at
    most BUCKETS numbers for each language.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    sizes = {r.lang: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    # The lowest hashes of a language: the share of the range that holds MARGIN times as many rows as are wanted.
    ceilings = {k: min(2**63 - 1, int(-(2**63) + 2**64 * MARGIN * per_language / n)) for k, n in sizes.items()}
    ceiling = F.create_map(*(x for k, top in ceilings.items() for x in (F.lit(k), F.lit(top).cast("bigint"))))[F.col("lang")] if ceilings else F.lit(None).cast("bigint")
    low = known.select("lang", "h").where(F.col("h") <= ceiling).distinct()
    chosen = low.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= per_language).select("lang", "h")
    # At most languages * per_language hashes, so they can be broadcast.
    sample = known.join(F.broadcast(chosen), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at, n = trigrams(text)
                if lang not in sums:
                    sums[lang] = np.zeros(BUCKETS)
                # square roots, so that one long or repetitive document does not outweigh the others
                sums[lang][at] += np.sqrt(n)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], ["lang", "bucket", "n"])

    summed = sample.mapInArrow(count, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(summed["lang"].unique())
    table = np.zeros((BUCKETS, max(1, len(langs))))
    for k, lang in enumerate(langs):
        rows = summed[summed["lang"] == lang]
        table[rows["bucket"].to_numpy(), k] = np.round(rows["n"].to_numpy(), 6)
    table = table / np.maximum(table.sum(0), 1) * 0.98 + 0.02 / BUCKETS
    return langs, table


def mixture(likelihoods: np.ndarray, counts: np.ndarray, iterations: int = ITERATIONS) -> tuple[np.ndarray, float]:
    """Proportions of the languages by expectation-maximisation, and the log likelihood."""
    share = np.full(likelihoods.shape[1], 1 / likelihoods.shape[1])
    total = counts.sum()
    for _ in range(iterations):
        weighted = likelihoods @ share
        share = share * (likelihoods.T @ (counts / weighted)) / total
    return share, float(counts @ np.log(likelihoods @ share))


def infer(likelihoods: np.ndarray, counts: np.ndarray, penalty: float = PENALTY) -> tuple[list[int], np.ndarray]:
    """The chosen language set (places) and its proportions."""
    chosen = list(range(likelihoods.shape[1]))
    price = penalty * np.log(counts.sum() + 1)
    share, best = mixture(likelihoods, counts)
    while len(chosen) > 1:
        k = int(np.argmin(share))
        rest = chosen[:k] + chosen[k + 1 :]
        if len(rest) == 1:
            fewer, value = np.ones(1), float(counts @ np.log(likelihoods[:, rest[0]]))
        else:
            fewer, value = mixture(likelihoods[:, rest], counts)
        if value + price < best:
            break
        chosen, share, best = rest, fewer, value
    return chosen, share


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every text: id column, lang_pred, score (its proportion), languages (the chosen set, by proportion).

    Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned.
    """
    langs, table = model
    sent = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        likelihood = sent.value
        for batch in slices(batches, 1):
            names, scores, sets = [], [], []
            for text in batch.column(1).to_pylist():
                if not langs or not text or not _LETTER.search(text):
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    sets.append([])
                    continue
                at, counts = trigrams(text)
                chosen, share = infer(likelihood[at], counts)
                order = np.argsort(-share, kind="stable")
                names.append(langs[chosen[order[0]]])
                scores.append(float(min(1.0, max(0.0, share[order[0]]))))
                sets.append([langs[chosen[k]] for k in order])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, pa.list_(pa.string()))], [id_col, "lang_pred", "score", "languages"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, lang_pred string, score double, languages array<string>")
