"""A training-corpus pipeline of the operators in parcelyard.llm: each stage reads what the one before it kept.

Toxic documents go; of each group of near copies the document of least id stays; documents contaminated by the benchmark
go; secrets are replaced in the text; the last stage encodes the texts and proves that decoding gives them back.
All stages but the last return the columns of documents, extra ones included, whatever they are called.

Defined results: null and empty texts pass every stage; rows of null doc_id can't be compared and stay in the second; rows of
one id with different word sets all stay there, of those with equal sets the one of least text hash; rows that repeat whole
count as one in the second stage; ties of ids don't arise elsewhere, as the other stages judge rows one by one. Very long
texts are handled whole. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parcelyard.llm import bpe, decontam, jaccard, secrets, toxicity
from parcelyard.llm.queries import TOXIC_FROM, table, toxicity_machine, vocabulary_path
from parcelyard.llm.shared import Scratch, small


def spare(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have."""
    while name in docs.columns:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine scores below TOXIC_FROM; empty and null texts stay."""
    machine = toxicity_machine(docs, table(spark, sf_dir, "labels"))
    score = spare(docs, "toxicity")
    return toxicity.score(docs, machine, keep=True, score_col=score).where(F.col(score) < TOXIC_FROM).drop(score)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of the Jaccard join (word 5-grams, 0.8) the document of least id.

    Such an id keeps one row for each word set that it has, so texts that differ aren't lost. Most texts are the only row
    of theirs and are let through by a semi-join; only the others are sorted.
    """
    found = jaccard.classes(docs).where(F.col("doc_id") == F.col("component_id"))
    rows = found.groupBy("doc_id", "first", "sig").agg(F.count("*").alias("m"))
    chosen = rows.groupBy("doc_id", "first").agg(F.min(F.struct("sig", "m")).alias("s")).select(F.col("doc_id").alias("_id"), F.col("s.sig").alias("_sig"), F.col("s.m").alias("_m"))
    same = lambda d, c: (d["doc_id"] == c["_id"]) & (F.xxhash64(d["text"]) == c["_sig"])
    alone, several = chosen.where("_m = 1"), chosen.where("_m > 1")
    single = docs.join(alone, same(docs, alone), "left_semi")
    repeated = docs.join(small(several), same(docs, several), "left_semi")
    place = spare(docs, "place")
    order = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.xxhash64(*docs.columns))
    one = repeated.withColumn(place, F.row_number().over(order)).where(F.col(place) == 1).drop(place)
    return single.unionByName(one).unionByName(docs.where(F.col("doc_id").isNull()))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages in a twentieth of their words or more."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("sig").alias("_sig")).distinct()
    found = small(found)
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.xxhash64(docs["text"]) == found["_sig"])
    return docs.join(found, same, "left_anti")


def replace_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, each found secret replaced by a mark; n_chars counts the new text."""
    found = spare(docs, "found")
    clean = secrets.scan(docs, keep_text=True, found_col=found)
    return clean.withColumn("n_chars", F.when(F.size(found) > 0, F.length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the decoded text."""
    return bpe.encode(docs, vocabulary_path(), keep=("lang", "source"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", replace_secrets),
    ("encoding", encode),
]

#: Trained models and the vocabulary's merges can't be written in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's result is written as Parquet in the shared folder and read again.

    What a stage has read is deleted when its own result is stored; the last stage's input stays for the lazy result.
    """
    docs, read = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            kept = Scratch(spark)
            docs = kept.store(docs)
            if read:
                read.clear()
            read = kept
    return docs
