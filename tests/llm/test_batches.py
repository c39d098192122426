"""What Spark sends a Python worker at once: batches bounded by bytes, so that an executor doesn't hold tens of megabytes for each task."""

import numpy as np
import pytest

from parcelyard.llm import bpe, jaccard, queries, secrets, toxicity

BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def operators(docs):
    nothing = np.empty(0, np.int64)
    return {
        toxicity: lambda: toxicity.score(docs, toxicity.Machine(nothing, 0.0, np.empty(0), np.empty((0, 2))), keep=True),
        jaccard: lambda: jaccard.classes(docs),
        secrets: lambda: secrets.scan(docs, keep_text=True),
        bpe: lambda: bpe.encode(docs, queries.vocabulary_path()),
    }


@pytest.mark.parametrize("module", [toxicity, jaccard, secrets, bpe])
def test_batches_are_bounded_by_bytes(spark, monkeypatch, module):
    docs = spark.range(0, 1000, 1, 1).selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 2500) AS text")

    def first(batches, *_):
        for batch in batches:
            assert batch.nbytes < 8 << 20, f"a batch of {batch.nbytes} bytes"
            yield batch.slice(0, 1)

    monkeypatch.setattr(module, "slices", first)
    spark.conf.unset(BATCH)
    assert operators(docs)[module]().count() > 0


def test_a_bound_of_the_session_stands(spark):
    spark.conf.set(BATCH, "1m")
    try:
        secrets.scan(spark.range(1).selectExpr("id AS doc_id", "'x' AS text"))
        assert spark.conf.get(BATCH) == "1m"
    finally:
        spark.conf.unset(BATCH)
