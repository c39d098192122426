"""Large groups of near copies of which few pairs link: what the search tells grows with the sets, not with their pairs."""

import random

import pytest
from test_llm import brute_components

from parcelyard.llm import jaccard


@pytest.mark.parametrize("tile", [16, 512])
def test_jaccard_tells_no_more_rows_than_a_dense_group_has_sets(spark, monkeypatch, tile):
    rng = random.Random(11)
    base, rows = [f"w{k}" for k in range(150)], []
    for k in range(160):
        words = list(base)
        for at in rng.sample(range(150), rng.choice([1, 3, 4, 5])):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    told = []
    search = jaccard._block_pairs
    monkeypatch.setattr(jaccard, "_block_pairs", lambda m, p: told.append(found := search(m, p).localCheckpoint()) or found)
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "DENSE", 4, raising=False)
    monkeypatch.setattr(jaccard, "STARS", 1)
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {tuple(r) for r in jaccard.join(df).collect()} == brute_components(rows)
    assert told[0].count() <= 4 * len(rows)
