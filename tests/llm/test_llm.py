"""Each operator against a brute-force version, a public library or held-out labels, and on awkward tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelyard.llm import bpe, chat, components, decontam, jaccard, langid, lcp, queries, secrets, shared, text, toxicity, urls

SF = "/root/testdata/sf0.001"
AWKWARD = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one two three four five six"), (6, "one two three four five six"), (6, "one two three four five six"),
    (7, "A b C d E f G h " * 400), (8, "x" * 5000), (9, "é ß 日本 <|endoftext|> token = \"abcdef123\" AKIA" + "A1" * 10 + " " + "0a" * 20), (10, "tie tie"), (11, "tie tie"),
    (12, "² ½ ① Ⅷ 123 _"), (None, "one two three four five six"), (None, None),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string, score string, component_id string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(i, t, None, "s", None, "f", "s", "c") for i, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_is_the_library(spark, docs, awkward):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.vocabulary_path())
    both = docs.select("doc_id", "text").unionByName(awkward.select((F.col("doc_id") + 10000).alias("doc_id"), "text"))
    both = both.where("doc_id is not null")
    texts = {(r.doc_id, r.text or "") for r in both.collect()}
    want = {}
    for i, t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode(both, queries.vocabulary_path()).collect()}
    assert got == want
    counts = bpe.count_tokens(both, queries.vocabulary_path()).collect()
    assert {r.doc_id: r.n_tokens for r in counts} == {i: w[0] for i, w in want.items()}
    assert all(r.over_limit == (r.n_tokens > 512) for r in counts) and {r.doc_id: r.n_bytes for r in counts} == {i: len(t.encode()) for i, t in texts}
    assert bpe.encode(empty(spark), queries.vocabulary_path()).count() == bpe.count_tokens(empty(spark), queries.vocabulary_path()).count() == 0


@pytest.mark.parametrize("memo", [1, 3])
def test_bpe_memo_turns_over(monkeypatch, memo):
    """Results don't depend on what the memo has forgotten; long repetitive pre-tokens are merged like short ones."""
    vocabulary = bpe.Vocabulary(queries.vocabulary_path())
    texts = ["the theme of the then", "aaaaaaaaaaaaaaaaaaaaaaaab", "the theme", "x", "", "1 22 333 4444", "the " * 9 + "ab" * 200]
    plain = [(bpe.SegmentTreeEncoder(vocabulary).encode(t), bpe.HeapCounter(vocabulary).tokens(t)) for t in texts]
    assert all(len(ids) == n for ids, n in plain)
    monkeypatch.setattr(bpe, "MEMO", memo)
    encoder, counter = bpe.SegmentTreeEncoder(vocabulary), bpe.HeapCounter(vocabulary)
    assert [(encoder.encode(t), counter.tokens(t)) for t in texts * 2] == plain * 2
    assert [encoder.decode(encoder.encode(t)) for t in texts] == texts


def test_bpe_merges_new_pre_tokens_together(monkeypatch):
    """Each new pre-token took a tree and a walk of its own; only the rare lengths still do. The ids are the library's."""
    from tokenizers import Tokenizer

    rng = random.Random(31)
    parts = ["th", "e", "tion", "ß", "é", "中", "मा", "\0", "\x7f", "x", "aaaa", "ing", "Q", "!!", "12", "\U0001f600"]
    words = ["".join(rng.choices(parts, k=rng.choice([1, 2, 3, 5, 8, 13, 40]))) for _ in range(3000)]
    words += [c * n for c in ("a", "é", "!", "7", "\0") for n in (7, 8, 9, 15, 16, 17, 63, 64, 65, 127, 128, 129, 255, 256, 257, 600)]
    rng.shuffle(words)
    texts = ["", *(" ".join(words[k : k + 40]) for k in range(0, len(words), 40)), "<|endoftext|>the theme<|endoftext|>"]
    vocabulary = bpe.Vocabulary(queries.vocabulary_path())
    alone = []
    merge = bpe.SegmentTreeEncoder.merge
    monkeypatch.setattr(bpe.SegmentTreeEncoder, "merge", lambda self, ids: alone.append(0) or merge(self, ids))
    encoder = bpe.SegmentTreeEncoder(vocabulary)
    got = encoder.encode_all(texts)
    assert len(alone) < 0.05 * len({p for t in texts for p in bpe.pre_tokens(t)})
    library = Tokenizer.from_file(queries.vocabulary_path())
    assert got == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert all(len(p) <= bpe.MEMO_BYTES for p in encoder.memo)
    pieces = {p for t in texts for p in bpe.pre_tokens(t)}
    encoder.memo.clear()
    encoder.learn(pieces)
    assert encoder.memo == {p: merge(encoder, [vocabulary.first[b] for b in p.encode()]) for p in pieces}


def test_bpe_pair_ranks_by_array():
    """Pairs that share a place are told apart; ids of -1, unknown pairs and an empty table have no rank."""
    rng = random.Random(5)
    for n in (0, 1, 3000):
        rank = {rng.randrange(90) << 32 | rng.randrange(90): k for k in range(n)}
        table = bpe.PairRanks(rank)
        left, right = np.repeat(np.arange(-1, 90, dtype=np.int32), 91), np.tile(np.arange(-1, 90, dtype=np.int32), 91)
        assert table.find(left, right).tolist() == [rank.get(a << 32 | b, -1) if min(a, b) >= 0 else -1 for a, b in zip(left.tolist(), right.tolist())]


def test_bpe_keeps_columns(spark, awkward):
    rows = awkward.withColumn("n_tokens", F.lit("mine"))
    got = bpe.encode(rows, queries.vocabulary_path(), keep=("source", "n_tokens", "found"))
    assert got.columns == ["doc_id", "source", "found", "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "round_trip"]
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in got.collect())


def test_slices_and_shared_folder(spark):
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 50, "", "c"] * 3)], ["t"])
    for rows, size in ((2, 100), (100, 12), (1, 1), (100, 10**6)):
        parts = list(text.slices([batch], 0, rows, size))
        assert sum((p.column(0).to_pylist() for p in parts), []) == batch.column(0).to_pylist()
        assert all(p.num_rows <= rows and (p.num_rows == 1 or sum(len(t or "") for t in p.column(0).to_pylist()) <= size) for p in parts)

    class Far:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            getCheckpointDir, master = staticmethod(lambda: None), "spark://far:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_folder(Far)
    import glob

    with shared.Scratch(spark) as scratch:
        kept, used = scratch.store(spark.range(3), keep=True), scratch.store(spark.range(4))
        assert (kept.count(), used.count()) == (3, 4)
    assert kept.count() == 3 and [p.rsplit("/", 1)[1] for p in glob.glob(f"{scratch.folder}/*")] == ["kept"]


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = [x.translate({k: k + 32 for k in range(65, 91)}) for x in re.findall("[^\x20\x09-\x0d]+", t or "")]
        sets.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    every = [(i, s) for i, v in sets.items() for s in v if s and i is not None]
    for k, (i, s) in enumerate(every):
        for j, t in every[:k]:
            common = len(s & t)
            if common and 100 * common >= 80 * (len(s) + len(t) - common):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {(i, len(s), root(i)) for i, v in sets.items() for s in v}


def near_copies(n, seed):
    """Groups of copies with some words changed, around the threshold."""
    rng = random.Random(seed)
    out = []
    for g in range(n):
        base = [f"w{rng.randrange(300)}" for _ in range(rng.choice([4, 12, 60, 200]))]
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(0, 6)):
                words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
            out.append((len(out), " ".join(words)))
    return out


def test_jaccard_is_brute_force(spark, docs, awkward):
    rows = near_copies(40, 3)
    frames = [docs.select("doc_id", "text"), awkward.select("doc_id", "text"), spark.createDataFrame(rows, "doc_id bigint, text string")]
    for df in frames:
        assert {tuple(r) for r in jaccard.join(df).collect()} == brute_components([tuple(r) for r in df.collect()])
    assert jaccard.join(empty(spark)).count() == 0


def test_jaccard_links_every_text_of_an_id(spark):
    """Ids with several texts: each text links, whichever digest is the least; also in chains and with repeated rows."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        texts = [" ".join(f"g{g}t{t}w{k}" for k in range(60)) for t in range(3)]
        near = lambda t: t.rsplit(" ", 3)[0] + " p q r"
        i = 100 * g
        rows += [(i + 6, t) for t in texts] + [(i + 7 + k, t) for k, t in enumerate(texts)] + [(i + 17 + k, near(t)) for k, t in enumerate(texts)]
    rows += [(3000, t) for _, t in rng.sample(rows, 4)] + rng.choices(rows, k=20) + near_copies(10, 5)
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in jaccard.join(df).collect()]
    assert set(got) == brute_components(rows) and len(got) == len(rows)


def test_jaccard_large_blocks(spark, monkeypatch):
    """Blocks cut into tiles: every token is in all orders' prefixes, so blocks of a common passage are many tiles."""
    rng = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(12))
    rows = []
    for g in range(120):
        own = [f"g{g}w{k}" for k in range(rng.choice([4, 8, 20, 45]))]
        for _ in range(rng.choice([1, 1, 3])):
            words = list(own)
            words[rng.randrange(len(words))] = f"z{rng.randrange(9)}"
            rows.append((len(rows), passage + " " + " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(jaccard, "TILE", 8)
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    monkeypatch.setattr(jaccard, "STARS", 1)
    assert {tuple(r) for r in jaccard.join(df).collect()} == brute_components(rows)


def test_jaccard_hot_passage(spark, monkeypatch):
    """One passage in very many unlike texts: the tiles' boxes keep most members from meeting."""
    words = lambda g, n: " ".join(f"g{g}w{k}" for k in range(n))
    rows = [(g, " ".join(f"p{k}" for k in range(8)) + " " + words(g, 30 + g % 400)) for g in range(4000)] + [(9000 + g, " ".join(f"p{k}" for k in range(8)) + " " + words(g, 30 + g % 400) + " end") for g in range(0, 4000, 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    monkeypatch.setattr(jaccard, "FREQUENT", 10**9)
    monkeypatch.setattr(jaccard, "TILE", 64)
    searched = []
    search = jaccard._block_pairs
    monkeypatch.setattr(jaccard, "_block_pairs", lambda m, p: searched.append(m.count()) or search(m, p))
    got = {r.doc_id: r.component_id for r in jaccard.join(df).collect()}
    assert got == {i: i for i, _ in rows} | {9000 + g: g for g in range(0, 4000, 500)}
    # Four tokens of the passage; without boxes each member would meet 4000 / 64 tiles of its blocks.
    assert searched[0] < 4 * 4000 * 4000 / 64 / 4


def test_jaccard_ids_of_any_type(spark):
    rows = [("b", "one two three four five six"), ("a", "one two three four five six"), (None, "one two three four five six"), ("c", None)]
    got = {tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("b", 2, "a"), ("a", 2, "a"), (None, 2, None), ("c", 0, "c")}


@pytest.mark.parametrize("text", ["a", "a b", "a b c", "a b c d", "a b c d e", "x" * (1 << 20) + " y"])
def test_short_texts_alone(text):
    """A chunk of fewer words than an n-gram has: a table of one row, or a long text of few words beside others."""
    sets = lambda texts: [s.tolist() for s in jaccard.shingle_sets(np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)]))]
    alone, both = sets([text]), sets(["k l m n o p", text])
    assert len(alone[0]) == 1 and both[1] == alone[0] and len(both[0]) == 2


def test_tree_pairs_are_all_pairs():
    rng = np.random.default_rng(1)
    base = [rng.integers(0, 1 << 63, 90, dtype=np.uint64) for _ in range(20)]
    sets = [np.unique(np.concatenate([b[: 90 - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for b in base for k in range(0, 30, 3)]
    points, sizes = np.stack([jaccard.point(s) for s in sets]), np.array([len(s) for s in sets])
    found = {frozenset((int(x), int(y))) for a, b in jaccard.RTree(points, sizes, np.arange(len(sets))).pairs(80) for x, y in zip(a, b)}
    for i, s in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(s, sets[j]))
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                assert frozenset((i, j)) in found


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 20), (5, 5), (None, 4)] + [(100 + k, 101 + k) for k in range(60)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20} | {100 + k: 100 for k in range(61)}


def test_decontamination_is_brute_force(spark, awkward):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([0, 3, 13, 14, 40])))) for k in range(12)] + [(99, None), (5, "One-two three")]
    rows = [(k, "! " * (k % 2) + ", ".join(sum((rng.choice([i[1].split(" ")[:20] if i[1] else [], rng.choices(words, k=6)]) for i in rng.choices(items, k=4)), [])).upper()) for k in range(60)]
    rows += [(i and i + 1000, t) for i, t in AWKWARD]
    docs, bench = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
    windows = {}
    for i, t in items:
        w = split(t)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    want = set()
    for i, t in rows:
        w, hit, met = split(t), set(), set()
        for win, names in windows.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= {*range(k, k + len(win))}
                    met |= names
        want.add((i, len(w), len(hit), ",".join(sorted(met)), bool(hit) and 20 * len(hit) >= len(w)))
    got = decontam.contamination(docs, bench).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids), r.contaminated) for r in got} == want and len(got) == len(rows)
    assert decontam.contamination(empty(spark), bench).count() == 0
    assert decontam.contamination(docs, bench.where("false")).where("n_hit > 0").count() == 0


def test_proximity(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "alpha " + "x " * 50 + "beta gamma"), (3, "gamma beta alpha")], "doc_id bigint, text string")
    items = decontam.item_words(spark.createDataFrame([(7, "alpha beta gamma")], "item_id bigint, text string"))
    wanted = decontam.rarest_terms(items, decontam.term_counts(docs, items), 3)
    assert {r.doc for r in decontam.proximity_matches(decontam.index(docs, wanted), wanted, 10).collect()} == {1, 3}
    rng = random.Random(3)
    texts = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([0, 5, 80, 300])))) for k in range(40)]
    bench = [(k, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 2, 6, 20])))) for k in range(15)]
    counts = {}
    for _, t in texts:
        for w in t.split():
            counts[w] = counts.get(w, 0) + 1
    want = {}
    for i, t in texts:
        near, w = 0, t.split()
        for _, b in bench:
            terms = sorted({x for x in b.split() if x in counts}, key=lambda x: (counts[x], x))[:3]
            near += bool(terms) and any(set(terms) <= set(w[max(0, k - 20) : k + 1]) for k in range(len(w)))
        want[i] = near
    got = decontam.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert {r.doc_id: r.n_near for r in got.collect()} == want
    # The same where nothing is within the bound for a broadcast.
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    again = decontam.contamination(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(bench, "item_id bigint, text string"))
    assert sorted(map(str, again.drop("sig").collect())) == sorted(map(str, got.drop("sig").collect()))


def scanner(t):
    """The fixed patterns' spans, found character by character."""
    out, key = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    run = lambda i, ok: next((j for j in range(i, len(t)) if t[j] not in ok), len(t))
    low = "".join(c.lower() if c < "\x80" else c for c in t)
    i = 0
    while i < len(t):
        # Alternatives in order, so that "passwd" is tried after "password".
        for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(name, i):
                j = i + len(name)
                j += t[j : j + 1] in ('"', "'") and t[j : j + 1] != ""
                j = run(j, " ")
                if t[j : j + 1] in (":", "="):
                    if j + 1 <= len(t):
                        j = run(j + 1, " ")
                        j += t[j : j + 1] in ('"', "'") and t[j : j + 1] != ""
                        end = run(j, key)
                        if end > j:
                            if end - j >= 6:
                                out.append((i, "assign", end))
                            i = end - 1
                            break
        i += 1
    for kind, start, ok, least in (("access", "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 20), ("hex", "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(t):
            if t.startswith(start, i) and (start or t[i] in ok):
                end = run(i + len(start), ok)
                if end - i >= least:
                    out.append((i, kind, end))
                i = max(end, i + 1)
            else:
                i += 1
    return sorted(out, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[1])))


def test_secrets_query_is_brute_force(spark, docs, tmp_path):
    """base_sha256, the counts and the spans of every document, against a scanner without regular expressions."""
    got = {r.doc_id: r for r in queries.op1_secrets(spark, SF).collect()}
    for r in docs.collect():
        base = scanner(r.text or "")
        line = ",".join(f"{k}:{s}:{e}" for s, k, e in base)
        q = got[r.doc_id]
        assert q.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert (q.n_assign, q.n_access, q.n_hex) == tuple(sum(k == kind for _, k, _ in base) for kind in ("assign", "access", "hex"))
        spans = [x for x in q.spans.split(",") if x]
        assert [x for x in spans if not x.startswith("cnn")] == ([*line.split(",")] if line else [])
    rng = random.Random(8)
    for _ in range(4000):
        t = "".join(rng.choice(["password", "PassWd", "secret", "token", "api_key", "apikey", "AKIA", "AKIA" + "Z9" * 8, "0a" * 12, "f" * 11, " ", ":", "=", '"', "'", "x", "ABC123", "é", "-", "ſ"]) for _ in range(rng.randrange(14)))
        assert [(s, secrets.KINDS[k], e) for s, k, e in secrets.base_spans(t)] == scanner(t), t


def test_secrets(spark, awkward):
    network = secrets.train()
    own, held = secrets.split_findings()
    assert len(own) > 1000 and len(held) > 500
    for test, recall, wrong in ((own, 0.95, 0.03), (held[1::2], 0.95, 0.2)):
        score, y = secrets._score(network, [x[:3] for x in test]), np.array([x[3] for x in test])
        assert (score[y == 1] >= network.threshold).mean() >= recall and (score[y == 0] >= network.threshold).mean() <= wrong
    found = {r.doc_id: r.found for r in secrets.scan(awkward.where("doc_id is not null")).collect()}
    assert all(not found[i] for i in (1, 2, 3, 4, 5, 7)) and [f.kind for f in found[9]] == ["assign", "access", "hex"]
    text = 'x password: short1 Token="abcdefgh" ' + "AKIA" + "B" * 16 + " " + "f" * 24 + " " + "f" * 23
    assert [(k, text[s:e]) for s, k, e in secrets.base_spans(text)] == [(0, "password: short1"), (0, 'Token="abcdefgh'), (1, "AKIA" + "B" * 16), (2, "f" * 24)]
    clean = secrets.scan(awkward, keep_text=True, found_col="_found")
    assert "AKIA" not in clean.where("doc_id = 9").first().text and clean.columns == [*awkward.columns, "_found"]
    assert secrets.scan(empty(spark)).count() == 0


def test_secrets_network_adds_spans(spark):
    """Keys that no fixed pattern knows, alone and around a base span; prose and look-alikes stay."""
    key, tail = "kJ8dZq2WmX7rT4vBn6YpL1sHc9GfQ3eR5uKx", "Qz7LmW2rXv9TkB4nHd8YpS3cJf6GhR5wKt1E"
    rows = [(1, f"header Bearer {key} end"), (2, f"auth {'0a' * 12}-{tail} end"), (3, "the neighbourhoodassociation met at www.example.org/minutes-2023.html again")]
    found = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), keep_text=True).collect()}
    assert [f.kind for f in found[1].found] == ["cnn"] and found[1].text == "header Bearer <SECRET> end"
    assert sorted(f.kind for f in found[2].found) == ["cnn", "hex"] and found[2].text == "auth <SECRET> end"
    assert not found[3].found


def test_toxicity_finds_terms_and_pairs(spark, awkward):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(3000):
        words = [f"w{rng.randrange(400)}" for _ in range(30)]
        kind = k % 4
        words += [["insult"], ["group"], ["insult", "group"], []][kind]
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(kind == 2)))
    docs, truth = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    machine = toxicity.learn(docs, truth.where("doc_id < 2000"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    assert np.mean([(got[k] >= 0.7) == bool(y) for k, y in labels[2000:]]) > 0.97
    scores = toxicity.score(awkward, machine).collect()
    assert len(scores) == len(AWKWARD) and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.score(awkward, machine, keep=True, score_col="_s").columns == [*awkward.columns, "_s"]
    assert toxicity.learn(docs, truth.where("false")).scores(np.empty(0, int), np.empty(0, int), 1)[0] < 0.5


def test_toxicity_finds_pairs_that_terms_hide(spark):
    """One or the other term, but not both and not none, makes a text toxic: no term says anything alone."""
    rng = random.Random(5)
    rows, labels = [], []
    for k in range(4000):
        a, b = k % 2, k // 2 % 2
        words = [f"w{rng.randrange(300)}" for _ in range(20)] + ["insult"] * a + ["group"] * b
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
        labels.append((k, int(a != b)))
    docs, truth = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.learn(docs, truth.where("doc_id < 3000"))).collect()}
    assert np.mean([(got[k] >= 0.5) == bool(y) for k, y in labels[3000:]]) > 0.95
    # The best linear model of the same two terms is right about half of the time.
    x = np.array([[1, "insult" in t, "group" in t] for _, t in rows], float)
    y = np.array([y for _, y in labels])
    w = np.linalg.lstsq(x[:3000], y[:3000], rcond=None)[0]
    assert np.mean((x[3000:] @ w >= 0.5) == y[3000:]) < 0.7


def test_toxicity_scores_are_the_pair_sum(spark, docs):
    """Every score against the machine's formula summed pair by pair, from terms found one word at a time."""
    machine = queries.toxicity_machine(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    place = {int(t): k for k, t in enumerate(machine.terms)}
    got = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    for r in docs.collect()[:60]:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+".encode("latin-1"), (r.text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
        times = {}
        for w in words:
            for n in (0, *toxicity.BEGINNINGS):
                if n == 0 or len(w) > n:
                    part = np.frombuffer(w[:n] if n else w, np.uint8)
                    name = text.span_hashes(part, np.array([0]), np.array([len(part)]))
                    base = int(text.mix(name + np.uint64(n))[0]) >> (64 - toxicity.BASE_BITS)
                    times[base] = times.get(base, 0) + 1
        on = [place[b * len(toxicity.TIMES) + k] for b, m in times.items() for k, least in enumerate(toxicity.TIMES) if m >= least and b * len(toxicity.TIMES) + k in place]
        z = machine.bias + sum(machine.weights[i] for i in on) + sum(float(machine.factors[i] @ machine.factors[j]) for a, i in enumerate(on) for j in on[:a])
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6


def test_toxicity_bounds_rows_not_ids(spark, monkeypatch):
    """An id with very many rows gives one row to the fit."""
    rows = [(1, f"bad word {k}") for k in range(500)] + [(k, "good word") for k in range(2, 40)]
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda y, *a: seen.append(len(y)) or toxicity.Machine(np.empty(0, np.int64), -1.0, np.empty(0), np.empty((0, 8))))
    toxicity.learn(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([(k, int(k == 1)) for k in range(1, 40)] * 2, "doc_id bigint, toxic int"))
    assert seen == [39]


def test_language(spark, docs, awkward):
    rest = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.learn(docs.where(rest != 2))
    held = langid.identify(docs, model).join(docs.where(rest == 2).where("lang is not null").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) >= 0.95
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(awkward, model).collect()}
    assert got[1] == got[2] == got[3] == got[12] == ("und", 0.0)
    assert {r.lang_pred for r in langid.identify(awkward, langid.learn(empty(spark))).collect()} == {"und"}
    every = docs.select("doc_id", "text").collect()
    found = {r.doc_id: r.lang_pred for r in queries.op9_language(spark, SF).collect()}
    assert all((found[r.doc_id] == "und") == (not any(map(str.isalpha, r.text or ""))) for r in every)
    few = docs.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").first().lang
    assert langid.learn(docs, languages=1)[0] == [few]


def test_language_mixture_is_plain_em():
    """Proportions and language set of small cases against expectation-maximisation written out trigram by trigram."""
    rng = np.random.default_rng(4)
    for _ in range(20):
        k = int(rng.integers(2, 5))
        table, counts = rng.dirichlet(np.ones(30), k).T + 1e-4, rng.integers(1, 9, 30).astype(float)

        def em(langs):
            share = [1 / len(langs)] * len(langs)
            if len(langs) > 1:
                for _ in range(langid.ITERATIONS):
                    new = [0.0] * len(langs)
                    for t in range(30):
                        all_of = sum(share[i] * table[t, x] for i, x in enumerate(langs))
                        for i, x in enumerate(langs):
                            new[i] += counts[t] * share[i] * table[t, x] / all_of
                    share = [v / counts.sum() for v in new]
            return share, sum(counts[t] * np.log(sum(s * table[t, x] for s, x in zip(share, langs))) for t in range(30))

        chosen = list(range(k))
        share, best = em(chosen)
        while len(chosen) > 1:
            rest = [x for i, x in enumerate(chosen) if i != int(np.argmin(share))]
            fewer, value = em(rest)
            if value + langid.PENALTY * np.log(counts.sum() + 1) < best:
                break
            chosen, share, best = rest, fewer, value
        got, shares = langid.infer(table, counts)
        assert got == chosen and np.allclose(shares, share)


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/1?x"), (2, "https://a.example.com/en/1"), (3, "https://a.example.com/de/1"), (4, "http://x.net/es/#t"), (5, None), (6, "no scheme"), (7, "http://spam-farm.example.org/en/9"), (8, "http://ththre.example.org/fr/8"), (9, "http://examplecom/en/"), (10, "http://b.com")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id bigint, url string"), queries.URL_RULES).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert [(got[k].rule, got[k].verdict) for k in (2, 3, 4)] == [("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block")]
    assert (got[5].host, got[5].path, got[5].rule, got[6].host) == ("", "", None, "") and got[9].rule is None and got[10].rule is None
    assert (got[7].verdict, got[8].verdict) == ("block", "allow")
    long = [(1, "http://a.org/" + "x" * 100_000), (1, "http://a.org/" + "x" * 100_000), (None, "://")]
    wide = spark.createDataFrame(long, "page_id bigint, url string").withColumn("host", F.lit("mine"))
    few = urls.judge(wide, queries.URL_RULES).collect()
    assert len(few) == 3 and {r.host for r in few} == {"a.org", ""} and len({r.score for r in few if r.page_id == 1}) == 1
    assert urls.judge(wide.limit(0), queries.URL_RULES).count() == 0


def test_urls_held_out():
    """Hosts that the table does not have, with words that it has: blocked and clean ones are told apart."""
    bad = ["new-casino.example.net/slots/7", "cheap-viagra.example.org/buy/1", "adult-xxx.example.net/videos/4", "cheap-pills-online.example.com/en/1", "free-crack.example.info/keygen/3.exe", "secure-login-verify.example.org/account/login"]
    good = ["ththou.example.org/en/91", "blog.tionre.example.org/de/14", "www.thended.example.net/en/7.html", "library.example.org/catalogue/item/7", "museum.example.net/collection/3", "docs.example.org/guide/start.html"]
    score = urls.scores(bad + good, urls.train())
    assert np.mean((score >= 0.5) == [True] * 6 + [False] * 6) >= 0.8


def test_fingerprints(spark, docs, awkward):
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    got = {r.doc_id: r for r in lcp.edited_fingerprints(docs).collect()}
    for k, (i, t) in enumerate(rows):
        edited = t[: len(t) - len(t) // 4] + rows[(k + 1) % len(rows)][1][: len(t) // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
    plain = {r.doc_id: r.fingerprint for r in lcp.fingerprints(docs).collect()}
    assert plain == {i: r.fingerprint for i, r in got.items()}
    assert np.mean([r.near_edited for r in got.values()]) > 0.5 > 0.1 > np.mean([r.near_next for r in got.values()])
    few = lcp.edited_fingerprints(awkward).collect()
    assert len(few) == len(AWKWARD) and {r.fingerprint for r in few if r.doc_id in (1, 2)} == {""}
    assert len({r.fingerprint for r in few if r.doc_id in (5, 6)}) == 1
    assert lcp.edited_fingerprints(empty(spark)).count() == 0


def plain_parse(data):
    """Phrases of a byte string level by level, one symbol at a time."""
    symbols, levels = list(data), []
    for level in range(1, max(lcp.LEVELS) + 1):
        wide = level > 1
        runs = []
        for c in symbols:
            if runs and runs[-1][0] == c:
                runs[-1][1] += 1
            else:
                runs.append([c, 1])
        mix = lambda v: int(text.mix(np.array([v % (1 << 64)], np.uint64))[0])
        any_long = any(m > 1 for _, m in runs)
        names = [mix(c * 0xA24BAED4963EE407 + m + (1 << 40)) if m > 1 else c for c, m in runs]
        bits = 64 if wide or any_long else 8
        label = names
        for step in range(4 if bits == 64 else 3):
            full = (1 << (bits if step == 0 else 8)) - 1
            new = []
            for k, x in enumerate(label):
                differ = (x ^ (label[k - 1] if k else ~x & full)) & full
                low = (differ & -differ).bit_length() - 1
                new.append(2 * low + (x >> low & 1))
            label = new
        cut = [k for k in range(len(label)) if k == 0 or (label[k] > label[k - 1] and label[k] > (label[k + 1] if k + 1 < len(label) else -1))]
        values = np.array([n if bits == 64 else n + 0x51ED27 for n in names], np.uint64)
        symbols = [int(text.span_hashes(values, np.array([a]), np.array([b]))[0]) for a, b in zip(cut, [*cut[1:], len(label)])] if len(label) else []
        levels.append(symbols)
    return levels


def test_fingerprints_are_a_plain_parse():
    rng = random.Random(6)
    texts = ["", "a", "aaaa", "abab" * 30, "é ß 日本" * 5] + ["".join(rng.choice("abcdefgh  ") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    for t in texts:
        levels, names, seen = plain_parse(t.encode()), [], {}
        for level in lcp.LEVELS:
            for s in levels[level - 1]:
                s = (s + level) % (1 << 64)
                names.append((s + seen.get(s, 0) * 0x9E3779B97F4A7C15) % (1 << 64))
                seen[s] = seen.get(s, 0) + 1
        want = np.unique((text.mix(np.array(names, np.uint64)) >> np.uint64(32)).astype(np.uint32))[: lcp.SKETCH] if names else []
        data = np.frombuffer(t.encode(), np.uint8)
        assert lcp.sketches(data, np.array([0, len(data)]))[0].tolist() == list(want)
    a, b = (np.arange(0, 60, dtype=np.uint32), np.arange(30, 90, dtype=np.uint32))
    assert lcp.likeness(a, b) == len(set(a) & set(b)) / len(set(a) | set(b)) and lcp.likeness(a, a) == 1


def test_fingerprints_of_a_hot_id(spark, monkeypatch):
    """An id with very many rows takes several ranges; the order over all ranges is one cycle."""
    monkeypatch.setattr(lcp, "RANGE_ROWS", 20)
    rows = [(7, f"text number {k}") for k in range(300)] + [(k, f"other {k}") for k in range(100, 160)] + [(None, "none"), (3, "three")]
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(5)
    dealt = lcp.with_next(df).collect()
    assert len({r.range for r in dealt if r.id == 7}) > 5 and sum(r.place == 0 for r in dealt) == len(rows)
    got = lcp.edited_fingerprints(df)
    assert dict(got.dtypes)["doc_id"] == "int" and got.count() == len(rows)
    after = {hashlib.sha256((t[: len(t) - len(t) // 4] + f[: len(t) // 4]).encode()).hexdigest() for _, t in rows for _, f in rows}
    assert all(r.edited_sha256 in after for r in got.collect())


def test_chat(spark, monkeypatch):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{g}{t}") for c, g, n in ((1, "a", 3), (2, "a", 5), (3, "a", 5), (4, "b", 1), (5, "b", 2), (6, "c", 1)) for t in range(n)] + [(7, None, "user", "x"), (8, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert {r.conv_id for r in chat.render(df).collect()} == {2, 5, 6, 8}
    assert chat.render(df).where("conv_id = 5").first().rendered == "<|user|>\nb0<|end|>\n<|assistant|>\nb1<|end|>\n"
    monkeypatch.setattr(chat, "BLOCK", 2)
    assert {r.conv_id for r in chat.render(df, segment=2).collect()} == {2, 5, 6, 8}
    assert "".join(r.rendered for r in chat.render(df, segment=2).where("conv_id = 2").orderBy("segment").collect()).count("<|end|>") == 5
    assert chat.render(df.where("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.queries()[name](spark, SF).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    order = sorted(got.columns)
    assert sorted(map(str, got[order].values.tolist())) == sorted(map(str, want[order].values.tolist()))


def test_folds_and_pipeline(spark, docs):
    import corpus_pipeline

    held = {r.doc_id: r.held_out for r in queries.op5_toxicity(spark, SF).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in held.items())
    got = {r.doc_id: r.token_ids for r in corpus_pipeline.run(spark, SF).collect()}
    # Plainly, on the driver: the same decisions from the operators' own brute-force forms.
    machine = queries.toxicity_machine(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    scores = {r.doc_id: r.score for r in toxicity.score(docs, machine).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if scores[r.doc_id] < queries.TOXIC_FROM]
    first = {i for i, _, c in brute_components(rows) if i == c}
    dirty = {r.doc_id for r in queries.op7_decontam(spark, SF).where("contaminated").collect()}
    encoder = bpe.SegmentTreeEncoder(bpe.Vocabulary(queries.vocabulary_path()))
    want = {}
    for i, t in rows:
        if i in first and i not in dirty:
            base = secrets.base_spans(t)
            more = [c for c in secrets._candidates(t) if not any(s <= c[1] and c[2] <= e for s, _, e in base)]
            extra = [c[1:] for c, p in zip(more, secrets._score(secrets.train(), more) if more else []) if p >= secrets.train().threshold]
            want[i] = encoder.encode(secrets.redact(t, [(s, e) for s, _, e in base] + extra))
    assert got == want


def test_pipeline_stages_on_awkward_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, several texts of an id, columns named like a stage's own, and empty tables."""
    import corpus_pipeline

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _found string, found string, _toxicity double, toxicity double, first int, sig int, place int, doc int, _id int, key int"
    texts = [*AWKWARD, (20, "alpha beta gamma delta epsilon zeta"), (20, "quite another text of the same id here"), (20, "quite another text of the same id here"), (21, "Alpha beta gamma delta  epsilon zeta")]
    rows = [(i, t, "l", "s", len(t or ""), "f", "g", 0.5, 0.25, 1, 2, 3, 4, 5, 6) for i, t in texts]
    full = spark.createDataFrame(rows, schema)
    for docs in (full, full.limit(0), full.where("doc_id is null")):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
            got = out.collect()
            extra = lambda r: tuple(r)[5:]
            assert {extra(r) for r in got} <= {extra(r) for r in docs.collect()}
            if name == "near copies" and n > 3:
                assert sorted((r.text or "") for r in got if r.doc_id == 20) == ["alpha beta gamma delta epsilon zeta", "quite another text of the same id here"]
                ids = [r.doc_id for r in got]
                assert 21 not in ids and 6 not in ids and 11 not in ids and ids.count(None) == 2
            elif name in ("secrets", "near copies"):
                assert len(got) == n
            if name == "secrets":
                assert all(r.n_chars == len(r.text or "") for r in got)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == n
