"""URL filters: fixed host and path rules, and logistic regression on hashed character n-grams for all other URLs.

The regression is trained on the small labelled table below (seeded order, plain gradient descent in numpy). Rules are
native expressions. Null URLs and URLs without ``://`` have an empty host and path; no rule fits those, and the
regression judges the empty text like any other. Repeated rows are judged one by one, long URLs whole; other columns are
left out; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.text import U64, as_bytes, span_hashes

ALLOW, BLOCK = "allow", "block"
BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
#: (host, path, blocked): the labelled table.
LABELLED = (
    ("spam-farm.example.org", "/en/12", 1), ("www.spam-farm.example.org", "/de/7710/", 1), ("spam-farm.example.com", "/fr/91.html", 1),
    ("cheap-pills.example.org", "/en/450", 1), ("www.cheap-pills.example.org", "/es/3", 1), ("m.cheap-pills.example.net", "/de/8812", 1),
    ("free-casino.example.org", "/bonus/21", 1), ("casino-online.example.net", "/en/win-now/9", 1), ("www.best-casino.example.org", "/slots/44", 1),
    ("xxx-videos.example.org", "/en/77", 1), ("adult-cams.example.net", "/live/5", 1), ("hot-adult.example.org", "/xxx/8", 1),
    ("malware-drop.example.org", "/download/setup.exe", 1), ("free-crack.example.net", "/keygen/12.exe", 1), ("warez.example.org", "/torrent/crack/4", 1),
    ("phish-login.example.org", "/account/verify/login", 1), ("secure-verify.example.net", "/login/update-account", 1), ("click-bait.example.org", "/en/you-wont-believe/2", 1),
    ("ads.tracker.example.net", "/pixel/1", 1), ("banner-ads.example.org", "/click/88", 1), ("payday-loans.example.org", "/en/apply/6", 1),
    ("replica-watches.example.net", "/buy/cheap/3", 1), ("viagra-shop.example.org", "/pills/9", 1), ("buy-followers.example.net", "/cheap/10", 1),
    ("blog.tiontion.example.org", "/en/853/", 0), ("ththre.example.org", "/fr/825", 0), ("www.ththen.example.org", "/en/148.html", 0),
    ("m.ththth.example.org", "/de/25", 0), ("thther.example.org", "/en/685", 0), ("therin.example.net", "/en/770", 0),
    ("news.example.org", "/2024/05/article-12", 0), ("docs.example.net", "/guide/install.html", 0), ("en.wiki.example.org", "/wiki/Railway", 0),
    ("forum.example.org", "/thread/8812", 0), ("library.example.net", "/catalogue/item/55", 0), ("blog.ththan.example.net", "/de/612", 0),
    ("www.university.example.org", "/research/papers/7", 0), ("museum.example.org", "/collection/91", 0), ("weather.example.net", "/forecast/12", 0),
    ("recipes.example.org", "/soup/44.html", 0), ("m.therou.example.org", "/en/474.html", 0), ("tionsh.example.net", "/en/36815", 0),
    ("blog.thernd.example.net", "/de/612", 0), ("www.therti.example.org", "/en/334/", 0), ("school.example.org", "/timetable/5", 0),
    ("city-council.example.org", "/minutes/2023/11", 0), ("open-data.example.net", "/set/9", 0), ("", "", 0),
)


def host_of(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of the (verdict, host and path) rules that fits, as its text; null if none does."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every distinct character n-gram; texts are short, so they are taken as bytes in one array."""
    data, offsets = as_bytes(pa.array([f"^{t}$" for t in texts], pa.large_string()))
    rows = np.repeat(np.arange(len(texts)), np.diff(offsets))
    keys = [np.empty(0, np.int64)]
    for n in GRAMS:
        at = np.arange(max(0, len(data) - n + 1))
        at = at[rows[at] == rows[at + n - 1]] if len(at) else at
        names = span_hashes(data, at, at + n)
        keys.append(rows[at] * np.int64(BUCKETS) + (names >> U64(50)).astype(np.int64))
    return np.divmod(np.unique(np.concatenate(keys)), BUCKETS)


@functools.cache
def train(epochs: int = 400, rate: float = 0.5, decay: float = 1e-3) -> np.ndarray:
    """Weights of the buckets, then the bias, from the labelled table."""
    rows, buckets = _grams([h + p for h, p, _ in LABELLED])
    y = np.array([b for *_, b in LABELLED], float)
    size = np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(y))))
    w = np.zeros(BUCKETS + 1)
    for _ in range(epochs):
        z = np.bincount(rows, w[buckets], len(y)) / size + w[-1]
        error = (1 / (1 + np.exp(-z)) - y) / len(y)
        w[:-1] -= rate * 10 * (np.bincount(buckets, (error / size)[rows], BUCKETS) + decay * w[:-1])
        w[-1] -= rate * error.sum()
    return w


def scores(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """Probability that each host and path is to be blocked."""
    rows, buckets = _grams(texts)
    size = np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(texts))))
    return 1 / (1 + np.exp(-(np.bincount(rows, weights[buckets], len(texts)) / size + weights[-1])))


def judge(pages: DataFrame, rules: list[tuple[str, str]], weights: np.ndarray | None = None, id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Verdict on every URL: id column, host, path, rule, score, verdict. One pass, no shuffle."""
    weights = train() if weights is None else weights
    parts = pages.select(id_col, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    parts = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))

    def run(batches):
        for batch in batches:
            texts = [h + p for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores(texts, weights))], [*batch.schema.names, "score"])

    judged = parts.mapInArrow(run, f"`{id_col}` {dict(pages.dtypes)[id_col]}, host string, path string, rule string, score double")
    verdict = F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW)
    for name in (ALLOW, BLOCK):
        verdict = F.when(F.col("rule").isin([r for v, r in rules if v == name]), name).otherwise(verdict)
    return judged.withColumn("verdict", verdict)
