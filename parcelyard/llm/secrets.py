"""Secret scans: fixed patterns, and a character convolutional network over every candidate in its context.

Candidates are all runs of 16 or more key-like characters and the spans of the fixed patterns. The network sees windows of
characters around and inside the candidate (long candidates get several windows; the highest score counts), runs in numpy,
and is trained on a table of labelled findings that a seeded rule makes below. Its scores are calibrated (Platt) on findings
in formats that it was not trained on, and the threshold is the highest that keeps the wanted recall on those.

Defined results: null counts as empty; nothing is found in texts without candidates; very long texts are scanned whole, and
long runs by overlapping windows; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcelyard.llm.shared import bounded_batches
from parcelyard.llm.text import slices

#: The base patterns; letters of the assignment's name in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "cnn")
_ASSIGN_NAMES = re.compile("passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
BEFORE, INSIDE, AFTER, STRIDE = 24, 40, 8, 28
WIDTH, EMBED, FILTERS, KERNEL = BEFORE + INSIDE + AFTER, 12, 32, 5
#: Recall that the threshold keeps on held-out findings, and the number of labelled findings.
RECALL, FINDINGS, EPOCHS = 0.98, 3000, 12
#: Formats of secrets and of look-alikes (places in the lists below) that calibration and tests hold out of training.
HELD_SECRETS, HELD_LOOKALIKES = (3, 6), (2, 5, 9)


def _codes(text: str) -> np.ndarray:
    raw = np.array([ord(c) if ord(c) < 128 else 127 for c in text], np.int16)
    return raw


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Character codes [n, WIDTH] of the windows over a candidate; 0 stands outside of the text."""
    out = []
    for at in range(start, max(start + 1, end - (INSIDE - STRIDE)), STRIDE):
        stop = min(end, at + INSIDE)
        row = np.zeros(WIDTH, np.int16)
        head = _codes(text[max(0, at - BEFORE) : at])
        body, tail = _codes(text[at:stop]), _codes(text[stop : stop + AFTER])
        row[BEFORE - len(head) : BEFORE] = head
        row[BEFORE : BEFORE + len(body)] = body
        row[BEFORE + INSIDE : BEFORE + INSIDE + len(tail)] = tail
        out.append(row)
    return np.stack(out)


def labelled_findings(n: int = FINDINGS, seed: int = 5) -> list[tuple[str, int, int, int, bool]]:
    """Seeded table of findings: (text, start, end, is a secret, of a held-out format). Half are keys in usual formats, half look-alikes."""
    rng = np.random.default_rng(seed)

    def pick(alphabet: str, least: int, most: int) -> str:
        return "".join(rng.choice(list(alphabet), int(rng.integers(least, most + 1))))

    alnum, lower, upper, digits = string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase, string.digits
    word = lambda: pick("aeinorstlhd", 2, 9)
    prose = lambda k: " ".join(word() for _ in range(k))
    secrets = [
        lambda: pick(alnum, 24, 64),
        lambda: pick(alnum + "+/", 30, 80) + "=" * int(rng.integers(0, 3)),
        lambda: "ghp_" + pick(alnum, 36, 36),
        lambda: "sk_live_" + pick(alnum, 24, 32),
        lambda: "xoxb-" + pick(digits, 11, 12) + "-" + pick(alnum, 24, 24),
        lambda: "eyJ" + pick(alnum, 18, 30) + "." + pick(alnum + "_-", 30, 60) + "." + pick(alnum + "_-", 30, 43),
        lambda: pick(upper + digits, 20, 40),
        lambda: pick("0123456789abcdef", 32, 64),
    ]
    lookalikes = [
        lambda: f"//{word()}.example.com/{pick(lower, 2, 2)}/{pick(digits, 2, 6)}",
        lambda: f"www.{word()}{word()}.example.org/{word()}-{pick(digits, 2, 5)}.html",
        lambda: f"{word()}.{pick(digits, 2, 2)}-mail{pick(digits, 1, 1)}.example.com",
        lambda: f"{pick('12', 4, 4)}-{pick('01', 2, 2)}-{pick('012', 2, 2)}T{pick('012', 2, 2)}-{pick('012345', 2, 2)}",
        lambda: f"/usr/lib/{word()}{pick(digits, 1, 2)}/{word()}-{pick(digits, 1, 1)}.{pick(digits, 1, 2)}.so",
        lambda: f"{word()}_{word()}_{word()}_{pick(digits, 1, 3)}",
        lambda: f"{word()}{word()}{word()}{word()}{pick(digits, 1, 4)}",
        lambda: "-".join(pick(digits, 3, 5) for _ in range(4)) + word(),
        lambda: f"{word()}-{word()}-{pick(digits, 1, 2)}-{word()}-{word()}",
        lambda: "=" * int(rng.integers(16, 40)) + f"{word()}{pick(digits, 1, 2)}" + "=" * int(rng.integers(4, 20)),
        lambda: "".join(word() + pick(digits, 1, 1) for _ in range(3)) + word(),
        lambda: "".join(word() for _ in range(int(rng.integers(3, 8)))),
        lambda: (word() + word() + word() + word() + "nd").capitalize() + "." * int(rng.integers(0, 2)),
        lambda: pick(digits, 16, 20),
        lambda: pick("-=_.", 1, 1) * int(rng.integers(16, 60)),
    ]
    lead = [lambda: "key: ", lambda: "secret=", lambda: "Authorization: Bearer ", lambda: "export KEY=", lambda: '"credential": "', lambda: "https:", lambda: "see ", lambda: "", lambda: "auth = '", lambda: "on "]
    out = []
    for k in range(n):
        y = k % 2
        kinds = secrets if y else lookalikes
        kind = int(rng.integers(len(kinds)))
        body = kinds[kind]()
        if len(body) < 16:
            body = (pick(alnum, 20, 30) + "7a") if y else f"{word()}.{word()}.{word()}.{word()}.{pick(digits, 2, 2)}.x{word()}"
        before = prose(int(rng.integers(0, 6))) + " " + lead[int(rng.integers(len(lead)))]()
        out.append((before + body + " " + prose(int(rng.integers(0, 4))), len(before), len(before) + len(body), y, kind in (HELD_SECRETS if y else HELD_LOOKALIKES)))
    return out


class Network:
    """Embedding, one convolution, max over places, one dense layer; trained by Adam."""

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.p = {
            "e": rng.normal(0, 0.3, (128, EMBED)).astype(np.float32),
            "k": rng.normal(0, 1 / np.sqrt(KERNEL * EMBED), (KERNEL * EMBED, FILTERS)).astype(np.float32),
            "b": np.zeros(FILTERS, np.float32),
            "w": rng.normal(0, 1 / np.sqrt(2 * FILTERS), 2 * FILTERS).astype(np.float32),
            "c": np.zeros(1, np.float32),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        p = self.p
        seen = p["e"][x]
        n, places = len(x), WIDTH - KERNEL + 1
        cols = np.lib.stride_tricks.sliding_window_view(seen, KERNEL, 1).transpose(0, 1, 3, 2).reshape(n * places, -1)
        act = np.maximum(cols @ p["k"] + p["b"], 0).reshape(n, places, FILTERS)
        top = act.argmax(1)
        peak, mean = np.take_along_axis(act, top[:, None], 1)[:, 0], act.mean(1)
        return np.concatenate([peak, mean], 1) @ p["w"] + p["c"], (cols, act, top, peak, mean)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x[i : i + 512])[0] for i in range(0, len(x), 512)]) if len(x) else np.empty(0)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.004, batch: int = 64, seed: int = 9) -> None:
        rng, p = np.random.default_rng(seed), self.p
        m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
        places = WIDTH - KERNEL + 1
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                xs, ys = x[order[i : i + batch]], y[order[i : i + batch]]
                n = len(xs)
                z, (cols, act, top, peak, mean) = self._forward(xs)
                dz = (1 / (1 + np.exp(-z)) - ys) / n
                g = {"w": np.concatenate([peak, mean], 1).T @ dz, "c": dz.sum(keepdims=True)}
                d = dz[:, None] * p["w"][None]
                da = np.repeat(d[:, None, FILTERS:] / places, places, 1)
                np.put_along_axis(da, top[:, None], np.take_along_axis(da, top[:, None], 1) + d[:, None, :FILTERS], 1)
                da = (da * (act > 0)).reshape(n * places, FILTERS)
                g["k"], g["b"] = cols.T @ da, da.sum(0)
                dc = (da @ p["k"].T).reshape(n, places, KERNEL, EMBED)
                ds = np.zeros((n, WIDTH, EMBED), np.float32)
                for t in range(KERNEL):
                    ds[:, t : t + places] += dc[:, :, t]
                g["e"] = np.zeros_like(p["e"])
                np.add.at(g["e"], xs.ravel(), ds.reshape(-1, EMBED))
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)

    def calibrate(self, z: np.ndarray, y: np.ndarray, recall: float = RECALL) -> None:
        """Platt scaling on held-out findings, and the highest threshold that keeps the recall on them."""
        a, b = 1.0, 0.0
        for _ in range(500):
            q = 1 / (1 + np.exp(-(a * z + b)))
            a, b = a - 0.05 * ((q - y) * z).mean(), b - 0.05 * (q - y).mean()
        self.scale, self.shift = float(a), float(b)
        q = np.sort(self.probability(z[y == 1]))
        self.threshold = float(q[int(np.floor((1 - recall) * len(q)))])

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * z + self.shift)))


def _score(network: Network, found: list[tuple[str, int, int]]) -> np.ndarray:
    """Probability of each candidate: the highest of its windows."""
    rows = [windows(*f) for f in found]
    z = network.logits(np.concatenate(rows))
    cuts = np.cumsum([0] + [len(r) for r in rows[:-1]])
    return network.probability(np.maximum.reduceat(z, cuts))


@functools.cache
def train(n: int = FINDINGS, recall: float = RECALL) -> Network:
    """Train on the findings of the formats that are not held out; calibrate and set the threshold on half of the others."""
    own, held = split_findings(n)
    # Each finding is learned by its first window, where its beginning and the words before it are seen.
    x = np.stack([windows(t, s, e)[0] for t, s, e, _ in own])
    network = Network()
    network.fit(x, np.array([y for *_, y in own], np.float32))
    held = held[::2]
    network.calibrate(_logit(network, held), np.array([y for *_, y in held]), recall)
    return network


def split_findings(n: int = FINDINGS) -> tuple[list, list]:
    """Findings (text, start, end, is a secret) of the formats to train on, and of the held-out ones."""
    found = labelled_findings(n)
    return [f[:4] for f in found if not f[4]], [f[:4] for f in found if f[4]]


def _logit(network: Network, found) -> np.ndarray:
    rows = [windows(*f[:3]) for f in found]
    z = network.logits(np.concatenate(rows))
    return np.maximum.reduceat(z, np.cumsum([0] + [len(r) for r in rows[:-1]]))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of the fixed patterns, by start and then kind: (start, place in KINDS, end)."""
    out = []
    if _ASSIGN_NAMES.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def _candidates(text: str) -> list[tuple[str, int, int]]:
    """All key-like runs of a text."""
    return [(text, m.start(), m.end()) for m in CANDIDATE.finditer(text)]


def scan(docs: DataFrame, network: Network | None = None, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, found_col: str = "found") -> DataFrame:
    """Secrets in every whole text: id column, found array<struct<kind, start, end, score>>, redacted text if asked for.

    Code point offsets, ends exclusive, ordered by start and then kind. The network scores every candidate. Base spans always
    stay and carry their score; a run that the network takes for a secret is added, unless a base span holds all of it. The
    input's other columns are left out, except with ``keep_text``, which keeps them all and replaces each found span in the
    text by ``<SECRET>``; a column of docs named like ``found_col`` is left out.
    """
    bounded_batches(docs.sparkSession)
    network = network or train()

    def run(batches):
        for batch in slices(batches, at):
            names = batch.schema.names
            texts = [t or "" for t in batch.column(at).to_pylist()]
            every: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
            asked = []
            for k, t in enumerate(texts):
                base = base_spans(t)
                asked += [(k, (t, s, e), kind) for s, kind, e in base]
                asked += [(k, c, 3) for c in _candidates(t) if not any(s <= c[1] and c[2] <= e for s, _, e in base)]
            for i in range(0, len(asked), 2048):
                part = asked[i : i + 2048]
                for (k, (_, s, e), kind), p in zip(part, _score(network, [c for _, c, _ in part])):
                    if kind < 3 or p >= network.threshold:
                        every[k].append((s, kind, e, float(p)))
            rows = [[{"kind": KINDS[k], "start": s, "end": e, "score": p} for s, k, e, p in sorted(x)] for x in every]
            found = pa.array(rows, kind_type)
            if not keep_text:
                yield pa.RecordBatch.from_arrays([batch.column(0), found], [id_col, found_col])
                continue
            clean = [redact(t, [(s, e) for s, _, e, _ in x]) if x else old for t, x, old in zip(texts, every, batch.column(at).to_pylist())]
            cols = [pa.array(clean, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, found], [*names, found_col])

    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    rows = docs.drop(found_col) if keep_text else docs.select(id_col, text_col)
    at = rows.columns.index(text_col)
    schema = ", ".join(f"`{n}` {t}" for n, t in (rows.dtypes if keep_text else [(id_col, dict(docs.dtypes)[id_col])]))
    return rows.mapInArrow(run, f"{schema}, `{found_col}` array<struct<kind: string, start: int, `end`: int, score: double>>")


def redact(text: str, spans: list[tuple[int, int]], mark: str = "<SECRET>") -> str:
    """The text with each maximal union of overlapping spans replaced by the mark."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    for s, e in merged:
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])

