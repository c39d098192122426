"""N-gram Jaccard join by R-trees over count vectors, and its classes.

A document is the set of its word 5-grams (as 64-bit hashes). Tokens of the set are hashed into GROUPS groups; the group
counts are the document's point. Two sets can share at most the sum over groups of the smaller count, and an R-tree node's
box bounds that for all points in it at once, so subtrees and pairs that can't reach the threshold are left out; surviving
pairs are verified on the whole texts.

How it is spread: documents of equal sets are one class first, and one row stands for each distinct set, whatever its id
(an id may have several texts). A pair that reaches the threshold shares a token among each
one's first n - ceil(t n) + 1 tokens of any common order, so each such token is a block, and every block is searched by
R-trees of its own. The order puts tokens that are frequent in the whole table last. Blocks whose members are all known to
be connected (through links to the block's first member by a few min-hash tokens, verified too) have nothing to add, so
large groups of near copies are not paired out. A large block is cut into tiles of like size and min-hash, which are leaves
of its R-tree on the upper level: boxes of the tiles are joined first, and only the members of tiles whose boxes can hold
a pair meet. Texts are shipped last, and only those of the pairs that are left.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelyard.llm.components import components
from parcelyard.llm.shared import Scratch, bounded_batches, small
from parcelyard.llm.text import ASCII_SPACE, U64, as_bytes, chunks, lower_ascii, mix, slices, span_hashes, word_table, words

GROUPS, FULL = 256, 255
#: Entries of the table of approximate token counts, in how many pieces it is summed, and how many times the mean count
#: makes a token frequent.
SKETCH_BITS, PIECES, FREQUENT = 18, 64, 1.2
#: Min-hash tokens by which groups of near copies are linked first; their least count of orders.
STARS = 6
#: Points of an R-tree leaf, and members of a block that one tile holds.
LEAF, TILE = 24, 512
#: Members of blocks of one least component that one task searches together, and pairs that it remembers so as to tell them once.
DEALT, SEEN = 100_000, 300_000
#: Pairs of a deal, beside one for each of its sets, from which on it is dense: its pairs are compared where they are found.
DENSE = 256
#: Further rounds of stars, with other heads, among what the first has left apart; none, as a round shuffles more than it saves.
ROUNDS = 0
_SPACE = word_table(ASCII_SPACE)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each row's word n-grams; of fewer words, the whole sequence; none without words."""
    out: list[np.ndarray] = []
    data = lower_ascii(data)
    for i, j in chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, rows = words(part, off, _SPACE)
        names = span_hashes(part, starts, ends)
        cuts = np.searchsorted(rows, np.arange(j - i + 1))
        total = np.zeros(len(names), U64)
        factor = 1
        for k in range(n):
            total[: max(0, len(names) - k)] += names[k:] * U64(factor)
            factor = factor * 0x9E3779B97F4A7C15 % (1 << 64)
        grams = mix(total)
        for k in range(j - i):
            a, b = cuts[k], cuts[k + 1]
            if b - a >= n:
                out.append(np.unique(grams[a : b - n + 1]))
            elif b > a:
                whole = int(b - a)
                for name in names[a:b].tolist():
                    whole = (whole * 0xD6E8FEB86659FD93 + name) % (1 << 64)
                out.append(mix(np.array([whole], U64)))
            else:
                out.append(np.empty(0, U64))
    return out


def point(tokens: np.ndarray) -> np.ndarray:
    """Counts of a set's tokens by group; counts stop at FULL, which the bound allows for."""
    return np.minimum(np.bincount((tokens & U64(GROUPS - 1)).astype(np.int64), minlength=GROUPS), FULL).astype(np.uint8)


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Most tokens that sets of these points can share."""
    most = np.minimum(a, b)
    total = most.sum(-1, dtype=np.int64)
    return np.where(most.max(-1) == FULL, np.int64(1) << 60, total)


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Fewest common tokens with which sets of these sizes link: 100 * common >= percent * (a + b - common)."""
    return -((-percent * (a.astype(np.int64) + b)) // (100 + percent))


class RTree:
    """Bulk-loaded R-tree over points, split at the median of the widest group (or of size, where sizes differ much).

    A node keeps the group-wise largest counts of its points, their least and largest set size, and their component if it
    is but one.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray):
        self.points, self.sizes, self.components = points, sizes, components
        self.nodes: list[tuple] = []
        self._build(np.arange(len(points)))

    def _build(self, at: np.ndarray) -> int:
        own, box = len(self.nodes), self.points[at]
        self.nodes.append(())
        top, low, high = box.max(0), int(self.sizes[at].min()), int(self.sizes[at].max())
        comps = self.components[at]
        only = int(comps[0]) if (comps == comps[0]).all() else None
        if len(at) <= LEAF:
            self.nodes[own] = (top, low, high, only, at, -1, -1)
            return own
        axis = int(np.argmax(top - box.min(0)))
        key = box[:, axis] if high * 10 <= low * 11 else self.sizes[at]
        order = at[np.argsort(key, kind="stable")]
        half = len(order) // 2
        left, right = self._build(order[:half]), self._build(order[half:])
        self.nodes[own] = (top, low, high, only, None, left, right)
        return own

    def pairs(self, percent: int):
        """Places (i, j) of the pairs of different components whose bound reaches what is needed: a join of the tree with itself."""
        nodes, stack = self.nodes, [(0, 0)]
        while stack:
            i, j = stack.pop()
            top, low, high, only, at, left, right = nodes[i]
            top2, low2, high2, only2, at2, left2, right2 = nodes[j]
            if only is not None and only == only2:
                continue
            if 100 * min(high, high2) < percent * max(low, low2) or bound(top, top2) < -((-percent * (low + low2)) // (100 + percent)):
                continue
            if at is not None and at2 is not None:
                s, t = self.sizes[at][:, None], self.sizes[at2][None]
                keep = (self.components[at][:, None] != self.components[at2][None]) & (100 * np.minimum(s, t) >= percent * np.maximum(s, t))
                if i == j:
                    keep &= np.tri(len(at), k=-1, dtype=bool)
                x, y = np.nonzero(keep)
                if len(x):
                    x, y = at[x], at2[y]
                    near = bound(self.points[x], self.points[y]) >= needed(self.sizes[x], self.sizes[y], percent)
                    yield x[near], y[near]
            elif i == j:
                stack += ((left, left), (left, right), (right, right))
            elif at is None and (at2 is not None or high - low >= high2 - low2):
                stack += ((left, j), (right, j))
            else:
                stack += ((i, left2), (i, right2))


def token_counts(rows: DataFrame, n: int) -> np.ndarray:
    """Approximate counts over the whole table: tokens by the top SKETCH_BITS of their hash. A fixed-size table."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in slices(batches, 0):
            for tokens in shingle_sets(*as_bytes(batch.column(0)), n):
                np.add.at(total, (tokens >> U64(64 - SKETCH_BITS)).astype(np.int64), 1)
        parts = [zlib.compress(p.astype(np.int64).tobytes(), 1) for p in np.split(total, PIECES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary())], ["piece", "counts"])

    def add(piece: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in piece.column("counts"))
        return pa.table({"piece": piece.column("piece").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    summed = rows.select("text").mapInArrow(run, "piece int, counts binary").groupBy("piece").applyInArrow(add, "piece int, counts binary").collect()
    out = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), np.int64)
    for r in summed:
        out[r.piece] = np.frombuffer(zlib.decompress(r.counts), np.int64)
    return out.ravel()


def points_table(rows: DataFrame, counts: np.ndarray, percent: int, n: int, scratch: Scratch) -> DataFrame:
    """Stored rows (key, id, sig, digest, n, point, stars, tokens, z), one for each of rows.

    key is a number of the row's own, sig the hash of its text. Then come the set's digest and size, its count vector, min-hashes and prefix tokens,
    and the compressed text, which is read again only for pairs that have to be verified.
    """
    spark = rows.sparkSession
    mean = max(1.0, counts.mean())
    # 0: usual; higher: the more frequent. Any fixed order of tokens keeps the search exact.
    rank = spark.sparkContext.broadcast(np.where(counts > FREQUENT * mean, 1 + np.log2(np.maximum(counts, 1) / mean) * 8, 0).astype(np.uint8))
    seeds = [U64(s) for s in (0x9AE16A3B2F90404F, 0xC3A5C85C97CB3127, 0xB492B66FBE98F273, 0x9DDFEA08EB382D69, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)][:STARS]

    def run(batches):
        packer = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches, 1):
            digests, sizes, points, stars, tokens, packed = [], [], [], [], [], []
            for s, text in zip(shingle_sets(*as_bytes(batch.column(1)), n), batch.column(1)):
                m = len(s)
                sizes.append(m)
                if not m:
                    digests.append(None)
                    points.append(None)
                    stars.append([])
                    tokens.append(np.empty(0, np.int64))
                    packed.append(None)
                    continue
                both = mix(s ^ U64(0x5851F42D4C957F2D))
                digests.append(int(s.sum(dtype=U64)).to_bytes(8, "big") + int((both * (s | U64(1))).sum(dtype=U64)).to_bytes(8, "big"))
                points.append(point(s).tobytes())
                stars.append(np.array([int(mix(s ^ seed).min()) for seed in seeds], U64).astype(np.int64))
                keep = m - -(-percent * m // 100) + 1
                order = np.lexsort((both, rank.value[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]))[:keep]
                tokens.append(s[order].astype(np.int64))
                packed.append(packer.compress(text.as_buffer()))
            cols = [batch.column(2), batch.column(0), batch.column(3), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(points, pa.binary()), pa.array(stars, pa.list_(pa.int64())), pa.array(tokens, pa.list_(pa.int64())), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["key", "id", "sig", "digest", "n", "point", "stars", "tokens", "z"])

    keyed = rows.select("id", "text", F.monotonically_increasing_id().alias("key"), F.xxhash64("text").alias("sig"))
    kind = dict(rows.dtypes)["id"]
    out = scratch.store(keyed.mapInArrow(run, f"key bigint, id {kind}, sig bigint, digest binary, n bigint, point binary, stars array<bigint>, tokens array<bigint>, z binary"))
    rank.destroy()
    return out


def _bounded(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, n_a, n_b, point_a, point_b) the pairs (a, b) whose bound reaches what is needed."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, GROUPS) for k in (4, 5))
            s, t = (batch.column(k).to_numpy() for k in (2, 3))
            keep = (bound(x, y) >= needed(s, t, percent)) & (100 * np.minimum(s, t) >= percent * np.maximum(s, t))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], ["a", "b"])

    return pairs.select("a", "b", "n_a", "n_b", "point_a", "point_b").mapInArrow(run, "a bigint, b bigint").distinct()


def verify(pairs: DataFrame, table: DataFrame, percent: int, n: int, scratch: Scratch) -> DataFrame:
    """Of the pairs (a, b) of keys those whose sets reach the threshold, compared on the whole texts.

    The keys that the pairs have come first; only their texts are read from the table and shuffled.
    """
    keys = scratch.store(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    wanted = scratch.store(table.select("key", "z").join(small(keys), "key", "left_semi"))
    first = pairs.join(wanted.select(F.col("key").alias("a"), F.col("z").alias("z_a")), "a")
    both = first.join(wanted.select(F.col("key").alias("b"), F.col("z").alias("z_b")), "b").select("a", "b", "z_a", "z_b")

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        known: dict[bytes, np.ndarray] = {}

        def tokens(z: bytes) -> np.ndarray:
            found = known.get(z)
            if found is None:
                if len(known) >= 256:
                    known.clear()
                text = np.frombuffer(unpack(z), np.uint8)
                found = known[z] = shingle_sets(text, np.array([0, len(text)]), n)[0]
            return found

        for batch in slices(batches, 2):
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                s, t = tokens(x), tokens(y)
                common = len(np.intersect1d(s, t, assume_unique=True))
                keep[k] = common and 100 * common >= percent * (len(s) + len(t) - common)
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], ["a", "b"])

    return scratch.store(both.mapInArrow(run, "a bigint, b bigint"))


def boxes(tiled: DataFrame) -> DataFrame:
    """Rows (token, tile, class, top, low, high, x, y): largest group counts, least and largest set size and component of each tile."""

    def run(batches):
        open_key, held = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, tile, size_class, comp, size = (batch.column(k).to_numpy() for k in range(5))
            points = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(-1, GROUPS)
            cuts = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (tile[1:] != tile[:-1])])
            found = [np.maximum.reduceat(points, cuts, 0), np.minimum.reduceat(size, cuts), np.maximum.reduceat(size, cuts), np.minimum.reduceat(comp, cuts), np.maximum.reduceat(comp, cuts)]
            keys = list(zip(token[cuts].tolist(), tile[cuts].tolist(), size_class[cuts].tolist()))
            rows = [list(x) for x in zip(found[0], *(x.tolist() for x in found[1:]))]
            if held and keys[0] == open_key:  # the tile goes on from the batch before
                (top, low, high, x, y), r = held, rows[0]
                rows[0] = [np.maximum(top, r[0]), min(low, r[1]), max(high, r[2]), min(x, r[3]), max(y, r[4])]
            elif held:
                keys, rows = [open_key, *keys], [held, *rows]
            open_key, held = keys[-1], rows[-1]
            yield as_batch(keys[:-1], rows[:-1])
        if held:
            yield as_batch([open_key], [held])

    def as_batch(keys, rows):
        columns = [pa.array([k[c] for k in keys], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int32()))]
        columns += [pa.array([r[0].tobytes() for r in rows], pa.binary())] + [pa.array([r[c] for r in rows], pa.int64()) for c in range(1, 5)]
        return pa.RecordBatch.from_arrays(columns, ["token", "tile", "class", "top", "low", "high", "x", "y"])

    rows = tiled.select("token", "tile", "class", "component", "n", "point")
    return rows.repartition("token", "tile").sortWithinPartitions("token", "tile").mapInArrow(run, "token bigint, tile bigint, class int, top binary, low bigint, high bigint, x bigint, y bigint")


def meeting(tiles: DataFrame, percent: int) -> DataFrame:
    """Rows (token, tile, tile2): the tiles of a block (tile <= tile2) whose boxes can hold a pair of different components."""
    u, v = tiles.alias("u"), tiles.alias("v")
    near = (F.col("u.token") == F.col("v.token")) & (F.abs(F.col("u.class") - F.col("v.class")) <= 1) & (F.col("u.tile") <= F.col("v.tile"))
    several = (F.least("u.x", "v.x") < F.greatest("u.y", "v.y")) & (100 * F.least("u.high", "v.high") >= percent * F.greatest("u.low", "v.low"))
    both = u.join(v, near & several).select("u.token", "u.tile", F.col("v.tile").alias("tile2"), "u.low", F.col("v.low").alias("low2"), "u.top", F.col("v.top").alias("top2"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            top, top2 = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, GROUPS) for k in (5, 6))
            low, low2 = (batch.column(k).to_numpy() for k in (3, 4))
            keep = pa.array(bound(top, top2) >= needed(low, low2, percent))
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(keep) for k in range(3)], ["token", "tile", "tile2"])

    return both.mapInArrow(run, "token bigint, tile bigint, tile2 bigint")


def large_blocks(rows: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Rows (token, pair, key, component, n, point): the members of large blocks, once for each pair of tiles that has to be searched.

    Sets of a pair differ in size by the threshold at most, so a tile holds sets of one class of sizes and meets those of
    that class and its neighbours; within a class sets of equal min-hash are in the same tile, unless it would be too large.
    """
    size_class = F.floor(F.log("n") / math.log(100 / percent)).cast("int")
    rows = rows.withColumn("class", size_class)
    counts = rows.groupBy("token", "class").agg(F.count("*").alias("m_class"))
    rows = rows.join(counts, ["token", "class"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("star"), F.ceil(F.col("m_class") / TILE)).cast("int")).drop("m_class", "star")
    parts = rows.groupBy("token", "class", "part").agg(F.count("*").alias("m_part"))
    rows = rows.join(parts, ["token", "class", "part"])
    slot = F.pmod(F.xxhash64("key"), F.ceil(F.col("m_part") / TILE)).cast("int")
    tiled = scratch.store(rows.select("token", F.xxhash64("class", "part", slot).alias("tile"), "class", "key", "component", "n", "point"))
    pairs = scratch.store(meeting(scratch.store(boxes(tiled)), percent))
    members = tiled.select("token", "tile", "key", "component", "n", "point")
    own = members.join(pairs, ["token", "tile"])
    others = members.withColumnRenamed("tile", "tile2").join(pairs.where("tile <> tile2"), ["token", "tile2"])
    columns = ["token", F.xxhash64("tile", "tile2").alias("pair"), "key", "component", "n", "point"]
    return own.select(columns).unionByName(others.select(columns))


def _groups(batches, n_key: int):
    """Rows of sorted batches as (key, rows): those that agree in the first n_key columns, which come together."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[:n_key] != key:
                if held:
                    yield key, held
                key, held = row[:n_key], []
            held.append(row[n_key:])
    if held:
        yield key, held


def _block_pairs(members: DataFrame, percent: int) -> DataFrame:
    """Rows (a, b, deal): pairs of different components that some block's R-trees let through, or a dense deal without its pairs.

    Rows of one (block, tile pair) are sorted together and searched as they stream by; no more than two tiles of a block
    are held at once. Near copies share most of their blocks; as such blocks are dealt together, a pair of theirs is told once.
    A deal that has more pairs than sets (and DENSE) is told as one row and left to _dense_links.
    """

    def search(rows):
        rows = list({r[0]: r for r in rows}.values())
        comp = np.array([r[1] for r in rows])
        if len(rows) < 2 or (comp == comp[0]).all():
            return
        keys, sizes = np.array([r[0] for r in rows]), np.array([r[2] for r in rows])
        points = np.frombuffer(b"".join([r[3] for r in rows]), np.uint8).reshape(-1, GROUPS)
        for x, y in RTree(points, sizes, comp).pairs(percent):
            yield zip(np.minimum(keys[x], keys[y]).tolist(), np.maximum(keys[x], keys[y]).tolist())

    def run(batches):
        out, deal, sets, seen, dense = [], None, set(), set(), False
        for (of, _, _), rows in _groups(batches, 3):
            if of != deal:
                out += [(None, None, deal)] if dense else [(*p, None) for p in seen]
                deal, sets, seen, dense = of, set(), set(), False
                if len(out) > 4096:
                    yield as_batch(out)
                    out = []
            sets.update(r[0] for r in rows)
            for found in () if dense else search(rows):
                seen.update(found)
                if dense := len(seen) > DENSE + len(sets):
                    break
        out += [(None, None, deal)] if dense else [(*p, None) for p in seen]
        if out:
            yield as_batch(out)

    def as_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["a", "b", "deal"])

    rows = members.select("deal", "token", "pair", "key", "component", "n", "point")
    return rows.repartition("deal").sortWithinPartitions("deal", "token", "pair").mapInArrow(run, "a bigint, b bigint, deal bigint").distinct()


def _dense_links(members: DataFrame, table: DataFrame, percent: int, n: int, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join the components of the sets of each deal, compared on the whole texts.

    Each text of a deal comes once, before its blocks. A pair is compared as it is found, and what is linked by then is one
    component, so its pairs are left out: a deal tells fewer links than it has sets. SEEN pairs that don't link are remembered.
    """
    blocks = scratch.store(members.select("deal", "token", "pair", "key", "component"))
    wanted = blocks.select("deal", "key").distinct().join(table.select("key", "z"), "key")
    none = lambda kind: F.lit(None).cast(kind)
    first = wanted.select("deal", none("bigint").alias("token"), none("bigint").alias("pair"), "key", none("bigint").alias("component"), "z")
    rows = first.unionByName(blocks.withColumn("z", none("binary")))

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        out, deal, packed, known, parent, apart = [], None, {}, {}, {}, set()

        def tokens(key):
            found = known.get(key)
            if found is None:
                if len(known) >= 2 * TILE:
                    known.clear()
                text = np.frombuffer(unpack(packed[key]), np.uint8)
                found = known[key] = shingle_sets(text, np.array([0, len(text)]), n)[0]
            return found

        def root(c):
            while (up := parent.get(c, c)) != c:
                parent[c] = c = parent.get(up, up)
            return c

        def links(at):
            keys = list(at)
            comp, of = np.array([root(c) for c in at.values()]), list(at.values())
            if len(keys) < 2 or (comp == comp[0]).all():
                return
            sets = [tokens(k) for k in keys]
            sizes, points = np.array([len(s) for s in sets]), np.stack([point(s) for s in sets])
            for x, y in RTree(points, sizes, comp).pairs(percent):
                for i, j in zip(x.tolist(), y.tolist()):
                    u, v = root(of[i]), root(of[j])
                    pair = (min(keys[i], keys[j]), max(keys[i], keys[j]))
                    if u == v or pair in apart:
                        continue
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if common and 100 * common >= percent * (sizes[i] + sizes[j] - common):
                        parent[max(u, v)] = min(u, v)
                        yield pair
                    elif len(apart) < SEEN:
                        apart.add(pair)

        for (of, token, _), rows in _groups((b for batch in batches for b in slices([batch], 5)), 3):
            if of != deal:
                deal, packed, known, parent, apart = of, {}, {}, {}, set()
            if token is None:
                packed.update((r[0], r[2]) for r in rows)
            else:
                out += links({r[0]: r[1] for r in rows})
            if len(out) > 4096:
                yield as_batch(out)
                out = []
        if out:
            yield as_batch(out)

    def as_batch(pairs):
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    return scratch.store(rows.repartition("deal").sortWithinPartitions("deal", F.col("token").asc_nulls_first(), "pair").mapInArrow(run, "a bigint, b bigint"))


def join(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every row: id column, n_shingles, component_id (the least id that its links reach, itself included).

    Documents link when 100 * |common| >= percent * |union| of their sets. Null texts, empty ones and ones without words
    have an empty set and link with nothing. Repeated rows are one class. Equal ids with different texts count as linked.
    A row of null id is a class of its own: it links with nothing and its component_id is null. Ids of any type that has an
    order will do. Very long texts are whole sets like others; other columns are not read; an empty table gives an empty result.
    """
    return classes(docs, percent, n, id_col, text_col).drop("first", "sig")


def classes(docs: DataFrame, percent: int = 80, n: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As join, with ``first``, a number that rows of equal sets share (null for empty sets and null ids), and ``sig``, the
    xxhash64 of the text. A stored table."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        table = points_table(rows, token_counts(rows, n), percent, n, scratch)
        # One row stands for each set: that of least key. Only repeated sets are stored and joined; as the stored table is a
        # side of its own, the join can split the rows of a set that very many documents have.
        told = table.where("n > 0 and id is not null")
        repeated = scratch.store(told.groupBy("digest").agg(F.min("id").alias("rep"), F.min("key").alias("first"), F.count("*").alias("m")).where("m > 1").select("digest", "rep", "first"))
        members = told.select("key", "id", "digest").join(repeated, "digest", "left")
        members = scratch.store(members.select("key", "id", F.coalesce("rep", "id").alias("rep"), F.coalesce("first", "key").alias("first")))
        own = members.where("key = first").select("key")
        # Stars: each set against the first of its min-hash blocks.
        heads = scratch.store(table.select("key", "stars").join(own, "key", "left_semi").select("key", F.explode(F.array_distinct("stars")).alias("star")))
        first = heads.groupBy("star").agg(F.min("key").alias("b"), F.count("*").alias("m")).where("m > 1").select("star", "b")
        pairs = heads.join(first, "star").where("key <> b").select(F.col("key").alias("a"), "b").distinct()
        # The points are a stored side of their own, so that a join can split the pairs of a star's head, however many there are.
        points = table.select("key", "n", "point")

        def checked(pairs: DataFrame) -> DataFrame:
            pairs = pairs.join(points.select(F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("point").alias("point_a")), "a")
            pairs = pairs.join(points.select(F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("point").alias("point_b")), "b")
            return verify(scratch.store(_bounded(pairs, percent)), table, percent, n, scratch)

        def labelled() -> DataFrame:
            linked = components(star_links, scratch=scratch).withColumnRenamed("id", "key")
            return own.join(linked, "key", "left").select("key", F.coalesce("component", "key").alias("component"))

        star_links = checked(pairs)
        known = scratch.store(labelled())
        for k in range(ROUNDS):
            mine = heads.join(known, "key")
            other = mine.groupBy("star").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), F.col("key").alias("b"), F.col("component").alias("of"))).alias("head"))
            other = other.where("x < y").select("star", "head.b", "head.of")
            star_links = star_links.unionByName(checked(mine.join(other, "star").where("component <> of").select(F.col("key").alias("a"), "b").distinct()))
            known = scratch.store(labelled())
        # Blocks by prefix token; those of one component only are done.
        held = scratch.store(table.select("key", "tokens").join(known, "key"))
        entries = held.select("key", "component", F.explode("tokens").alias("token"))
        blocks = entries.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x < y").select("token", "m", "x")
        entries = scratch.store(entries.join(blocks, "token"))
        # Blocks of one least component are searched together, unless they are too many members.
        heavy = entries.where(F.col("m") <= TILE).groupBy("x").agg(F.count("*").alias("w")).where(F.col("w") > DEALT)
        usual = entries.where(F.col("m") <= TILE).join(small(heavy), "x", "left")
        part = F.when(F.col("w").isNotNull(), F.pmod(F.xxhash64("token"), F.ceil(F.col("w") / DEALT))).otherwise(0)
        usual = usual.select(F.xxhash64("x", part).alias("deal"), "token", F.lit(0).cast("bigint").alias("pair"), "key", "component").join(points, "key")
        many = entries.where(F.col("m") > TILE).select("token", "key", "component").join(table.select("key", "n", "point", F.get("stars", F.lit(0)).alias("star")), "key")
        columns = ["token", "pair", "key", "component", "n", "point"]
        blocked = usual.select("deal", *columns)
        if not many.isEmpty():
            # Tiles are named alike in all blocks, so near copies meet in one deal whatever token they share.
            tiled = scratch.store(large_blocks(many, percent, scratch))
            heavy = tiled.groupBy("pair").agg(F.count("*").alias("w")).where(F.col("w") > DEALT)
            tiled = tiled.join(small(heavy), "pair", "left")
            blocked = blocked.unionByName(tiled.select(F.xxhash64("pair", F.when(F.col("w").isNotNull(), F.pmod(F.xxhash64("token"), F.ceil(F.col("w") / DEALT))).otherwise(0), F.lit(1)).alias("deal"), *columns))
        candidates = scratch.store(_block_pairs(blocked, percent))
        block_links = verify(candidates.where("deal is null").select("a", "b"), table, percent, n, scratch)
        dense = candidates.where("deal is not null").select("deal")
        if not dense.isEmpty():
            block_links = block_links.unionByName(_dense_links(blocked.join(small(dense), "deal", "left_semi"), table, percent, n, scratch))
        # All sets of an id hang together.
        several = members.groupBy("id").agg(F.min("first").alias("b"), F.max("first").alias("last")).where("b < last").select("id", "b")
        same_id = members.join(several, "id").where("first <> b").select(F.col("first").alias("a"), "b").distinct()
        final = components(star_links.unionByName(block_links).unionByName(same_id), scratch=scratch)
        # The least id of each component, for the sets that are linked; the others have that of their own class.
        reps = members.where("key = first").select(F.col("first").alias("id"), "rep")
        labelled = final.join(reps, "id")
        least = labelled.groupBy("component").agg(F.min("rep").alias("label"))
        labels = scratch.store(labelled.join(least, "component").select(F.col("id").alias("first"), "label"))
        known = members.join(labels, "first", "left").select("key", "first", F.coalesce("label", "rep").alias("component_id"))
        out = table.select("key", "id", "sig", F.col("n").alias("n_shingles")).join(known, "key", "left")
        component = F.coalesce("component_id", "id")
        return Scratch(docs.sparkSession).store(out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), "first", "sig"), keep=True)
