"""Near-duplicate embeddings by cross-polytope hashing, verified by exact cosines.

Equal vectors are one class, a row with its number of copies. A class's vector is turned by fast
pseudo-random rotations (three rounds of random signs and a Hadamard transform) and hashed to the
nearest signed axis; HASHES of them make a bucket. A table is one such hash: a class resides in its
own bucket of each table and visits PROBES - 1 more, those with the next largest coordinates, so a
pair meets where one visits the other's bucket. How many hashes make a bucket follows from the
number of classes (about CROWD residents a bucket), and how many tables are needed from the share
of pairs at the limit that meet in a table, measured on random pairs of that cosine: a linked pair
is missed with a probability of at most MISS at any size.

Residents of a bucket above BLOCK are cut in blocks, each of which every visitor of the bucket
visits. Blocks stream through a task in the order of their keys: residents are held, visitors pass
in batches, and a matrix product finds the links. No pair leaves a block: a visitor or resident
leaves with the number of its links there and one edge, to a linked resident or to the root of those
that are joined in the block. A pair that meets in several tables or buckets counts in the first,
which a block finds out by hashing the linked vectors again.

The dot products of a dense cloud of different vectors grow with its square, as their links do;
rows, shuffles and memory don't, but for a visitor's copies, one a block.

Defined results: one row a vec_id; repeated rows of an id are one vector, the smallest component by
component; vectors that are null, empty, zero or hold null or non-finite components link with
nothing, nor do those of unequal length with one another; a null vec_id takes no part (one row, no
links, a null component, kept); components go to the smallest vec_id; other columns, whatever their
names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.near_dup import components
from quillgraph.llm.shared import Scratch

#: Parts that the copies of one vector are dealt in.
SALTS = 64
#: Cosines nearer to the limit than this are computed again pair by pair.
DOUBT = 1e-9
#: Visitors that meet a block's residents at once.
CHUNK = 256


@dataclass(frozen=True)
class Polytopes:
    limit: float = 0.95
    probes: int = 4
    miss: float = 1e-6
    crowd: int = 1000
    block: int = 2000
    seed: int = 5


def power_scaled(v: np.ndarray) -> np.ndarray:
    """Rows times a power of two, so that squares neither overflow nor vanish; exact."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def hadamard(x: np.ndarray) -> np.ndarray:
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, -1, 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2)
        h *= 2
    return x.reshape(n, d)


class Hasher:
    """Buckets of vectors of one length, out of `classes` different ones."""

    def __init__(self, settings: Polytopes, dim: int, classes: int):
        self.s, self.d = settings, max(2, 1 << (int(dim) - 1).bit_length())
        self.hashes = 1
        while classes / (2 * self.d) ** self.hashes > settings.crowd and (2 * self.d) ** (self.hashes + 1) < 1 << 62:
            self.hashes += 1
        self.signs: dict[int, np.ndarray] = {}
        self.tables = self._tables_needed()

    def visits(self, v: np.ndarray, table: int) -> np.ndarray:
        """[rows, probes] of buckets, a row's own first. Row by row the same whatever rows are beside it."""
        if table not in self.signs:
            self.signs[table] = np.random.default_rng((self.s.seed, self.d, table)).choice((-1.0, 1.0), (self.hashes, 3, self.d))
        x = np.zeros((len(v), self.d))
        x[:, : v.shape[1]] = v
        keys, away = np.zeros((len(v), 1), np.int64), np.zeros((len(v), 1))
        for signs in self.signs[table]:
            y = x
            for s in signs:
                y = hadamard(y * s)
            top = np.argsort(-np.abs(y), 1, kind="stable")[:, : self.s.probes]
            value = np.take_along_axis(y, top, 1)
            axis = 2 * top + (value < 0)
            gap = (np.abs(value[:, :1]) - np.abs(value)) ** 2
            keys = (keys[:, :, None] * (2 * self.d) + axis[:, None, :]).reshape(len(v), -1)
            away = (away[:, :, None] + gap[:, None, :]).reshape(len(v), -1)
            near = np.argsort(away, 1, kind="stable")[:, : self.s.probes]
            keys, away = np.take_along_axis(keys, near, 1), np.take_along_axis(away, near, 1)
        return keys

    def _tables_needed(self) -> int:
        """From the share of random pairs at the limit that meet in a table, less two standard errors."""
        n = max(512, min(8192, (1 << 22) // self.d))
        rng = np.random.default_rng(self.s.seed)
        a, b = rng.standard_normal((2, n, self.d))
        a /= np.linalg.norm(a, axis=1, keepdims=True)
        b -= (a * b).sum(1, keepdims=True) * a
        b *= math.sqrt(1 - self.s.limit**2) / np.linalg.norm(b, axis=1, keepdims=True)
        x, y = self.visits(a, 1 << 30), self.visits(self.s.limit * a + b, 1 << 30)
        met = (meets(x, y[:, 0]) | meets(y, x[:, 0])).mean()
        met = min(max(met - 2 * math.sqrt(met * (1 - met) / n), 1e-3), 0.999)
        return math.ceil(math.log(self.s.miss) / math.log(1 - met))


@lru_cache(8)
def hasher(settings: Polytopes, dim: int, classes: int) -> Hasher:
    return Hasher(settings, dim, classes)


def meets(visits: np.ndarray, own: np.ndarray) -> np.ndarray:
    return (visits == own[:, None]).any(1)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row."""
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


class Block:
    """Residents of a block and those that visit them; rows are (id, copies, vector)."""

    def __init__(self, key: tuple, settings: Polytopes, classes: int):
        self.table, self.hasher, self.limit = key[1], hasher(settings, key[0], classes), settings.limit
        self.held: list[tuple] = []
        self.ids: np.ndarray | None = None

    def seal(self) -> None:
        """From here on no more residents come; they meet one another."""
        if not self.held:
            self.ids = np.empty(0, np.int64)
            return
        self.ids, self.copies, self.v = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.unit = self.v / np.linalg.norm(self.v, axis=1, keepdims=True)
        self.count = np.zeros(len(self.ids), np.int64)
        self.parent = list(range(len(self.ids)))
        self.joined = np.zeros(len(self.ids), bool)
        for a in range(0, len(self.ids), CHUNK):
            self._meet(self.ids[a : a + CHUNK], self.copies[a : a + CHUNK], self.v[a : a + CHUNK], np.arange(a, min(a + CHUNK, len(self.ids))))

    def visited(self, ids: np.ndarray, copies: np.ndarray, v: np.ndarray) -> list[tuple]:
        """(ids, numbers of links, linked residents' ids) of visitors with a link."""
        out = []
        for a in range(0, len(ids) if len(self.ids) else 0, CHUNK):
            got = self._meet(ids[a : a + CHUNK], copies[a : a + CHUNK], v[a : a + CHUNK], None)
            if got:
                out.append(got)
        return out

    def closed(self) -> list[tuple]:
        """The same of the residents, each with its root."""
        at = np.flatnonzero(self.joined) if len(self.ids) else []
        return [(self.ids[at], self.count[at], self.ids[[self._root(i) for i in at]])] if len(at) else []

    def _root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def _meet(self, ids: np.ndarray, copies: np.ndarray, v: np.ndarray, own: np.ndarray | None) -> tuple | None:
        s = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ self.unit.T
        r, c = np.nonzero(s >= self.limit - DOUBT)
        near = np.abs(s[r, c] - self.limit) <= DOUBT
        sure = (ids[r] != self.ids[c]) & ~near
        sure[near] = (ids[r[near]] != self.ids[c[near]]) & (cosines(v[r[near]], self.v[c[near]]) >= self.limit)
        r, c = r[sure], c[sure]
        if not len(r):
            return None
        at, begin = np.unique(r, return_index=True)
        self._join(np.repeat(c[begin], np.diff(begin, append=len(r))), c)  # all that a row is linked with
        first = self._counted_here(ids, v, r, c)
        links = np.bincount(r[first], self.copies[c[first]], len(ids)).astype(np.int64)
        self.count += np.bincount(c[first], copies[r[first]], len(self.ids)).astype(np.int64)
        self.joined[c] = True
        if own is None:
            return ids[at], links[at], self.ids[c[begin]]
        self._join(own[at], c[begin])
        self.count[own] += links
        self.joined[own[at]] = True
        return None

    def _join(self, a: np.ndarray, b: np.ndarray) -> None:
        pairs = np.unique(a * len(self.ids) + b)
        for x, y in zip((pairs // len(self.ids)).tolist(), (pairs % len(self.ids)).tolist(), strict=True):
            x, y = sorted((self._root(x), self._root(y)))
            self.parent[y] = x

    def _counted_here(self, ids: np.ndarray, v: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Which pairs (r, c) meet here first: in no earlier table, and where both visit one another in
        this one, in the bucket of the larger id."""
        rows, r = np.unique(r, return_inverse=True)
        columns, c = np.unique(c, return_inverse=True)
        first = np.ones(len(r), bool)
        for t in range(self.table + 1):
            x, y = self.hasher.visits(v[rows], t), self.hasher.visits(self.v[columns], t)
            back = meets(y[c], x[r, 0])
            first &= ~back | (ids[rows][r] < self.ids[columns][c]) if t == self.table else ~(back | meets(x[r], y[c, 0]))
        return first


_PLACED = "dim int, table int, bucket long, own boolean, id long, copies long, v "


def _columns(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return rows["id"].to_numpy(), rows["copies"].to_numpy(), power_scaled(np.array(rows["v"].tolist(), float))


def links(classes: DataFrame, n: int, settings: Polytopes, scratch: Scratch) -> DataFrame:
    """(id, n, root): numbers of links and an edge for each block in which a class has links. classes: (id, copies, v)."""
    kind = classes.schema["v"].dataType.simpleString()

    def by_length(b: pd.DataFrame) -> Iterator[tuple[int, pd.DataFrame]]:
        return b.groupby(b["v"].map(len), sort=False) if len(b) else iter(())

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in by_length(b):
                h, v = hasher(settings, dim, n), _columns(part)[2]
                for t in range(h.tables):
                    bucket, size = np.unique(h.visits(v, t)[:, 0], return_counts=True)
                    yield pd.DataFrame({"dim": np.int32(dim), "table": np.int32(t), "bucket": bucket, "size": size})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in by_length(b):
                h, v = hasher(settings, dim, n), _columns(part)[2]
                for t in range(h.tables):
                    keys = h.visits(v, t)
                    for p in range(keys.shape[1]):
                        yield pd.DataFrame({"dim": np.int32(dim), "table": np.int32(t), "bucket": keys[:, p], "own": p == 0, "id": part["id"], "copies": part["copies"], "v": part["v"]})

    sizes = classes.mapInPandas(own, "dim int, table int, bucket long, size long").groupBy("dim", "table", "bucket").agg(F.sum("size").alias("size"))
    crowded = scratch.write(sizes.filter(F.col("size") > settings.block).select("dim", "table", "bucket", F.ceil(F.col("size") / settings.block).cast("int").alias("blocks")), "crowded")
    placed = classes.mapInPandas(place, _PLACED + kind).join(crowded, ["dim", "table", "bucket"], "left")
    blocks = F.coalesce("blocks", F.lit(1))
    placed = placed.withColumn("mine", F.pmod(F.xxhash64("id"), blocks)).withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.select("dim", "table", "bucket", "block", (F.col("own") & (F.col("mine") == F.col("block"))).alias("resident"), "id", "copies", "v")
    keys = ["dim", "table", "bucket", "block"]
    placed = placed.repartition(*keys).sortWithinPartitions(*keys, F.desc("resident"), "id")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, now = None, None
        for b in batches:
            out: list[tuple] = []
            fresh = (b[keys] != b[keys].shift()).any(axis=1).to_numpy() | (b["resident"] != b["resident"].shift()).to_numpy()
            ids, copies, v = b["id"].to_numpy(), b["copies"].to_numpy(), b["v"]
            starts = np.flatnonzero(fresh).tolist()
            for a, z in zip(starts, [*starts[1:], len(b)]):
                key, resident = tuple(b[keys].iloc[a]), b["resident"].iloc[a]
                if key != now:
                    out += _close(block)
                    block, now = Block(key, settings, n), key
                if not resident and block.ids is None:
                    block.seal()
                if resident or len(block.ids):
                    rows = ids[a:z], copies[a:z], power_scaled(np.array(v.iloc[a:z].tolist(), float))
                    if resident:
                        block.held.append(rows)
                    else:
                        out += block.visited(*rows)
            if out:
                yield _rows(out)
        if last := _close(block):
            yield _rows(last)

    return placed.mapInPandas(work, "id long, n long, root long")


def _close(block: Block | None) -> list[tuple]:
    if block is None:
        return []
    if block.ids is None:
        block.seal()
    return block.closed()


def _rows(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("id", "n", "root"), (np.concatenate(x) for x in zip(*found, strict=True)), strict=True)))


def near_duplicates(vectors: DataFrame, settings: Polytopes | None = None, vector: str = "embedding") -> DataFrame:
    """vectors (vec_id, embedding) as vec_id, n_links, component_id, kept."""
    settings = settings or Polytopes()
    scratch = Scratch(vectors.sparkSession, "embedding-dup")
    element = vectors.schema[vector].dataType.elementType.simpleString()
    v = F.col(vector) if element in ("float", "double") else F.col(vector).cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    one = vectors.select(F.col("vec_id").cast("long"), F.when(good, v).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")
    all_ = scratch.write(one.select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"), salt), "vectors")

    copies = all_.filter("v is not null").groupBy("h", "g", "salt").agg(F.min("vec_id").alias("low"), F.count("*").alias("n"), F.min_by("v", "vec_id").alias("v"))
    copies = scratch.write(copies, "copies")
    classes = scratch.write(copies.groupBy("h", "g").agg(F.min("low").alias("id"), F.sum("n").alias("copies"), F.min_by("v", "low").alias("v")), "classes")
    found = scratch.write(links(classes.select("id", "copies", "v"), classes.count(), settings, scratch), "found")
    totals = found.groupBy("id").agg(F.sum("n").alias("n"))
    joined = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")), scratch, "components")

    known = classes.select("h", "g", "id", "copies").join(totals, "id", "left").join(joined, F.col("id") == F.col("node"), "left")
    known = known.select("h", "g", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    known = copies.select("h", "g", "salt").join(known, ["h", "g"])  # at most SALTS rows for a vector's copies
    part = [F.when(F.col("v").isNotNull(), F.col(x)).alias(x) for x in ("h", "g", "salt")]
    out = all_.select("vec_id", *part).join(known, ["h", "g", "salt"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
