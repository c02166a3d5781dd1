"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are hashed in TABLES tables by HASHES projections onto normal directions, floor((a.v+b)/w).
A query visits its own bucket and then buckets at perturbed hashes, in ascending order of the
summed squared distances to the crossed bucket edges, which estimates where neighbours are most
likely. Candidates of all tables are merged and ranked by the exact inner product.

Vectors and queries are hashed by direction, so norms of any spread share the same cells; the
ranking is by the inner product itself. A query that meets fewer than k others is scored against
all vectors.

The bucket width follows from a bounded sample (SAMPLE vectors). The number of projections is a
parameter or grows with the number of vectors. Buckets above BLOCK vectors are cut in
blocks, each of which gets the bucket's probes; nothing is left out. Scores are made block by
block, a block's vectors against its queries: a matrix product leaves out what can't be among a
query's k best, the rest is scored exactly, and the k best by (score, vec_id) leave the block.

Defined results: vectors that are null, zero or hold null or non-finite components take no part,
nor do those of another length than the most frequent one (the shorter, if several are); a vec_id
is one vector, the smallest, component by component, of repeated rows; equal scores go to the
smaller vec_id; fewer candidates than asked for give all of them; a null vec_id takes no part;
other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.shared import Scratch

SAMPLE = 2000


@dataclass(frozen=True)
class Probing:
    tables: int = 3
    probes: int = 24
    #: Projections a table; None: as many as make a bucket hold about `bucket` vectors.
    hashes: int | None = None
    bucket: int = 2000
    block: int = 4000
    seed: int = 11
    #: Width of a hash cell, in standard deviations of a projection over the sample.
    width: float = 2.0


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part, one for each id."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(good).select(F.col("vec_id").cast("long"), v.alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def of_one_length(vectors: DataFrame) -> DataFrame:
    most = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return vectors.filter(F.size("v") == most["n"]) if most else vectors


class Hasher:
    def __init__(self, probing: Probing, dim: int, hashes: int, width: np.ndarray):
        rng = np.random.default_rng(probing.seed)
        self.p, self.hashes, self.width = probing, hashes, width
        self.a = rng.standard_normal((probing.tables, hashes, dim))
        self.b = rng.random((probing.tables, hashes))
        self.mult = rng.integers(1, 1 << 62, hashes, dtype=np.int64) * 2 + 1

    def points(self, v: np.ndarray) -> np.ndarray:
        x = v / np.abs(v).max(1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def places(self, x: np.ndarray, table: int) -> np.ndarray:
        return x @ self.a[table].T / self.width + self.b[table]

    def buckets(self, cells: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (cells.astype(np.int64) * self.mult).sum(-1)

    def probes(self, x: np.ndarray, table: int) -> np.ndarray:
        """[queries, probes] of buckets, the likeliest first. Perturbation sets are drawn from each
        query's own edge distances, smallest sums first."""
        place = self.places(x, table)
        cell = np.floor(place)
        low = place - cell  # distance to the lower edge; to the upper one 1 - low
        edge = np.concatenate([low, 1 - low], 1) ** 2
        m = edge.shape[1]
        order = np.argsort(edge, 1)
        rank_sets = _template(self.hashes, self.p.probes * 4)
        sorted_edge = np.take_along_axis(edge, order, 1)
        score = np.stack([sorted_edge[:, list(s)].sum(1) if s else np.zeros(len(x)) for s in rank_sets], 1)
        delta = np.zeros((len(x), len(rank_sets), self.hashes), np.int64)
        valid = np.ones((len(x), len(rank_sets)), bool)
        r = np.arange(len(x))
        for j, s in enumerate(rank_sets):
            for k in s:
                which = order[:, k]
                h, sign = which % self.hashes, np.where(which < self.hashes, -1, 1)
                valid[:, j] &= delta[r, j, h] == 0  # no cell crosses both its edges
                delta[r, j, h] += sign
        assert m == 2 * self.hashes
        score = np.where(valid, score, np.inf)
        best = np.argsort(score, 1, kind="stable")[:, : self.p.probes]
        keys = self.buckets(cell[:, None, :] + np.take_along_axis(delta, best[:, :, None], 1))
        return np.where(np.isfinite(np.take_along_axis(score, best, 1)), keys, keys[:, :1])


def _template(hashes: int, count: int) -> list[tuple[int, ...]]:
    """Sets of edge ranks in ascending order of their expected summed squared distances."""
    import heapq

    m = 2 * hashes
    j = np.arange(1, m + 1)
    z = np.where(j <= hashes, j * (j + 1) / (4 * (hashes + 1) * (hashes + 2)), 1 - (2 * hashes + 1 - j) / (hashes + 1) + (2 * hashes + 1 - j) * (2 * hashes + 2 - j) / (4 * (hashes + 1) * (hashes + 2)))
    out: list[tuple[int, ...]] = [()]
    heap = [(z[0], (0,))]
    while heap and len(out) < count:
        s, x = heapq.heappop(heap)
        if len({min(i, m - 1 - i) for i in x}) == len(x):
            out.append(x)
        last = x[-1]
        if last + 1 < m:
            heapq.heappush(heap, (s - z[last] + z[last + 1], (*x[:-1], last + 1)))
            heapq.heappush(heap, (s + z[last + 1], (*x, last + 1)))
    return out


def fit(vectors: DataFrame, probing: Probing) -> Hasher | None:
    """From the number of vectors and a sample of at most SAMPLE of them by id hash."""
    n = vectors.count()
    if not n:
        return None
    sample = np.array([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()])
    dim = sample.shape[1]
    for hashes in [probing.hashes] if probing.hashes else range(2, 40):
        h = Hasher(probing, dim, hashes, np.ones(1))
        x = h.points(sample)
        width = probing.width * np.mean([(x @ h.a[t].T).std(0).mean() for t in range(probing.tables)])
        h.width = np.array([width if width > 0 else 1.0])  # 0 where all directions are one
        same = 0.0
        for t in range(probing.tables):
            _, counts = np.unique(h.buckets(np.floor(h.places(x, t))), return_counts=True)
            same += (counts * (counts - 1)).sum() / max(1, len(x) * (len(x) - 1)) / probing.tables
        if same * n <= probing.bucket:
            break
    return h


_BEST = "query_id long, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int = 20, probing: Probing | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector for which is_query holds, the k nearest of the others found."""
    probing = probing or Probing()
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    usables = of_one_length(scratch.write(usable(vectors), "vectors"))
    hasher = fit(usables, probing)
    if hasher is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = hasher.points(np.array(b["v"].tolist()))
                for t in range(probing.tables):
                    yield pd.DataFrame({"table": t, "bucket": hasher.buckets(np.floor(hasher.places(x, t))), "vec_id": b["vec_id"], "v": b["v"]})

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                v = np.array(b["v"].tolist())
                x = hasher.points(v)
                for t in range(probing.tables):
                    keys = hasher.probes(x, t)
                    row, col = np.nonzero(_first_of_row(keys))
                    yield pd.DataFrame({"table": t, "bucket": keys[row, col], "query_id": b["vec_id"].to_numpy()[row]})

    placed = usables.mapInPandas(index, "table int, bucket long, vec_id long, v array<double>")
    # a bucket above the block size is cut by id hash; sizes are known before vectors move
    keys = usables.mapInPandas(lambda it: (x.drop(columns="v") for x in index(it)), "table int, bucket long, vec_id long")
    sizes = keys.groupBy("table", "bucket").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(F.col("size") / probing.block).cast("int"))
    sizes = scratch.write(sizes.select("table", "bucket", "blocks"), "sizes")
    placed = placed.join(sizes, ["table", "bucket"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    asked = usables.filter(is_query).mapInPandas(ask, "table int, bucket long, query_id long")
    asked = asked.join(sizes, ["table", "bucket"]).select("table", "bucket", "query_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # the query's vector goes with it
    queries = usables.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    asked = asked.join(queries, "query_id")

    def score(key: tuple, have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if not len(have) or not len(want):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        ids = have["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, v = ids[order], np.array(have["v"].tolist())[order]
        # a matrix product rounds by at most about this; what may be among the k best is scored exactly
        doubt = 8 * v.shape[1] * np.finfo(float).eps * np.linalg.norm(v, axis=1).max()
        out = []
        for a in range(0, len(want), 256):
            part = want.iloc[a : a + 256]
            q, x = part["query_id"].to_numpy(), np.array(part["q"].tolist())
            s = x @ v.T
            other = q[:, None] != ids
            s[~other] = -np.inf
            if k < len(ids):
                other &= s >= (-np.partition(-s, k - 1, 1)[:, k - 1] - doubt * np.linalg.norm(x, axis=1))[:, None]
            r, c = np.nonzero(other)
            exact = _inner(x, v, r, c)
            best = np.lexsort((ids[c], -exact, r))
            r, c, exact = r[best], c[best], exact[best]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pd.DataFrame({"query_id": q[r[first]], "vec_id": ids[c[first]], "score": exact[first]}))
        return pd.concat(out)

    found = placed.groupBy("table", "bucket", "block").cogroup(asked.groupBy("table", "bucket", "block")).applyInPandas(score, _BEST)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    found = scratch.write(found, "found")
    enough = found.groupBy("query_id").count().filter(F.col("count") >= k)
    short = scratch.write(queries.join(enough, "query_id", "left_anti"), "short")
    if not short.isEmpty():
        blocks = usables.count() // probing.block + 1
        all_ = usables.select(F.lit(-1).alias("table"), F.lit(0).cast("long").alias("bucket"), "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
        rest = short.select(F.lit(-1).alias("table"), F.lit(0).cast("long").alias("bucket"), "query_id", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "q")
        rest = all_.groupBy("table", "bucket", "block").cogroup(rest.groupBy("table", "bucket", "block")).applyInPandas(score, _BEST)
        found = found.join(short, "query_id", "left_anti").select("query_id", "vec_id", "score").union(rest)
    wide = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(wide)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _first_of_row(keys: np.ndarray) -> np.ndarray:
    """Marks each value's first place in its row."""
    order = np.argsort(keys, 1, kind="stable")
    s = np.take_along_axis(keys, order, 1)
    fresh = np.concatenate([np.ones((len(keys), 1), bool), s[:, 1:] != s[:, :-1]], 1)
    out = np.zeros(keys.shape, bool)
    np.put_along_axis(out, order, fresh, 1)
    return out


def _inner(x: np.ndarray, v: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of the rows r of x with the rows c of v, added component by component in order, so
    that equal vectors have equal scores in whatever block they meet."""
    out = np.zeros(len(r))
    for j in range(x.shape[1]):
        out += x[r, j] * v[c, j]
    return out
