"""Searching vectors in blocks, and an inverted-file index of described things on disk.

Vectors are dealt into blocks by a hash of their ids, or lie in the lists of an index; a block meets
its queries as matrices, and only each query's best rows leave it, ties to the smaller id. An index
has `lists` centres, fitted on a bounded sample; every row lies in the list of its nearest centre. A
probe reads the lists of the centres nearest to a query and ranks their rows exactly; with all lists
it is an exact search.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.embedding import Embedder, embed
from quillgraph.session import scratch_path

#: Vectors of a block, and queries that meet it at once.
BLOCK, QUERIES = 4000, 500
#: Rows of the sample that a list's centre is fitted on, about.
SAMPLE = 100

#: Likeness of each query (a row of the first matrix) to each vector (a row of the second).
Measure = Callable[[np.ndarray, np.ndarray], np.ndarray]


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """0 where a vector has no direction."""
    size = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(v, axis=1)[None, :]
    return np.divide(q @ v.T, size, out=np.zeros_like(size), where=size > 0)


def nearness(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distance below zero."""
    out = np.empty((len(q), len(v)))
    for i in range(len(q)):
        out[i] = -np.sqrt(((v - q[i]) ** 2).sum(1))
    return out


def _best(measure: Measure, k: int | None, least: float | None, digits: int, query_id: str):
    def meet(have: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        rows = [pd.DataFrame({"qid": want["qid"][:0], "id": have["id"][:0], "score": np.empty(0)})]
        if len(have) and len(want):
            ids, v = have["id"].to_numpy(), np.array(have["v"].tolist(), float)
            place = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
            for a in range(0, len(want), QUERIES):
                part = want.iloc[a : a + QUERIES]
                s = np.round(measure(np.array(part["q"].tolist(), float), v), digits)
                able = np.ones(s.shape, bool) if least is None else s >= least
                if "apart" in part:  # only what is apart from a query counts
                    able &= part["apart"].to_numpy()[:, None] != have["apart"].to_numpy()[None, :]
                if query_id in have:
                    able &= part["qid"].to_numpy()[:, None] != have[query_id].to_numpy()[None, :]
                if k is not None and k < len(ids):
                    kept = np.where(able, s, -np.inf)
                    able &= s >= -np.partition(-kept, k - 1, 1)[:, k - 1 : k]
                r, c = np.nonzero(able)
                order = np.lexsort((place[c], -s[r, c], r))
                r, c = r[order], c[order]
                if k is not None:
                    first = np.arange(len(r)) - np.searchsorted(r, r) < k
                    r, c = r[first], c[first]
                rows.append(pd.DataFrame({"qid": part["qid"].to_numpy()[r], "id": ids[c], "score": s[r, c]}))
        return pd.concat(rows)

    return meet


def _top(found: DataFrame, k: int | None) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return found if k is None else found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int | None = None, least: float | None = None, measure: Measure = cosines, digits: int = 6, not_itself: bool = True) -> DataFrame:
    """(qid, id, score, rank): of vectors (id, v) the k most like each of queries (qid, q), or all (without rank)
    that are at least as like as asked. Where both have a column apart, equal ones don't meet."""
    n = vectors.count() // BLOCK + 1
    apart = ["apart"] if "apart" in vectors.columns and "apart" in queries.columns else []
    have = vectors.select("id", "v", *apart, F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"))
    want = queries.select("qid", "q", *apart, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("block"))
    schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, score double"
    found = have.groupBy("block").cogroup(want.groupBy("block")).applyInPandas(_best(measure, k, least, digits, "id" if not_itself else ""), schema)
    return _top(found, k)


@dataclass(frozen=True)
class Lists:
    lists: int = 64
    probes: int | None = 8
    seed: int = 3


class DescriptionIndex:
    """Descriptions of columns, one entry for each text that isn't empty."""

    FIELDS = ("column_name", "column_description", "value_description")

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder, lists: Lists | None = None):
        self.spark, self.path, self.embedder, self.lists = spark, path.rstrip("/"), embedder, lists or Lists()

    def build(self, descriptions: DataFrame) -> DescriptionIndex:
        """Embeds and lists descriptions (table, column, column_name, column_description, value_description)."""
        texts = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("content")) for f in self.FIELDS])
        docs = descriptions.select("table", "column", F.explode(texts).alias("x")).select("table", "column", "x.*").filter(F.trim("content") != "").distinct()
        entry = F.xxhash64("table", "column", "field", "content")
        at = scratch_path(self.spark, "descriptions")
        embed(docs, self.embedder).withColumn("entry", entry).write.parquet(at)
        made = self.spark.read.parquet(at)
        centres = self._centres(made)
        nearest = _nearest(centres, 1)
        made.withColumn("list", F.element_at(nearest("vector"), 1)).write.partitionBy("list").parquet(f"{self.path}/entries")
        self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>").coalesce(1).write.parquet(f"{self.path}/centres")
        return self

    def _centres(self, made: DataFrame) -> np.ndarray:
        """Fitted on about SAMPLE rows a list, by hash of the entry."""
        n = made.count()
        share = min(1.0, self.lists.lists * SAMPLE / max(1, n))
        some = made.filter(F.pmod(F.xxhash64(F.lit(self.lists.seed), "entry"), F.lit(1 << 20)) < int(share * (1 << 20))).select(array_to_vector("vector").alias("features"))
        if n <= self.lists.lists or some.limit(self.lists.lists + 1).count() <= self.lists.lists:
            return np.array([r["vector"] for r in made.select("vector").orderBy("entry").limit(1).collect()])
        return np.array(KMeans(k=self.lists.lists, seed=self.lists.seed, maxIter=10).fit(some).clusterCenters())

    def probe(self, queries: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
        """(qid, entry, score, rank) of queries (qid, q): the k best, or all (without rank) that are like enough."""
        centres = np.array([r["centre"] for r in self.spark.read.parquet(f"{self.path}/centres").orderBy("list").collect()])  # as many as lists
        asked = queries.withColumn("list", F.explode(_nearest(centres, self.lists.probes or len(centres))("q")))
        entries = self.spark.read.parquet(f"{self.path}/entries").select(F.col("entry").alias("id"), F.col("vector").alias("v"), "list")
        sizes = entries.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))  # a row a list
        have = entries.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("id"), "blocks"))
        again = sizes.select(F.col("list").alias("list"), F.col("blocks").alias("n"))  # both sides come from one table
        want = asked.join(F.broadcast(again), "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        schema = f"qid {queries.schema['qid'].dataType.simpleString()}, id long, score double"
        keys = ("list", "block")
        found = have.groupBy(*keys).cogroup(want.groupBy(*keys)).applyInPandas(_best(cosines, k, least, 6, ""), schema)
        return _top(found, k).withColumnRenamed("id", "entry")

    def similar_columns(self, keywords: DataFrame, k: int | None = 5, least: float | None = None) -> DataFrame:
        """(qid, keyword, table, column, score) of keywords (qid, question, evidence, keyword): each is asked with its
        question and with its evidence, and a column counts with the better of its entries' likenesses to both."""
        texts = F.array(F.concat_ws(" ", "question", "keyword"), F.concat_ws(" ", "evidence", "keyword"))
        asked = keywords.select("qid", "keyword", F.explode(F.array_distinct(texts)).alias("content"))
        at = scratch_path(self.spark, "asked")
        embed(asked.select("content").distinct(), self.embedder).write.parquet(at)
        hits = self.probe(self.spark.read.parquet(at).select(F.col("content").alias("qid"), F.col("vector").alias("q")), k, least)
        named = hits.join(self.spark.read.parquet(f"{self.path}/entries").select("entry", "table", "column"), "entry")
        wide = named.withColumnRenamed("qid", "content").join(asked, "content")
        return wide.groupBy("qid", "keyword", "table", "column").agg(F.max("score").alias("score"))


def _nearest(centres: np.ndarray, most: int):
    """A column function: the lists of a vector's nearest centres, the nearest first."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            if not len(vectors):
                yield pd.Series([], dtype=object)
                continue
            v = np.array(vectors.tolist(), float)
            away = (centres**2).sum(1)[None, :] - 2 * v @ centres.T
            yield pd.Series(list(np.argsort(away, 1, kind="stable")[:, :most].astype(np.int32)))

    return lambda c: F.pandas_udf(work, "array<int>")(F.col(c))
