"""A MinHash index of database values that stays on disk, grows and is probed by keyword.

A value's character n-grams give `bands` keys of `rows` minima each; values that share a key with a
keyword are its candidates. Keys and values are bucketed tables in the index's folder: keys by key,
values by id. A probe shuffles the keywords' keys and the candidates' ids to the buckets and never
moves the index; adding shuffles the new values alone. Another session opens the index by its folder.

Values are the commit: keys of new values are written first, so a broken addition leaves keys
without a value, which a probe doesn't see and the next addition writes again.

Candidates are ranked by the exact similarity of the n-gram sets. A value of similarity s is met with
probability 1 - (1 - s^rows)^bands.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.columns import dot, jaccard, ngrams
from quillgraph.operators.embedding import Embedder, embed
from quillgraph.operators.linking import near_best, search_values, sequence_ratio
from quillgraph.session import scratch_path

#: Least similarity by matching blocks and by embedding; share of the best that is kept. Fixed values.
EDIT, EMBEDDING, NEAR = 0.3, 0.6, 0.9


@dataclass(frozen=True)
class IndexSettings:
    gram: int = 3
    bands: int = 64
    rows: int = 2
    buckets: int = 16


def band_keys(text: Column, settings: IndexSettings) -> Column:
    """Distinct keys of a text's bands; a text shorter than a gram has none."""
    def keys(hashes: Column) -> Column:
        least = lambda i: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, i)))
        rows = F.sequence(F.lit(1), F.lit(settings.rows))
        band = lambda b: F.aggregate(rows, b.cast("long"), lambda key, r: F.xxhash64(key, least(b * settings.rows + r)))
        return F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(settings.bands - 1)), band))

    grams = ngrams(text, settings.gram)
    hashes = F.transform(F.array(F.transform(grams, lambda g: F.xxhash64(g))), keys)[0]  # a variable, so grams are hashed once
    return F.when(F.length(text) >= settings.gram, hashes).otherwise(F.array().cast("array<long>"))


class ValueIndex:
    def __init__(self, spark: SparkSession, path: str, settings: IndexSettings):
        self.spark, self.path, self.settings = spark, path.rstrip("/"), settings
        name = "value_index_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        self.keys, self.values = f"{name}_keys", f"{name}_values"
        into = f"INTO {settings.buckets} BUCKETS"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.keys} (key BIGINT, id BINARY) USING parquet CLUSTERED BY (key) {into} LOCATION '{self.path}/keys'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.values} (id BINARY, `table` STRING, `column` STRING, value STRING) USING parquet CLUSTERED BY (id) {into} LOCATION '{self.path}/values'")

    @classmethod
    def create(cls, spark: SparkSession, path: str, settings: IndexSettings | None = None) -> ValueIndex:
        """A new index; a folder that has one is left as it is (an error)."""
        settings = settings or IndexSettings()
        row = spark.createDataFrame([(json.dumps(asdict(settings)),)], "settings string")
        row.coalesce(1).write.mode("error").text(f"{path.rstrip('/')}/settings")
        return cls(spark, path, settings)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> ValueIndex:
        found = spark.read.text(f"{path.rstrip('/')}/settings").head()
        return cls(spark, path, IndexSettings(**json.loads(found["value"])))

    def close(self) -> None:
        """Forgets the tables' names; the folder stays."""
        for name in (self.keys, self.values):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def add(self, values: DataFrame) -> None:
        """Adds values (table, column, value) that aren't there; null values are left out."""
        at = F.unhex(F.md5(F.to_json(F.array("table", "column", "value"))))
        given = values.filter("value is not null").select("table", "column", "value").distinct().select(at.alias("id"), "table", "column", "value")
        fresh = given.join(self.spark.table(self.values).select("id"), "id", "left_anti")
        path = scratch_path(self.spark, "values")  # read twice, and the table must not change between
        fresh.write.parquet(path)
        fresh = self.spark.read.parquet(path)
        n = self.settings.buckets
        keys = fresh.select(F.explode(band_keys(F.col("value"), self.settings)).alias("key"), "id")
        keys.repartition(n, "key").write.insertInto(self.keys)
        fresh.repartition(n, "id").write.insertInto(self.values)
        for name in (self.keys, self.values):
            self.spark.catalog.refreshTable(name)

    def probe(self, keywords: DataFrame, most: int = 10, least: float = 0.0) -> DataFrame:
        """(kid, table, column, value, score, place): of keywords (kid, keyword) the most similar values met."""
        k = keywords.select("kid", "keyword").distinct()
        asked = k.select("kid", F.explode(band_keys(F.col("keyword"), self.settings)).alias("key"))
        met = asked.join(self.spark.table(self.keys), "key").select("kid", "id").distinct()
        wide = met.join(self.spark.table(self.values), "id").join(k, "kid")
        score = F.round(jaccard(ngrams(F.col("keyword"), self.settings.gram), ngrams(F.col("value"), self.settings.gram)), 6)
        order = Window.partitionBy("kid").orderBy(F.desc("score"), "table", "column", "value")
        found = wide.select("kid", "table", "column", "value", score.alias("score")).filter(F.col("score") >= least)
        return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)


def similar_entities(index: ValueIndex, keywords: DataFrame, embedder: Embedder, most: int = 10) -> DataFrame:
    """(question, table, column, value, edit, embedding): values like keywords (question, keyword) or parts
    of them. What a part meets in the index must be like it by matching blocks and then by embedding; of a
    question's values of a column those near the best stay, by blocks and then, among these, by embedding."""
    pieces = search_values(keywords).select("question", "piece").distinct()
    hits = index.probe(pieces.select(F.col("piece").alias("kid"), F.col("piece").alias("keyword")).distinct(), most)
    like = sequence_ratio(hits.select(F.col("kid").alias("piece"), "table", "column", "value"), "piece", "value").filter(F.col("ratio") >= EDIT)
    path = scratch_path(index.spark, "entities")
    like.write.parquet(path)
    like = index.spark.read.parquet(path)
    texts = like.select(F.col("piece").alias("content")).union(like.select("value")).distinct()
    path = scratch_path(index.spark, "entity-vectors")
    embed(texts, embedder).write.parquet(path)  # each text once, before it is joined twice
    vectors = index.spark.read.parquet(path)
    a, b = vectors.select(F.col("content").alias("piece"), F.col("vector").alias("a")), vectors.select(F.col("content").alias("value"), F.col("vector").alias("b"))
    near = like.join(a, "piece").join(b, "value").withColumn("embedding", dot(F.col("a"), F.col("b"))).filter(F.col("embedding") >= EMBEDDING)
    asked = near.join(pieces, "piece").select("question", "table", "column", "value", F.col("ratio").alias("edit"), "embedding")
    group = ["question", "table", "column"]
    best = near_best(near_best(asked, group, "edit", NEAR), group, "embedding", NEAR)
    return best.groupBy(*group, "value").agg(F.max("edit").alias("edit"), F.max("embedding").alias("embedding"))
