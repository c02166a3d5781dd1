"""Caches on disk whose entries belong to a version, bounded first in, first out.

Entries are appended in batches and never changed; what counts follows from reading: an entry's first
batch, the version asked for, and the newest `most` of that version. A graph's version is an order-free
digest of its rows, so any change of the graph leaves all older entries behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import scratch_path


def version_of(*tables: DataFrame) -> str:
    """The same for the same rows in any order."""
    found = []
    for t in tables:
        h = F.xxhash64(F.to_json(F.struct(*sorted(t.columns))))
        found += list(t.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).head())
    return ":".join(map(str, found))


class Cache:
    def __init__(self, spark: SparkSession, path: str, value_type: str, most: int | None = None):
        self.spark, self.path, self.most = spark, path, most
        self.schema = f"version string, key string, batch long, value {value_type}"

    def _read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # nothing was put yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def entries(self, version: str) -> DataFrame:
        """(key, value) that count: of those put for the version the newest, a batch's in order of their keys."""
        mine = self._read().filter(F.col("version") == version).groupBy("key").agg(F.min("batch").alias("batch"), F.min_by("value", "batch").alias("value"))
        if self.most is not None:
            mine = mine.orderBy(F.desc("batch"), F.desc("key")).limit(self.most)  # a bounded number
        return mine.select("key", "value")

    def put(self, rows: DataFrame, version: str) -> int:
        """Adds rows (key, value) whose keys the version doesn't hold; null keys are left out. Returns how many."""
        old = self._read()
        batch = (old.agg(F.max("batch")).head()[0] or 0) + 1
        fresh = rows.filter("key is not null").groupBy("key").agg(F.min("value").alias("value")).join(self.entries(version).select("key"), "key", "left_anti")
        at = scratch_path(self.spark, "cache")  # the table is read and written
        fresh.select(F.lit(version).alias("version"), "key", F.lit(batch).cast("long").alias("batch"), "value").write.parquet(at)
        new = self.spark.read.schema(self.schema).parquet(at)
        gone = old.join(new.select("version", "key"), ["version", "key"], "left_semi").limit(1).isEmpty()
        if not gone:  # an evicted key comes back: its first batch must not count any more
            self._rewrite(old.join(new.select("version", "key"), ["version", "key"], "left_anti"))
        new.write.mode("append").parquet(self.path)
        return new.count()

    def get(self, keys: DataFrame, version: str) -> DataFrame:
        """keys (key, ..) with value and hit."""
        return keys.join(self.entries(version).withColumn("hit", F.lit(True)), "key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))

    def drop_stale(self, version: str) -> None:
        """Forgets what no longer counts: other versions, and evicted entries."""
        kept = self._read().filter(F.col("version") == version).join(self.entries(version).select("key"), "key", "left_semi").select("version", "key", "batch", "value")
        self._rewrite(kept)

    def _rewrite(self, rows: DataFrame) -> None:
        at = scratch_path(self.spark, "cache")
        rows.select("version", "key", "batch", "value").write.parquet(at)
        self.spark.read.schema(self.schema).parquet(at).write.mode("overwrite").parquet(self.path)
