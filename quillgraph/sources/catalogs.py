"""What a session's catalog holds, and running queries the way a caller wants their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.schemas import nested_paths


def catalog_columns(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(db, table, position, column, type) of all tables and views, in their order."""
    rows = []
    for t in spark.catalog.listTables(database):
        name = t.name if t.isTemporary else ".".join([*(t.namespace or []), t.name])
        rows += [(".".join(t.namespace or []), t.name, i, f.name, f.dataType.simpleString()) for i, f in enumerate(spark.table(name).schema.fields)]
    return spark.createDataFrame(rows, "db string, table string, position int, column string, type string")


def field_paths(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame(nested_paths(spark.table(table)), "path string, type string")


def fetched(df: DataFrame, fetch: str | int = "all", seed: int = 0) -> DataFrame:
    """all rows, one, so many, or up to ten that stay the same for a seed (random)."""
    if fetch == "all":
        return df
    if fetch == "random":
        return df.orderBy(F.xxhash64(F.lit(seed), F.to_json(F.struct(*df.columns)))).limit(10)
    return df.limit(1 if fetch == "one" else int(fetch))


def reduced_copy(df: DataFrame, most: int = 100_000, seed: int = 0) -> DataFrame:
    """At most so many rows, by a hash of their contents."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.to_json(F.struct(*df.columns)))).limit(most)


def sampled_json(df: DataFrame, rows: int, path: str, seed: int = 0) -> None:
    """Some rows as JSON lines."""
    reduced_copy(df, rows, seed).write.mode("overwrite").json(path)
