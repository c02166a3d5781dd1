"""Key-value tables, graphs and task files as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyValueTable:
    """A Parquet table with a key column id. Inserts append files and never overwrite known keys."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # the table isn't written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def insert_if_absent(self, rows: DataFrame) -> DataFrame:
        """Appends rows with new ids, of an id the row that is smallest field by field, and returns them."""
        columns = self.read().columns
        one = rows.groupBy("id").agg(F.min(F.struct(*[c for c in columns if c != "id"])).alias("row")).select("id", "row.*")
        new = one.join(self.read().select("id"), "id", "left_anti").select(*columns)
        new = new.checkpoint(eager=True)
        new.write.mode("append").parquet(self.path)
        return new

    def get(self, ids: DataFrame, fields: list[str] | None = None) -> DataFrame:
        """ids (id, pos) with their fields in order of pos; null where unknown."""
        rows = self.read()
        wanted = rows.select("id", *[c for c in fields or rows.columns if c != "id"])
        return ids.join(wanted, "id", "left").orderBy("pos")

    def keys(self) -> DataFrame:
        return self.read().select("id")

    def drop(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)


def read_graphml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, props), edges (src, dst, props)) of a GraphML file; keys are named, null values dropped."""
    keys = {r["_id"]: r["_attr.name"] for r in spark.read.format("xml").option("rowTag", "key").load(path).select("_id", "`_attr.name`").collect()}  # a graph's few attribute names
    named = F.create_map(*[F.lit(x) for kv in keys.items() for x in kv]) if keys else F.expr("map()")
    data = "data array<struct<_VALUE: string, _key: string>>"
    props = F.map_from_entries(F.transform(F.filter(F.coalesce("data", F.array()), lambda d: d["_VALUE"].isNotNull()), lambda d: F.struct(F.coalesce(F.get(F.map_values(F.map_filter(named, lambda k, v: k == d["_key"])), F.lit(0)), d["_key"]), d["_VALUE"])))
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id string, {data}").load(path)
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_source string, _target string, {data}").load(path)
    return nodes.select(F.col("_id").alias("node"), props.alias("props")), edges.select(F.col("_source").alias("src"), F.col("_target").alias("dst"), props.alias("props"))


def read_tasks(spark: SparkSession, path: str, ids: list[str] | None = None) -> DataFrame:
    """JSON-lines tasks; malformed lines are dropped."""
    schema = "instance_id string, db_id string, instruction string, external_knowledge string"
    rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return rows.filter(F.col("instance_id").isin(ids)) if ids else rows


def read_descriptions(spark: SparkSession, path: str) -> DataFrame:
    """Column description CSVs: line breaks and the usual lead-ins stripped, the table from the file's name."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\r\n]+", " "), r"(?i)^(commonsense evidence:|not useful)\s*", ""))
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return rows.select(name.alias("table"), *[strip(c).alias(c) for c in rows.columns])


def flat_schema(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(columns, primary keys, foreign keys) of positional schema files."""
    raw = spark.read.option("multiLine", True).json(path)
    cols = raw.select("db_id", "table_names_original", F.posexplode("column_names_original").alias("i", "c"), "column_types")
    cols = cols.select("db_id", "i", F.get("table_names_original", F.get("c", F.lit(0)).cast("int")).alias("table"), F.get("c", F.lit(1)).alias("column"), F.get("column_types", F.col("i")).alias("type"))
    keys = raw.select("db_id", F.explode("primary_keys").cast("int").alias("i")).join(cols, ["db_id", "i"]).select("db_id", "table", "column")
    fk = raw.select("db_id", F.explode("foreign_keys").alias("f")).select("db_id", F.col("f")[0].cast("int").alias("a"), F.col("f")[1].cast("int").alias("b"))
    end = lambda k, p: cols.select("db_id", F.col("i").alias(k), F.col("table").alias(f"{p}_table"), F.col("column").alias(f"{p}_column"))
    return cols, keys, fk.join(end("a", "src"), ["db_id", "a"]).join(end("b", "ref"), ["db_id", "b"]).select("db_id", "src_table", "src_column", "ref_table", "ref_column")


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added and changed files of two binaryFile reads."""
    digest = lambda df, n: df.select("path", F.sha2("content", 256).alias(n))
    both = digest(after, "new").join(digest(before, "old"), "path", "left")
    return both.filter(F.col("old").isNull() | (F.col("old") != F.col("new"))).select("path", F.when(F.col("old").isNull(), "added").otherwise("changed").alias("change"))
