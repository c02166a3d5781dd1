"""Folders of table descriptions: JSON files walked to schema rows, CSV files of either encoding, and summaries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a table's file holds; lists are positional: name, type and description of a column share a place.
TABLE_FILE = "table_name string, table_fullname string, column_names array<string>, column_types array<string>, description array<string>, sample_rows array<map<string,string>>"

#: Bytes that windows-1252 reads as signs and ISO-8859-1 as control characters, and the signs.
_HIGH = [bytes([b]) for b in range(0x80, 0xA0) if bytes([b]).decode("cp1252", "ignore")]
_SIGNS = (b"".join(_HIGH).decode("latin-1"), b"".join(_HIGH).decode("cp1252"))


class Metadata:
    """Tables, columns and samples of all JSON files below root; a file's database is the folder below root that it is in."""

    def __init__(self, spark: SparkSession, root: str):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root)
        text = F.try_validate_utf8(F.col("content").cast("string"))
        below = rf".*/{re.escape(root.rstrip('/').split('/')[-1])}/([^/]+)/.*"
        self.files = files.select("path", F.regexp_extract("path", below, 1).alias("db"), F.from_json(text, TABLE_FILE).alias("t"))
        self.good = self.files.filter("t.table_name is not null and t.column_names is not null")

    def broken(self) -> DataFrame:
        """(path) of files that are no description of a table; empty files aren't listed."""
        return self.files.join(self.good.select("path"), "path", "left_anti").select("path")

    def tables(self) -> DataFrame:
        """(db, table, full_name, n_columns, n_samples)."""
        return self.good.select("db", F.col("t.table_name").alias("table"), F.col("t.table_fullname").alias("full_name"), F.size("t.column_names").alias("n_columns"), F.coalesce(F.size("t.sample_rows"), F.lit(0)).alias("n_samples"))

    def columns(self) -> DataFrame:
        """(db, table, position, column, type, description); what a list lacks is null."""
        wide = self.good.select("db", F.col("t.table_name").alias("table"), "t", F.posexplode("t.column_names").alias("position", "column"))
        at = lambda c: F.get(f"t.{c}", F.col("position"))
        return wide.select("db", "table", "position", "column", at("column_types").alias("type"), at("description").alias("description"))

    def samples(self) -> DataFrame:
        """(db, table, place, column, value) of the sample rows, empty values left out."""
        rows = self.good.select("db", F.col("t.table_name").alias("table"), F.posexplode("t.sample_rows").alias("place", "row"))
        return rows.select("db", "table", "place", F.explode("row").alias("column", "value")).filter("value <> ''")

    def databases(self) -> DataFrame:
        """(db, tables, columns, columns_per_table)."""
        per = self.tables().groupBy("db").agg(F.count("*").alias("tables"), F.sum("n_columns").alias("columns"))
        return per.withColumn("columns_per_table", F.round(F.col("columns") / F.col("tables"), 4))


def summaries(columns: DataFrame) -> DataFrame:
    """(db, json): a document for each database of columns (db, table, position, column, type, ..): tables with their
    columns in order. Numbers and dates of other fields are written as text, NaN and infinities as null."""
    rest = [f for f in columns.schema.fields if f.name not in ("db", "table", "position", "column")]
    plain = lambda f: F.when(F.isnan(f.name) | (F.abs(f.name) == float("inf")), None).otherwise(F.col(f.name)).cast("string") if f.dataType.typeName() in ("double", "float") else F.col(f.name).cast("string")
    one = F.struct("position", F.struct(F.col("column").alias("name"), *[plain(f).alias(f.name) for f in rest]).alias("x"))
    tables = columns.groupBy("db", "table").agg(F.transform(F.array_sort(F.collect_list(one)), lambda c: c["x"]).alias("columns"))
    listed = F.array_sort(F.collect_list(F.struct(F.col("table").alias("name"), F.size("columns").alias("column_count"), "columns")))
    return tables.groupBy("db").agg(listed.alias("tables")).select("db", F.to_json(F.struct("db", F.size("tables").alias("table_count"), "tables")).alias("json"))


def write_summaries(columns: DataFrame, path: str) -> None:
    """A folder for each database (db=..) with its document as text."""
    summaries(columns).write.mode("overwrite").partitionBy("db").text(path)


def described_columns(spark: SparkSession, path: str) -> DataFrame:
    """Column descriptions of CSV files, UTF-8 with or without a mark, else windows-1252; the table is the file's
    name. Line breaks and usual lead-ins are stripped, null is empty."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    known = files.select("path", F.try_validate_utf8(F.col("content").cast("string")).isNotNull().alias("utf8")).collect()  # a row a file, as a listing
    out = None
    for encoding, paths in (("UTF-8", [r["path"] for r in known if r["utf8"]]), ("ISO-8859-1", [r["path"] for r in known if not r["utf8"]])):
        if not paths:
            continue
        rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("encoding", encoding).csv(paths)
        rows = rows.toDF(*[c.lstrip("﻿").strip() for c in rows.columns])
        text = lambda c: F.translate(f"`{c}`", *_SIGNS) if encoding == "ISO-8859-1" else F.col(f"`{c}`")  # noqa: E731, B023
        strip = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text(c), F.lit("")), r"[\r\n]+", " "), r"(?i)^(commonsense evidence:|not useful)\s*", ""))  # noqa: E731, B023
        part = rows.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1).alias("table"), *[strip(c).alias(c) for c in rows.columns])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"no CSV files in {path}")
    return out


def concatenated(described: DataFrame, fields: tuple[str, ...] = ("column_name", "column_description", "value_description")) -> DataFrame:
    """(table, column, description): the fields that aren't empty, joined by commas."""
    said = F.array(*[F.nullif(F.col(f), F.lit("")) for f in fields])
    return described.select("table", F.col("original_column_name").alias("column"), F.concat_ws(", ", F.array_compact(said)).alias("description"))
