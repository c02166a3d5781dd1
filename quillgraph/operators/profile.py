"""Table profiles and key inference: one aggregate over all columns of a table, then rules on its rows."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.operators.ordered import running

#: Name patterns of key columns, {} being the table's name, and their scores; the first that is
#: found in the upper-cased name counts. Fixed values.
KEY_NAMES = (
    ("^ID$", 15), ("^{}_ID$", 15), ("^{}_KEY$", 15), ("^PK_", 15), ("^KEY$", 10), ("^CODE$", 8), ("^UUID$", 15), ("^GUID$", 15), ("^SERIAL$", 15), ("^SEQ", 10), ("ID$", 5),
    ("UUID$", 10), ("CODE$", 5), ("NUM$", 5), ("NO$", 5), ("^RECORD", 8), ("^PID$", 15), ("^MID$", 15), ("^UID$", 15), ("^EID$", 15), ("^[A-Z]+ID$", 10), ("^[A-Z]+_ID$", 10),
)
#: Name patterns of references, {table} and {column} being the key's. Fixed values.
REFERENCE_NAMES = ("^{table}_{column}$", "^{table}{column}$", "^{table}_ID$", "^{table}ID$", "^{table}_KEY$", "^FK_{table}_", "^{column}$")


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _per_column(df: DataFrame, columns: list[str], stats) -> DataFrame:
    """One pass over df; a row for each column with the fields of stats(column)."""
    if not columns:
        raise ValueError("no columns of this kind")
    made = df.agg(*[F.struct(*stats(c)).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("s")) for c in columns])
    return made.select(F.explode(rows).alias("r")).select("r.column", "r.s.*")


def counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, row_count, distinct_count, null_count, nullability, cardinality."""
    out = _per_column(df, columns, lambda c: [F.count(F.lit(1)).alias("row_count"), F.count_distinct(c).alias("distinct_count"), F.count_if(F.col(c).isNull()).alias("null_count")])
    share = lambda x: F.when(F.col("row_count") > 0, F.round(F.col(x) / F.col("row_count"), 4))
    return out.withColumns({"nullability": share("null_count"), "cardinality": share("distinct_count")})


def medians(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, median): exact, from the counts of values, which are added up over ranges of values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    counted = df.select(F.explode(pairs).alias("p")).select("p.*").filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("n"))
    summed = running(counted, ["column", "value"], "n", "upto")
    ends = summed.groupBy("column").agg(F.sum("n").alias("total"), F.min(F.col("upto") - F.col("n")).alias("start"))  # a row a column
    at = summed.join(F.broadcast(ends), "column").withColumn("to", F.col("upto") - F.col("start"))
    holds = lambda place: F.max(F.when((F.col("to") - F.col("n") <= place) & (place < F.col("to")), F.col("value")))
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    return at.groupBy("column").agg(((holds(low) + holds(high)) / 2).alias("median"))


def numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    x = lambda c: F.col(c).cast("double")
    out = _per_column(df, columns, lambda c: [F.min(x(c)).alias("min"), F.max(x(c)).alias("max"), F.round(F.avg(x(c)), 4).alias("avg"), F.round(F.stddev_samp(x(c)), 4).alias("stddev")])
    return out.join(medians(df, columns), "column", "left").select("column", "min", "max", "avg", F.round("median", 4).alias("median"), "stddev")


def text(df: DataFrame, columns: list[str]) -> DataFrame:
    return _per_column(df, columns, lambda c: [F.round(F.avg(F.length(c)), 2).alias("avg_length"), F.sum(F.length(c)).cast("long").alias("total_length")])


def dates(df: DataFrame, columns: list[str]) -> DataFrame:
    day = lambda f, c: f(F.to_date(c)).cast("string")
    return _per_column(df, columns, lambda c: [day(F.min, c).alias("min_date"), day(F.max, c).alias("max_date"), F.datediff(F.max(c), F.min(c)).cast("long").alias("date_range_days")])


def common_values(df: DataFrame, columns: list[str], top: int = 5, most_distinct: int = 100) -> DataFrame:
    """column, value, n, rank: the most frequent values of columns with few; ties by value."""
    found = _union([df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("column"), "value", "n") for c in columns])
    few = found.groupBy("column").agg(F.count("*").alias("k")).filter(F.col("k") <= most_distinct)
    order = Window.partitionBy("column").orderBy(F.desc("n"), "value")
    return found.join(few, "column", "left_semi").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def value_statics(df: DataFrame, columns: list[str]) -> DataFrame:
    out = _per_column(df, columns, lambda c: [F.count(c).alias("t"), F.count_distinct(c).alias("d"), F.count_if(F.col(c).isNull()).alias("n")])
    return out.select("column", F.format_string("Total count %d - Distinct count %d - Null count %d", "t", "d", "n").alias("value_statics"))


def categorical(df: DataFrame, columns: list[str], below: int = 20) -> DataFrame:
    return _per_column(df, columns, lambda c: [(F.count_distinct(c) < below).alias("is_categorical")])


def name_score(column, table) -> Column:
    """The score of the first key name pattern that fits the upper-cased column name."""
    score = F.lit(0)
    for pattern, points in reversed(KEY_NAMES):
        before, found, after = pattern.partition("{}")
        regex = F.concat(F.lit("(?i)" + before + "\\Q"), F.upper(table), F.lit("\\E" + after)) if found else F.lit("(?i)" + pattern)
        score = F.when(F.regexp_like(F.upper(column), regex), points).otherwise(score)
    return score


def key_scores(profile: DataFrame, types: dict[str, T.DataType], table: str = "", defaults: dict[str, str] | None = None) -> DataFrame:
    """profile (counts) with key_score and is_key: unique and complete enough columns, near the best
    score. defaults: the columns' default expressions, of which a sequence's next value speaks for a key."""
    whole = [c for c, t in types.items() if isinstance(t, T.IntegralType)]
    texts = [c for c, t in types.items() if isinstance(t, T.StringType)]
    counted = [c for c, d in (defaults or {}).items() if "NEXTVAL" in str(d).upper()]
    ratio = F.col("distinct_count") / F.greatest(F.lit(1), F.col("row_count"))
    nulls = F.col("null_count") / F.greatest(F.lit(1), F.col("row_count"))
    score = F.when(ratio == 1, 30).when(ratio > 0.98, 20).otherwise(0) + F.when(F.col("null_count") == 0, 20).otherwise(0) + F.when(F.col("column").isin(whole), 15).when(F.col("column").isin(texts), 5).otherwise(0)
    score = score + name_score(F.col("column"), F.lit(table)) + F.when(F.col("column").isin(counted), 15).otherwise(0)
    fit = (ratio >= 0.9) & (nulls <= 0.1) & (F.col("row_count") > 0)
    scored = profile.withColumn("key_score", F.when(fit, score).otherwise(F.lit(0)).cast("long"))
    best = F.max("key_score").over(Window.partitionBy())
    return scored.withColumn("is_key", (F.col("key_score") >= 25) & (F.col("key_score") >= 0.8 * best))


def reference_names(columns: DataFrame, keys: DataFrame) -> DataFrame:
    """columns (table, column, type) against keys (ref_table, ref_column, ref_type) of other tables whose
    name they bear: confidence low where types differ, else medium. A pattern that is a whole name is
    made for each key, one that a name begins with is met by each beginning of the column's name that ends
    where the pattern does; both are equi-joins."""
    upper = {"{table}": F.upper("ref_table"), "{column}": F.upper("ref_column")}

    def made(pattern: str) -> Column:
        return F.concat(*[upper.get(x, F.lit(x)) for x in re.split(r"(\{table\}|\{column\})", pattern.strip("^$")) if x])

    whole = F.array(*[made(p) for p in REFERENCE_NAMES if p.endswith("$")])
    named = keys.withColumn("name", F.explode(F.array_distinct(whole)))
    met = columns.withColumn("name", F.upper("column")).join(named, "name").drop("name")
    for pattern in (p for p in REFERENCE_NAMES if not p.endswith("$")):
        end = pattern[-1]
        pieces = F.split(F.upper("column"), end)
        begins = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.concat(F.array_join(F.slice(pieces, F.lit(1), i), end), F.lit(end)))
        parts = columns.filter(F.size(pieces) > 1).withColumn("name", F.explode(begins))
        met = met.union(parts.join(keys.withColumn("name", made(pattern)), "name").drop("name"))
    confidence = F.when(F.upper("type") != F.upper("ref_type"), "low").otherwise("medium")
    return met.filter("table <> ref_table").select("table", "column", "ref_table", "ref_column", confidence.alias("confidence")).distinct()


def foreign_key(src: DataFrame, src_column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    """orphans, coverage, confidence of src_column as a reference to ref_column, on values exactly;
    columns of different types are none."""
    same = F.lit(src.schema[src_column].dataType == ref.schema[ref_column].dataType)
    a = src.select(F.col(src_column).cast("string").alias("v")).filter("v is not null").distinct()
    b = ref.select(F.col(ref_column).cast("string").alias("v")).filter("v is not null").distinct().withColumn("there", F.lit(1))
    # one full join gives both sizes and the orphans
    both = a.withColumn("here", F.lit(1)).join(b, "v", "full_outer")
    out = both.agg(F.count("here").alias("n_src"), F.count("there").alias("n_ref"), F.count_if(F.col("here").isNotNull() & F.col("there").isNull()).alias("orphans"))
    coverage = F.round(F.col("n_src") / F.greatest(F.lit(1), F.col("n_ref")), 4)
    out = out.withColumn("coverage", coverage).withColumn("accepted", same & (F.col("orphans") == 0) & (F.col("coverage") > 0.01))
    confidence = F.when(F.col("accepted") & (F.col("coverage") > 0.3), "high").when(F.col("accepted"), "medium").otherwise("none")
    return out.select(F.lit(src_column).alias("src_column"), F.lit(ref_column).alias("ref_column"), "orphans", "coverage", confidence.alias("confidence"))


def foreign_keys(pairs: list[tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    return _union([foreign_key(*p) for p in pairs])
