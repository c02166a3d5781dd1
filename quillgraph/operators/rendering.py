"""SQL skeletons, context tables, path texts and message windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def skeleton(sql: Column, names: list[str]) -> Column:
    """sql with literals and the given names masked, repeated masks joined; for likeness of shape."""
    out = F.lower(F.trim(F.regexp_replace(sql, r"\s+", " ")))
    out = F.regexp_replace(out, r"'[^']*'|\b[0-9]+(\.[0-9]+)?\b", "_")
    if names:
        out = F.regexp_replace(out, r"\b(" + "|".join(sorted(names, key=len, reverse=True)) + r")\b", "_")
    return F.regexp_replace(out, r"_( ?, ?_)+", "_")


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of tokens, with multiplicity."""
    count = lambda x, t: F.size(F.filter(x, lambda y: y == t))
    tokens = F.array_union(a, b)
    sums = lambda f: F.aggregate(F.transform(tokens, lambda t: f(count(a, t), count(b, t))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(tokens) > 0, sums(F.least) / sums(F.greatest)).otherwise(F.lit(0.0))


def replace_names(sql: Column, names: dict[str, str]) -> Column:
    """Whole names, not beside a dot, longest first."""
    for old in sorted(names, key=len, reverse=True):
        sql = F.regexp_replace(sql, rf"(?<![\w.])\Q{old}\E(?![\w.])", names[old].replace("\\", "\\\\").replace("$", "\\$"))
    return sql


def csv_context(rows: DataFrame, group: str, order: list, columns: list[str]) -> DataFrame:
    """(group, context): numbered CSV lines of a group's rows. A group's rows make one text, so they
    must be within a token budget already."""
    numbered = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    line = F.to_csv(F.struct(F.col("_n").alias("id"), *columns))
    lines = numbered.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("_n", line.alias("line")))).alias("l"))
    head = ",".join(["id", *columns])
    return lines.select(group, F.concat(F.lit(head + "\r\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\r\n")).alias("context"))


def qualified_path(path: Column, db: str) -> Column:
    """TABLE.COLUMN nodes of a path as quoted, database-qualified names."""
    quoted = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    node = lambda x: F.concat_ws(".", F.lit(f'"{db}"'), F.lit(f'"{db}"'), quoted(F.split_part(x, F.lit("."), F.lit(1))), F.when(F.contains(x, F.lit(".")), quoted(F.split_part(x, F.lit("."), F.lit(2)))))
    return F.array_join(F.transform(F.split(path, " -> "), node), " -> ")


def memory_window(messages: DataFrame, key: str, order: str, pairs: int) -> DataFrame:
    """System messages and the last 2 * pairs others of each conversation."""
    other = messages.filter("role <> 'system'").withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).filter(F.col("_r") <= 2 * pairs).drop("_r")
    return messages.filter("role = 'system'").unionByName(other)


def top_schema(scores: DataFrame, tables: int, columns: int) -> DataFrame:
    """scores (table, table_score, column, column_score): the best tables and, in each, its best columns."""
    t = Window.orderBy(F.desc("table_score"), "table")
    best = scores.select("table", "table_score").distinct().withColumn("_t", F.row_number().over(t)).filter(F.col("_t") <= tables).select("table")  # a row for each table
    c = Window.partitionBy("table").orderBy(F.desc("column_score"), "column")
    return scores.join(best, "table", "left_semi").withColumn("_c", F.row_number().over(c)).filter(F.col("_c") <= columns).select("table", "column")


def length_histogram(rows: DataFrame, length: str, bins: int = 20) -> DataFrame:
    """(bin, n): equal-width bins between the extremes."""
    ends = rows.agg(F.min(length).alias("lo"), F.max(length).alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins), F.floor((F.col(length) - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))) + 1)).otherwise(F.lit(1))
    return rows.select(length).join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))  # ends is one row


def line_widths(edges: DataFrame, thin: float = 0.5, thick: float = 4.0) -> DataFrame:
    """edges with width: their weights stretched between thin and thick; 1 where all are equal, thin
    where a weight isn't positive and finite."""
    usable = (F.col("weight") > 0) & (F.col("weight") < float("inf"))
    held = edges.filter(usable)
    low, high = held.agg(F.min("weight").alias("x")).scalar(), held.agg(F.max("weight").alias("x")).scalar()
    stretched = F.when(high > low, thin + (thick - thin) * (F.col("weight") - low) / (high - low)).otherwise(F.lit(1.0))
    return edges.withColumn("width", F.when(usable, stretched).otherwise(F.lit(thin)))


def alternating_roles(messages: DataFrame, key: str, order: str) -> DataFrame:
    """messages with role: user and assistant in turns, by order within each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return messages.withColumn("role", F.when(n % 2 == 1, F.lit("user")).otherwise(F.lit("assistant")))
