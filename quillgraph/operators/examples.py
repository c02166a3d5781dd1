"""Choosing few-shot examples: nearest by distance, by the better of two likenesses, with rules and fallbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def other_domain(pairs: DataFrame, mine: str = "db", other: str = "other_db") -> DataFrame:
    """pairs of questions of different databases."""
    return pairs.filter(F.col(mine) != F.col(other))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """(qid, example, distance, rank): the k nearest examples of pairs (qid, example, distance)."""
    order = Window.partitionBy("qid").orderBy("distance", "example")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def best_likeness(pairs: DataFrame, k: int) -> DataFrame:
    """(qid, example, likeness, rank) by the greater of a question's and its skeleton's likeness."""
    order = Window.partitionBy("qid").orderBy(F.desc("likeness"), "example")
    wide = pairs.withColumn("likeness", F.greatest("question_likeness", "skeleton_likeness"))
    return wide.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "example", "likeness", "rank")


def two_passes(pairs: DataFrame, k: int, least: float) -> DataFrame:
    """(qid, example, rank): first those whose pattern is like enough (likeness), nearest first, then the rest."""
    order = Window.partitionBy("qid").orderBy(F.when(F.col("likeness") >= least, 0).otherwise(1), "distance", "example")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("qid", "example", "rank")


def arbitrary(rows: DataFrame, key: str, k: int, seed: int = 0) -> DataFrame:
    """k rows in the order of a hash of their key and the seed: the same ones every time."""
    return rows.orderBy(F.xxhash64(F.lit(seed), key), key).limit(k)


def masked(tokens: DataFrame, links: DataFrame, tag: str = "_") -> DataFrame:
    """(qid, text) of tokens (qid, pos, token) with the linked ones (qid, pos) replaced, runs of tags as one."""
    hit = tokens.join(links.select("qid", "pos", F.lit(True).alias("hit")).distinct(), ["qid", "pos"], "left")
    words = F.array_sort(F.collect_list(F.struct("pos", F.when(F.col("hit"), F.lit(tag)).otherwise(F.col("token")).alias("w"))))
    text = F.array_join(F.transform(words, lambda x: x["w"]), " ")
    return hit.groupBy("qid").agg(F.regexp_replace(text, rf"\Q{tag}\E(?: \Q{tag}\E)+", tag).alias("text"))


def relevant_tables(links: DataFrame, tables: DataFrame) -> DataFrame:
    """(qid, table): tables that links (qid, table) name; a question without any gets all its tables (qid, table)."""
    named = links.select("qid", "table").distinct()
    rest = tables.join(named.select("qid").distinct(), "qid", "left_anti").select("qid", "table")
    return named.union(rest)
