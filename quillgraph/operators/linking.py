"""Linking questions to columns and values: n-grams, prefixes, shared words and shared trigrams."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.columns import column_value, jaccard, ngrams, pieces
from quillgraph.operators.sql_text import parenthesis_spans


def question_ngrams(questions: DataFrame, most: int = 5) -> DataFrame:
    """(qid, pos, n, gram) of questions (qid, text), words lower-cased."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    q = questions.select("qid", words.alias("w")).select("qid", "w", F.posexplode("w").alias("pos", "_w"))
    q = q.select("qid", "w", "pos", F.explode(F.sequence(F.lit(1), F.least(F.lit(most), F.size("w") - F.col("pos")))).alias("n"))
    return q.select("qid", "pos", "n", F.array_join(F.slice("w", F.col("pos") + 1, F.col("n")), " ").alias("gram"))


def schema_links(questions: DataFrame, names: DataFrame) -> DataFrame:
    """(qid, name, kind, n): names (name, words) that a question says whole, or by its words' beginning
    (equal first word, an equi-join; then tested). Names are met where the grams are dealt by their words:
    grams are many times the questions that the planner knows of, so they are neither sent whole nor sorted."""
    grams = question_ngrams(questions)
    exact = grams.join(names.hint("shuffle_hash"), grams["gram"] == names["words"]).select("qid", "name", F.lit("exact").alias("kind"), "n")
    first = grams.filter("length(gram) > 2").withColumn("head", F.split_part("gram", F.lit(" "), F.lit(1)))
    heads = names.withColumn("head", F.split_part("words", F.lit(" "), F.lit(1)))
    part = first.join(heads.hint("shuffle_hash"), "head").filter("words <> gram and startswith(words, concat(gram, ' '))").select("qid", "name", F.lit("prefix").alias("kind"), "n")
    # a name said whole isn't linked by its beginning as well
    best = F.min(F.struct("kind", (-F.col("n")).alias("m"))).alias("p")
    return exact.union(part).groupBy("qid", "name").agg(best).select("qid", "name", "p.kind", (-F.col("p.m")).alias("n"))


def cell_links(questions: DataFrame, values: DataFrame) -> DataFrame:
    """(qid, pos, column): question words that are a word of a value (column, value)."""
    w = question_ngrams(questions, 1).select("qid", "pos", F.col("gram").alias("word"))
    v = values.select("column", F.explode(F.array_distinct(F.split(F.lower("value"), r"[^\p{L}\p{N}_]+"))).alias("word")).filter("word <> ''").distinct()
    return w.join(v.hint("shuffle_hash"), "word").select("qid", "pos", "column")


def islands(links: DataFrame) -> DataFrame:
    """(qid, column, start, length) of runs of linked neighbouring positions."""
    order = Window.partitionBy("qid", "column").orderBy("pos")
    run = links.distinct().withColumn("island", F.col("pos") - F.row_number().over(order))
    return run.groupBy("qid", "column", "island").agg(F.min("pos").alias("start"), F.count("*").alias("length")).drop("island")


def similar_values(keywords: DataFrame, values: DataFrame, n: int = 3, least: float = 0.3) -> DataFrame:
    """(kid, column, value, score): values whose trigram sets are like a keyword's. Candidates share
    one of the rarer trigrams by prefix filtering: sets of similarity t share one of the
    |a| - ceil(t|a|) + 1 first in any common order, here by hash."""
    def prefix(c: str):
        g = F.sort_array(F.transform(F.col(c), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("g"))))
        return F.explode(F.slice(g, F.lit(1), F.size(c) - F.ceil(F.lit(least) * F.size(c)).cast("int") + 1))

    k = keywords.select("kid", ngrams(F.lower("keyword"), n).alias("a")).filter(F.size("a") > 0)
    v = values.select("column", "value", ngrams(F.lower("value"), n).alias("b")).filter(F.size("b") > 0)
    pairs = k.select("kid", "a", prefix("a").alias("x")).select("kid", "a", "x.g").join(v.select("column", "value", "b", prefix("b").alias("x")).select("column", "value", "b", "x.g"), "g")
    pairs = pairs.dropDuplicates(["kid", "column", "value"]).withColumn("score", F.round(jaccard(F.col("a"), F.col("b")), 6))
    return pairs.filter(F.col("score") >= least).select("kid", "column", "value", "score")


def near_best(rows: DataFrame, group: list[str], score: str, share: float = 0.9) -> DataFrame:
    best = F.max(score).over(Window.partitionBy(*group))
    return rows.withColumn("_b", best).filter(F.col(score) >= share * F.col("_b")).drop("_b")


def sequence_ratio(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with ratio: matching blocks over total length, lower-cased; batches, not rows, cross to Python."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            x["ratio"] = [difflib.SequenceMatcher(None, (s or "").lower(), (t or "").lower()).ratio() for s, t in zip(x[a], x[b])]
            yield x

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields)
    return pairs.mapInPandas(work, f"{schema}, ratio double")


def indexable_columns(profile: DataFrame) -> DataFrame:
    """profile (column, type, is_key, distinct_count, total_length, avg_length, of distinct values): text
    columns worth a value index."""
    name = F.lower("column")
    named = name.contains("name") & (F.col("total_length") < 5_000_000)
    small = (F.col("total_length") < 2_000_000) & (F.col("avg_length") < 25)
    skipped = name.rlike("(_ref|_id| id|url|email|web|time|phone|date|address)") | F.col("column").endswith("Id")
    text = F.lower("type").rlike("text|char") & ~F.col("is_key") & (F.col("distinct_count") > 0)
    return profile.filter(text & ~skipped & (named | small | (F.col("distinct_count") < 100)))


def search_values(keywords: DataFrame) -> DataFrame:
    """(question, keyword) as question, keyword, piece, place: each keyword, its parts at every space and
    the value behind its equals sign, longest first within a keyword; repeated pieces stay."""
    k = keywords.select("question", F.regexp_replace("keyword", r"^\s+|\s+$", "").alias("keyword"))
    value = column_value(F.col("keyword"))[1]
    found = F.when(value != "", F.concat(pieces(F.col("keyword")), F.array(value))).otherwise(pieces(F.col("keyword")))
    order = Window.partitionBy("question").orderBy(F.desc("keyword"), F.desc(F.length("piece")), F.desc("piece"))
    return k.select("question", "keyword", F.explode(found).alias("piece")).withColumn("place", F.row_number().over(order))


def possible_names(keywords: DataFrame) -> DataFrame:
    """(question, keyword) as question, name: what may name a column in it, which is the keyword, what
    stands before an equals sign, what stands in parentheses, and each word."""
    k = keywords.select("question", F.regexp_replace("keyword", r"^\s+|\s+$", "").alias("keyword"))
    before = F.when(F.contains("keyword", F.lit("=")), column_value(F.col("keyword"))[0])
    words = F.when(F.contains("keyword", F.lit(" ")), F.split("keyword", r"\s+")).otherwise(F.array().cast("array<string>"))
    names = k.select("question", F.explode(F.concat(F.array("keyword", before), words)).alias("name"))
    spans = parenthesis_spans(k, "keyword").select("question", "keyword", F.explode("spans").alias("s")).select("question", F.substring("keyword", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("name"))
    return names.filter("name <> ''").union(spans).distinct()


def matching_columns(names: DataFrame, columns: DataFrame, least: float = 0.9) -> DataFrame:
    """(question, name) and (table, column) as question, name, table, column, ratio: columns spelt almost
    like a name, apart from case, spaces, underscores and an ending s. Only names that share one of the
    first characters, in a common order, that a match must share meet, so no pair is lost."""

    def plain(c: str):
        return F.regexp_replace(F.regexp_replace(F.lower(c), "[ _]", ""), "s+$", "")

    def prefix(c: str):
        letters = F.when(F.length(c) > 0, F.split(c, "")).otherwise(F.array().cast("array<string>"))
        numbered = F.transform(letters, lambda x, i: F.struct(F.xxhash64(x).alias("h"), x.alias("x"), F.size(F.filter(F.slice(letters, F.lit(1), i), lambda y: y == x)).alias("k")))
        most = F.size(letters) - F.ceil(F.lit(least / (2 - least) - 1e-9) * F.size(letters)).cast("int") + 1
        return F.when(F.size(letters) > 0, F.slice(F.sort_array(numbered), F.lit(1), most)).otherwise(F.array(F.struct(F.lit(0).cast("long").alias("h"), F.lit("").alias("x"), F.lit(0).alias("k"))))

    a = names.select("question", "name", plain("name").alias("n")).filter("n is not null").distinct()
    b = columns.select("table", "column", plain("column").alias("c")).filter("c is not null").distinct()
    met = a.select("n").distinct().select("n", F.explode(prefix("n")).alias("p")).join(b.select("c").distinct().select("c", F.explode(prefix("c")).alias("p")), "p")
    able = 2 * F.least(F.length("n"), F.length("c")) + 1e-9 >= least * (F.length("n") + F.length("c"))
    like = sequence_ratio(met.filter(able).select("n", "c").distinct(), "c", "n").filter(F.col("ratio") >= least)
    return like.join(a, "n").join(b, "c").select("question", "name", "table", "column", "ratio")
