"""Queries of database values: the persistent index, entities like keywords, bridges and phrases."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import bridge, phrases, value_index, vector_index
from quillgraph.registry import query
from quillgraph.session import scratch_path, table


def _words(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return table(spark, sf, name).select("*", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("word")).filter("length(word) >= 11")


def _values(spark: SparkSession, sf: str) -> DataFrame:
    """Every longer word of the documents, by language, and the names and types of parts."""
    words = _words(spark, sf, "documents").select(F.col("lang").alias("table"), F.lit("word").alias("column"), F.col("word").alias("value")).distinct()
    part = table(spark, sf, "part")
    return words.union(part.select(F.lit("part"), F.lit("p_name"), "p_name").distinct()).union(part.select(F.lit("part"), F.lit("p_type"), "p_type").distinct())


def _keywords(spark: SparkSession, sf: str) -> DataFrame:
    """The benchmark's longer words without their last letter."""
    return _words(spark, sf, "benchmark").select(F.left("word", F.length("word") - 1).alias("keyword")).distinct()


def _index(spark: SparkSession, sf: str) -> value_index.ValueIndex:
    """Made in two additions, the second of which holds the first, and opened anew."""
    path = scratch_path(spark, "value-index")
    made = value_index.ValueIndex.create(spark, path, value_index.IndexSettings(bands=48, rows=3))
    made.add(_values(spark, sf).filter("`table` in ('en', 'part')"))
    made.add(_values(spark, sf))
    made.close()
    return value_index.ValueIndex.open(spark, path)


_VALUE_SQL = r"""w AS (SELECT lang, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'))) AS word FROM documents),
v AS (SELECT DISTINCT lang AS t, 'word' AS c, word AS value FROM w WHERE length(word) >= 11 UNION SELECT 'part', 'p_name', p_name FROM part UNION SELECT 'part', 'p_type', p_type FROM part),
k AS (SELECT DISTINCT left(word, length(word) - 1) AS k FROM (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'))) AS word FROM benchmark) b WHERE length(word) >= 11),
vg AS (SELECT DISTINCT t, c, value, unnest(list_transform(generate_series(1, length(value) - 2), lambda i: substr(value, i, 3))) AS g FROM v),
kg AS (SELECT DISTINCT k, unnest(list_transform(generate_series(1, length(k) - 2), lambda i: substr(k, i, 3))) AS g FROM k),
vn AS (SELECT t, c, value, count(*) AS n FROM vg GROUP BY ALL), kn AS (SELECT k, count(*) AS n FROM kg GROUP BY ALL),
p AS (SELECT k, t, c, value, count(*) AS n FROM kg JOIN vg USING (g) GROUP BY ALL)"""


@query(f"""WITH {_VALUE_SQL}, s AS (SELECT k, t, c, value, round(p.n / (kn.n + vn.n - p.n), 6) AS score FROM p JOIN kn USING (k) JOIN vn USING (t, c, value))
SELECT k AS keyword, t AS "table", c AS "column", value, score, place FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, t, c, value)::INT AS place FROM s WHERE score >= 0.6) x WHERE place <= 10""")
def value_index_hits(spark: SparkSession, sf: str) -> DataFrame:
    keywords = _keywords(spark, sf).select(F.col("keyword").alias("kid"), "keyword")
    return _index(spark, sf).probe(keywords, 10, 0.6).withColumnRenamed("kid", "keyword")


def letter_counts(texts: list[str]) -> np.ndarray:
    """Unit vectors of how often each letter occurs: an embedding that needs no model."""
    out = np.zeros((len(texts), 27))
    for row, text in zip(out, texts, strict=True):
        for c in text.lower():
            row[ord(c) - 97 if "a" <= c <= "z" else 26] += 1
    return out / np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))


@query()
def similar_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Values like the benchmark's altered words, each a question of its own."""
    keywords = _keywords(spark, sf).select(F.col("keyword").alias("question"), "keyword")
    return value_index.similar_entities(_index(spark, sf), keywords, letter_counts)


# ---- phrases: a question of each part says its name forwards and backwards, its type and size

_ASK = "p_name || ' and ' || split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1) || ', ' || p_type || ' ' || p_name || ' ' || p_size"


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), F.expr(_ASK).alias("text"))


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    value = lambda c: p.select(F.lit("part").alias("table"), F.lit(c).alias("column"), F.col(c).alias("value")).distinct()
    return value("p_name").union(value("p_type")).union(value("p_brand"))


_PHRASES_SQL = rf"""q AS (SELECT p_partkey AS qid, list_filter(list_transform(regexp_split_to_array(lower({_ASK}), '\s+'), lambda w: regexp_replace(w, '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')), lambda w: w <> '') AS w FROM part),
t AS (SELECT qid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM q),
v AS (SELECT DISTINCT 'p_name' AS c, p_name AS v FROM part UNION SELECT 'p_type', p_type FROM part UNION SELECT 'p_brand', p_brand FROM part),
i AS (SELECT DISTINCT c, unnest(string_split(lower(v), ' ')) AS word FROM v),
l AS (SELECT qid, c, pos, word, pos - row_number() OVER (PARTITION BY qid, c ORDER BY pos) AS run FROM t JOIN i USING (word) WHERE word <> 'and' AND try_cast(word AS DOUBLE) IS NULL),
r AS (SELECT qid, c, min(pos)::INT AS start, count(*)::INT AS length, string_agg(word, ' ' ORDER BY pos) AS phrase FROM l GROUP BY qid, c, run),
f AS (SELECT r.*, EXISTS (SELECT 1 FROM v WHERE v.c = r.c AND lower(v.v) = phrase) AS exact FROM r)"""


@query(f"""WITH {_PHRASES_SQL} SELECT qid, 'part' AS "table", c AS "column", start, length, phrase, CASE WHEN exact THEN 'exact' ELSE 'partial' END AS kind FROM f""")
def cell_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.cell_phrases(_questions(spark, sf), _cells(spark, sf), ("and",))


@query(rf"""WITH {_PHRASES_SQL} SELECT qid, pos::INT AS pos, 'part' AS "table", c AS "column", k AS kind FROM t, (VALUES ('p_size', 'NUMBER'), ('p_since', 'TIME')) x(c, k) WHERE try_cast(word AS DOUBLE) IS NOT NULL""")
def number_links(spark: SparkSession, sf: str) -> DataFrame:
    columns = spark.createDataFrame([("part", "p_size", "number"), ("part", "p_since", "time"), ("part", "p_name", "text")], "table string, column string, type string")
    return phrases.number_links(_questions(spark, sf), columns)


# matches of a word: the columns and tables whose name, here a letter of the word, it says

_MATCH_SQL = f"""{_PHRASES_SQL}, m AS (SELECT DISTINCT qid, pos, CASE WHEN j = 3 THEN 'table' ELSE 'column' END AS what, word[j] AS name, CASE WHEN (pos + j) % 3 = 0 THEN 'exact' ELSE 'partial' END AS kind FROM t, (VALUES (1), (2), (3)) z(j) WHERE word[j] <> ''),
g AS (SELECT qid, pos, list_sort(list({{'what': what, 'name': name, 'kind': kind}})) AS found FROM m GROUP BY qid, pos), o AS (SELECT qid, pos, found, row_number() OVER (PARTITION BY qid ORDER BY len(found), pos) AS k FROM g),
s AS (SELECT qid, k, pos, [] :: STRUCT(what VARCHAR, name VARCHAR, kind VARCHAR)[] AS known, found, false AS done, [] :: STRUCT(what VARCHAR, name VARCHAR, kind VARCHAR)[] AS kept FROM o WHERE k = 1
UNION ALL SELECT s.qid, s.k + 1, n.pos, s.known || CASE WHEN len(list_intersect(s.known, s.found)) > 0 THEN [] ELSE CASE WHEN len(list_filter(s.found, lambda x: x.kind = 'exact')) > 0 THEN list_filter(s.found, lambda x: x.kind = 'exact') ELSE s.found END END,
n.found, false, [] FROM s JOIN o n ON n.qid = s.qid AND n.k = s.k + 1),
d AS (SELECT qid, pos, unnest(CASE WHEN len(list_intersect(known, found)) > 0 THEN list_intersect(known, found) WHEN len(list_filter(found, lambda x: x.kind = 'exact')) > 0 THEN list_filter(found, lambda x: x.kind = 'exact') ELSE found END) AS x FROM s)"""


@query(f"WITH RECURSIVE {_MATCH_SQL} SELECT qid, pos::INT AS pos, x.what AS what, x.name AS name, x.kind AS kind FROM d")
def settled_links(spark: SparkSession, sf: str) -> DataFrame:
    w = phrases.question_words(_questions(spark, sf)).withColumn("j", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("name", F.substring("word", F.col("j"), F.lit(1))).filter("name <> ''")
    matches = w.select("qid", "pos", F.when(F.col("j") == 3, "table").otherwise("column").alias("what"), "name", F.when((F.col("pos") + F.col("j")) % 3 == 0, "exact").otherwise("partial").alias("kind")).distinct()
    return phrases.settled(matches)


@query()
def bridge_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Values of parts and places that the questions about parts spell out, one letter short or as an owner."""
    p = table(spark, sf, "part")
    text = F.concat(F.lit("Which "), F.regexp_replace("p_name", "(.)$", ""), F.lit(" is of "), F.lower("p_brand"), F.lit(" or nation_1's "), F.col("p_name"), F.lit("?"))
    n = table(spark, sf, "nation").select(F.lit("nation").alias("table"), F.lit("n_name").alias("column"), F.col("n_name").alias("value"))
    return bridge.bridge_matches(p.select(text.alias("qid"), text.alias("text")).distinct(), _cells(spark, sf).withColumn("column", F.replace("column", F.lit("p_name"), F.lit("p_label"))).union(n))


# ---- descriptions: each part's name, type and brand as a column of its type's table

_LETTERS = "list_transform(generate_series(97, 122), lambda c: length({0}) - length(replace({0}, chr(c::INT), '')))"


def _vector_sql(text: str) -> str:
    """Counts of letters and of what is none, as letter_counts has them."""
    counts = _LETTERS.format(f"lower({text})")
    return f"list_append({counts}, length({text}) - list_sum({counts}))::DOUBLE[]"


@query(f"""WITH d AS (SELECT DISTINCT p_type AS t, p_brand AS c, unnest([p_name, p_brand || ' of ' || p_type]) AS content FROM part), e AS (SELECT *, {_vector_sql('content')} AS v FROM d),
k AS (SELECT DISTINCT p_name AS qid, p_type AS keyword, unnest(['what is ' || p_name || ' ' || p_type, p_type || ' ' || p_type]) AS content FROM part), q AS (SELECT DISTINCT content, {_vector_sql('content')} AS v FROM k),
s AS (SELECT q.content, t, c, round(list_cosine_similarity(q.v, e.v), 6) AS score FROM q, e)
SELECT qid, keyword, t AS "table", c AS "column", max(score) AS score FROM s JOIN k USING (content) WHERE score >= 0.8 GROUP BY ALL""")
def similar_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """Columns with a description like a part's name or type, from all lists of the index."""
    p = table(spark, sf, "part")
    descriptions = p.select(F.col("p_type").alias("table"), F.col("p_brand").alias("column"), F.col("p_name").alias("column_name"), F.lit("").alias("column_description"), F.concat("p_brand", F.lit(" of "), "p_type").alias("value_description"))
    index = vector_index.DescriptionIndex(spark, scratch_path(spark, "description-index"), letter_counts, vector_index.Lists(16, None)).build(descriptions.distinct())
    asked = p.select(F.col("p_name").alias("qid"), F.concat(F.lit("what is "), "p_name").alias("question"), F.col("p_type").alias("evidence"), F.col("p_type").alias("keyword")).distinct()
    return index.similar_columns(asked, None, 0.8)
