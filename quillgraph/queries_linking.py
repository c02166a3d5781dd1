"""Queries of names and keywords: quoting, search values, column names, index choice, widths, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.operators import linking, rendering, schemas
from quillgraph.registry import query
from quillgraph.session import table

_WORDS = ", ".join(f"'{w}'" for w in C.RESERVED)
_SIGNS = C.NAME_SIGNS.replace("'", "''")


@query(
    f"""WITH n AS (SELECT n_name AS name FROM nation UNION SELECT replace(upper(p_brand), '#', '_') FROM part UNION SELECT unnest(string_split(upper(p_type), ' ')) FROM part UNION SELECT p_type FROM part
UNION SELECT unnest(string_split(text, ' ')) FROM benchmark) SELECT name, CASE WHEN name = '' OR regexp_matches(name, '{_SIGNS}') OR regexp_matches(name, '^\\p{{Nd}}') OR name <> upper(name) OR lower(name) IN ({_WORDS})
THEN '"' || replace(name, '"', '""') || '"' ELSE name END AS quoted FROM n"""
)
def quote_identifiers(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name")).union(part.select(F.replace(F.upper("p_brand"), F.lit("#"), F.lit("_"))))
    names = names.union(part.select(F.explode(F.split(F.upper("p_type"), " ")))).union(part.select("p_type"))
    names = names.union(table(spark, sf, "benchmark").select(F.explode(F.split("text", " ")))).distinct()
    return names.select("name", C.quote_identifier(F.col("name")).alias("quoted"))


@query("""WITH k AS (SELECT p_size AS question, p_brand || ' = ' || p_name AS keyword FROM part),
s AS (SELECT question, keyword, keyword AS piece FROM k UNION ALL SELECT question, keyword, trim(keyword[strpos(keyword, '=') + 1 :]) FROM k
UNION ALL SELECT question, keyword, unnest(flatten(list_transform(list_filter(generate_series(1, length(keyword)), lambda i: keyword[i] = ' '), lambda i: [left(keyword, i - 1), substr(keyword, i + 1)]))) FROM k)
SELECT question, keyword, piece, row_number() OVER (PARTITION BY question ORDER BY keyword DESC, length(piece) DESC, piece DESC)::INT AS place FROM s""")
def search_values(spark: SparkSession, sf: str) -> DataFrame:
    return linking.search_values(table(spark, sf, "part").select(F.col("p_size").alias("question"), F.concat("p_brand", F.lit(" = "), "p_name").alias("keyword")))


@query()
def matching_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Part names as columns, types and sizes as tables, against words of part names."""
    p = table(spark, sf, "part")
    names = linking.possible_names(p.select(F.col("p_partkey").alias("question"), F.concat("p_brand", F.lit(" = "), "p_name").alias("keyword")))
    return linking.matching_columns(names, p.select(F.col("p_type").alias("table"), F.explode(F.split("p_name", " ")).alias("column")).distinct())


@query(f"""WITH v AS (SELECT DISTINCT p_type || ' name' AS c, p_name AS v FROM part UNION SELECT p_type || '_id', p_name FROM part UNION SELECT p_type || 'Id', p_name FROM part),
s AS (SELECT c AS "column", 'VARCHAR(9)' AS type, false AS is_key, count(*) AS distinct_count, sum(length(v))::BIGINT AS total_length, avg(length(v)) AS avg_length FROM v GROUP BY c)
SELECT "column", distinct_count, total_length FROM s WHERE NOT regexp_matches(lower("column"), '(_ref|_id| id|url|email|web|time|phone|date|address)') AND NOT ends_with("column", 'Id')
AND ((lower("column") LIKE '%name%' AND total_length < 5000000) OR (total_length < 2000000 AND avg_length < 25) OR distinct_count < 100)""")
def indexable_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Each part type as three columns, of which only the name is worth an index."""
    p = table(spark, sf, "part")
    held = p.select(F.explode(F.array(*[F.concat("p_type", F.lit(x)) for x in (" name", "_id", "Id")])).alias("column"), F.col("p_name").alias("v")).distinct()
    profile = held.groupBy("column").agg(F.count("*").alias("distinct_count"), F.sum(F.length("v")).alias("total_length"), F.avg(F.length("v")).alias("avg_length"))
    return linking.indexable_columns(profile.withColumns({"type": F.lit("VARCHAR(9)"), "is_key": F.lit(False)})).select("column", "distinct_count", "total_length")


@query("""WITH w AS (SELECT ps.l_orderkey AS src, ps.l_partkey AS dst, ps.l_linenumber AS k, CASE WHEN ps.l_linenumber = 7 THEN 0.0 ELSE ps.l_quantity::DOUBLE END AS weight FROM lineitem ps),
m AS (SELECT min(weight) AS a, max(weight) AS b FROM w WHERE weight > 0) SELECT src, dst, k, round(CASE WHEN weight > 0 THEN CASE WHEN b > a THEN 0.5 + 3.5 * (weight - a) / (b - a) ELSE 1.0 END ELSE 0.5 END, 9)::DOUBLE AS width FROM w, m""")
def line_widths(spark: SparkSession, sf: str) -> DataFrame:
    weight = F.when(F.col("l_linenumber") == 7, F.lit(0.0)).otherwise(F.col("l_quantity").cast("double"))
    edges = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("k"), weight.alias("weight"))
    return rendering.line_widths(edges).select("src", "dst", "k", F.round("width", 9).alias("width"))


@query("SELECT c_nationkey, c_custkey, CASE WHEN row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM customer")
def alternating_roles(spark: SparkSession, sf: str) -> DataFrame:
    return rendering.alternating_roles(table(spark, sf, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey")


@query("""WITH t AS (SELECT p_brand AS db, p_type AS t, count(DISTINCT p_size) AS n FROM part GROUP BY 1, 2), d AS (SELECT db, count(*) AS tables, sum(n) AS columns FROM t GROUP BY 1)
SELECT count(*) AS n_dbs, round(avg(tables), 2) AS tables, round(avg(columns), 2) AS columns, round(avg(columns / tables), 2) AS columns_per_table FROM d""")
def database_stats(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.database_stats(table(spark, sf, "part").select(F.col("p_brand").alias("db"), F.col("p_type").alias("table"), F.col("p_size").alias("column")))


@query()
def reference_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers of a nation as keys, each referring to those a fixed step before and behind."""
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("db"), F.col("s_suppkey").alias("pos"), F.col("s_suppkey").alias("key"))
    return schemas.reference_classes(s.withColumn("ref_key", (F.col("key") * 7) % 50))
