"""Queries of chunks by tokens, statements under a time limit, and communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import communities, graph, running, tokens
from quillgraph.registry import query
from quillgraph.session import scratch_path, table
from quillgraph.sources import caches


@query(r"""WITH c AS (SELECT doc_id, text, unnest(generate_series(0, length(text) - 1, 1100)) AS start FROM documents WHERE length(text) > 0)
SELECT doc_id AS full_doc_id, (start // 1100)::INT AS chunk_order_index, start::INT AS start, least(1200, length(text) - start)::INT AS tokens, 'chunk-' || md5(regexp_replace(substr(text, (start + 1)::INT, 1200), '^\s+|\s+$', '', 'g')) AS chunk_id FROM c""")
def chunks_by_tokenizer(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.token_chunks(table(spark, sf, "documents"), tokens.CodePoints()).drop("content")


_STATEMENTS = ("SELECT c_custkey FROM bq_customer WHERE c_nationkey = {0}", "SELECT c_custkey FROM bq_customer WHERE c_nationkey = {0} + 1000", "SELEC c_custkey FROM bq_customer WHERE c_nationkey = {0}")


@query("""SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 2 THEN 'SYNTACTICALLY_INCORRECT' WHEN 1 THEN 'EMPTY_RESULT' ELSE CASE WHEN EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey) THEN 'CORRECT' ELSE 'EMPTY_RESULT' END END AS status,
CASE WHEN n_nationkey % 3 = 0 THEN least(30, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey)) ELSE 0 END AS n_rows FROM nation""")
def statement_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """A statement for each nation, run side by side."""
    table(spark, sf, "customer").createOrReplaceTempView("bq_customer")
    keys = [r[0] for r in table(spark, sf, "nation").select("n_nationkey").collect()]  # a statement each
    found = running.run_all(spark, [(k, _STATEMENTS[k % 3].format(k)) for k in keys], (120.0,))
    return spark.createDataFrame([(o.id, o.status, len(o.rows)) for o in found], "id int, status string, n_rows long")


@query()
def place_communities(spark: SparkSession, sf: str) -> DataFrame:
    """Regions, their nations and suppliers."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("u"), (F.col("n_nationkey") + 100).cast("long").alias("v"))
    s = table(spark, sf, "supplier").select((F.col("s_nationkey") + 100).cast("long").alias("u"), (F.col("s_suppkey") + 1000).alias("v"))
    return communities.communities(graph.cut(graph.adjacency(n.union(s).withColumn("w", F.lit(1.0)))))


@query("""WITH u AS (SELECT DISTINCT user_id::VARCHAR AS key, user_id % 3 AS batch FROM events), k AS (SELECT key FROM u ORDER BY batch DESC, key DESC LIMIT 100)
SELECT key, key IN (FROM k) AS hit, CASE WHEN key IN (FROM k) THEN 2 * key::BIGINT END AS value, false AS stale_hit FROM u""")
def bounded_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Three batches of users in a cache of 100 entries, asked for all users, and again once the graph changed."""
    users = table(spark, sf, "events").select("user_id").distinct()
    graph_ = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    now, later = caches.version_of(graph_), caches.version_of(graph_.filter("n_nationkey > 0"))
    cache = caches.Cache(spark, scratch_path(spark, "cache"), "long", 100)
    for k in range(3):
        cache.put(users.filter(F.col("user_id") % 3 == k).select(F.col("user_id").cast("string").alias("key"), (2 * F.col("user_id")).alias("value")), now)
    keys = users.select(F.col("user_id").cast("string").alias("key"))
    again = cache.get(keys, later).select("key", F.col("hit").alias("stale_hit"))
    return cache.get(keys, now).join(again, "key").select("key", "hit", "value", "stale_hit")
