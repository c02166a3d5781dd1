"""Queries of the graph and vector stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph, stores
from quillgraph.registry import query
from quillgraph.session import table

# nodes are parts, edges the parts and suppliers of lines; half of them are stored and a part is new


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.create_map(F.lit("type"), "p_type", F.lit("size"), F.col("p_size").cast("string")).alias("props"))


@query("""SELECT p_partkey AS node, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS type, CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END AS size FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0""")
def upsert_nodes(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "part").filter("p_partkey % 3 = 0").select(F.col("p_partkey").alias("node"), F.create_map(F.lit("type"), "p_brand").alias("props"))
    out = stores.upsert_nodes(_nodes(spark, sf).filter("node % 2 = 0"), new)
    return out.select("node", F.col("props")["type"].alias("type"), F.col("props")["size"].alias("size"))


_PAIRS = "SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem"


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).distinct()


@query(f"""WITH e AS ({_PAIRS}), n AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 5 <> 0) SELECT src, dst, CASE WHEN src % 2 = 0 THEN 'old' END AS a, CASE WHEN src % 3 = 0 AND src IN (FROM n) AND dst IN (FROM n) THEN 'new' WHEN src % 2 = 0 THEN 'first' END AS b
FROM e WHERE src % 2 = 0 OR (src % 3 = 0 AND src IN (FROM n) AND dst IN (FROM n))""")
def upsert_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = _pairs(spark, sf)
    old = e.filter("src % 2 = 0").withColumn("props", F.create_map(F.lit("a"), F.lit("old"), F.lit("b"), F.lit("first")))
    new = e.filter("src % 3 = 0").withColumn("props", F.create_map(F.lit("b"), F.lit("new")))
    out = stores.upsert_edges(old, new, _nodes(spark, sf).filter("node % 5 <> 0"))
    return out.select("src", "dst", F.col("props")["a"].alias("a"), F.col("props")["b"].alias("b"))


@query("SELECT s_suppkey * 7 AS node, p_partkey IS NOT NULL AS there, p_type AS type FROM supplier LEFT JOIN part ON p_partkey = s_suppkey * 7")
def look_up_nodes(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "supplier").select((F.col("s_suppkey") * 7).alias("node"))
    return stores.look_up_nodes(ids, _nodes(spark, sf)).select("node", "there", F.col("props")["type"].alias("type"))


@query(f"WITH e AS ({_PAIRS}) SELECT p_partkey AS src, 3::BIGINT AS dst, e.src IS NOT NULL AS there FROM part LEFT JOIN e ON e.src = p_partkey AND e.dst = 3")
def look_up_edges(spark: SparkSession, sf: str) -> DataFrame:
    return stores.look_up_edges(table(spark, sf, "part").select(F.col("p_partkey").alias("src"), F.lit(3).cast("long").alias("dst")), _pairs(spark, sf))


@query(f"WITH e AS ({_PAIRS}) SELECT 'out' AS way, src, dst FROM e WHERE src % 10 = 0 UNION ALL SELECT 'in', src, dst FROM e WHERE dst % 10 = 0")
def node_edges(spark: SparkSession, sf: str) -> DataFrame:
    e, ids = _pairs(spark, sf), table(spark, sf, "part").select(F.col("p_partkey").alias("node")).filter("node % 10 = 0")
    ids = ids.union(table(spark, sf, "supplier").select("s_suppkey").filter("s_suppkey % 10 = 0"))
    return stores.out_edges(e, ids).select(F.lit("out").alias("way"), "src", "dst").union(stores.in_edges(e, ids).select(F.lit("in"), "src", "dst"))


def _every_seventh(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "part").select(F.col("p_partkey").alias("node")).union(table(spark, sf, "supplier").select("s_suppkey"))
    return both.filter("node % 7 = 0").distinct()


@query(f"WITH e AS ({_PAIRS}) SELECT 'node' AS kind, p_partkey AS a, NULL::BIGINT AS b FROM part WHERE p_partkey % 7 <> 0 UNION ALL SELECT 'edge', src, dst FROM e WHERE src % 7 <> 0 AND dst % 7 <> 0")
def delete_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    left, edges = graph.drop_nodes(nodes, _pairs(spark, sf), _every_seventh(spark, sf))
    return left.select(F.lit("node").alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b")).union(edges.select(F.lit("edge"), "src", "dst"))


@query(f"""WITH e AS ({_PAIRS}), g AS (SELECT s_suppkey AS node FROM supplier WHERE s_suppkey % 4 = 0)
SELECT 'node' AS store, count(*) AS n, sum(p_partkey)::BIGINT AS total FROM part WHERE p_partkey NOT IN (FROM g) UNION ALL SELECT 'edge', count(*), sum(src + dst)::BIGINT FROM e WHERE src NOT IN (FROM g) AND dst NOT IN (FROM g)
UNION ALL SELECT 'entity', count(*), sum(vec_id)::BIGINT FROM embeddings WHERE vec_id NOT IN (FROM g) UNION ALL SELECT 'relation', count(*), sum(src)::BIGINT FROM e WHERE src NOT IN (FROM g) AND dst NOT IN (FROM g)""")
def delete_entity(spark: SparkSession, sf: str) -> DataFrame:
    e = _pairs(spark, sf)
    gone = table(spark, sf, "supplier").filter("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("node"))
    nodes, edges, entities, relations = stores.delete_entity(_nodes(spark, sf).select("node"), e, table(spark, sf, "embeddings").select(F.col("vec_id").alias("entity")), e.withColumn("v", F.lit(0.5)), gone)
    total = lambda df, name, x: df.agg(F.count("*").alias("n"), F.sum(x).alias("total")).select(F.lit(name).alias("store"), "n", "total")
    return total(nodes, "node", F.col("node")).union(total(edges, "edge", F.col("src") + F.col("dst"))).union(total(entities, "entity", F.col("entity"))).union(total(relations, "relation", F.col("src")))


@query("""WITH s AS (SELECT p_brand AS name, min(p_type) AS entity_type, p_size FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand, p_size),
st AS (SELECT name, min(entity_type) AS entity_type, list(DISTINCT p_size::VARCHAR) AS d FROM s GROUP BY name),
nw AS (SELECT p_brand AS name, p_type, p_size::VARCHAR AS d, p_partkey FROM part WHERE p_partkey % 5 = 1),
k AS (SELECT name, t, count(*) AS n, min(q) AS q FROM (SELECT name, p_type AS t, p_partkey AS q FROM nw UNION ALL SELECT name, entity_type, 4611686018427387903 FROM st WHERE name IN (SELECT name FROM nw)) GROUP BY ALL),
b AS (SELECT name, arg_max(t, (n, -q)) AS entity_type FROM k GROUP BY name),
d AS (SELECT name, string_agg(DISTINCT x, '<SEP>' ORDER BY x) AS description FROM (SELECT name, unnest(d) AS x FROM st UNION ALL SELECT name, d FROM nw) GROUP BY name)
SELECT name, coalesce(b.entity_type, st.entity_type) AS entity_type, description FROM d LEFT JOIN b USING (name) LEFT JOIN st USING (name)""")
def merge_into_nodes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_size").cast("string").alias("description"), F.lit("c").alias("source_id"), F.col("p_partkey").alias("seq"))
    stored = p.filter("seq % 2 = 0").groupBy("name").agg(F.min("entity_type").alias("entity_type"), F.array_join(F.array_sort(F.collect_set("description")), "<SEP>").alias("description"), F.min("source_id").alias("source_id"))
    return stores.merge_into_nodes(stored, p.filter("seq % 5 = 1")).select("name", "entity_type", "description")


@query("""WITH st AS (SELECT p_brand AS src, p_type AS dst, p_size FROM part WHERE p_partkey % 2 = 0), nw AS (SELECT p_brand AS src, p_type AS dst, p_size FROM part WHERE p_partkey % 5 = 1)
SELECT src, dst, sum(p_size)::DOUBLE AS weight, string_agg(DISTINCT p_size::VARCHAR, '<SEP>' ORDER BY p_size::VARCHAR) AS description FROM (FROM st UNION ALL FROM nw) GROUP BY ALL""")
def merge_into_edges(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    p = table(spark, sf, "part").select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.col("p_size").cast("double").alias("weight"), size.alias("description"), F.lit("k").alias("keywords"), F.lit("c").alias("source_id"), "p_partkey")
    from quillgraph.operators.text import merge_edges

    return stores.merge_into_edges(merge_edges(p.filter("p_partkey % 2 = 0")), p.filter("p_partkey % 5 = 1")).select("src", "dst", "weight", "description")


@query("""WITH c AS (SELECT n_regionkey AS source_id, min('chunk-' || n_nationkey) AS chunk_id FROM nation WHERE n_regionkey < 3 GROUP BY 1),
r AS (SELECT '"' || lower(c_name) || '"' AS src, '"' || lower(n_name) || '"' AS dst, coalesce(chunk_id, 'UNKNOWN') AS s FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN c ON source_id = n_regionkey WHERE c_custkey % 10 = 0),
e AS (SELECT '"' || lower(n_name) || '"' AS node, 'nation' AS entity_type, coalesce(chunk_id, 'UNKNOWN') AS s FROM nation LEFT JOIN c ON source_id = n_regionkey WHERE n_nationkey % 2 = 0)
SELECT node, entity_type, s AS source_id FROM e UNION ALL SELECT node, 'UNKNOWN', min(s) FROM (SELECT src AS node, s FROM r UNION ALL SELECT dst, s FROM r) WHERE node NOT IN (SELECT node FROM e) GROUP BY node""")
def custom_graph(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    chunks = n.filter("n_regionkey < 3").groupBy(F.col("n_regionkey").alias("source_id")).agg(F.min(F.concat(F.lit("chunk-"), "n_nationkey")).alias("chunk_id"))
    entities = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("entity_name"), F.lit("nation").alias("entity_type"), F.lit(None).cast("string").alias("description"), F.col("n_regionkey").alias("source_id"))
    relations = table(spark, sf, "customer").filter("c_custkey % 10 = 0").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    relations = relations.select(F.col("c_name").alias("src_id"), F.col("n_name").alias("tgt_id"), F.lit("d").alias("description"), F.lit("k").alias("keywords"), F.lit(None).cast("double").alias("weight"), F.col("n_regionkey").alias("source_id"))
    return stores.custom_graph(chunks, entities, relations)[0].select("node", "entity_type", "source_id")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS content, CASE WHEN vec_id % 3 = 0 THEN 2.0 ELSE 1.0 END::DOUBLE AS first FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0")
def upsert_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    stored = e.filter("id % 2 = 0").select("id", F.lit("old").alias("content"), F.array(F.lit(1.0)).alias("vector"))
    new = e.filter("id % 3 = 0").select("id", F.lit("new").alias("content"))
    return stores.upsert_vectors(stored, new, lambda df: df.withColumn("vector", F.array(F.lit(2.0)))).select("id", "content", F.col("vector")[0].alias("first"))


@query(f"""WITH e AS ({_PAIRS}), g AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1) SELECT s_suppkey * 3 AS node, p_type AS type, coalesce(degree, 0) AS rank FROM supplier JOIN part ON p_partkey = s_suppkey * 3 LEFT JOIN g ON node = s_suppkey * 3""")
def hits_with_nodes(spark: SparkSession, sf: str) -> DataFrame:
    hits = table(spark, sf, "supplier").select((F.col("s_suppkey") * 3).alias("node"))
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("type"))
    return stores.hits_with_nodes(hits, nodes, graph.degrees(_pairs(spark, sf))).select("node", "type", "rank")


@query("SELECT DISTINCT least(l_partkey, l_suppkey) AS u, greatest(l_partkey, l_suppkey) AS v, least(l_partkey, l_suppkey) || ' -> ' || greatest(l_partkey, l_suppkey) AS label FROM lineitem")
def stable_edges(spark: SparkSession, sf: str) -> DataFrame:
    return stores.stable_edges(_pairs(spark, sf))
