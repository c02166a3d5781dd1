"""Queries of schema rows, keys and SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import graph, profile, schemas, sql_text
from quillgraph.registry import query
from quillgraph.session import table

# a schema to work on: brands are tables, types their columns, the smallest part of each its place
_SCHEMA = "s AS (SELECT p_brand AS t, p_type AS c, min(p_partkey) AS pos, min(p_size) < 10 AS is_key FROM part GROUP BY 1, 2)"
_REFS = "r AS (SELECT DISTINCT a.t AS t, a.c AS c, b.t AS rt, b.c AS rc FROM s a JOIN s b ON b.pos = a.pos + 7)"


def _schema(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.groupBy(F.col("p_brand").alias("table"), F.col("p_type").alias("column")).agg(F.min("p_partkey").alias("pos"), (F.min("p_size") < 10).alias("is_key"))


def _references(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf)
    r = s.select(F.col("table").alias("ref_table"), F.col("column").alias("ref_column"), (F.col("pos") - 7).alias("pos"))
    return s.join(r, "pos").select("table", "column", "ref_table", "ref_column")


def _upper(df: DataFrame) -> DataFrame:
    return df.withColumns({"table": F.upper("table"), "column": F.upper("column")})


@query(f'WITH {_SCHEMA} SELECT t AS "table", c AS "column" FROM s WHERE pos % 3 = 0')
def schema_selection(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf)
    return schemas.select_columns(s, _upper(s.filter("pos % 3 = 0"))).select("table", "column")


@query(f"""WITH {_SCHEMA}, e AS (SELECT 0 AS k, pos, t, c FROM s WHERE pos % 2 = 0 UNION ALL SELECT 1, pos, upper(t), upper(c) FROM s WHERE pos % 3 = 0 OR pos % 5 = 0),
n AS (SELECT lower(t) AS lt, arg_min(t, (k, pos)) AS t FROM e GROUP BY 1) SELECT n.t AS "table", x.c AS "column" FROM (SELECT lower(t) AS lt, lower(c) AS lc, arg_min(c, (k, pos)) AS c FROM e GROUP BY 1, 2) x JOIN n USING (lt)""")
def schema_union(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf)
    return schemas.union_schemas(s.filter("pos % 2 = 0"), _upper(s.filter("pos % 3 = 0 or pos % 5 = 0")))


@query(f'WITH {_SCHEMA} SELECT t AS "table", c AS "column" FROM s WHERE pos % 2 = 0 UNION ALL SELECT upper(t), upper(c) FROM s WHERE pos % 2 = 1')
def schema_additions(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf)
    return schemas.add_missing(s.filter("pos % 2 = 0"), _upper(s))


@query(f'WITH {_SCHEMA} SELECT t AS "table", c AS "column", CASE WHEN pos % 2 = 0 THEN pos END AS place FROM s')
def schema_fields(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf)
    return schemas.add_fields(s.select("table", "column"), _upper(s.filter("pos % 2 = 0")).select("table", "column", F.col("pos").alias("place")))


@query(f"""WITH {_SCHEMA}, h AS (SELECT * FROM s WHERE pos % 4 = 0 AND t < 'Brand#3') SELECT 'table' AS kind, t AS "table", NULL AS "column" FROM s WHERE t NOT IN (SELECT t FROM h) GROUP BY t
UNION ALL SELECT 'column', t, c FROM s WHERE t IN (SELECT t FROM h) AND (t, c) NOT IN (SELECT (t, c) FROM h)""")
def schema_gaps(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf)
    return schemas.missing_from(_upper(s.filter("pos % 4 = 0 and table < 'Brand#3'")), s)


@query(f'WITH {_SCHEMA}, {_REFS} SELECT t AS "table", c AS "column", rt AS ref_table, rc AS ref_column FROM r WHERE t < \'Brand#3\' AND rt < \'Brand#3\'')
def closed_references(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.closed_references(_references(spark, sf), _schema(spark, sf).filter("table < 'Brand#3'")).select("table", "column", "ref_table", "ref_column")


@query(f"""WITH {_SCHEMA}, {_REFS}, m AS (SELECT * FROM s WHERE t < 'Brand#3'), x AS (SELECT * FROM r WHERE t < 'Brand#3' AND rt < 'Brand#3')
SELECT t AS "table", c AS "column" FROM m WHERE is_key OR (t, c) IN (SELECT (t, c) FROM x) OR (t, c) IN (SELECT (rt, rc) FROM x) OR EXISTS (SELECT 1 FROM m o WHERE o.is_key AND o.c = m.c AND o.t <> m.t)""")
def connecting_columns(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf)
    return schemas.connecting_columns(s, _references(spark, sf), s.filter("table < 'Brand#3'"))


@query(f'WITH {_SCHEMA} SELECT count(*) AS "full", count(*) FILTER (pos % 3 = 0) AS "current", round((count(*) - count(*) FILTER (pos % 3 = 0)) / count(*) * 100, 2) AS rate FROM s')
def schema_reduction(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf)
    return schemas.reduction_rate(s, s.filter("pos % 3 = 0"))


@query('SELECT p_brand AS "table", p_type AS "column", max(p_retailprice) AS score FROM part GROUP BY 1, 2')
def merged_scores(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.merge_scores(table(spark, sf, "part").select(F.col("p_brand").alias("table"), F.col("p_type").alias("column"), F.col("p_retailprice").alias("score")))


@query("""SELECT l_orderkey AS "group", l_returnflag AS "table", l_linestatus AS ref_table, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS columns, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS ref_columns FROM lineitem GROUP BY ALL""")
def composite_keys(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_returnflag").alias("table"), F.col("l_linenumber").cast("string").alias("column"), F.col("l_linestatus").alias("ref_table"), F.col("l_partkey").cast("string").alias("ref_column"), F.col("l_linenumber").alias("pos"))
    return schemas.composite_keys(x).withColumns({"columns": F.array_join("columns", ","), "ref_columns": F.array_join("ref_columns", ",")})


@query("""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_linenumber = 1), n AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem WHERE l_suppkey % 2 = 0 AND l_partkey % 3 = 0),
b AS (SELECT src, dst FROM n UNION SELECT dst, src FROM n) SELECT src, dst, 1.0::DOUBLE AS weight FROM e UNION ALL SELECT src, dst, 1.2::DOUBLE FROM b WHERE (src, dst) NOT IN (SELECT (src, dst) FROM e)""")
def added_relationships(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_linenumber")
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"))
    nodes = nodes.filter("node % 3 = 0").union(table(spark, sf, "supplier").select("s_suppkey").filter("s_suppkey % 2 = 0")).distinct()
    new = line.filter("src % 3 = 0 and dst % 2 = 0").select("src", "dst", F.lit(1.2).alias("weight"))
    return schemas.add_relationships(line.filter("l_linenumber = 1").select("src", "dst", F.lit(1.0).alias("weight")).distinct(), nodes, new)


@query(f"WITH {_SCHEMA} SELECT t AS \"table\", t || ': ' || string_agg(c, ', ' ORDER BY pos, c) AS line FROM s GROUP BY t")
def column_listing(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.column_listing(_schema(spark, sf))


@query(f"WITH {_SCHEMA} SELECT t AS \"table\", string_agg(c, ',' ORDER BY pos, c) AS columns FROM s WHERE is_key GROUP BY t")
def key_lists(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.key_lists(_schema(spark, sf).filter("is_key")).withColumn("columns", F.array_join("columns", ","))


@query(f"WITH {_SCHEMA}, {_REFS} SELECT t AS \"table\", c AS \"column\", 'to' AS way, rt AS other_table, rc AS other_column FROM r UNION ALL SELECT rt, rc, 'from', t, c FROM r")
def referenced_by(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.referenced_by(_references(spark, sf))


@query(f"WITH {_SCHEMA}, {_REFS}, k AS (SELECT t, arg_min(c, pos) AS c FROM s WHERE is_key GROUP BY t) SELECT r.t AS \"table\", r.c AS \"column\", rt AS ref_table, CASE WHEN rc LIKE 'S%' THEN rc ELSE k.c END AS ref_column FROM r LEFT JOIN k ON k.t = rt")
def implicit_targets(spark: SparkSession, sf: str) -> DataFrame:
    refs = _references(spark, sf).withColumn("ref_column", F.when(F.col("ref_column").startswith("S"), F.col("ref_column")))
    return schemas.implicit_targets(refs, _schema(spark, sf).filter("is_key"))


@query("""WITH u AS (SELECT l_orderkey AS name, l_returnflag AS t, l_partkey AS c, l_linenumber AS pos FROM lineitem) SELECT a.t AS "table", a.c AS "column", b.t AS ref_table, b.c AS ref_column
FROM u a LEFT JOIN u b ON b.name = CASE WHEN a.name % 2 = 0 THEN a.name + 1 END AND b.pos = a.pos""")
def declared_keys(spark: SparkSession, sf: str) -> DataFrame:
    usage = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("name"), F.col("l_returnflag").alias("table"), F.col("l_partkey").alias("column"), F.col("l_linenumber").alias("pos"))
    constraints = usage.select("name").distinct().select("name", F.when(F.col("name") % 2 == 0, F.col("name") + 1).alias("ref_name"))
    return schemas.declared_keys(constraints, usage)


@query("SELECT l_returnflag AS db, l_linestatus AS \"column\", count(*) AS n FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_linestatus = 'F') GROUP BY ALL")
def skipped_columns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("db"), F.col("l_linestatus").alias("column"))
    skipped = spark.createDataFrame([("R", "f"), (None, "never")], "db string, column string")
    return schemas.skip_columns(rows, skipped).groupBy("db", "column").agg(F.count("*").alias("n"))


@query(f"""WITH {_SCHEMA}, {_REFS} SELECT count(DISTINCT substr(t, 1, 7)) AS databases, count(DISTINCT (substr(t, 1, 7), substr(c, 1, 1))) AS schemas, count(DISTINCT (substr(t, 1, 7), substr(c, 1, 1), t)) AS tables, count(*) AS columns,
count(DISTINCT (substr(t, 1, 7), substr(c, 1, 1), t)) FILTER (is_key) AS key_tables, (SELECT count(DISTINCT t) FROM r) AS reference_tables, (SELECT count(*) FROM r) AS relationships FROM s""")
def schema_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf).withColumns({"db": F.substring("table", 1, 7), "schema": F.substring("column", 1, 1)})
    return schemas.summary_counts(s, _references(spark, sf))


@query("""WITH f AS (SELECT * FROM orders ORDER BY o_orderkey LIMIT 3) SELECT 'o_orderstatus' AS "column", string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS values FROM f UNION ALL SELECT 'o_custkey', string_agg(o_custkey::VARCHAR, '|' ORDER BY o_orderkey) FROM f""")
def sample_values(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.sample_values(table(spark, sf, "orders"), "o_orderkey", ["o_orderstatus", "o_custkey"]).withColumn("values", F.array_join("values", "|"))


@query("""WITH v AS (SELECT p_brand AS c, p_type AS v, min(p_partkey) AS pos FROM part WHERE length(p_type) BETWEEN 1 AND 25 GROUP BY 1, 2) SELECT c AS "column", v AS value FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY pos, v) AS r FROM v) WHERE r <= 2""")
def short_examples(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.short_examples(table(spark, sf, "part").select(F.col("p_brand").alias("column"), F.col("p_type").alias("value"), F.col("p_partkey").alias("pos")))


@query("SELECT p_partkey, length(p_name || p_type) < 50 AS shown, list_contains([p_size], 5) AND list_contains([p_size], 5) AS holds FROM part")
def display_filters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", schemas.displayable(F.concat("p_name", "p_type")).alias("shown"), schemas.contains_all(F.array("p_size"), F.array(F.lit(5))).alias("holds"))


@query(f"""WITH {_SCHEMA} SELECT a.t AS "table", a.c AS "column", b.t AS ref_table, b.c AS ref_column, 'medium' AS confidence FROM s a JOIN s b ON a.c = b.c AND a.t <> b.t AND b.is_key AND b.pos % 5 = 0""")
def reference_names(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf).withColumn("type", F.lit("TEXT"))
    keys = s.filter("is_key and pos % 5 = 0").select(F.col("table").alias("ref_table"), F.col("column").alias("ref_column"), F.col("type").alias("ref_type"))
    return profile.reference_names(s, keys)


_G = "e AS (SELECT DISTINCT n_regionkey AS a, 100 + n_nationkey AS b, (1 + n_nationkey % 3)::DOUBLE AS w FROM nation), adj AS (SELECT a AS u, b AS v, w FROM e UNION ALL SELECT b, a, w FROM e)"


@query(f"""WITH {_G}, t AS (SELECT u, v, w FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS r FROM adj) WHERE r <= 3), b AS (SELECT u, v, sum(w) / 2 AS w FROM (SELECT * FROM t UNION ALL SELECT v, u, w FROM t) GROUP BY ALL),
l AS (SELECT u, v, sum(w) AS w FROM (SELECT * FROM b UNION ALL SELECT DISTINCT u, u, 1.0::DOUBLE FROM adj) GROUP BY ALL), p AS (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS w FROM l),
p2 AS (SELECT a.u, b.v, sum(a.w * b.w) AS w FROM p a JOIN p b ON a.v = b.u GROUP BY ALL), p3 AS (SELECT a.u, b.v, sum(a.w * b.w) AS w FROM p2 a JOIN p b ON a.v = b.u GROUP BY ALL)
SELECT p3.u, p3.v, round(p3.w, 9) AS w FROM p3 JOIN adj ON adj.u = p3.u AND adj.v = p3.v""")
def network_diffusion(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation")
    e = n.select(F.col("n_regionkey").alias("u"), (F.col("n_nationkey") + 100).alias("v"), (1 + F.col("n_nationkey") % 3).cast("double").alias("w")).distinct()
    return schemas.network_diffusion(graph.adjacency(e), 3).withColumn("w", F.round("w", 9))


# ---- SQL text

_SQL = "'SELECT \"N\", ''It'' FROM part WHERE p_size > = ' || p_partkey || ' AND p_type = ''' || p_type || ''' ; -- end'"


def _sql() -> F.Column:
    return F.concat(F.lit("SELECT \"N\", 'It' FROM part WHERE p_size > = "), F.col("p_partkey").cast("string"), F.lit(" AND p_type = '"), "p_type", F.lit("' ; -- end"))


@query("SELECT p_partkey, 'select ''N'', ''It'' from part where p_size >= ' || p_partkey || ' and p_type = ''' || p_type || '''' AS sql FROM part")
def normalized_sql(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", sql_text.normalize(_sql()).alias("sql"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'bigquery' WHEN 1 THEN 'bigquery' WHEN 2 THEN 'local' ELSE 'snowflake' END AS dialect FROM part")
def sql_dialects(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("bq", "ga", "local", "sf_bq")]), (F.col("p_partkey") % 4 + 1).cast("int")), F.col("p_partkey").cast("string"))
    return table(spark, sf, "part").select("p_partkey", sql_text.dialect(name).alias("dialect"))


@query("SELECT p_partkey, CASE WHEN p_size > 20 THEN left(p_name, 5) || '...' ELSE p_name END AS cut, printf('%.2f%%', p_size * 1.0) AS percent FROM (SELECT *, length(p_name) AS n FROM part)".replace("CASE WHEN p_size > 20", "CASE WHEN n > 5"))
def rendered_values(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select("p_partkey", sql_text.truncated(F.col("p_name"), 5, "...").alias("cut"), sql_text.percent(F.col("p_size") / 100).alias("percent"))


@query("SELECT p_partkey, try_cast(p_size || CASE WHEN p_partkey % 2 = 0 THEN 'x' ELSE '.5' END AS DOUBLE) IS NOT NULL AS is_number, regexp_matches(p_type, '[^A-Za-z0-9_]') AS special FROM part")
def value_kinds(spark: SparkSession, sf: str) -> DataFrame:
    v = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "x").otherwise(".5"))
    return table(spark, sf, "part").select("p_partkey", sql_text.is_number(v).alias("is_number"), sql_text.has_special(F.col("p_type")).alias("special"))


@query("SELECT p_partkey, lower(p_brand[1:5]) || '_' || p_partkey AS name FROM part".replace("p_brand[1:5]", "left(p_brand, 5)"))
def normalized_names(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit("The "), F.substring("p_brand", 1, 5), F.lit(" of a, "), F.col("p_partkey").cast("string"), F.lit("!"))
    return table(spark, sf, "part").select("p_partkey", sql_text.short_name(raw, least=0).alias("name"))


# ---- graphs of schemas and illustrations


@query(f"""WITH {_SCHEMA}, {_REFS} SELECT t || '.' || c AS dst, t AS src, 10.0::DOUBLE AS weight, 'contains' AS keywords FROM s UNION ALL SELECT rt, t, 15.0, 'references ' || rc FROM r""")
def schema_to_graph(spark: SparkSession, sf: str) -> DataFrame:
    return schemas.schema_to_graph(_schema(spark, sf).withColumn("type", F.lit("TEXT")), _references(spark, sf))[1]


@query("""WITH e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst, (l_suppkey % 4)::DOUBLE AS weight FROM lineitem), n AS (SELECT p_partkey AS node FROM part WHERE p_partkey % 5 <> 0), f AS (SELECT * FROM e WHERE weight > 0 AND src IN (FROM n) AND dst IN (FROM n))
SELECT src, dst, weight, 0.5 + 3.5 * CASE WHEN (SELECT max(weight) > min(weight) FROM f) THEN (weight - (SELECT min(weight) FROM f)) / (SELECT max(weight) - min(weight) FROM f) ELSE 1 END AS width FROM f""")
def visible_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_suppkey") % 4).cast("double").alias("weight")).distinct()
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("kind"))
    return schemas.visible_graph(nodes, e)[1].select("src", "dst", "weight", "width")


@query("""WITH e AS (SELECT l_partkey AS src, l_suppkey AS dst, sum(l_quantity) AS strength FROM lineitem GROUP BY 1, 2), d AS (SELECT node, sum(strength) AS s FROM (SELECT src AS node, strength FROM e UNION ALL SELECT dst, strength FROM e) GROUP BY 1),
r AS (SELECT p_partkey AS node, p_brand AS source, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(s, 0) DESC, p_partkey) AS r FROM part LEFT JOIN d ON node = p_partkey) SELECT node, source FROM r WHERE r <= 7 OR node % 50 = 0""")
def strongest_nodes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.sum("l_quantity").alias("strength"))
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("source"))
    return schemas.strongest_of_each_source(nodes, e, nodes.filter("node % 50 = 0"))[0]


@query(f"WITH {_SCHEMA} SELECT t || '.' || c AS name FROM s WHERE pos % 2 = 0")
def known_columns(spark: SparkSession, sf: str) -> DataFrame:
    s = _schema(spark, sf)
    name = F.concat_ws(".", "table", "column")
    return schemas.known_columns(s.select(F.when(F.col("pos") % 2 == 0, name).otherwise(F.lower(name)).alias("name")), s)


@query("SELECT event_type || event_id AS id, event_id AS pos FROM events WHERE event_id BETWEEN 100 AND 799 AND event_type LIKE 'c%' AND event_id % 3 <> 0")
def tasks_to_run(spark: SparkSession, sf: str) -> DataFrame:
    tasks = table(spark, sf, "events").select(F.concat("event_type", "event_id").alias("id"), F.col("event_id").alias("pos"))
    return schemas.tasks_to_run(tasks, tasks.filter("pos % 3 = 0"), 100, 800, "c")


@query("SELECT p_partkey, CASE WHEN p_size < 20 THEN p_type ELSE left(p_type, 3) END AS description FROM part")
def summarised_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", "p_size", F.col("p_type").alias("description"))
    return schemas.summarised(p, 20, F.col("p_size"), lambda d: F.left(d, F.lit(3))).select("p_partkey", "description")


@query("SELECT p_partkey AS request, p_type || '0|' || p_type || '1|' || p_type || '2' AS answers FROM part")
def sampled_answers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("request"), F.col("p_type").alias("prompt"))
    return schemas.sampled_answers(p, 3, lambda t, k: F.concat(t, k.cast("string"))).withColumn("answers", F.array_join("answers", "|"))


@query("SELECT p_partkey, CASE WHEN n_name IS NOT NULL THEN n_name || '!' ELSE 'No summary' END AS summary FROM part LEFT JOIN nation ON p_partkey = n_nationkey")
def function_summaries(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("name"), F.lit("c").alias("category"), F.concat("n_name", F.lit("!")).alias("summary"))
    names = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("c/"), F.col("p_partkey").cast("string"))).otherwise(F.col("p_partkey").cast("string")).alias("name"))
    return schemas.function_summaries(names, f).select("p_partkey", "summary")


@query("""SELECT o_custkey AS subquery, rank::INT AS rank, path, reward FROM (SELECT c_custkey AS o_custkey, 1 AS rank, 'c' || c_custkey AS path, 1.0::DOUBLE AS reward FROM customer UNION ALL SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, 'o' || o_orderkey) + 1, 'o' || o_orderkey, o_totalprice FROM orders)""")
def ranked_path_rows(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.plans import schema_graph

    sure = table(spark, sf, "customer").select(F.col("c_custkey").alias("subquery"), F.concat(F.lit("c"), "c_custkey").alias("path"))
    found = table(spark, sf, "orders").select(F.col("o_custkey").alias("subquery"), F.concat(F.lit("o"), "o_orderkey").alias("path"), F.col("o_totalprice").alias("score"))
    return schema_graph.ranked_paths(sure, found).withColumn("rank", F.col("rank").cast("int"))


_GRAPH = f"""{_SCHEMA}, {_REFS}, o AS (SELECT t AS src, t || '.' || c AS dst, CASE WHEN is_key THEN 1.8 ELSE 1.0 END::DOUBLE AS w FROM s UNION ALL SELECT t, t || '.' || c, 1.8 FROM r UNION ALL SELECT t || '.' || c, rt || '.' || rc, 1.2 FROM r),
g AS (SELECT src, dst, max(w) AS weight FROM (SELECT src, dst, max(w) AS w FROM o GROUP BY ALL UNION ALL SELECT dst, src, max(w) FROM o GROUP BY ALL) z GROUP BY ALL)"""


@query(f"WITH {_GRAPH} SELECT src, dst, weight FROM g")
def schema_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.plans import schema_graph

    return schema_graph.schema_graph(_schema(spark, sf).select("table", "column", "is_key"), _references(spark, sf))[1].select("src", "dst", "weight")


def _kernel_sql(block: str) -> str:
    return f"exp(-0.8::DOUBLE * list_sum(list_transform(list_zip(a.{block}, b.{block}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


@query(f"""WITH {_GRAPH}, d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) z GROUP BY 1), k AS (SELECT DISTINCT t || '.' || c AS node FROM r),
n AS (SELECT DISTINCT t AS node, t AS tab, NULL AS type, false AS is_key, NULL::BIGINT AS pos FROM s UNION ALL SELECT t || '.' || c, t, CASE pos % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'text' ELSE 'time' END, is_key, pos FROM s),
f AS (SELECT node, tab, type, is_key, node IN (FROM k) AS is_ref, pos, [least(1, coalesce(degree, 0) / 20), (pos IS NULL)::INT, (pos IS NOT NULL)::INT, is_key::INT, (node IN (FROM k))::INT]::DOUBLE[] AS structure,
[coalesce((type = 'integer')::INT, 0), coalesce((type = 'text')::INT, 0), coalesce((type = 'time')::INT, 0), coalesce(pos % 10 / 10, 0.5), 0.5]::DOUBLE[] AS stats FROM n LEFT JOIN d USING (node)),
w AS (SELECT src, dst, weight, a.*, b.tab AS btab, b.type AS btype, b.is_key AS bkey, b.is_ref AS bref, 0.4 + 0.3 * {_kernel_sql('structure')} + 0.3 * {_kernel_sql('stats')} AS alike, list_distinct(string_split(lower(split_part(src, '.', -1)), '_')) AS x, list_distinct(string_split(lower(split_part(dst, '.', -1)), '_')) AS y
FROM g JOIN f a ON a.node = src JOIN f b ON b.node = dst)
SELECT src, dst, round(weight * (0.4 * alike + 0.6 * (0.4 * (1 + (is_key OR bkey)::INT + (is_ref OR bref)::INT) / 5 + 0.4 * (len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) + 2) / 5
+ 0.2 * (CASE WHEN type IS NULL OR btype IS NULL THEN 0.5 WHEN type = btype THEN 1 ELSE 0 END + (tab = btab)::INT) / 2)), 9)::DOUBLE AS weight FROM w""")
def reweighted_edges(spark: SparkSession, sf: str) -> DataFrame:
    """The whole schema graph, references among it, weighted anew by its nodes' and its edges' features."""
    from quillgraph.operators import graph
    from quillgraph.plans import schema_graph

    s, refs = _schema(spark, sf), _references(spark, sf)
    nodes, edges = schema_graph.schema_graph(s.select("table", "column", "is_key"), refs)
    edges = graph.cut(edges)
    name = F.concat_ws(".", "table", "column")
    kind = F.element_at(F.array(*map(F.lit, ("integer", "text", "time"))), (F.col("pos") % 3 + 1).cast("int"))
    referring = refs.select(name.alias("node")).distinct().withColumn("is_reference", F.lit(True))
    own = s.select(name.alias("node"), "table", kind.alias("kind"), "is_key", (F.col("pos") % 10 / 10).alias("cardinality"), F.lit(0.5).alias("nullability"))
    whole = s.select(F.col("table").alias("node"), "table", F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("double"), F.lit(0.5)).distinct()
    profile = own.union(whole).join(referring, "node", "left").na.fill(False, ["is_reference"])
    features = schema_graph.node_features(nodes.distinct(), graph.degrees(edges), profile.drop("table"))
    kinds = edges.withColumn("kind", F.when(F.contains("src", F.lit(".")) & F.contains("dst", F.lit(".")), "reference").otherwise("table_column"))
    blocks = schemas.edge_features(kinds, profile.withColumnRenamed("kind", "type_name"))
    return schema_graph.reweight(edges, features, blocks).select("src", "dst", F.round("weight", 9).alias("weight"))


_EW = """0.4 * (0.5 + node / 200.0) + 0.6 * (0.4 * (1 + CASE WHEN k THEN 1 ELSE 0 END) / 5.0 + 0.4 * (1 + 4 * 0.5) / 5.0 + 0.2 * (CASE WHEN k THEN 1 ELSE 0 END + 1) / 2.0)"""


@query(f"SELECT 'a.x' AS src, 'b' || p_partkey || '.x' AS dst, round({_EW.replace('node', 'p_size').replace('k THEN', 'p_size % 2 = 0 THEN')}, 9)::DOUBLE AS weight FROM part")
def schema_edge_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of equal names and one table; an even size makes the far end a key of the same type."""
    p = table(spark, sf, "part")
    even = F.col("p_size") % 2 == 0
    name = F.concat(F.lit("b"), "p_partkey", F.lit(".x"))
    ends = p.select(name.alias("node"), F.lit("t").alias("table"), F.when(even, "INT").otherwise("TEXT").alias("type_name"), even.alias("is_key"), F.lit(False).alias("is_reference"))
    ends = ends.union(p.limit(1).select(F.lit("a.x"), F.lit("t"), F.lit("INT"), F.lit(False), F.lit(False)))
    edges = p.select(F.lit("a.x").alias("src"), name.alias("dst"), F.lit("reference").alias("kind"), (0.5 + F.col("p_size") / 200).alias("like"))
    got = schemas.edge_features(edges.drop("like"), ends).join(edges.select("dst", "like"), "dst")
    return got.select("src", "dst", F.round(schemas.edge_weight(F.col("like"), [F.col("relation"), F.col("meaning"), F.col("types")]), 9).alias("weight"))


@query("SELECT vec_id, round(list_max(embedding)::DOUBLE, 6) AS top, true AS near FROM embeddings")
def dequantized_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Codes read back: the largest component is exact, the others lie within a step."""
    from quillgraph.functions import columns as C
    from quillgraph.operators import embedding

    v = F.col("embedding").cast("array<double>")
    low, high = F.array_min(v), F.array_max(v)
    back = embedding.dequantize(C.quantize(v), low, high)
    near = F.forall(F.zip_with(v, back, lambda x, y: F.abs(x - y)), lambda d: d <= (high - low) / 255)
    return table(spark, sf, "embeddings").select("vec_id", F.round(F.array_max(back), 6).alias("top"), near.alias("near"))
