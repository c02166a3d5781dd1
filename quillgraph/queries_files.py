"""Queries that write files from the tables and read them back, and queries of statements' text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators import sql_text
from quillgraph.registry import query
from quillgraph.session import scratch_path, table
from quillgraph.sources import graph_files, metadata, store

# ---- graphs: nations and suppliers with their places


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n, s = table(spark, sf, "nation"), table(spark, sf, "supplier")
    nodes = n.select(F.col("n_name").alias("node"), F.create_map(F.lit("kind"), F.lit("<nation> & co"), F.lit("none"), F.lit(None).cast("string")).alias("props"))
    nodes = nodes.union(s.select("s_name", F.create_map(F.lit("kind"), F.lit('"supplier"'), F.lit("balance"), F.col("s_acctbal").cast("decimal(12,2)").cast("string"))))
    edges = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"), F.create_map(F.lit("weight"), F.col("s_suppkey").cast("string")).alias("props"))
    return nodes, edges


def _listed(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select(F.col("node").alias("a"), F.lit(None).cast("string").alias("b"), F.col("props")["kind"].alias("kind"), F.col("props")["balance"].alias("value"), F.map_contains_key("props", "none").alias("has_null"))
    return n.union(edges.select("src", "dst", F.lit(None), F.col("props")["weight"], F.lit(False)))


def _graph_sql(null: str) -> str:
    return f"""SELECT n_name AS a, NULL AS b, '<nation> & co' AS kind, NULL AS value, {null} AS has_null FROM nation UNION ALL SELECT s_name, NULL, '"supplier"', s_acctbal::DECIMAL(12, 2)::VARCHAR, false FROM supplier
UNION ALL SELECT s_name, n_name, NULL, s_suppkey::VARCHAR, false FROM supplier JOIN nation ON n_nationkey = s_nationkey"""


@query(_graph_sql("false"))
def graphml_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "graphml")
    graph_files.write_graphml(*_graph(spark, sf), path)
    return _listed(*store.read_graphml(spark, path))


@query(_graph_sql("true"))
def node_link_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "node-link")
    nodes, edges = _graph(spark, sf)
    graph_files.node_link(nodes, edges).write.text(path)
    return _listed(*graph_files.read_node_link(spark, path))


# ---- folders of descriptions: a file for each type and brand


def _described(spark: SparkSession, sf: str) -> metadata.Metadata:
    p = table(spark, sf, "part")
    one = F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_size")))
    tables = p.groupBy(F.col("p_type").alias("db"), F.col("p_brand").alias("table_name")).agg(one.alias("x"))
    field = lambda f: F.transform("x", f)
    tables = tables.select("db", F.translate("table_name", "#", "-").alias("name"), "table_name", F.concat_ws(".", "db", "table_name").alias("table_fullname"), field(lambda c: F.concat(F.lit("c"), c["p_partkey"])).alias("column_names"), field(lambda c: F.when(c["p_size"] > 25, "NUMBER").otherwise("TEXT")).alias("column_types"), field(lambda c: c["p_name"]).alias("description"))
    path = scratch_path(spark, "metadata")
    tables.write.partitionBy("db", "name").json(f"{path}/meta")
    return metadata.Metadata(spark, f"{path}/meta")


@query("""SELECT 'db=' || p_type AS db, p_brand AS "table", (row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) - 1)::INT AS position, 'c' || p_partkey AS "column", CASE WHEN p_size > 25 THEN 'NUMBER' ELSE 'TEXT' END AS type, p_name AS description FROM part""")
def metadata_columns(spark: SparkSession, sf: str) -> DataFrame:
    return _described(spark, sf).columns()


@query("""WITH t AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL) SELECT 'db=' || p_type AS db, count(*) AS tables, sum(n)::BIGINT AS columns, round(sum(n) / count(*), 4)::DOUBLE AS columns_per_table FROM t GROUP BY p_type""")
def metadata_databases(spark: SparkSession, sf: str) -> DataFrame:
    return _described(spark, sf).databases()


@query("""WITH c AS (SELECT p_type, p_brand, '[' || string_agg('{"name":"c' || p_partkey || '","size":"' || p_size || '"}', ',' ORDER BY p_partkey) || ']' AS columns, count(*) AS n FROM part GROUP BY ALL)
SELECT p_type AS db, '{"db":"' || p_type || '","table_count":' || count(*) || ',"tables":[' || string_agg('{"name":"' || p_brand || '","column_count":' || n || ',"columns":' || columns || '}', ',' ORDER BY p_brand) || ']}' AS value FROM c GROUP BY p_type""")
def database_summaries(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_type").alias("db"), F.col("p_brand").alias("table"), F.col("p_partkey").alias("position"), F.concat(F.lit("c"), "p_partkey").alias("column"), F.col("p_size").alias("size"))
    path = scratch_path(spark, "summaries")
    metadata.write_summaries(rows, path)
    return spark.read.text(path).select("db", "value")


@query("""SELECT 'c' || p_partkey AS "column", p_name || CASE WHEN p_size > 9 THEN ', ' || p_type || ', of ' || p_brand ELSE '' END || ', ' || p_size AS description FROM part""")
def described_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions with line breaks, quotes' signs and lead-ins that reading takes off."""
    p = table(spark, sf, "part")
    said = F.when(F.col("p_size") > 9, F.concat(F.lit("Commonsense evidence: "), "p_type", F.lit(",\nof "), "p_brand"))
    rows = p.select(F.concat(F.lit("c"), "p_partkey").alias("original_column_name"), F.col("p_name").alias("column_name"), said.alias("column_description"), F.concat(F.lit("not useful "), F.col("p_size").cast("string")).alias("value_description"))
    path = scratch_path(spark, "descriptions")
    rows.write.option("header", True).option("escape", '"').csv(path)
    return metadata.concatenated(metadata.described_columns(spark, path)).select("column", "description")


# ---- tasks, changes, keys


@query("SELECT 'sf' || p_partkey AS instance_id, p_type AS db_id, p_name AS instruction, CASE WHEN p_size > 25 THEN p_brand END AS external_knowledge FROM part WHERE p_partkey % 10 <> 0")
def task_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenth line is broken."""
    p = table(spark, sf, "part")
    line = F.to_json(F.struct(F.concat(F.lit("sf"), "p_partkey").alias("instance_id"), F.col("p_type").alias("db_id"), F.col("p_name").alias("instruction"), F.when(F.col("p_size") > 25, F.col("p_brand")).alias("external_knowledge")))
    path = scratch_path(spark, "tasks")
    p.select(F.when(F.col("p_partkey") % 10 == 0, F.left(line, F.lit(20))).otherwise(line)).write.text(path)
    return store.read_tasks(spark, path)


@query("SELECT 'f' || p_partkey AS path, CASE WHEN p_partkey % 3 = 0 THEN 'added' ELSE 'changed' END AS change FROM part WHERE p_partkey % 3 = 0 OR p_size > 40")
def file_changes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    at = F.concat(F.lit("f"), "p_partkey").alias("path")
    before = p.filter("p_partkey % 3 <> 0").select(at, F.encode("p_name", "utf-8").alias("content"))
    after = p.select(at, F.encode(F.when(F.col("p_size") > 40, F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), "utf-8").alias("content"))
    return store.file_changes(before, after)


@query("SELECT DISTINCT text AS id, false AS dropped FROM benchmark UNION ALL SELECT '0', true")
def key_value_keys(spark: SparkSession, sf: str) -> DataFrame:
    """All keys of a table, and how many are left once it is dropped."""
    kept = store.KeyValueTable(spark, scratch_path(spark, "kv"), "id string, item_id long")
    kept.insert_if_absent(table(spark, sf, "benchmark").select(F.col("text").alias("id"), "item_id"))
    at = scratch_path(spark, "keys")
    kept.keys().write.parquet(at)
    kept.drop()
    left = kept.keys().agg(F.count("*").cast("string").alias("id"))
    return spark.read.parquet(at).select("id", F.lit(False).alias("dropped")).union(left.select("id", F.lit(True)))


# ---- statements' text


@query("SELECT p_partkey, p_name || ' ' || chr(233) || p_type || chr(252) || ' u00e9' AS text FROM part")
def unicode_texts(spark: SparkSession, sf: str) -> DataFrame:
    escaped = F.concat("p_name", F.lit(r" \u00e9"), "p_type", F.lit(r"\u00FC u00e9"))
    return table(spark, sf, "part").select("p_partkey", sql_text.unicode_decoded(escaped).alias("text"))


@query("""SELECT p_partkey, length(p_name) + 1 AS start, length(p_name) + length(p_type) + 3 AS "end" FROM part UNION ALL SELECT p_partkey, 0, length(p_name) + length(p_type) + 5 FROM part""")
def parenthesis_spans(spark: SparkSession, sf: str) -> DataFrame:
    """(name(type)x)) has two spans; the last parenthesis closes none."""
    rows = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("("), "p_name", F.lit("("), "p_type", F.lit(")x))")).alias("text"))
    return sql_text.parenthesis_spans(rows).select("p_partkey", F.explode("spans").alias("s")).select("p_partkey", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query("""SELECT p_partkey, unnest(['a INT', 'b DECIMAL(' || p_size || ', 2)', 'c ' || p_type || ' DEFAULT (1, (2))']) AS definition FROM part""")
def table_definitions(spark: SparkSession, sf: str) -> DataFrame:
    ddl = F.concat(F.lit("CREATE TABLE t (a INT, b DECIMAL("), "p_size", F.lit(", 2) , c "), "p_type", F.lit(" DEFAULT (1, (2)),) PARTITION BY (a, b)"))
    return sql_text.split_definitions(table(spark, sf, "part").select("p_partkey", ddl.alias("ddl"))).select("p_partkey", F.explode("definitions").alias("definition"))


@query("SELECT p_partkey, p_name AS bare, p_type || ' (' || p_brand || ')' AS argument, '' AS other FROM part")
def actions(spark: SparkSession, sf: str) -> DataFrame:
    """A quoted name, and the argument of an action in a reply of several lines."""
    reply = F.concat(F.lit("Thought: x\nAction: Run("), "p_type", F.lit(" ("), "p_brand", F.lit("))\n"))
    sign = F.element_at(F.array(F.lit("'"), F.lit('"'), F.lit("`")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return table(spark, sf, "part").select("p_partkey", sql_text.unquoted(F.concat(F.lit(" "), sign, "p_name", sign)).alias("bare"), sql_text.action(reply, "Run").alias("argument"), sql_text.action(reply, "Stop").alias("other"))
