"""Graphs as files: GraphML, node-link JSON and compact text. For exports, which one writer makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODE_LINK = "nodes array<struct<id:string,props:map<string,string>>>, links array<struct<source:string,target:string,props:map<string,string>>>"


def _escaped(c: Column) -> Column:
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, key, line) of a GraphML file of nodes (node, props) and edges (src, dst, props); null values are left out."""
    names = lambda df, kind: df.select(F.explode(F.map_keys("props")).alias("name")).distinct().select(F.lit(kind).alias("kind"), "name")
    keys = names(nodes, "node").union(names(edges, "edge"))
    ident = F.concat(F.col("kind"), F.lit("_"), F.col("name"))
    heads = keys.select(F.lit(1).alias("section"), ident.alias("key"), F.concat(F.lit('<key id="'), _escaped(ident), F.lit('" for="'), "kind", F.lit('" attr.name="'), _escaped(F.col("name")), F.lit('" attr.type="string"/>')).alias("line"))

    def data(kind: str) -> Column:
        entries = F.array_sort(F.map_entries(F.map_filter("props", lambda k, v: v.isNotNull())))
        return F.array_join(F.transform(entries, lambda e: F.concat(F.lit(f'<data key="{kind}_'), _escaped(e["key"]), F.lit('">'), _escaped(e["value"]), F.lit("</data>"))), "")

    quoted = lambda c: _escaped(F.col(c).cast("string"))
    n = nodes.select(F.lit(3).alias("section"), F.col("node").cast("string").alias("key"), F.concat(F.lit('<node id="'), quoted("node"), F.lit('">'), data("node"), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(4).alias("section"), F.concat_ws("\x01", "src", "dst").alias("key"), F.concat(F.lit('<edge source="'), quoted("src"), F.lit('" target="'), quoted("dst"), F.lit('">'), data("edge"), F.lit("</edge>")).alias("line"))
    spark = nodes.sparkSession
    fixed = spark.createDataFrame([(0, "", '<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">'), (2, "", '<graph edgedefault="directed">'), (5, "", "</graph></graphml>")], "section int, key string, line string")
    return fixed.union(heads).union(n).union(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graphml_lines(nodes, edges).orderBy("section", "key", "line").select("line").coalesce(1).write.mode("overwrite").text(path)


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON document of a schema graph, which is small."""
    n = nodes.agg(F.array_sort(F.collect_list(F.struct(F.col("node").alias("id"), F.to_json("props").alias("p")))).alias("n"))
    e = edges.agg(F.array_sort(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.to_json("props").alias("p")))).alias("e"))
    back = lambda p: F.from_json(p, "map<string,string>").alias("props")
    wide = n.crossJoin(e)  # a row each
    return wide.select(F.to_json(F.struct(F.transform("n", lambda x: F.struct(x["id"].alias("id"), back(x["p"]))).alias("nodes"), F.transform("e", lambda x: F.struct(x["source"].alias("source"), x["target"].alias("target"), back(x["p"]))).alias("links"))).alias("value"))


def read_node_link(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    doc = spark.read.schema(NODE_LINK).option("multiLine", True).json(path)
    nodes = doc.select(F.explode("nodes").alias("x")).select(F.col("x.id").alias("node"), "x.props")
    return nodes, doc.select(F.explode("links").alias("x")).select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"), "x.props")


def compact_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(line): a schema graph as text, tables with their columns and then what refers to what."""
    columns = nodes.filter("type = 'column'").select(F.substring_index("node", ".", 1).alias("table"), F.substring_index("node", ".", -1).alias("column"))
    tables = columns.groupBy("table").agg(F.array_join(F.array_sort(F.collect_set("column")), ", ").alias("c")).select(F.format_string("%s(%s)", "table", "c").alias("line"))
    refs = edges.filter(F.col("src").contains(".") & F.col("dst").contains(".") & (F.col("src") < F.col("dst"))).select(F.format_string("%s = %s", "src", "dst").alias("line"))
    return tables.union(refs)


def ui_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, json): nodes and edges with quotes around names and values stripped and weight 0 where none is."""
    bare = lambda c: F.regexp_replace(c, '^"+|"+$', "")
    props = F.transform_values("props", lambda k, v: bare(v))
    n = nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct(bare(F.col("node")).alias("id"), props.alias("properties"))).alias("json"))
    weight = F.coalesce(F.col("props")["weight"].try_cast("double"), F.lit(0.0))
    return n.union(edges.select(F.lit("edge"), F.to_json(F.struct(bare(F.col("src")).alias("source"), bare(F.col("dst")).alias("target"), weight.alias("weight")))))
