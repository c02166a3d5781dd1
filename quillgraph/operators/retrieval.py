"""From seeds to context: hits, flow clusters around them, their nodes, edges and texts, within budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.ordered import numbered, running
from quillgraph.operators.text import first_of_each, rank_text_units


@dataclass(frozen=True)
class Limits:
    seeds: int = 10
    min_flow: float = 0.1
    node_tokens: int = 4000
    edge_tokens: int = 4000
    text_tokens: int = 4000


def seeds(hits: DataFrame, nodes: DataFrame, most: int, excluded: str = "complete_table") -> DataFrame:
    """(node, rank): the best hits (node, score) that are in the graph; the excluded name is none of them."""
    there = hits.join(nodes.select("node"), "node", "left_semi").filter(F.lower(F.col("node").cast("string")) != excluded)
    best = there.orderBy(F.desc("score"), "node").limit(most)  # a bounded number
    return best.select("node", F.row_number().over(Window.orderBy(F.desc("score"), "node")).alias("rank"))


def cluster_members(flow: DataFrame, min_flow: float) -> DataFrame:
    """(seed, node, x, place): clusters of more than one node whose flow somewhere reaches the least, by flow."""
    live = flow.filter("x > 0").select("seed", "node", "x")
    good = live.groupBy("seed").agg(F.count("*").alias("n"), F.max("x").alias("top")).filter((F.col("n") > 1) & (F.col("top") >= min_flow)).select("seed")
    return live.join(good, "seed", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("x"), "node")))


def cluster_edges(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, src, dst, weight): edges of which a cluster holds both ends."""
    m = members.select("seed", "node")
    one = edges.join(m.withColumnRenamed("node", "src"), "src")
    return one.join(m.select("seed", F.col("node").alias("dst")), ["seed", "dst"], "left_semi").select("seed", "src", "dst", "weight")


def cluster_text(members: DataFrame, edges: DataFrame, nodes: DataFrame, mode: str = "full") -> DataFrame:
    """(seed, text): a line for each node, by flow, and in full mode one for each edge. nodes: (node, kind, description)."""
    wide = members.join(nodes, "node", "left")
    line = F.col("node").cast("string") if mode == "names" else F.concat_ws(" ", F.concat(F.lit("- "), F.col("node").cast("string")), F.concat(F.lit("("), F.coalesce("kind", F.lit("UNKNOWN")), F.lit("):")), F.coalesce("description", F.lit("")))
    body = wide.groupBy("seed").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    if mode != "full":
        return body
    row = F.format_string("%s -> %s (%.2f)", F.col("src").cast("string"), F.col("dst").cast("string"), "weight")
    tail = edges.groupBy("seed").agg(F.array_join(F.array_sort(F.collect_list(row)), "\n").alias("links"))
    return body.join(tail, "seed", "left").select("seed", F.concat_ws("\n", "text", "links").alias("text"))


def cluster_json(members: DataFrame, edges: DataFrame, nodes: DataFrame, mode: str = "compact") -> DataFrame:
    """(seed, json): nodes by flow and edges; minimal: names alone."""
    wide = members.join(nodes, "node", "left")
    one = F.struct("place", F.col("node").alias("id")) if mode == "minimal" else F.struct("place", F.col("node").alias("id"), F.col("kind").alias("type"), F.round("x", 3).alias("flow"))
    drop = (lambda x: F.struct(x["id"].alias("id"))) if mode == "minimal" else (lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["flow"].alias("flow")))
    n = wide.groupBy("seed").agg(F.transform(F.array_sort(F.collect_list(one)), drop).alias("nodes"))
    e = edges.groupBy("seed").agg(F.array_sort(F.collect_list(F.struct("src", "dst", F.round("weight", 3).alias("w")))).alias("edges"))
    return n.join(e, "seed", "left").select("seed", F.to_json(F.struct("nodes", F.coalesce("edges", F.expr("cast(array() as array<struct<src:bigint,dst:bigint,w:double>>)")).alias("edges"))).alias("json"))


def text_context(seed_rows: DataFrame, mentions: DataFrame, edges: DataFrame, chunks: DataFrame, budget: int) -> DataFrame:
    """(chunk, place, tokens): texts that seeds mention, by the first seed and then by shared relations, while
    their tokens fit. chunks: (chunk, content, tokens); texts that aren't there or are empty don't count."""
    ranked = rank_text_units(seed_rows, mentions, edges)
    there = ranked.join(chunks.filter(F.col("content").isNotNull() & (F.col("content") != "")), "chunk")
    order = ["seed_order", F.desc("relation_counts"), "chunk"]
    kept = running(there, order, "tokens", "running").filter(F.col("running") <= budget)
    return numbered(kept, order, "place").select("chunk", "place", "tokens")


def combined_sources(global_: DataFrame, local: DataFrame) -> DataFrame:
    """(id, content): both lists without repeats, the global one first, numbered from 1."""
    both = global_.select("content", F.lit(0).alias("side"), "place").union(local.select("content", F.lit(1), "place"))
    once = first_of_each(both, "content", ["side", "place"])
    return numbered(once, ["side", "place", "content"], "id").select("id", "content")


def hybrid_contexts(local: DataFrame, global_: DataFrame) -> DataFrame:
    """(section, mode, place, content): sections of both modes one after another, sources combined."""
    rest = local.withColumn("mode", F.lit("local")).union(global_.withColumn("mode", F.lit("global"))).filter("section <> 'sources'")
    pick = lambda df: df.filter("section = 'sources'").select("content", "place")
    sources = combined_sources(pick(global_), pick(local)).select(F.lit("sources").alias("section"), F.col("id").cast("int").alias("place"), "content", F.lit("both").alias("mode"))
    return rest.select("section", "place", "content", "mode").union(sources)


def furthest_node(adj: DataFrame, flow: DataFrame, source: int) -> DataFrame:
    """(node, depth): of the nodes that breadth-first search reaches inside the flow's support, the deepest,
    of equally deep ones the one with the most flow, then the smallest."""
    from quillgraph.operators.graph import bfs

    spark = adj.sparkSession
    live = flow.filter("x > 0").select("node", "x")
    inner = adj.join(live.select(F.col("node").alias("u")), "u", "left_semi").join(live.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v", "w")
    depth = bfs(inner, spark.createDataFrame([(source,)], "node long"))
    return depth.join(live, "node").orderBy(F.desc("depth"), F.desc("x"), "node").limit(1).select("node", "depth")


def compared_flows(plain: DataFrame, aware: DataFrame) -> DataFrame:
    """(seed, node, plain, aware, change) of two runs over the same seeds."""
    a = plain.select("seed", "node", F.col("x").alias("plain"))
    b = aware.select("seed", "node", F.col("x").alias("aware"))
    both = a.join(b, ["seed", "node"], "full_outer").na.fill(0.0, ["plain", "aware"])
    return both.withColumn("change", F.col("aware") - F.col("plain"))
