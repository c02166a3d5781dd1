"""Graphs as edge tables (src, dst, weight): projection, degrees, walks, components, ranks."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.session import checkpoint_dir, scratch_path

#: Rows of a node table that are sent whole: a few MB.
FEW = 200_000


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared folder, so that a loop's plan stays small and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def by_end(df: DataFrame, end: str = "u", most: int | None = None) -> DataFrame:
    """df written once to the shared folder, dealt by a column, for loops that join with it on that column
    each round: those joins deal only their other side. Compressed, unlike a checkpoint. At most so many parts."""
    spark = df.sparkSession
    at = scratch_path(spark, "dealt")
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), most or 2**30)
    df.repartition(tasks, end).write.bucketBy(tasks, end).option("path", at).option("compression", "zstd").saveAsTable(name := f"dealt_{at.rsplit('-', 1)[1]}")
    return spark.table(name)


def written(df: DataFrame, name: str = "written") -> DataFrame:
    """df written once to the shared folder and read back: compressed, and of a size that the planner knows."""
    at = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.parquet(at)


def few(df: DataFrame) -> DataFrame:
    """df, cut or written before, to be broadcast if it has at most FEW rows; else it's joined like any other."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def members(rows: DataFrame) -> DataFrame:
    """(members): the (place, node) of each group of rows (group, place, node) that isn't alone in it, dealt once
    as they are; a row without one of these stands with nothing."""
    whole = rows.select("group", "place", "node").na.drop().repartition("group").groupBy("group")
    return whole.agg(F.collect_list(F.struct("place", "node")).alias("members")).filter(F.size("members") > 1)


def pairs(groups: DataFrame) -> DataFrame:
    """(u, v, w), u < v: how often two nodes stand at two places of one group (members)."""
    two = groups.select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b")).filter("a.place < b.place and a.node <> b.node")
    return two.groupBy(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v")).agg(F.count("*").cast("double").alias("w"))


def paired(groups: DataFrame) -> DataFrame:
    """(node): the nodes of the adjacency of pairs(groups), without its edges."""
    other = lambda a: F.exists("members", lambda b: (a["place"] != b["place"]) & (a["node"] != b["node"]))
    return groups.select(F.explode(F.array_distinct(F.transform(F.filter("members", other), lambda a: a["node"]))).alias("node")).distinct()


def near(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, w): of the adjacency of pairs(groups) all edges of nodes (node; distinct, cut or written). Groups
    stream past the nodes; only what these stand with is dealt."""
    mine = groups.select(F.explode("members").alias("a"), "members").join(few(nodes.select("node")), F.col("a.node") == F.col("node"))
    two = mine.select("node", "a", F.explode("members").alias("b")).filter("a.place <> b.place and a.node <> b.node")
    return two.groupBy(F.col("node").alias("u"), F.col("b.node").alias("v")).agg(F.count("*").cast("double").alias("w"))


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v, w) with u < v; of parallel and opposite edges the largest weight. Missing weight: 1."""
    return edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.coalesce("weight", F.lit(1.0)).alias("w")).groupBy("u", "v").agg(F.max("w").alias("w"))


def adjacency(projection: DataFrame) -> DataFrame:
    """Both directions of an undirected projection; a self-loop once."""
    one, other = F.struct("u", "v", "w"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"), "w")
    return projection.select(F.explode(F.when(F.col("u") == F.col("v"), F.array(one)).otherwise(F.array(one, other))).alias("x")).select("x.u", "x.v", "x.w")


def degrees(edges: DataFrame) -> DataFrame:
    """In plus out; a self-loop counts twice."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def edge_degrees(edges: DataFrame) -> DataFrame:
    d = degrees(edges)
    a, b = d.select(F.col("node").alias("src"), F.col("degree").alias("da")), d.select(F.col("node").alias("dst"), F.col("degree").alias("db"))
    return edges.join(a, "src").join(b, "dst").select("src", "dst", (F.col("da") + F.col("db")).alias("edge_degree"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """kind, n: nodes, edges, and nodes by type."""
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
    by_type = nodes.groupBy("entity_type").agg(F.count("*").alias("n")).select(F.concat(F.lit("type:"), "entity_type"), "n")
    return count(nodes, "nodes").union(count(edges, "edges")).union(by_type)


def insertable_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")


def missing_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Placeholder nodes for ends that aren't there."""
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    return ends.join(nodes, "node", "left_anti").withColumn("entity_type", F.lit("UNKNOWN"))


def induced(edges: DataFrame, members: DataFrame) -> DataFrame:
    return insertable_edges(edges, members)


def drop_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node", "left_anti"), left


def bfs(adj: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, depth) of nodes reachable from sources (node), a round for each level."""
    seen = cut(sources.select("node").distinct().withColumn("depth", F.lit(0)))
    for depth in count(1):
        front = seen.filter(F.col("depth") == depth - 1)
        new = adj.join(front, adj["u"] == front["node"]).select(F.col("v").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("depth", F.lit(depth))
        new = cut(new)
        if new.isEmpty():
            return seen
        seen = cut(seen.union(new))
    raise AssertionError("levels end")


def components(adj: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable. Labels spread along edges and then jump to
    their label's label, so the rounds grow with the logarithm of a component's width."""
    label = cut(adj.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component")))
    while True:
        near = adj.join(label, adj["v"] == label["node"]).groupBy("u").agg(F.min("component").alias("m"))
        step = label.join(near, label["node"] == near["u"]).select("node", "component", F.least("component", "m").alias("m"))
        far = step.select(F.col("node").alias("at"), F.col("m").alias("jump"))
        new = cut(step.join(far, step["m"] == far["at"], "left").select("node", "component", F.coalesce(F.least("m", "jump"), "m").alias("new")))
        if new.filter("new <> component").isEmpty():
            return new.select("node", "component")
        label = new.select("node", F.col("new").alias("component"))


def largest_component(adj: DataFrame) -> DataFrame:
    c = components(adj)
    top = c.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(1)
    return c.join(top, "component", "left_semi").select("node")


def pagerank(adj: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(node, rank) on a weighted symmetric adjacency (no dangling nodes)."""
    return _ranks(adj.select("u", F.array("v").alias("vs"), "w"), rounds, damping)


def pagerank_together(groups: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """pagerank on the adjacency of pairs(groups), whose edges are neither counted nor dealt one by one: a member
    gives to the others of its group at once."""
    others = lambda a: F.transform(F.filter("members", lambda b: (b["place"] != a["place"]) & (b["node"] != a["node"])), lambda b: b["node"])
    each = groups.select(F.explode(F.transform("members", lambda a: F.struct(a["node"].alias("u"), others(a).alias("vs")))).alias("x"))
    return _ranks(each.select("x.u", "x.vs").filter(F.size("vs") > 0).withColumn("w", F.lit(1.0)), rounds, damping)


def _ranks(out: DataFrame, rounds: int, damping: float) -> DataFrame:
    """pagerank of rows (u, vs, w): u gives to each of vs by weight w. A node's sum leaves every part in which
    it gets something, so there are only as many parts as keep all cores busy, however large the graph."""
    parts = min(int(out.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * out.sparkSession.sparkContext.defaultParallelism)
    out = by_end(out, "u", parts)
    total = by_end(out.groupBy(F.col("u").alias("node")).agg(F.sum(F.size("vs") * F.col("w")).alias("t")), "node", parts)
    n = total.count()
    rank = total.select("node", F.lit(1.0 / n).alias("rank"))
    for k in range(rounds):
        # what a node gives is told where its edges lie
        gives = total.join((rank.repartition(parts, "node") if k else rank).hint("merge"), "node").select("node", "rank", "t").hint("shuffle_hash")
        got = out.join(gives, out["u"] == gives["node"]).select(F.explode("vs").alias("v"), (F.col("w") / F.col("t") * F.col("rank")).alias("x")).groupBy("v").agg(F.sum("x").alias("x"))
        rank = cut(got.select(F.col("v").alias("node"), (F.lit((1 - damping) / n) + damping * F.col("x")).alias("rank")))
    return rank


def pagerank_until(edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, most: int = 100) -> DataFrame:
    """(node, rank) of directed weighted edges (src, dst, weight): nodes without a way out give to all alike;
    rounds until the ranks' total change is below the number of nodes times the tolerance."""
    nodes = cut(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    total = edges.groupBy("src").agg(F.sum("weight").alias("t"))
    step = cut(edges.join(total, "src").filter("t > 0").select("src", "dst", (F.col("weight") / F.col("t")).alias("p")))
    out = step.select(F.col("src").alias("node")).distinct().withColumn("out", F.lit(True))
    rank = cut(nodes.join(out, "node", "left").select("node", F.coalesce("out", F.lit(False)).alias("out"), F.lit(1.0 / n).alias("rank"), F.lit(1.0).alias("change")))
    for _ in range(most):
        lost = rank.agg(F.sum(F.when(~F.col("out"), F.col("rank")))).head()[0] or 0.0
        got = step.join(rank.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("p") * F.col("rank")).alias("x"))
        new = F.lit((1 - damping + damping * lost) / n) + damping * F.coalesce("x", F.lit(0.0))
        rank = cut(rank.drop("change").join(got, "node", "left").select("node", "out", new.alias("rank"), F.abs(new - F.col("rank")).alias("change")))
        if rank.agg(F.sum("change")).head()[0] < n * tolerance:
            return rank.select("node", "rank")
    raise RuntimeError("ranks didn't settle")


def strongest_neighbours(adj: DataFrame, k: int) -> DataFrame:
    from pyspark.sql.window import Window

    order = Window.partitionBy("u").orderBy(F.desc("w"), "v")
    return adj.filter("u <> v").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)
