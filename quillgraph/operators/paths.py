"""Cheapest paths inside the support of a flow, for many seeds and targets at once.

Costs are settled by delta-stepping: of the nodes whose cost fell, those below the current limit
offer new costs to their neighbours; when none is left the limit moves to the cheapest one by whole
steps. A node's state is its cost alone. Predecessors follow from the settled costs in one join (the
edges that are tight), and paths from walking them back, a round for each hop of the longest path,
over the asked targets only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.diffusion import path_score
from quillgraph.operators.graph import cut


def support_edges(adj: DataFrame, flow: DataFrame) -> DataFrame:
    """(seed, u, v, c): edges between nodes that a seed's flow (seed, node, x) runs through, cheap where it is strong."""
    x = flow.filter("x > 0").select("seed", "node", "x")
    a = x.select("seed", F.col("node").alias("u"), F.col("x").alias("xu"))
    b = x.select("seed", F.col("node").alias("v"), F.col("x").alias("xv"))
    return adj.filter("u <> v").select("u", "v").join(a, "u").join(b, ["seed", "v"]).select("seed", "u", "v", (1 / (F.col("xu") + F.col("xv") + 1e-10)).alias("c"))


def distances(edges: DataFrame, sources: DataFrame, step: float) -> DataFrame:
    """(seed, node, cost) of all nodes reached from sources (seed, node) over edges (seed, u, v, c), c > 0.
    step: how far the limit moves at once; about a usual edge's cost."""
    state = cut(sources.select("seed", "node", F.lit(0.0).alias("cost"), F.lit(True).alias("fresh")))
    limit = step
    while (low := state.filter("fresh").agg(F.min("cost")).head()[0]) is not None:
        if low >= limit:
            limit = (math.floor(low / step) + 1) * step
        now = F.col("fresh") & (F.col("cost") < limit)
        offers = state.filter(now).select("seed", F.col("node").alias("u"), "cost").join(edges, ["seed", "u"]).select("seed", F.col("v").alias("node"), (F.col("cost") + F.col("c")).alias("cost"), F.lit(None).cast("double").alias("old"), F.lit(False).alias("later"))
        known = state.select("seed", "node", "cost", F.col("cost").alias("old"), (F.col("fresh") & ~now).alias("later"))
        merged = known.union(offers).groupBy("seed", "node").agg(F.min("cost").alias("cost"), F.max("old").alias("old"), F.max("later").alias("later"))
        state = cut(merged.select("seed", "node", "cost", (F.col("old").isNull() | (F.col("cost") < F.col("old")) | F.col("later")).alias("fresh")))
    return state.select("seed", "node", "cost")


def predecessors(edges: DataFrame, settled: DataFrame) -> DataFrame:
    """(seed, node, before): the smallest node from which a node's cost comes."""
    a = settled.select("seed", F.col("node").alias("u"), F.col("cost").alias("cu"))
    b = settled.select("seed", F.col("node").alias("v"), F.col("cost").alias("cv"))
    tight = edges.join(a, ["seed", "u"]).join(b, ["seed", "v"]).filter(F.col("cu") + F.col("c") == F.col("cv"))
    return tight.groupBy("seed", F.col("v").alias("node")).agg(F.min("u").alias("before"))


def walked_back(before: DataFrame, ends: DataFrame) -> DataFrame:
    """(seed, target, node, back): the nodes of the paths to ends (seed, target, node), back hops before their last one."""
    front = cut(ends.select("seed", "target", "node", F.lit(0).alias("back")))
    steps = []
    while not front.isEmpty():
        steps.append(front)
        front = cut(front.join(before, ["seed", "node"]).select("seed", "target", F.col("before").alias("node"), (F.col("back") + 1).alias("back")))
    out = steps[0] if steps else front
    for s in steps[1:]:
        out = out.union(s)
    return out


def find_paths(adj: DataFrame, flow: DataFrame, pairs: DataFrame, confidence: float = 0.5) -> DataFrame:
    """(seed, target, reached, path, score) of pairs (seed, target), each seed a node of its own flow.

    A target inside the flow's support gets the cheapest path to it; one outside it a path of fewest
    hops to the furthest node, of equally far ones to the one with the most flow, then the smallest,
    and reached is false. A path of one node scores 0. No path: null and 0."""
    x = cut(flow.filter("x > 0").select("seed", "node", "x"))
    edges = cut(support_edges(adj, x))
    wanted = cut(pairs.select("seed", "target").distinct())
    start = x.filter("seed = node").join(wanted.select("seed").distinct(), "seed", "left_semi").select("seed", "node")
    inside = wanted.join(x.select("seed", F.col("node").alias("target")), ["seed", "target"], "left_semi").withColumn("node", F.col("target"))
    outside = wanted.join(inside, ["seed", "target"], "left_anti")

    usual = edges.agg(F.avg("c")).head()[0] or 1.0
    cost = distances(edges, start.join(inside.select("seed").distinct(), "seed", "left_semi"), usual)
    there = inside.join(cost.select("seed", "node"), ["seed", "node"], "left_semi")
    near = walked_back(cut(predecessors(edges, cost)), there)

    equal = edges.withColumn("c", F.lit(1.0))
    hops = distances(equal, start.join(outside.select("seed").distinct(), "seed", "left_semi"), 1.0)
    far = hops.join(x, ["seed", "node"]).groupBy("seed").agg(F.max(F.struct("cost", "x", (-F.col("node")).alias("n"))).alias("best")).select("seed", (-F.col("best.n")).alias("node"))
    instead = walked_back(cut(predecessors(equal, hops)), outside.join(far, "seed"))

    both = near.withColumn("reached", F.lit(True)).union(instead.withColumn("reached", F.lit(False))).join(x, ["seed", "node"], "left")
    line = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("back")).alias("at"), "node"))), lambda s: s["node"])
    found = both.groupBy("seed", "target", "reached").agg(line.alias("path"), F.avg(F.when(F.col("x") > 0, F.col("x"))).alias("mean"))
    found = found.withColumn("score", path_score(F.lit(confidence), F.coalesce("mean", F.lit(0.0)), F.size("path"))).select("seed", "target", "reached", "path", "score")
    lost = wanted.join(found, ["seed", "target"], "left_anti").select("seed", "target", F.lit(False), F.lit(None).cast("array<long>"), F.lit(0.0))
    return found.union(lost)


def readable(path, score, between: str = " -> "):
    """A path in words, with its score."""
    return F.concat(F.array_join(path.cast("array<string>"), between), F.format_string(" (score: %.3f)", score))
