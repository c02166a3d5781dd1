"""Communities of a weighted graph by local moves and contraction, in rounds over all nodes.

In a round a share of the nodes, by a hash of node and round, moves each to the neighbouring community
that gains most modularity, ties to the smaller one. Moves of a round are made side by side, so a
round that lowers the modularity is taken back and the next one moves a smaller share. When no share
helps any more, communities become nodes, their inner weight a loop, and rounds go on there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.graph import cut

#: Shares of nodes that are tried, as divisors, before a level counts as settled; least gain of a round.
SHARES, GAIN = (2, 4, 16), 1e-9


def _totals(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"))


def modularity(adj: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of labels (node, community) on adj (u, v, w), which has both directions of an edge and a loop's weight twice."""
    a, b = labels.select(F.col("node").alias("u"), F.col("community").alias("cu")), labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
    by = adj.join(a, "u").join(b, "v").groupBy("cu").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inner"))
    row = by.agg(F.sum("inner").alias("inner"), F.sum("total").alias("all"), F.sum(F.col("total") * F.col("total")).alias("squares")).head()
    return row["inner"] / row["all"] - resolution * row["squares"] / row["all"] ** 2 if row["all"] else 0.0


def _moved(adj: DataFrame, totals: DataFrame, labels: DataFrame, weight: float, moving, resolution: float) -> DataFrame:
    """labels after the nodes for which moving holds went where they gain most."""
    own = labels.join(totals, "node")
    sizes = own.groupBy("community").agg(F.sum("k").alias("total"))
    near = labels.select(F.col("node").alias("v"), "community")
    links = adj.filter("u <> v").join(near, "v").groupBy(F.col("u").alias("node"), "community").agg(F.sum("w").alias("inside"))
    here = own.filter(moving)
    # staying is a choice as well, also for a node without a link into its community
    offers = links.join(here.select("node"), "node", "left_semi").union(here.select("node", "community", F.lit(0.0)))
    offers = offers.groupBy("node", "community").agg(F.sum("inside").alias("inside")).join(sizes, "community").join(here.select("node", F.col("community").alias("mine"), "k"), "node")
    rest = F.col("total") - F.when(F.col("community") == F.col("mine"), F.col("k")).otherwise(0.0)
    score = F.round(F.col("inside") - resolution * F.col("k") * rest / weight, 9)
    best = offers.withColumn("score", score).groupBy("node").agg(F.max(F.struct("score", (F.col("community") == F.col("mine")).alias("stays"), (-F.col("community")).alias("c"))).alias("x"))
    return labels.join(best.select("node", (-F.col("x.c")).alias("new")), "node", "left").select("node", F.coalesce("new", "community").alias("community"))


def _level(adj: DataFrame, resolution: float, most: int) -> tuple[DataFrame, float]:
    """(labels, modularity) after rounds of moves from every node alone."""
    totals = cut(_totals(adj))
    weight = totals.agg(F.sum("k")).head()[0]
    labels = cut(totals.select("node", F.col("node").alias("community")))
    score, share = modularity(adj, labels, resolution), 0
    for k in range(most):
        moving = F.pmod(F.xxhash64(F.lit(k), "node"), F.lit(SHARES[share])) == 0
        new = cut(_moved(adj, totals, labels, weight, moving, resolution))
        now = modularity(adj, new, resolution)
        if now > score + GAIN:
            labels, score, share = new, now, max(0, share - 1)
        elif share + 1 < len(SHARES):
            share += 1
        else:
            return labels, score
    return labels, score


def communities(adj: DataFrame, resolution: float = 1.0, most: int = 60) -> DataFrame:
    """(node, community): the smallest node of each community. adj: (u, v, w) with both directions of each
    edge; most: rounds of a level."""
    known, graph, score = None, adj.filter("w > 0"), None
    if graph.isEmpty():
        return adj.select(F.col("u").alias("node"), F.col("u").alias("community")).distinct()
    while True:
        labels, now = _level(graph, resolution, most)
        if score is not None and now <= score + GAIN:
            break
        known = labels if known is None else cut(known.join(labels.select(F.col("node").alias("community"), F.col("community").alias("new")), "community").select("node", F.col("new").alias("community")))
        score = now
        a, b = labels.select(F.col("node").alias("u"), F.col("community").alias("cu")), labels.select(F.col("node").alias("v"), F.col("community").alias("cv"))
        graph = cut(graph.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))
    names = known.groupBy("community").agg(F.min("node").alias("name"))
    alone = adj.select(F.col("u").alias("node")).distinct().join(known, "node", "left_anti")
    return known.join(names, "community").select("node", F.col("name").alias("community")).union(alone.select("node", "node"))
