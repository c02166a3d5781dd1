"""Communities against sequential local moves."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import communities, graph


def plain_modularity(edges, label):
    m = sum(edges.values())
    total, inner = {}, 0.0
    for (a, b), w in edges.items():
        total[label[a]] = total.get(label[a], 0) + w
        total[label[b]] = total.get(label[b], 0) + w
        inner += w * (label[a] == label[b])
    return inner / m - sum((t / (2 * m)) ** 2 for t in total.values())


def sequential(edges):
    """One node after another, then contraction."""
    nodes = sorted({n for e in edges for n in e})
    where = {n: n for n in nodes}
    now = dict(edges)
    while True:
        adj, loop = {}, {}
        for (a, b), w in now.items():
            if a == b:
                loop[a] = loop.get(a, 0) + w
            else:
                adj.setdefault(a, {})[b] = adj.setdefault(a, {}).get(b, 0) + w
                adj.setdefault(b, {})[a] = adj.setdefault(b, {}).get(a, 0) + w
        here = sorted({n for e in now for n in e})
        k = {n: sum(adj.get(n, {}).values()) + 2 * loop.get(n, 0) for n in here}
        m2 = sum(k.values())
        label, total = {n: n for n in here}, dict(k)
        moved = True
        while moved:
            moved = False
            for n in here:
                inside = {}
                for v, w in adj.get(n, {}).items():
                    inside[label[v]] = inside.get(label[v], 0) + w
                total[label[n]] -= k[n]
                gain = lambda c: inside.get(c, 0) - k[n] * total[c] / m2  # noqa: E731, B023
                best = max(inside, key=lambda c: (gain(c), -c), default=label[n])  # noqa: B023
                if gain(best) > gain(label[n]) + 1e-12:
                    label[n], moved = best, True
                total[label[n]] += k[n]
        if len(set(label.values())) == len(here):
            return where
        where = {n: label[c] for n, c in where.items()}
        new = {}
        for (a, b), w in now.items():
            key = tuple(sorted((label[a], label[b])))
            new[key] = new.get(key, 0) + w
        now = new


def planted(seed, groups, size, inner, outer):
    rnd = random.Random(seed)
    edges = {}
    for a in range(groups * size):
        for b in range(a):
            if rnd.random() < (inner if a // size == b // size else outer):
                edges[(b, a)] = rnd.choice((1.0, 2.0))
    return edges


def found(spark, edges):
    adj = graph.cut(graph.adjacency(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "u long, v long, w double")))
    labels = communities.communities(adj)
    return {r["node"]: r["community"] for r in labels.collect()}, communities.modularity(adj, labels)


@pytest.mark.parametrize("edges", [planted(1, 6, 12, 0.7, 0.02), planted(2, 3, 9, 0.7, 0.05)])
def test_not_below_sequential_moves(spark, edges):
    label, score = found(spark, edges)
    assert score == pytest.approx(plain_modularity(edges, label))
    assert score >= plain_modularity(edges, sequential(edges)) - 1e-9


def test_cliques_in_a_ring(spark):
    edges = {}
    for c in range(5):
        mine = range(5 * c, 5 * c + 5)
        edges |= {(a, b): 1.0 for a in mine for b in mine if a < b}
        edges[tuple(sorted((5 * c, (5 * c + 9) % 25)))] = 1.0
    label, _ = found(spark, edges)
    assert label == {n: n - n % 5 for n in range(25)}


def test_odd_graphs(spark):
    adj = spark.createDataFrame([], "u long, v long, w double")
    assert communities.communities(adj).isEmpty()
    two = graph.adjacency(spark.createDataFrame([(1, 2, 1.0), (3, 4, 0.0)], "u long, v long, w double"))
    assert {tuple(r) for r in communities.communities(two).collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    assert communities.modularity(two.filter(F.lit(False)), two.select(F.col("u").alias("node"), F.col("u").alias("community"))) == 0.0
