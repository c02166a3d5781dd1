"""Phrases, settled matches and paths against plain versions."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import graph, paths, phrases


def test_phrases_of_cells(spark):
    questions = spark.createDataFrame([(1, "Is New York, bigger than York new?"), (2, "the 12 of new"), (3, ""), (4, None), (5, "york york of")], "qid long, text string")
    cells = [("t", "city", "New York"), ("t", "city", " york"), ("t", "town", "Old York"), ("t", "town", None), ("t", "year", "12")]
    values = spark.createDataFrame(cells, "table string, column string, value string")
    got = {tuple(r) for r in phrases.cell_phrases(questions, values, ("of", "the")).select("qid", "column", "start", "length", "phrase", "kind").collect()}
    assert got == {
        (1, "city", 1, 2, "new york", "exact"), (1, "city", 5, 2, "york new", "partial"), (1, "town", 2, 1, "york", "partial"), (1, "town", 5, 1, "york", "partial"),
        (2, "city", 3, 1, "new", "partial"), (5, "city", 0, 2, "york york", "partial"), (5, "town", 0, 2, "york york", "partial"),
    }
    columns = spark.createDataFrame([("t", "year", "time"), ("t", "n", "number"), ("t", "city", "text")], "table string, column string, type string")
    assert {tuple(r) for r in phrases.number_links(questions, columns).collect()} == {(2, 1, "t", "year", "TIME"), (2, 1, "t", "n", "NUMBER")}


def plainly_settled(rows):
    """The sequential rule, a question at a time."""
    out = set()
    for qid in {r[0] for r in rows}:
        at = {}
        for _, pos, *m in (r for r in rows if r[0] == qid):
            at.setdefault(pos, set()).add(tuple(m))
        known = set()
        for pos in sorted(at, key=lambda p: (len(at[p]), p)):
            kept = known & at[pos]
            if not kept:
                kept = {m for m in at[pos] if m[2] == "exact"} or at[pos]
                known |= kept
            out |= {(qid, pos, *m) for m in kept}
    return out


def test_settled_matches_follow_the_rule(spark):
    rnd = random.Random(2)
    rows = [(q, rnd.randrange(8), rnd.choice(("column", "table")), rnd.choice("abcde"), rnd.choice(("exact", "partial"))) for q in range(60) for _ in range(rnd.randint(1, 25))]
    df = spark.createDataFrame([*rows, *rows[:50]], "qid long, pos int, what string, name string, kind string")
    assert {tuple(r) for r in phrases.settled(df).collect()} == plainly_settled(rows)
    cells = spark.createDataFrame([(0, p, "x") for p in range(9)], "qid long, pos int, value string")
    assert {r["pos"] for r in phrases.unsettled_cells(cells, df).collect()} == set(range(9)) - {r[1] for r in rows if r[0] == 0}


def made_graph(seed):
    rnd = random.Random(seed)
    edges = {}
    for i in range(1, 60):
        edges[(rnd.randrange(max(0, i - 6), i), i)] = 1.0
    for _ in range(40):
        a, b = sorted(rnd.sample(range(60), 2))
        edges[(a, b)] = 1.0
    x = {s: {n: rnd.uniform(0.01, 3) for n in rnd.sample(range(60), 45)} for s in (0, 7, 20)}
    for s in x:
        x[s][s] = 1.0
    return edges, x


def plain_path(edges, x, source, target):
    """Cheapest by trying all relaxations; fewest hops to the furthest node where the target has no flow."""
    near = {}
    for a, b in edges:
        if a in x and b in x:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def settle(cost):
        best = {source: 0.0}
        todo = deque([source])
        while todo:
            u = todo.popleft()
            for v in near.get(u, ()):
                if best[u] + cost(u, v) < best.get(v, float("inf")):
                    best[v] = best[u] + cost(u, v)
                    todo.append(v)
        return best

    def back(best, cost, node):
        out = [node]
        while node != source:
            node = min(u for u in near[node] if u in best and best[u] + cost(u, node) == best[node])
            out.append(node)
        return out[::-1]

    if target in x:
        cost = lambda u, v: 1 / (x[u] + x[v] + 1e-10)
        best = settle(cost)
        return (True, back(best, cost, target)) if target in best else (False, None)
    hops = lambda u, v: 1.0
    best = settle(hops)
    return False, back(best, hops, max(best, key=lambda n: (best[n], x[n], -n)))


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_equal_plain_search(spark, seed):
    edges, x = made_graph(seed)
    adj = graph.cut(graph.adjacency(spark.createDataFrame([(a, b, w) for (a, b), w in edges.items()], "u long, v long, w double")))
    flow = spark.createDataFrame([(s, n, v) for s, f in x.items() for n, v in f.items()] + [(0, 99, 0.0)], "seed long, node long, x double")
    pairs = [(s, t) for s in x for t in (*range(0, 60, 4), s, 99, -1)]
    got = {(r["seed"], r["target"]): r for r in paths.find_paths(adj, flow, spark.createDataFrame(pairs, "seed long, target long"), 0.8).collect()}
    assert len(got) == len(set(pairs))
    for s, t in pairs:
        reached, path = plain_path(edges, x[s], s, t)
        mean = sum(x[s][n] for n in path) / len(path) if path else 0.0
        score = 0.0 if not path or len(path) < 2 else 0.7 * 0.8 + 0.3 * mean / (mean + 1)
        assert (got[s, t]["reached"], got[s, t]["path"]) == (reached, path) and abs(got[s, t]["score"] - score) < 1e-9


def test_paths_of_lone_and_missing_seeds(spark):
    adj = graph.cut(graph.adjacency(spark.createDataFrame([(0, 1, 1.0), (2, 3, 1.0)], "u long, v long, w double")))
    flow = spark.createDataFrame([(0, 0, 1.0), (0, 3, 1.0), (5, 1, 1.0)], "seed long, node long, x double")
    asked = spark.createDataFrame([(0, 0), (0, 1), (0, 3), (5, 1), (8, 1)], "seed long, target long")
    found = paths.find_paths(adj, flow, asked).withColumn("said", paths.readable(F.col("path"), F.col("score"))).collect()
    assert {(r["seed"], r["target"], r["reached"], tuple(r["path"] or ()), r["score"]) for r in found} == {(0, 0, True, (0,), 0.0), (0, 1, False, (0,), 0.0), (0, 3, False, (), 0.0), (5, 1, False, (), 0.0), (8, 1, False, (), 0.0)}
    assert {r["said"] for r in found if r["path"]} == {"0 (score: 0.000)"}
