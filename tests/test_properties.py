"""Operators that SQL can't state: properties and brute force on small graphs and rows."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from quillgraph.functions import columns as C
from quillgraph.operators import diffusion, evaluate, graph, linking, text
from quillgraph.plans import schema_graph
from quillgraph.sources import store
from quillgraph.streaming import ingest


def edges(spark, n=60, m=150, seed=3):
    rnd = random.Random(seed)
    rows = {}
    for i in range(1, n):
        rows[(rnd.randrange(i), i)] = rnd.uniform(0.5, 2)
    for _ in range(m):
        a, b = sorted(rnd.sample(range(n), 2))
        rows.setdefault((a, b), rnd.uniform(0.5, 2))
    return spark.createDataFrame([(a, b, w) for (a, b), w in rows.items()], "u long, v long, w double")


def solve(rows, seed, mass):
    """Sequential pushes, one node at a time."""
    adj, m, x = {}, {seed: mass}, {}
    for u, v, w in rows:
        adj.setdefault(u, {})[v] = w
        adj.setdefault(v, {})[u] = w
    for _ in range(200_000):
        over = [v for v in m if m[v] > len(adj[v]) + 1e-12]
        if not over:
            break
        v = over[0]
        e, total = m[v] - len(adj[v]), sum(adj[v].values())
        x[v] = x.get(v, 0) + e / total
        m[v] = len(adj[v])
        for u, w in adj[v].items():
            m[u] = m.get(u, 0) + e * w / total
    return m, x


def test_diffusion_conserves_mass_and_equals_sequential_pushes(spark):
    p = edges(spark)
    adj = graph.cut(graph.adjacency(p))
    out = {r["node"]: r for r in diffusion.diffuse(adj, spark.createDataFrame([(5,)], "seed long"), alpha=6, rounds=400, tolerance=1e-9, check_every=50).collect()}
    deg = {r["node"]: r["degree"] for r in graph.degrees(p.select(F.col("u").alias("src"), F.col("v").alias("dst"))).collect()}
    mass = 6 * 1.7 * deg[5]
    assert abs(sum(r["m"] for r in out.values()) - mass) < 1e-6
    assert all(r["converged"] and r["m"] <= deg[n] + 1e-6 and r["x"] >= 0 for n, r in out.items())
    assert all(abs(r["m"] - deg[n]) < 1e-6 for n, r in out.items() if r["x"] > 1e-6)
    _, x = solve([tuple(r) for r in p.collect()], 5, mass)
    assert all(abs(x.get(n, 0) - r["x"]) < 1e-4 for n, r in out.items())


def test_infeasible_mass_is_reported(spark):
    adj = graph.cut(graph.adjacency(spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0)], "u long, v long, w double")))
    assert not diffusion.diffuse(adj, spark.createDataFrame([(0,)], "seed long"), rounds=5).head()["converged"]


def test_path_and_components(spark):
    p = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (8, 9, 1.0)], "u long, v long, w double")
    adj = graph.cut(graph.adjacency(p))
    assert {(r[0], r[1]) for r in graph.components(adj).collect()} == {(0, 0), (1, 0), (2, 0), (8, 8), (9, 8)}
    assert {r[0] for r in graph.largest_component(adj).collect()} == {0, 1, 2}


def test_folds(spark):
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([30, 30, 10, 50, 5, 70])], "g long, i long, t long")
    assert [r["bin"] for r in text.greedy_bins(rows, "g", "i", "t", 60).orderBy("i").collect()] == [0, 0, 1, 1, 2, 3]
    assert sorted(r["i"] for r in text.skipping_budget(rows, "g", "i", "t", 60).collect()) == [0, 1]


def test_records_edge_cases(spark):
    raw = '("entity"<|>" A&amp;B "<|>t<|>d (x) y)##(entity<|>a<|>b<|>c)##("entity"<|>a<|>b)<|COMPLETE|>'
    got = text.entities(text.records(spark.createDataFrame([(1, raw)], "chunk_id long, raw string"))).collect()
    assert [(r["name"], r["description"]) for r in got] == [('" a&b "', "d (x) y")]


def test_ratio_and_links(spark):
    df = spark.createDataFrame([("Abcd", "abxd"), ("", None)], "a string, b string")
    assert [r["ratio"] for r in linking.sequence_ratio(df, "a", "b").collect()] == [SequenceMatcher(None, "abcd", "abxd").ratio(), 1.0]
    q = spark.createDataFrame([(1, "how many new york office staff")], "qid long, text string")
    names = spark.createDataFrame([("c1", "new york"), ("c2", "office staff name")], "name string, words string")
    assert {(r["name"], r["kind"]) for r in linking.schema_links(q, names).collect()} == {("c1", "exact"), ("c2", "prefix")}
    cells = linking.cell_links(q, spark.createDataFrame([("city", "New York")], "column string, value string"))
    assert [(r["start"], r["length"]) for r in linking.islands(cells).collect()] == [(2, 2)]


def test_result_equality(spark):
    a = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "x int, y int")
    b = spark.createDataFrame([(2, 1), (4, 3), (2, 1)], "p int, q int")
    assert evaluate.equal_under_permutation(a, b) is True
    assert evaluate.equal_as_sets(a, a.distinct()) and not evaluate.equal_as_bags(a, a.distinct())
    a.createOrReplaceTempView("some_rows")
    assert evaluate.run_sql(spark, "select nothing from nowhere")[0] == "ERROR"
    assert evaluate.run_sql(spark, "select * from some_rows where x > 9")[0] == "EMPTY"
    assert evaluate.run_sql(spark, "select * from some_rows")[0] == "CORRECT"


def test_column_functions(spark):
    df = spark.createDataFrame([("a b c",)], "s string")
    assert df.select(C.expansions(F.col("s"))).head()[0] == ["a b c", "a", "b c", "a b", "c"]
    v = spark.createDataFrame([([1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = v.select(C.quantize(F.col("a")), C.rescaled_cosine(F.col("a"), F.col("b")), C.rescaled_cosine(F.col("a"), F.col("a"))).head()
    assert r[0] == [0, 0] and r[1] == 0.0 and abs(r[2] - 1) < 1e-12
    assert spark.range(1).select(C.clean_sql(F.lit("select *\n from t where a > = 1; drop"))).head()[0] == "select * from t where a >= 1"


def test_schema_graph(spark):
    cols = spark.createDataFrame([("T", "ID", True), ("T", "R", False), ("S", "ID", True)], "table string, column string, is_key boolean")
    refs = spark.createDataFrame([("T", "R", "S", "ID")], "table string, column string, ref_table string, ref_column string")
    nodes, e = schema_graph.schema_graph(cols, refs)
    w = {(r["src"], r["dst"]): r["weight"] for r in e.collect()}
    assert nodes.count() == 5 and w["T", "T.R"] == 1.8 and w["S.ID", "T.R"] == 1.2 and len(w) == 8


def test_ingest_is_idempotent(spark, tmp_path):
    docs = spark.createDataFrame([("one two",), ("one two",), (None,), ("three",)], "text string")
    new, made = ingest.ingest_batch(docs, str(tmp_path / "kb"))
    assert new.count() == 2 and made.count() == 2
    new, made = ingest.ingest_batch(docs, str(tmp_path / "kb"))
    assert new.count() == 0 and made.count() == 0
    docs.write.parquet(str(tmp_path / "in"))
    ingest.ingest_stream(spark, str(tmp_path / "in"), "text string", str(tmp_path / "stream")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "stream" / "chunks")).count() == 2


def test_graphml(spark, tmp_path):
    (tmp_path / "g.xml").write_text('<graphml><key id="d0" for="node" attr.name="kind" attr.type="string"/><key id="d1" for="edge" attr.name="weight" attr.type="double"/><graph><node id="a"><data key="d0">x</data></node><node id="b"></node><edge source="a" target="b"><data key="d1">2.0</data></edge></graph></graphml>')
    nodes, e = store.read_graphml(spark, str(tmp_path / "g.xml"))
    assert {r["node"]: r["props"] for r in nodes.collect()} == {"a": {"kind": "x"}, "b": {}}
    assert e.head()["props"] == {"weight": "2.0"}
