"""What must not grow with the input in one place: sent to all tasks, held by one task, or dealt anew each round."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import diffusion, graph, linking, phrases, text, tokens
from quillgraph.operators.lineage import Lineage


def sent(df) -> list[str]:
    """The steps whose rows are sent whole to every task."""
    found, at = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        if at is not None and depth <= at:
            at = None
        if at is None and "BroadcastExchange" in line:
            at = depth
        elif at is not None:
            found.append(line.strip())
    return found


def test_chunks_are_made_in_pieces(spark):
    most = tokens.PIECE

    class Wary(tokens.CodePoints):
        """Refuses more than a piece at once, unless it is one text."""

        def encode(self, texts):
            assert sum(map(len, texts)) <= max(most, *map(len, texts), 0)
            return [list(map(ord, t)) for t in texts]

        def decode(self, ids):
            assert sum(map(len, ids)) <= most
            return ["".join(map(chr, x)) for x in ids]

    docs = spark.range(0, 700, 1, 1).select(F.when(F.col("id") > 0, F.col("id") + 2**60).alias("doc_id"), F.when(F.col("id") != 5, F.repeat(F.lit("añ b"), F.when(F.col("id") == 9, 90000).otherwise(500).cast("int"))).alias("text"))
    got = tokens.token_chunks(docs, Wary()).groupBy("full_doc_id").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"), F.max("start").alias("s")).collect()
    by = {r[0]: tuple(r)[1:] for r in got}
    assert len(by) == 699 and by[None] == by[2**60 + 1] == (2, 2100, 1100) and 2**60 + 5 not in by
    assert by[2**60 + 9] == (328, 360000 + 327 * 100, 327 * 1100)


@pytest.fixture(scope="module")
def words(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("w") / "q")
    spark.createDataFrame([(1, "Large red ring"), (2, "small ring")], "qid long, text string").write.parquet(at)
    return spark.read.parquet(at)


def test_grams_are_not_sent_whole(spark, words):
    names = spark.createDataFrame([("a", "red ring"), ("b", "ring of fire")], "name string, words string")
    links = linking.schema_links(words, names)
    assert not any("explode" in line for line in sent(links))
    assert sorted(map(tuple, links.collect())) == [(1, "a", "exact", 2), (1, "b", "prefix", 1), (2, "b", "prefix", 1)]


def test_words_of_questions_are_neither_sent_nor_sorted_to_meet_cells(spark, words):
    cells = words.select(F.lit("t").alias("table"), F.lit("c").alias("column"), F.split("text", " ")[1].alias("value"))
    df = phrases.cell_phrases(words, cells)
    assert not sent(df) and "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[3:] for r in df.collect()) == [(1, 1, "ring", "exact"), (1, 2, "red ring", "partial")]


@pytest.mark.parametrize("what", ["tables", "columns", "literals"])
def test_tokens_of_statements_are_not_sent_whole(spark, words, what):
    statements = words.select(F.col("qid").alias("sid"), F.lit("SELECT a FROM t WHERE b IN (1, 2) AND a = 'x'").alias("sql"))
    df = getattr(Lineage(statements, spark.createDataFrame([("t", "a"), ("t", "b")], "table string, column string")), what)()
    assert not any("explode" in line or "sid" in line for line in sent(df))
    assert df.count() == {"tables": 2, "columns": 4, "literals": 6}[what]


def depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_rounds_do_not_deal_the_edges_again(spark):
    adj = graph.adjacency(spark.createDataFrame([(i, j, 1.0) for i in range(9) for j in range(i, 9, 2)], "u long, v long, w double"))
    assert sorted(map(tuple, adj.filter("u = 0 or v = 0").collect())) == [(0, 0, 1.0), *[(0, j, 1.0) for j in (2, 4, 6, 8)], *[(j, 0, 1.0) for j in (2, 4, 6, 8)]]
    assert plan(adj).count("Scan") == 1
    moves, sinks, state = diffusion.start(adj, spark.createDataFrame([(0,)], "seed long"), 50.0, 0.7)
    pushed = diffusion.push_round(moves, sinks, state)
    lines = plan(pushed).splitlines()
    for name, ends in (("w#", "u#"), ("sink#", "total#")):
        at = next(i for i, line in enumerate(lines) if "FileScan" in line and name in line and ends in line)
        over, least = [], depth(lines[at])
        for line in reversed(lines[:at]):
            if depth(line) < least:
                over, least = [*over, line], depth(line)
        assert "Join" in next(line for line in over if "Exchange" in line or "Join" in line)
    assert abs(pushed.agg(F.sum("m")).head()[0] - 50 * 1.7 * 5) < 1e-9


def test_mentions_are_not_sent_whole(spark, tmp_path):
    spark.createDataFrame([(1, 10), (2, 10), (2, 11), (3, 12)], "node long, chunk long").write.parquet(str(tmp_path / "m"))
    mentions = spark.read.parquet(str(tmp_path / "m"))
    seeds, edges = spark.createDataFrame([(1, 1), (2, 2)], "node long, rank int"), spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    df = text.rank_text_units(seeds, mentions, edges)
    assert not any("AS dst" in line and "chunk" in line for line in sent(df))
    assert sorted(map(tuple, df.collect())) == [(10, 1, 1), (11, 2, 0)]


def test_retrieval_of_seeds_runs_no_flow(spark, monkeypatch):
    from quillgraph import catalog

    monkeypatch.setattr(diffusion, "diffuse", None)
    assert catalog.QUERIES["retrieval_seeds"](spark, "/root/testdata/sf0.001").count() == 4


def grouped(spark, rows):
    return graph.members(spark.createDataFrame(rows, "group long, place int, node long"))


def test_edges_are_made_where_mass_arrives(spark, monkeypatch):
    """A second component of any size costs a flow in the first one nothing: none of its edges is made."""
    rng = random.Random(3)
    rows = [(o + 1000 * part, n, p + 100 * part) for part in range(4) for o in range(40) for n, p in enumerate(rng.choices(range(30), k=3))]
    rows += [(None, 1, 1), (None, 2, 2), (5000, None, 1), (5000, 2, 2), (5001, 1, None), (5001, 2, 2), (5002, 1, 1), (5002, 1, 2), (5003, 1, 1), (5003, 2, 1)]
    orders = graph.written(grouped(spark, rows))
    adj = graph.adjacency(graph.pairs(orders))
    seeds = spark.createDataFrame([(1,), (2,), (-5,)], "seed long")
    made = []

    def near(nodes):
        made.append(graph.cut(graph.near(orders, nodes)))
        return made[-1]

    def plain(df):
        return sorted((r.seed, r.node, round(r.m, 9), round(r.x, 9), r.converged) for r in df.collect())

    for rounds, alpha in ((3, 50.0), (12, 2.0)):
        made.clear()
        got = plain(diffusion.diffuse_near(near, seeds, alpha=alpha, rounds=rounds))
        assert got == plain(diffusion.diffuse(adj, seeds, alpha=alpha, rounds=rounds)) and got
        edges = [tuple(r) for df in made for r in df.collect()]
        assert len(edges) == len(set(edges)) and all(u < 100 and v < 100 for u, v, _ in edges)
        assert set(edges) <= {tuple(r) for r in adj.collect()}
    # rows without group, place or node stand with nothing, nor does a node with itself or at one place
    assert not graph.pairs(grouped(spark, rows[-10:])).count()
    # many nodes are not sent whole, and come to the same
    nodes = graph.cut(adj.select(F.col("u").alias("node")).distinct())
    assert any("BroadcastExchange" in line for line in plan(graph.near(orders, nodes)).splitlines())
    monkeypatch.setattr(graph, "FEW", 5)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        whole = graph.near(orders, nodes)
        assert not sent(whole) and sorted(map(tuple, whole.collect())) == sorted(map(tuple, adj.collect()))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def dealt_whole(monkeypatch):
    """From here on nothing may make all edges."""
    for name in ("adjacency", "by_end", "pairs"):
        monkeypatch.setattr(graph, name, None)
    monkeypatch.setattr(diffusion, "by_end", None)


@pytest.mark.parametrize("name", ["diffusion_converged", "diffusion_rounds", "retrieval_seeds", "retrieval_texts", "retrieval_cluster_edges", "retrieval_cluster_json", "retrieval_cluster_text", "retrieval_clusters"])
def test_query_makes_no_edges_elsewhere(spark, monkeypatch, name):
    from quillgraph import catalog

    dealt_whole(monkeypatch)
    assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count()


def test_ranks_leave_few_parts_and_edges_are_not_counted(spark, monkeypatch):
    """A node's sum leaves every part: their number doesn't follow the shuffle partitions of a larger input."""
    rng = random.Random(5)
    orders = graph.written(grouped(spark, [(o, n, p) for o in range(60) for n, p in enumerate(rng.choices(range(25), k=rng.randint(1, 5)))] + [(99, 1, 1), (99, 1, 2), (98, 1, 3), (98, 2, 3)]))
    adj = graph.adjacency(graph.pairs(orders))
    edges = [tuple(r) for r in adj.collect()]
    total = {u: sum(w for a, _, w in edges if a == u) for u, _, _ in edges}
    want = dict.fromkeys(total, 1 / len(total))
    for _ in range(4):
        want = {v: 0.15 / len(total) + 0.85 * sum(w / total[u] * want[u] for u, b, w in edges if b == v) for v in total}
    by_end, parts = graph.by_end, []

    def seen(*args):
        parts.append(by_end(*args))
        return parts[-1]

    monkeypatch.setattr(graph, "by_end", seen)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        for ranks in (graph.pagerank(adj, 4), graph.pagerank_together(orders, 4)):
            assert {r["node"]: round(r["rank"], 12) for r in ranks.collect()} == {v: round(x, 12) for v, x in want.items()}
        for df in parts:
            assert df.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism < 40
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    from quillgraph import catalog

    monkeypatch.setattr(graph, "pairs", None)
    assert catalog.QUERIES["pagerank_rounds"](spark, "/root/testdata/sf0.001").count()
