"""Names, SQL text, result frames, files, embedding and ranks, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import embedding, evaluate, graph, profile, retrieval, schemas, sql_text, stores
from quillgraph.plans import schema_graph
from quillgraph.sources import catalogs, graph_files, store


def test_key_names_in_order(spark):
    names = ["ID", "film_id", "FILM_KEY", "pk_x", "key", "CODE", "uuid", "seq_no", "my_uuid", "zipcode", "film_num", "no", "record_x", "pid", "xid", "a_id", "name", "FILM.ID", "other"]
    want = []
    for n in names:
        want.append(next((p for pattern, p in profile.KEY_NAMES if re.search(pattern.format("FILM"), n.upper(), re.IGNORECASE)), 0))
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    got = [r["s"] for r in df.select("i", profile.name_score(F.col("n"), F.lit("film")).alias("s")).orderBy("i").collect()]
    assert got == want and len(set(want)) > 4


def test_key_score_of_defaults(spark):
    rows = spark.createDataFrame([("a", 10, 10, 0), ("b", 10, 10, 0)], "column string, row_count long, distinct_count long, null_count long")
    types = {f.name: f.dataType for f in spark.createDataFrame([(1, 1)], "a int, b int").schema.fields}
    got = {r["column"]: r["key_score"] for r in profile.key_scores(rows, types, "t", {"b": "seq.nextval"}).collect()}
    assert got == {"a": 65, "b": 80}


def test_reference_names_equal_patterns(spark):
    columns = ["FILM_ID", "FILMID", "film_film_id", "fk_film_x", "FILM_KEY", "ID", "OTHER", "FILM_IDX"]
    keys = [("FILM", "FILM_ID"), ("FILM", "ID"), ("X.Y", "A+B")]
    want = set()
    for c in columns:
        for t, k in keys:
            patterns = [p.replace("{table}", re.escape(t)).replace("{column}", re.escape(k)) for p in profile.REFERENCE_NAMES]
            if any(re.match(p, c.upper(), re.IGNORECASE) for p in patterns):
                want.add((c, t, k))
    df = spark.createDataFrame([("RENT", c, "INT") for c in columns], "table string, column string, type string")
    ref = spark.createDataFrame([(t, k, "TEXT") for t, k in keys], "ref_table string, ref_column string, ref_type string")
    got = profile.reference_names(df, ref).collect()
    assert {(r["column"], r["ref_table"], r["ref_column"]) for r in got} == want and {r["confidence"] for r in got} == {"low"}


def test_sql_text(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).head()[0]
    assert value(sql_text.without_comment(F.lit("select 1 /* x */ y"))) == "select 1"
    assert value(sql_text.without_distinct(F.lit("SELECT DISTINCT a, count(distinct b)"))) == "SELECT a, count(b)"
    assert value(sql_text.unquoted(F.lit(" 'a\nb' "))) == "a\nb" and value(sql_text.unquoted(F.lit("'a"))) == "'a"
    assert value(sql_text.action(F.lit("Thought: x\nAction: Bash(ls (a)\n b)"), "Bash")) == "ls (a)\n b"
    assert value(sql_text.unicode_decoded(F.lit(r"aéb中\u12"))) == "aéb中\\u12"
    assert value(sql_text.short_name(F.lit("Sales.Orders"))) == "sales.orders" and value(sql_text.short_name(F.lit("a of"))) == "metadata_entity"
    rows = spark.createDataFrame([("CREATE TABLE t (a INT, b DECIMAL(10, 2), c VARCHAR(5))",), ("none",), (None,)], "ddl string")
    assert [r["definitions"] for r in sql_text.split_definitions(rows).collect()] == [["a INT", "b DECIMAL(10, 2)", "c VARCHAR(5)"], [], []]
    spans = sql_text.parenthesis_spans(spark.createDataFrame([("a (b (c) d) e)",)], "text string")).head()["spans"]
    assert [(s["start"], s["end"]) for s in spans] == [(5, 8), (2, 11)]


def test_frames_and_verdicts(spark):
    a = spark.createDataFrame([(1, "x", 1.004), (2, "y", 2.0)], "a int, b string, c double")
    b = spark.createDataFrame([("y", 2.0, 2.0), ("x", 1.0, 1.001)], "p string, q double, r double")
    assert evaluate.equal_frames(a, b) and evaluate.contains_columns(a, b.select("q")) and not evaluate.contains_columns(b.select("q"), a)
    assert not evaluate.equal_frames(a, b.withColumn("q", F.lit(3)))
    a.createOrReplaceTempView("frame_a")
    assert evaluate.judged(spark, "select a from frame_a", "select a from frame_a union all select 1") == "--"
    assert evaluate.judged(spark, "select 5", "select a from frame_a") == "incorrect answer"
    assert evaluate.judged(spark, "select nothing", "select 1") == "error"
    assert evaluate.validate(spark, "select a from frame_a")[0] == "OK" and evaluate.validate(spark, "selec")[0] == "ERROR"
    assert evaluate.formatted(a.select("a")) == "Rows: 2, Columns: 1, Results: [(1,), (2,)]"


def test_permuted_columns_of_equal_digests(spark):
    a = spark.createDataFrame([(1, 1, 2), (2, 2, 1)], "a int, b int, c int")
    b = spark.createDataFrame([(2, 1, 1), (1, 2, 2)], "x int, y int, z int")
    assert evaluate.equal_under_permutation(a, b) is True
    assert evaluate.equal_under_permutation(a, spark.createDataFrame([(1, 1, 1), (2, 2, 2)], "x int, y int, z int")) is False
    assert evaluate.equal_under_permutation(a, b, most=1) in (True, None)


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a<b", {"kind": 'x"y', "none": None}), ("c", {})], "node string, props map<string,string>")
    edges = spark.createDataFrame([("a<b", "c", {"weight": "2.5"}), ("c", "c", {})], "src string, dst string, props map<string,string>")
    graph_files.write_graphml(nodes, edges, str(tmp_path / "g"))
    file = next((tmp_path / "g").glob("part-*"))
    n, e = store.read_graphml(spark, str(file))
    assert {r["node"]: r["props"] for r in n.collect()} == {"a<b": {"kind": 'x"y'}, "c": {}}
    assert {(r["src"], r["dst"]): r["props"] for r in e.collect()} == {("a<b", "c"): {"weight": "2.5"}, ("c", "c"): {}}
    graph_files.node_link(nodes, edges).write.text(str(tmp_path / "j"))
    n, e = graph_files.read_node_link(spark, str(tmp_path / "j"))
    assert n.count() == 2 and {r["dst"] for r in e.collect()} == {"c"}
    quoted = spark.createDataFrame([('"A"', '"B"', {})], "src string, dst string, props map<string,string>")
    assert [r["json"] for r in graph_files.ui_json(nodes, quoted).filter("kind = 'edge'").collect()] == ['{"source":"A","target":"B","weight":0.0}']


def test_schema_graph_texts(spark):
    cols = spark.createDataFrame([("T", "ID", True), ("T", "R", False), ("S", "ID", True)], "table string, column string, is_key boolean")
    refs = spark.createDataFrame([("T", "R", "S", "ID")], "table string, column string, ref_table string, ref_column string")
    nodes, e = schema_graph.schema_graph(cols, refs)
    assert sorted(r["line"] for r in graph_files.compact_lines(nodes, e).collect()) == ["S(ID)", "S.ID = T.R", "T(ID, R)"]
    got = {r["table"]: (r["columns"], r["references"]) for r in schemas.schema_details(nodes, e).collect()}
    assert got == {"T": (["ID", "R"], ["T.R = S.ID"]), "S": (["ID"], ["S.ID = T.R"])}
    flat = nodes.select("node", F.array(F.lit(1.0)).alias("meaning"), F.array(F.lit(0.0)).alias("structure"), F.array(F.lit(0.5)).alias("stats"))
    ones = e.select("src", "dst", *[F.array(F.lit(1.0)).alias(x) for x in ("relation", "meaning", "types")])
    assert all(abs(r["weight"] - r["w"]) < 1e-9 for r in schema_graph.reweight(e, flat, ones).join(e.withColumnRenamed("weight", "w"), ["src", "dst"]).collect())


def test_catalog_and_fetching(spark):
    spark.createDataFrame([(1, [{"b": 2}])], "a int, s array<struct<b:int>>").createOrReplaceTempView("kept_rows")
    got = {(r["position"], r["column"]) for r in catalogs.catalog_columns(spark).filter("table = 'kept_rows'").collect()}
    assert got == {(0, "a"), (1, "s")}
    assert [r["path"] for r in catalogs.field_paths(spark, "kept_rows").collect()] == ["a", "s", "s.b"]
    df = spark.range(50)
    assert [catalogs.fetched(df, x).count() for x in ("all", "one", "random", 7)] == [50, 1, 10, 7]
    assert catalogs.fetched(df, "random").collect() == catalogs.fetched(df, "random").collect() and catalogs.reduced_copy(df, 20).count() == 20


def test_embedding_by_halves(spark):
    import numpy as np

    calls = []

    def embedder(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise ValueError("no")
        return np.array([[len(t), 1.0] for t in texts])

    assert embedding.embedded_batch(["a", "bb", "bad", "dddd"], embedder, 2) == [[1.0, 1.0], [2.0, 1.0], [0.0, 0.0], [4.0, 1.0]] and calls == [4, 2, 2, 1, 1]

    def plain(texts):
        return np.array([[float(len(t))] for t in texts])

    rows = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "id long, content string")
    kept = spark.createDataFrame([(1, "a", [9.0]), (2, "old", [8.0])], "id long, content string, vector array<double>")
    got = {r["id"]: r["vector"] for r in embedding.embed_missing(rows, kept, plain).collect()}
    assert got == {1: [9.0], 2: [2.0], 3: [0.0]}


def test_ranks_equal_plain_iteration(spark):
    rnd = random.Random(2)
    rows = list({(rnd.randrange(30), rnd.randrange(40)): rnd.uniform(0.5, 2) for _ in range(120)}.items())
    n = {x for (a, b), _ in rows for x in (a, b)}
    out = {}
    for (a, _), w in rows:
        out[a] = out.get(a, 0) + w
    rank = dict.fromkeys(n, 1 / len(n))
    for _ in range(200):
        lost = sum(r for x, r in rank.items() if x not in out)
        new = dict.fromkeys(n, (0.15 + 0.85 * lost) / len(n))
        for (a, b), w in rows:
            new[b] += 0.85 * rank[a] * w / out[a]
        rank = new
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in rows], "src long, dst long, weight double")
    got = {r["node"]: r["rank"] for r in graph.pagerank_until(edges, tolerance=1e-9).collect()}
    assert got.keys() == n and all(abs(got[x] - rank[x]) < 1e-6 for x in n)


def test_stores_keep_null_attributes_and_empty_input(spark):
    nodes = spark.createDataFrame([(1, {"a": "x"}), (2, None)], "node long, props map<string,string>")
    new = spark.createDataFrame([(2, {"a": "y"}), (3, None)], "node long, props map<string,string>")
    assert {r["node"]: r["props"] for r in stores.upsert_nodes(nodes, new).collect()} == {1: {"a": "x"}, 2: {"a": "y"}, 3: {}}
    assert stores.upsert_nodes(nodes, new.limit(0)).count() == 2
    flow = spark.createDataFrame([(1, 1, 0.5), (1, 2, 0.0), (2, 3, 0.01), (2, 4, 0.02)], "seed long, node long, x double")
    assert retrieval.cluster_members(flow, 0.1).count() == 0  # a single node, and too little flow


@pytest.mark.parametrize("mode", ["full", "names"])
def test_cluster_text(spark, mode):
    members = spark.createDataFrame([(1, 5, 0.9, 1), (1, 6, 0.5, 2)], "seed long, node long, x double, place int")
    edges = spark.createDataFrame([(1, 5, 6, 1.5)], "seed long, src long, dst long, weight double")
    nodes = spark.createDataFrame([(5, "t", "five"), (6, None, None)], "node long, kind string, description string")
    text = retrieval.cluster_text(members, edges, nodes, mode).head()["text"]
    assert text == ("- 5 (t): five\n- 6 (UNKNOWN): \n5 -> 6 (1.50)" if mode == "full" else "5\n6")
    assert retrieval.cluster_json(members, edges, nodes).head()["json"] == '{"nodes":[{"id":5,"type":"t","flow":0.9},{"id":6,"flow":0.5}],"edges":[{"src":5,"dst":6,"w":1.5}]}'


def test_names_that_need_quotes(spark):
    from quillgraph.functions import columns as C

    want = {"ORDER": '"ORDER"', "A_1": "A_1", "9A": '"9A"', "a": '"a"', "": '""', 'A"B': '"A""B"', "A$": '"A$"', "{X}": "{X}", "TRY_CAST": '"TRY_CAST"'}
    df = spark.createDataFrame([(k,) for k in want], "s string")
    assert dict(df.select("s", C.quote_identifier(F.col("s"))).collect()) == want


def test_columns_spelt_almost_alike_equal_brute_force(spark):
    import difflib
    import itertools
    import random

    from quillgraph.operators import linking

    rng = random.Random(4)
    stems = ["customer name", "order_key", "ship dates", "part", "s", "", "a_b", "total price of line"]
    spoilt = [w[:i] + rng.choice("abs_ x") + w[i + 1 :] for w in stems for i in (rng.randrange(max(1, len(w))) for _ in range(6))]
    names, columns = stems + spoilt[::2], stems + spoilt[1::2]
    plain = lambda x: x.lower().replace(" ", "").replace("_", "").rstrip("s")
    want = {(a, b) for a, b in itertools.product(names, columns) if difflib.SequenceMatcher(None, plain(b), plain(a)).ratio() >= 0.9}
    n = spark.createDataFrame([(1, x) for x in names] + [(1, None)], "question int, name string")
    c = spark.createDataFrame([("t", x) for x in columns] + [("t", None)], "table string, column string")
    got = linking.matching_columns(n, c)
    assert {(r["name"], r["column"]) for r in got.collect()} == want and len(want) > 10 and got.count() == len(want)
    k = spark.createDataFrame([(1, " size = (a (b) c) d ")], "question int, keyword string")
    assert {r["name"] for r in linking.possible_names(k).collect()} == {"size = (a (b) c) d", "size", "=", "(a", "(b)", "c)", "d", "(a (b) c)"}


def test_reference_classes_take_references_in_order(spark):
    from quillgraph.operators import schemas

    rows = [("x", 0, 1, 2), ("x", 1, 3, 4), ("x", 2, 2, 3), ("x", 3, 5, 4), ("y", 0, 9, 8), ("y", 1, None, 8)]
    got = schemas.reference_classes(spark.createDataFrame(rows, "db string, pos int, key int, ref_key int"))
    # 2-3 joins the first class; 3 is then in both and told by the later one, whose smallest key it is
    assert {tuple(r) for r in got.collect()} == {("x", 1, 1), ("x", 2, 1), ("x", 3, 3), ("x", 4, 3), ("x", 5, 3), ("y", 8, 8), ("y", 9, 8)}


def test_sqlite_file(spark, tmp_path):
    import sqlite3

    from quillgraph.sources import sqlite

    path = str(tmp_path / "a file.sqlite")
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE a (id INTEGER PRIMARY KEY, name TEXT, price REAL, raw BLOB, free)")
    con.execute('CREATE TABLE "b b" (k INT REFERENCES a, v VARCHAR(5)) ')
    con.execute("CREATE TABLE e (x NUMERIC)")
    con.execute("CREATE TABLE w (k TEXT PRIMARY KEY, n INT) WITHOUT ROWID")
    con.execute("CREATE VIEW v AS SELECT name FROM a WHERE id < 3")
    con.executemany("INSERT INTO a VALUES (?, ?, ?, ?, ?)", [(i * i - 5, f"n{i}", i / 2, bytes([i]), i) for i in range(1, 60)] + [(-9, None, None, None, None)])
    con.execute("UPDATE a SET name = CAST(x'66FC72' AS TEXT) WHERE id = -4")
    con.executemany('INSERT INTO "b b" VALUES (?, ?)', [(1, "x"), (None, "y"), ("odd", "z")])
    con.execute("INSERT INTO w VALUES ('a', 1)")
    con.commit()
    con.close()
    a = sqlite.scan(spark, path, "a", parts=4)
    assert a.dtypes == [("id", "bigint"), ("name", "string"), ("price", "double"), ("raw", "binary"), ("free", "string")]
    rows = {r["id"]: r for r in a.collect()}
    assert len(rows) == 60 == a.count() and rows[-4]["name"] == "für" and rows[20]["free"] == "5" and rows[-9]["raw"] is None and bytes(rows[20]["raw"]) == b"\x05"
    assert sqlite.scan(spark, path, "e").count() == 0 and sqlite.scan(spark, path, "w").count() == 1 and sqlite.scan(spark, path, "v").count() == 4 - 1
    assert {r["k"] for r in sqlite.scan(spark, path, "b b", types={"k": "string"}).collect()} == {"1", None, "odd"}
    with pytest.raises(Exception, match="odd|int"):
        sqlite.scan(spark, path, "b b").collect()
    with pytest.raises(ValueError):
        sqlite.scan(spark, path, "none")
    assert [tuple(r) for r in sqlite.references(spark, path).collect()] == [("b b", "k", "a", "id")]
    assert {r["table"]: r["kind"] for r in sqlite.tables(spark, path).collect()} == {"a": "table", "b b": "table", "e": "table", "w": "table", "v": "view"}
    assert [r["column"] for r in sqlite.columns(spark, path).filter("is_key").collect()] == ["id", "k"]
