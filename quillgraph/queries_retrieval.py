"""Queries from seeds to context, of example selection and of reading model output."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph import catalog as base
from quillgraph.functions import columns as C
from quillgraph.operators import diffusion, examples, graph, parsing, retrieval, vector_index
from quillgraph.registry import query
from quillgraph.session import table

# ---- the whole way: hits on parts, flow around them, orders as texts

_HITS = "h AS (SELECT p_partkey AS node, p_size * 1000 + p_partkey % 7 AS score FROM part WHERE p_partkey % 11 <> 0)"
_SEED_SQL = f"{_HITS}, seed AS (SELECT node, row_number() OVER (ORDER BY score DESC, node) AS rank FROM (SELECT * FROM h WHERE node IN (SELECT u FROM adj0) ORDER BY score DESC, node LIMIT 4))"


def _start(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(orders, seeds)."""
    orders = graph.written(base._orders(spark, sf), "orders")
    hits = table(spark, sf, "part").filter("p_partkey % 11 <> 0").select(F.col("p_partkey").alias("node"), (F.col("p_size") * 1000 + F.col("p_partkey") % 7).alias("score"))
    return orders, graph.cut(retrieval.seeds(hits, graph.paired(orders), 4))


def _flow_sql() -> str:
    sql = base._diffusion_sql(3)
    head, tail = sql.split(", m0 AS (", 1)
    head = head.replace("WITH ", f"WITH {base._EDGES}, adj0 AS (SELECT u FROM e UNION SELECT v FROM e), {_SEED_SQL}, ", 1).replace(f"{base._EDGES}, s AS", "s AS", 1)
    body = "m0 AS (" + tail.rsplit(" SELECT seed, node, round", 1)[0]
    return f"{head}, {body.replace('WHERE u IN (1, 2, 3, 5, 8)', 'WHERE u IN (SELECT node FROM seed)')}"


_MEMBERS = ", good AS (SELECT seed FROM m3 WHERE x > 0 GROUP BY seed HAVING count(*) > 1 AND max(x) >= 0.1), c AS (SELECT seed, node, x, row_number() OVER (PARTITION BY seed ORDER BY round(x, 6) DESC, node) AS place FROM m3 WHERE x > 0 AND seed IN (FROM good))"


@query(_flow_sql() + " SELECT node, rank::INT AS rank FROM seed")
def retrieval_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return _start(spark, sf)[1].select("node", F.col("rank").cast("int").alias("rank"))


def _members(spark: SparkSession, sf: str) -> tuple[diffusion.Near, DataFrame, DataFrame]:
    orders, found = _start(spark, sf)
    near = base._near(spark, sf, orders)
    flow = graph.cut(diffusion.diffuse_near(near, found.select(F.col("node").alias("seed")), rounds=3))
    return near, found, retrieval.cluster_members(flow.withColumn("x", F.round("x", 6)), 0.1)


@query(_flow_sql() + _MEMBERS + " SELECT seed, node, round(x, 6) AS x, place::INT AS place FROM c WHERE round(x, 6) > 0")
def retrieval_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf)[2].select("seed", "node", "x", F.col("place").cast("int").alias("place"))


@query(_flow_sql() + _MEMBERS + " SELECT a.seed, a.node AS src, b.node AS dst, round(adj.w, 6) AS weight FROM c a JOIN c b ON a.seed = b.seed JOIN adj ON adj.u = a.node AND adj.v = b.node")
def retrieval_cluster_edges(spark: SparkSession, sf: str) -> DataFrame:
    near, _, members = _members(spark, sf)
    members = graph.cut(members)
    adj = near(graph.cut(members.select("node").distinct()))
    return retrieval.cluster_edges(members, adj.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.round("w", 6).alias("weight")))


@query(_flow_sql() + _MEMBERS + " SELECT seed, string_agg('- ' || node || ' (' || p_type || '): ' || p_brand, chr(10) ORDER BY place) AS text FROM c JOIN part ON p_partkey = node GROUP BY seed")
def retrieval_cluster_text(spark: SparkSession, sf: str) -> DataFrame:
    _, _, members = _members(spark, sf)
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_type").alias("kind"), F.col("p_brand").alias("description"))
    return retrieval.cluster_text(members, members, nodes, "nodes")


@query(_flow_sql() + _MEMBERS + """ SELECT seed, '{"nodes":[' || string_agg('{"id":' || node || '}', ',' ORDER BY place) || '],"edges":[]}' AS json FROM c GROUP BY seed""")
def retrieval_cluster_json(spark: SparkSession, sf: str) -> DataFrame:
    _, _, members = _members(spark, sf)
    none = spark.createDataFrame([], "seed long, src long, dst long, weight double")
    return retrieval.cluster_json(members, none, members.select("node", F.lit("part").alias("kind")).distinct(), "minimal")


@query(_flow_sql() + """, mention AS (SELECT DISTINCT l_partkey AS node, l_orderkey AS chunk FROM lineitem), m AS (SELECT seed.node, rank, chunk FROM seed JOIN mention USING (node)), o AS (SELECT chunk, min(rank) AS seed_order FROM m GROUP BY 1),
n AS (SELECT m.chunk, count(*) AS rc FROM m JOIN adj ON adj.u = m.node JOIN mention x ON x.node = adj.v AND x.chunk = m.chunk GROUP BY 1),
t AS (SELECT chunk, seed_order, coalesce(rc, 0) AS rc, o_custkey % 50 + 1 AS tokens FROM o LEFT JOIN n USING (chunk) JOIN orders ON o_orderkey = chunk WHERE o_orderstatus <> 'F'),
r AS (SELECT *, sum(tokens) OVER w AS running, row_number() OVER w AS place FROM t WINDOW w AS (ORDER BY seed_order, rc DESC, chunk ROWS UNBOUNDED PRECEDING)) SELECT chunk, place::INT AS place, tokens::BIGINT AS tokens FROM r WHERE running <= 600""")
def retrieval_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds to texts: chunks that seeds mention, ranked, present and within the budget."""
    orders, found = _start(spark, sf)
    near = base._near(spark, sf, orders)
    adj = graph.written(near(found.select("node")), "edges")
    # only chunks that seeds mention are ranked; what else these mention is all that has to meet
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_orderkey").alias("chunk"))
    asked = graph.cut(lines.join(graph.few(found.select("node")), "node", "left_semi").select("chunk").distinct())
    mentions = graph.written(lines.join(graph.few(asked), "chunk", "left_semi").distinct(), "mentions")
    chunks = table(spark, sf, "orders").select(F.col("o_orderkey").alias("chunk"), F.when(F.col("o_orderstatus") != "F", "text").alias("content"), (F.col("o_custkey") % 50 + 1).alias("tokens"))
    return retrieval.text_context(found, mentions, adj.select(F.col("u").alias("src"), F.col("v").alias("dst")), chunks, 600).select("chunk", F.col("place").cast("int").alias("place"), "tokens")


@query("""WITH b AS (SELECT p_type AS content, 0 AS side, p_partkey AS place FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_type || CASE WHEN p_partkey % 3 = 0 THEN '!' ELSE '' END, 1, p_partkey FROM part WHERE p_partkey % 2 = 1),
o AS (SELECT content, arg_min((side, place), (side, place)) AS w FROM b GROUP BY 1) SELECT row_number() OVER (ORDER BY w, content)::INT AS id, content FROM o""")
def combined_sources(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("content"), F.col("p_partkey").alias("place"))
    local = p.filter("p_partkey % 2 = 1").withColumn("content", F.concat("content", F.when(F.col("p_partkey") % 3 == 0, "!").otherwise("")))
    return retrieval.combined_sources(p.filter("p_partkey % 2 = 0"), local).withColumn("id", F.col("id").cast("int"))


@query("""SELECT section, place::INT AS place, content, mode FROM (SELECT 'nodes' AS section, n_nationkey AS place, n_name AS content, 'local' AS mode FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 'nodes', n_nationkey, n_name, 'global' FROM nation WHERE n_nationkey >= 10
UNION ALL SELECT 'sources', row_number() OVER (ORDER BY side, r_regionkey), r_name, 'both' FROM (SELECT *, CASE WHEN r_regionkey >= 2 THEN 0 ELSE 1 END AS side FROM region))""")
def hybrid_contexts(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.lit("nodes").alias("section"), F.col("n_nationkey").alias("place"), F.col("n_name").alias("content"))
    r = table(spark, sf, "region").select(F.lit("sources").alias("section"), F.col("r_regionkey").alias("place"), F.col("r_name").alias("content"))
    return retrieval.hybrid_contexts(n.filter("place < 20").union(r.filter("place < 4")), n.filter("place >= 10").union(r.filter("place >= 2")))


@query("SELECT c AS node, 2 AS depth FROM (SELECT 'x' || min(c_custkey) AS c0, 1000 + min(c_custkey) AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0)")
def furthest_node(spark: SparkSession, sf: str) -> DataFrame:
    """From region 0 over its nations to its customers, all with the same flow."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("u"), (F.col("n_nationkey") + 100).cast("long").alias("v"))
    c = table(spark, sf, "customer").select((F.col("c_nationkey") + 100).cast("long").alias("u"), (F.col("c_custkey") + 1000).alias("v"))
    adj = graph.cut(graph.adjacency(n.union(c).withColumn("w", F.lit(1.0))))
    flow = adj.select(F.col("u").alias("node"), F.lit(1.0).alias("x")).distinct()
    return retrieval.furthest_node(adj, flow, 0)


@query("SELECT 1::BIGINT AS seed, coalesce(a.p_partkey, b.p_partkey) AS node, coalesce(a.p_size, 0)::DOUBLE AS plain, coalesce(b.p_size * 2, 0)::DOUBLE AS aware, coalesce(b.p_size * 2, 0)::DOUBLE - coalesce(a.p_size, 0) AS change FROM (SELECT * FROM part WHERE p_partkey % 2 = 0) a FULL JOIN (SELECT * FROM part WHERE p_partkey % 3 = 0) b USING (p_partkey)")
def compared_flows(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.lit(1).cast("long").alias("seed"), F.col("p_partkey").alias("node"), F.col("p_size").cast("double").alias("x"))
    return retrieval.compared_flows(p.filter("node % 2 = 0"), p.filter("node % 3 = 0").withColumn("x", F.col("x") * 2))


# ---- examples

_DIST = "round(sqrt(list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) ** 2))), 6)"
_PAIRS = f"p AS (SELECT a.vec_id AS qid, b.vec_id AS example, {_DIST} AS distance, round({base._COS}, 6) AS likeness FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND a.label <> b.label)"


def _met(spark: SparkSession, sf: str, k: int, measure) -> DataFrame:
    """(qid, example, score): the k best examples of other labels than the query's."""
    rows, queries = base._vectors(spark, sf)
    return vector_index.search(rows, queries, k, measure=measure).select("qid", F.col("id").alias("example"), "score")


@query(f"WITH {_PAIRS} SELECT qid, example, distance, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, example) AS rank FROM p) WHERE rank <= 5")
def nearest_examples(spark: SparkSession, sf: str) -> DataFrame:
    near = _met(spark, sf, 5, vector_index.nearness).withColumn("distance", -F.col("score"))
    return examples.nearest(near, 5).select("qid", "example", "distance", "rank")


@query(f"WITH {_PAIRS} SELECT qid, example, l AS likeness, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY l DESC, example) AS rank FROM (SELECT *, greatest(likeness, round(1 - distance, 6)) AS l FROM p)) WHERE rank <= 5")
def likely_examples(spark: SparkSession, sf: str) -> DataFrame:
    # who is among the best by the greater likeness is among the best by one of them
    said = _met(spark, sf, 5, vector_index.cosines).withColumnRenamed("score", "question_likeness")
    shape = _met(spark, sf, 5, lambda q, v: 1 + np.round(vector_index.nearness(q, v), 6)).withColumnRenamed("score", "skeleton_likeness")
    return examples.best_likeness(said.join(shape, ["qid", "example"], "full").na.fill(-9.0, ["question_likeness", "skeleton_likeness"]), 5)


@query(f"WITH {_PAIRS} SELECT qid, example, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN likeness >= 0.3 THEN 0 ELSE 1 END, distance, example) AS rank FROM p) WHERE rank <= 9")
def two_pass_examples(spark: SparkSession, sf: str) -> DataFrame:
    first = 1e6  # those that are like enough come before all others, the nearest first
    order = lambda q, v: np.where(np.round(vector_index.cosines(q, v), 6) >= 0.3, first, 0.0) + np.round(vector_index.nearness(q, v), 6)
    alike = F.col("score") > first / 2
    pairs = _met(spark, sf, 9, order).select("qid", "example", F.when(alike, 0.3).otherwise(0.0).alias("likeness"), (F.when(alike, first).otherwise(0.0) - F.col("score")).alias("distance"))
    return examples.two_passes(pairs, 9, 0.3)


_TOKENS = "w AS (SELECT p_partkey AS qid, unnest(string_split(p_type || ' x ' || p_brand, ' ')) AS token, generate_subscripts(string_split(p_type || ' x ' || p_brand, ' '), 1) - 1 AS pos FROM part)"


@query(f"WITH {_TOKENS} SELECT qid, regexp_replace(string_agg(CASE WHEN (qid + pos) % 2 = 0 OR pos = 1 THEN '_' ELSE token END, ' ' ORDER BY pos), '_( _)+', '_', 'g') AS text FROM w GROUP BY qid")
def masked_questions(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("qid"), F.posexplode(F.split(F.concat_ws(" x ", "p_type", "p_brand"), " ")).alias("pos", "token"))
    return examples.masked(t, t.filter("(qid + pos) % 2 = 0 or pos = 1"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS qid, l_returnflag AS t FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 2 = 0), a AS (SELECT DISTINCT l_orderkey AS qid, l_returnflag AS t FROM lineitem) SELECT qid, t AS "table" FROM l UNION ALL SELECT qid, t FROM a WHERE qid NOT IN (SELECT qid FROM l)""")
def relevant_tables(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_returnflag").alias("table"), "l_linenumber")
    return examples.relevant_tables(line.filter("l_linenumber = 1 and qid % 2 = 0"), line.select("qid", "table").distinct())


# ---- model output


def _reply(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) and not p.startswith("p_") else F.col(p).cast("string") for p in parts])


@query("""SELECT p_partkey, '{"a": "' || p_type || '", "b": {"c": ' || p_size || '}}' AS body FROM part""")
def json_bodies(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", parsing.json_body(_reply("Sure: {'a': '", "p_type", "',\n 'b': {'c': ", "p_size", "}} done")).alias("body")).withColumn("body", F.regexp_replace("body", ", +", ", "))


@query("SELECT p_partkey, p_type || ', ' || p_brand AS low, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS high FROM part")
def keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    high = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "p_brand", F.lit('"'))).otherwise("")
    text = F.concat(_reply('x {"low_level_keywords": ["', "p_type", '", "', "p_brand", '"], "high_level_keywords": ['), high, F.lit("]} y"))
    low, up = parsing.keywords(text)
    return table(spark, sf, "part").select("p_partkey", low.alias("low"), up.alias("high"))


@query("SELECT p_partkey, p_type AS first, CASE WHEN p_partkey % 2 = 0 THEN 'b' END AS second, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS n FROM part")
def tagged_blocks(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(_reply("<NODE> ", "p_type", " </NODE> and "), F.when(F.col("p_partkey") % 2 == 0, "<NODE>b</NODE>").otherwise("<NODE>open"))
    found = parsing.tagged(text, "NODE")
    return table(spark, sf, "part").select("p_partkey", F.get(found, F.lit(0)).alias("first"), F.get(found, F.lit(1)).alias("second"), F.size(found).alias("n"))


@query("SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN 0.5 / 1.05 WHEN p_size % 3 = 1 THEN 0.4 ELSE 0.4 END, 9)::DOUBLE AS first FROM part")
def weight_lists(spark: SparkSession, sf: str) -> DataFrame:
    text = F.element_at(F.array(F.lit("0.5, 0.3, 0.25"), F.lit("0.9 0.9 0.9"), F.lit("0.5, 0.5")), F.col("p_size") % 3 + 1)
    return table(spark, sf, "part").select("p_partkey", F.round(F.get(parsing.weights(text, (0.4, 0.3, 0.3)), F.lit(0)), 9).alias("first"))


@query("""SELECT p_partkey, 'SELECT ' || p_size AS sql, p_type || '|' || p_brand AS items, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verdict FROM part""")
def model_answers(spark: SparkSession, sf: str) -> DataFrame:
    sql = F.element_at(F.array(_reply('{"SQL": "SELECT ', "p_size", '"}'), _reply("so ```sql\nSELECT ", "p_size", "\n``` ok"), _reply("I think SELECT ", "p_size")), F.col("p_size") % 3 + 1)
    said = F.element_at(F.array(F.lit("Yes, it is"), F.lit("{'is_column_information_relevant': 'No'}"), F.lit("perhaps")), F.col("p_size") % 3 + 1)
    items = F.array_join(parsing.listed(_reply("out: ['", "p_type", "', \"", "p_brand", "\", ] end")), "|")
    return table(spark, sf, "part").select("p_partkey", parsing.sql_answer(sql).alias("sql"), items.alias("items"), parsing.verdict(said).alias("verdict"))


@query("SELECT p_partkey, 2 AS n, p_size / 2.0::DOUBLE AS second, round(p_size * 0.001 * 2 + 0.003 * 3, 9)::DOUBLE AS cost FROM part")
def candidate_scores(spark: SparkSession, sf: str) -> DataFrame:
    got = parsing.scores(F.concat(F.lit("Candidate Response #1: [[1]]\nCandidate Response #2: [["), (F.col("p_size") / 2).cast("string"), F.lit("]]\n#3: none")))
    return table(spark, sf, "part").select("p_partkey", F.size(got).alias("n"), got[1]["score"].alias("second"), F.round(parsing.cost(F.col("p_size"), F.lit(3), 2.0, 3.0), 9).alias("cost"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_type ELSE 'just ' || p_type END AS query, CASE WHEN p_size % 2 = 0 THEN 'a' END AS source FROM part")
def sub_query_lists(spark: SparkSession, sf: str) -> DataFrame:
    text = F.when(F.col("p_size") % 2 == 0, _reply('[{"query": "', "p_type", '", "source": "a", "target": "b"}]')).otherwise(_reply("just ", "p_type"))
    first = F.get(parsing.sub_queries(text), F.lit(0))
    return table(spark, sf, "part").select("p_partkey", first["query"].alias("query"), first["source"].alias("source"))
