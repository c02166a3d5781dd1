"""Registry of the engine's own queries and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import columns as C
from quillgraph.operators import diffusion, evaluate, graph, linking, paths, profile, rendering, text, vector_index
from quillgraph.registry import ORACLES, QUERIES, Query, query
from quillgraph.session import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["diffusion_converged"](spark, sf_dir)


# ---- documents, chunks, stores


@query("SELECT doc_id, 'doc-' || md5(trim(text, ' ')) AS key FROM documents")
def doc_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", C.content_id("doc-", F.trim("text")).alias("key"))


_CHUNKS = """w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
c AS (SELECT doc_id AS full_doc_id, w, unnest(generate_series(0, len(w) - 1, 1100)) AS p FROM w WHERE len(w) > 0),
chunk AS (SELECT full_doc_id, (p // 1100)::INT AS chunk_order_index, least(1200, len(w) - p)::INT AS tokens, array_to_string(w[p + 1 : p + 1200], ' ') AS content FROM c)"""


@query(f"WITH {_CHUNKS} SELECT full_doc_id, chunk_order_index, tokens, 'chunk-' || md5(content) AS chunk_id FROM chunk")
def chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return text.chunks(table(spark, sf, "documents")).drop("content")


@query("SELECT doc_id, source, running FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM documents) WHERE running <= 40000")
def token_budget(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return text.budget_prefix(docs, ["source"], ["doc_id"], "n_chars", 40000).select("doc_id", "source", "running")


@query("SELECT doc_id, text_id, lang FROM (SELECT doc_id, md5(text) AS text_id, lang, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def dedupe_sources(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.encode("text", "utf-8")).alias("text_id"), "lang")
    return text.first_of_each(docs, "text_id", ["doc_id"])


# ---- extraction and merging


@query("SELECT p_partkey AS chunk_id, lower(p_name) AS name, p_type AS entity_type, p_brand AS description FROM part WHERE trim(p_name) <> ''")
def extract_entities(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit('("entity"<|>'), "p_name", F.lit("<|>"), "p_type", F.lit("<|>"), "p_brand", F.lit(')##("entity"<|>only<|>three)##(entity<|>a<|>b<|>c)<|COMPLETE|>'))
    return text.entities(text.records(table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), raw.alias("raw")))).drop("seq")


@query("SELECT p_partkey AS chunk_id, lower(p_brand) AS src, lower(p_type) AS dst, p_size::DOUBLE AS weight FROM part UNION ALL SELECT p_partkey, 'a', 'b', 1.0 FROM part")
def extract_relations(spark: SparkSession, sf: str) -> DataFrame:
    raw = F.concat(F.lit('("relationship"<|>'), "p_brand", F.lit("<|>"), "p_type", F.lit("<|>d<|>k<|>"), F.col("p_size").cast("string"), F.lit(')##("relationship"<|>A<|>B<|>d<|>k<|>strong)'))
    return text.relations(text.records(table(spark, sf, "part").select(F.col("p_partkey").alias("chunk_id"), raw.alias("raw")))).select("chunk_id", "src", "dst", "weight")


@query("""SELECT name, arg_max(entity_type, (n, -first)) AS entity_type, any_value(description) AS description, any_value(source_id) AS source_id FROM
(SELECT p_brand AS name, p_type AS entity_type, count(*) AS n, min(p_partkey) AS first FROM part GROUP BY ALL) JOIN
(SELECT p_brand AS name, string_agg(DISTINCT p_size::VARCHAR, '<SEP>' ORDER BY p_size::VARCHAR) AS description, md5(string_agg(DISTINCT p_partkey::VARCHAR, '<SEP>' ORDER BY p_partkey::VARCHAR)) AS source_id FROM part GROUP BY 1) USING (name) GROUP BY name""")
def node_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_brand").alias("name"), F.col("p_type").alias("entity_type"), F.col("p_size").cast("string").alias("description"), F.col("p_partkey").cast("string").alias("source_id"), F.col("p_partkey").alias("seq"))
    return text.merge_nodes(rows).withColumn("source_id", F.md5("source_id"))


@query("SELECT p_brand AS src, p_type AS dst, sum(p_size)::DOUBLE AS weight, string_agg(DISTINCT p_size::VARCHAR, '<SEP>' ORDER BY p_size::VARCHAR) AS keywords FROM part GROUP BY 1, 2")
def edge_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    size = F.col("p_size").cast("string")
    rows = p.select(F.col("p_brand").alias("src"), F.col("p_type").alias("dst"), F.col("p_size").cast("double").alias("weight"), size.alias("description"), size.alias("keywords"), size.alias("source_id"))
    return text.merge_edges(rows).select("src", "dst", "weight", "keywords")


# ---- graphs: parts that stand in the same order (an order has a handful of lines)

_EDGES = "e AS (SELECT least(a.l_partkey, b.l_partkey) AS u, greatest(a.l_partkey, b.l_partkey) AS v, count(*)::DOUBLE AS w FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_partkey <> b.l_partkey GROUP BY ALL)"
_ADJ = f"{_EDGES}, adj AS (SELECT u, v, w FROM e UNION ALL SELECT v, u, w FROM e)"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """An order's few lines, brought together once."""
    return graph.members(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("group"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("node")))


def _projection(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pairs(_orders(spark, sf))


_DIRECTED = "SELECT l_partkey AS src, l_suppkey AS dst, max(l_quantity) AS weight FROM lineitem GROUP BY 1, 2"


def _directed(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")).agg(F.max("l_quantity").alias("weight"))


@query(f"WITH d AS ({_DIRECTED}) SELECT least(src, dst) AS u, greatest(src, dst) AS v, max(weight) AS w FROM d GROUP BY ALL")
def undirected_projection(spark: SparkSession, sf: str) -> DataFrame:
    return graph.undirected(_directed(spark, sf))


@query(f"WITH d AS ({_DIRECTED}) SELECT node, count(*) AS degree FROM (SELECT src AS node FROM d UNION ALL SELECT dst FROM d) GROUP BY 1")
def degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(_directed(spark, sf))


@query(f"WITH d AS ({_DIRECTED}), g AS (SELECT node, count(*) AS n FROM (SELECT src AS node FROM d UNION ALL SELECT dst FROM d) GROUP BY 1) SELECT src, dst, a.n + b.n AS edge_degree FROM d JOIN g a ON a.node = src JOIN g b ON b.node = dst")
def edge_degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.edge_degrees(_directed(spark, sf))


@query("SELECT 'nodes' AS kind, count(*) AS n FROM part UNION ALL SELECT 'edges', count(*) FROM lineitem UNION ALL SELECT 'type:' || p_type, count(*) FROM part GROUP BY p_type")
def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    return graph.graph_stats(table(spark, sf, "part").select(F.col("p_type").alias("entity_type")), table(spark, sf, "lineitem"))


@query(f"WITH d AS ({_DIRECTED}) SELECT DISTINCT node, 'UNKNOWN' AS entity_type FROM (SELECT src AS node FROM d UNION ALL SELECT dst FROM d) WHERE node NOT IN (SELECT s_suppkey FROM supplier)")
def missing_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.missing_endpoints(_directed(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node")))


@query(f"WITH d AS ({_DIRECTED}) SELECT src, dst, weight FROM d WHERE src IN (SELECT s_suppkey FROM supplier) AND dst IN (SELECT s_suppkey FROM supplier)")
def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.induced(_directed(spark, sf), table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))).select("src", "dst", "weight")


@query(f"WITH {_ADJ} SELECT u, v, w, r FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY w DESC, v) AS r FROM adj) WHERE r <= 10")
def strongest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return graph.strongest_neighbours(graph.adjacency(_projection(spark, sf)), 10)


def _place_graph(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("u"), F.concat(F.lit("n"), "n_nationkey").alias("v"), F.lit(1.0).alias("w"))
    c = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("u"), F.concat(F.lit("c"), "c_custkey").alias("v"), F.lit(1.0).alias("w"))
    return graph.adjacency(n.union(c).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "w"))


@query("SELECT 'r0' AS node, 0 AS depth UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 'c' || c_custkey, 2 FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 0")
def bfs_levels(spark: SparkSession, sf: str) -> DataFrame:
    return graph.bfs(graph.cut(_place_graph(spark, sf)), spark.createDataFrame([("r0",)], "node string"))


@query("""WITH x AS (SELECT 'r' || r_regionkey AS node, r_regionkey AS r FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'n' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT node, min(node) OVER (PARTITION BY r) AS component FROM x""")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.components(graph.cut(_place_graph(spark, sf)))


def _pagerank_sql(rounds: int) -> str:
    steps = ["r0 AS (SELECT u AS node, 1.0::DOUBLE / (SELECT count(*) FROM t) AS rank FROM t)"]
    steps += [f"r{k} AS (SELECT adj.v AS node, 0.15::DOUBLE / (SELECT count(*) FROM t) + 0.85::DOUBLE * sum(w / t * rank) AS rank FROM adj JOIN t ON t.u = adj.u JOIN r{k - 1} ON node = adj.u GROUP BY 1)" for k in range(1, rounds + 1)]
    return f"WITH {_ADJ}, t AS (SELECT u, sum(w) AS t FROM adj GROUP BY 1), {', '.join(steps)} SELECT node, round(rank, 9) AS rank FROM r{rounds}"


@query(_pagerank_sql(5))
def pagerank_rounds(spark: SparkSession, sf: str) -> DataFrame:
    return graph.pagerank_together(_orders(spark, sf), 5).select("node", F.round("rank", 9).alias("rank"))


# ---- query-aware diffusion: parts are like the question by their price

_SIM = "s AS (SELECT p_partkey AS node, (p_partkey % 97) / 96.0::DOUBLE AS s FROM part)"


def _similarity(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("node"), ((F.col("p_partkey") % 97) / 96.0).alias("s"))


def _weight_sql(formula: str) -> str:
    return f"WITH {_EDGES}, {_SIM} SELECT u, v, round({formula}, 9) AS w FROM e JOIN s a ON a.node = u JOIN s b ON b.node = v"


def _weights(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return diffusion.weighted(_projection(spark, sf), _similarity(spark, sf), kind).withColumn("w", F.round("w", 9))

    return run


for _kind, _formula in (("original", "w * (1 + 0.5::DOUBLE * (a.s + b.s) / 2)"), ("multiply", "w * a.s * b.s"), ("add", "(w + a.s + b.s) / 3")):
    QUERIES[f"edge_weight_{_kind}"] = _weights(_kind)
    ORACLES[f"edge_weight_{_kind}"] = _weight_sql(_formula)

_SEEDS = (1, 2, 3, 5, 8)


def _diffusion_sql(rounds: int) -> str:
    steps = ["m0 AS (SELECT u AS seed, u AS node, 50 * 1.7::DOUBLE * sink AS m, 0::DOUBLE AS x FROM k WHERE u IN (1, 2, 3, 5, 8))"]
    for i in range(1, rounds + 1):
        steps.append(
            f"m{i} AS (SELECT seed, node, sum(m) AS m, sum(x) AS x FROM (SELECT seed, node, least(m, sink) AS m, x + greatest(0, m - sink) / total AS x FROM m{i - 1} JOIN k ON k.u = node"
            f" UNION ALL SELECT seed, adj.v, (m - sink) * w / total, 0 FROM m{i - 1} JOIN k ON k.u = node AND m > sink JOIN adj ON adj.u = node) GROUP BY ALL)"
        )
    return f"WITH {_EDGES}, {_SIM}, q AS (SELECT u, v, w * (1 + 0.5::DOUBLE * (a.s + b.s) / 2) AS w FROM e JOIN s a ON a.node = u JOIN s b ON b.node = v), adj AS (SELECT u, v, w FROM q UNION ALL SELECT v, u, w FROM q), k AS (SELECT u, count(*)::DOUBLE AS sink, sum(w) AS total FROM adj GROUP BY 1), {', '.join(steps)} SELECT seed, node, round(m, 6) AS m, round(x, 6) AS x FROM m{rounds}"


def _flow_sql(rounds: int, alpha: float, result: str) -> str:
    """result over the last of so many rounds, each written once."""
    sql = _diffusion_sql(rounds).replace("50 * 1.7::DOUBLE", f"{alpha} * 1.7::DOUBLE").rsplit(" SELECT seed, node, round", 1)[0]
    for i in range(rounds + 1):
        sql = sql.replace(f", m{i} AS (", f", m{i} AS MATERIALIZED (")
    return f"{sql} {result.replace('$', f'm{rounds}')}"


def _near(spark: SparkSession, sf: str, orders: DataFrame) -> diffusion.Near:
    """Weighted edges of nodes, made from all orders (members) when asked for."""

    def near(nodes: DataFrame) -> DataFrame:
        edges = graph.written(graph.near(orders, nodes), "edges")
        ends = graph.cut(edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct())
        return diffusion.weighted(edges, _similarity(spark, sf).join(graph.few(ends), "node", "left_semi"))

    return near


def _flow_graph(spark: SparkSession, sf: str) -> tuple[diffusion.Near, DataFrame]:
    near = _near(spark, sf, graph.written(_orders(spark, sf), "orders"))
    return near, spark.createDataFrame([(i,) for i in _SEEDS], "seed long")


@query(_diffusion_sql(3))
def diffusion_rounds(spark: SparkSession, sf: str) -> DataFrame:
    near, seeds = _flow_graph(spark, sf)
    return diffusion.diffuse_near(near, seeds, rounds=3).select("seed", "node", F.round("m", 6).alias("m"), F.round("x", 6).alias("x"))


def _stopped_sql(rounds: int, every: int) -> str:
    """The state of the first check whose excess over all seeds is below the tolerance, else the last one."""
    checks = [*range(every, rounds, every), rounds]
    sums = " UNION ALL ".join(f"SELECT {k} AS k, sum(greatest(0, m - sink)) AS e FROM m{k} JOIN k ON k.u = node" for k in checks)
    states = " UNION ALL ".join(f"SELECT {k} AS k, seed, node, m, x FROM m{k}" for k in checks)
    return f"SELECT seed, node, round(m, 6) AS m, round(x, 6) AS x, sum(greatest(0, m - sink)) OVER (PARTITION BY seed) < 0.05 AS converged FROM ({states}) z JOIN k ON k.u = node WHERE z.k = (SELECT min(k) FROM ({sums}) y WHERE e < 0.05 OR y.k = {rounds})"


@query(_flow_sql(40, 5.0, _stopped_sql(40, 5)))
def diffusion_converged(spark: SparkSession, sf: str) -> DataFrame:
    near, seeds = _flow_graph(spark, sf)
    flow = diffusion.diffuse_near(near, seeds, alpha=5.0, rounds=40, check_every=5)
    return flow.select("seed", "node", F.round("m", 6).alias("m"), F.round("x", 6).alias("x"), "converged")


@query(_flow_sql(10, 50.0, "SELECT seed, count(*) AS size, round(max(x), 6) AS max_flow FROM $ WHERE x > 0 GROUP BY seed HAVING count(*) > 1 AND max(x) >= 0.1"))
def diffusion_clusters(spark: SparkSession, sf: str) -> DataFrame:
    near, seeds = _flow_graph(spark, sf)
    return diffusion.clusters(diffusion.diffuse_near(near, seeds, rounds=10, check_every=11)).withColumn("max_flow", F.round("max_flow", 6))


_HOPS = 14  # more than any path here has


def _settled_sql(name: str, cost: str) -> str:
    """Costs from each seed by as many rounds as the longest path has hops, and predecessors."""
    rounds = [f"{name}0 AS (SELECT seed, seed AS node, 0::DOUBLE AS cost FROM x WHERE seed = node)"]
    rounds += [f"{name}{i} AS MATERIALIZED (SELECT seed, node, min(cost) AS cost FROM (SELECT * FROM {name}{i - 1} UNION ALL SELECT e.seed, e.v, cost + {cost} FROM {name}{i - 1} d JOIN edge e ON e.seed = d.seed AND e.u = d.node) z GROUP BY ALL)" for i in range(1, _HOPS + 1)]
    rounds.append(f"{name}_before AS MATERIALIZED (SELECT e.seed, e.v AS node, min(e.u) AS before FROM edge e JOIN {name}{_HOPS} a ON a.seed = e.seed AND a.node = e.u JOIN {name}{_HOPS} b ON b.seed = e.seed AND b.node = e.v WHERE a.cost + {cost} = b.cost GROUP BY ALL)")
    return ", ".join(rounds)


@query(
    _flow_sql(10, 50.0, f"""SELECT * FROM (WITH RECURSIVE x AS MATERIALIZED (SELECT seed, node, x FROM $ WHERE x > 0), edge AS MATERIALIZED (SELECT a.seed, u, v, 1 / (a.x + b.x + 1e-10::DOUBLE) AS c FROM adj JOIN x a ON a.node = u JOIN x b ON b.node = v AND b.seed = a.seed WHERE u <> v),
{_settled_sql("d", "c")}, {_settled_sql("h", "1")}, top AS (SELECT seed, arg_max(node, (round(x, 6), -node)) AS target FROM x WHERE node <> seed GROUP BY seed), far AS (SELECT seed, arg_max(node, (cost, x, -node)) AS node FROM h{_HOPS} JOIN x USING (seed, node) GROUP BY seed),
w AS (SELECT seed, target, target AS node, true AS reached, 0 AS back FROM top UNION ALL SELECT w.seed, target, before, true, back + 1 FROM w JOIN d_before b ON b.seed = w.seed AND b.node = w.node),
f AS (SELECT seed, -1::BIGINT AS target, node, false AS reached, 0 AS back FROM far UNION ALL SELECT f.seed, target, before, false, back + 1 FROM f JOIN h_before b ON b.seed = f.seed AND b.node = f.node),
p AS (SELECT z.seed, target, reached, list(node ORDER BY back DESC) AS path, avg(x.x) AS mean FROM (FROM w UNION ALL FROM f) z JOIN x USING (seed, node) GROUP BY ALL)
SELECT seed, target, reached, array_to_string(path, ' -> ') AS path, round(CASE WHEN len(path) < 2 THEN 0 ELSE 0.7 * 0.5 + 0.3 * mean / (mean + 1) END, 6)::DOUBLE AS score FROM p) q""")
)
def flow_path(spark: SparkSession, sf: str) -> DataFrame:
    """From each seed to the node with the most flow, and to one that isn't there."""
    near, seeds = _flow_graph(spark, sf)
    flow = graph.cut(diffusion.diffuse_near(near, seeds, alpha=50.0, rounds=10, check_every=11))
    top = flow.filter("x > 0 and node <> seed").groupBy("seed").agg(F.max(F.struct(F.round("x", 6).alias("x"), (-F.col("node")).alias("n"))).alias("t"))
    pairs = top.select("seed", (-F.col("t.n")).alias("target")).union(seeds.select("seed", F.lit(-1).cast("long")))
    adj = graph.written(near(graph.cut(flow.filter("x > 0").select("node").distinct())))
    found = paths.find_paths(adj, flow, pairs)
    return found.select("seed", "target", "reached", F.array_join(F.col("path").cast("array<string>"), " -> ").alias("path"), F.round("score", 6).alias("score"))


# ---- vectors: queries are the rows whose id is divisible by 100, in one bounded block

_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"


def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All rows, and those whose id is divisible by 100 as queries."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("apart"))
    return e, e.filter("id % 100 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), "apart")


@query(f"SELECT query_id, vec_id, sim, rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round({_COS}, 6) AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) WHERE rank <= 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    return vector_index.search(rows.drop("apart"), queries, 10).toDF("query_id", "vec_id", "sim", "rank")


@query(f"SELECT a.vec_id AS query_id, count(*) AS n FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND round({_COS}, 6) >= 0.2 GROUP BY 1")
def vector_threshold(spark: SparkSession, sf: str) -> DataFrame:
    rows, queries = _vectors(spark, sf)
    return vector_index.search(rows.drop("apart"), queries, least=0.2).groupBy(F.col("qid").alias("query_id")).agg(F.count("*").alias("n"))


@query(f"SELECT query_id, CASE WHEN s > 0.95 THEN hit END AS hit, round(s, 6) AS s FROM (SELECT a.vec_id AS query_id, arg_max(b.vec_id, (round({_COS}, 6), -b.vec_id)) AS hit, max(round({_COS}, 6)) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id GROUP BY 1)")
def semantic_cache_hit(spark: SparkSession, sf: str) -> DataFrame:
    """The nearest stored embedding counts as a hit only above a cosine of 0.95."""
    rows, queries = _vectors(spark, sf)
    best = vector_index.search(rows.drop("apart"), queries, 1)
    return best.select(F.col("qid").alias("query_id"), F.when(F.col("score") > 0.95, F.col("id")).alias("hit"), F.col("score").alias("s"))


@query("SELECT vec_id, list_sum(list_transform(embedding::DOUBLE[], lambda x: round_even((x - list_min(embedding::DOUBLE[])) * (255 / (list_max(embedding::DOUBLE[]) - list_min(embedding::DOUBLE[]))), 0)))::BIGINT AS code_sum FROM embeddings")
def quantized_vectors(spark: SparkSession, sf: str) -> DataFrame:
    codes = C.quantize(F.col("embedding").cast("array<double>"))
    return table(spark, sf, "embeddings").select("vec_id", F.aggregate(codes, F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


# ---- profiles and keys


def _profile_sql(t: str, columns: list[str], fields: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {fields.replace('$', c)} FROM {t}" for c in columns)


_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"]


@query(_profile_sql("lineitem", _LINE, "count(*) AS row_count, count(DISTINCT $) AS distinct_count, count(*) FILTER ($ IS NULL) AS null_count, round(count(*) FILTER ($ IS NULL) / count(*), 4) AS nullability, round(count(DISTINCT $) / count(*), 4) AS cardinality"))
def profile_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.counts(table(spark, sf, "lineitem"), _LINE)


@query(_profile_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "min($)::DOUBLE AS min, max($)::DOUBLE AS max, round(avg($), 4) AS avg, round(median($), 4) AS median, round(stddev_samp($), 4) AS stddev"))
def profile_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return profile.numeric(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query(_profile_sql("part", ["p_name", "p_brand", "p_type"], "round(avg(length($)), 2) AS avg_length, sum(length($))::BIGINT AS total_length"))
def profile_text(spark: SparkSession, sf: str) -> DataFrame:
    return profile.text(table(spark, sf, "part"), ["p_name", "p_brand", "p_type"])


@query("SELECT 'o_orderdate' AS \"column\", min(o_orderdate)::DATE::VARCHAR AS min_date, max(o_orderdate)::DATE::VARCHAR AS max_date, date_diff('day', min(o_orderdate), max(o_orderdate)) AS date_range_days FROM orders")
def profile_date(spark: SparkSession, sf: str) -> DataFrame:
    return profile.dates(table(spark, sf, "orders"), ["o_orderdate"])


def _common_sql() -> str:
    per = " UNION ALL ".join(f"SELECT '{c}' AS c, {c}::VARCHAR AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 2" for c in ("o_orderstatus", "o_orderpriority", "o_custkey"))
    return f"WITH x AS ({per}), f AS (SELECT c FROM x GROUP BY c HAVING count(*) <= 100) SELECT c AS \"column\", value, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, value) AS rank FROM x WHERE c IN (FROM f)) WHERE rank <= 5"


@query(_common_sql())
def profile_common_values(spark: SparkSession, sf: str) -> DataFrame:
    return profile.common_values(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"])


@query(_profile_sql("customer", ["c_custkey", "c_nationkey", "c_mktsegment"], "'Total count ' || count($) || ' - Distinct count ' || count(DISTINCT $) || ' - Null count ' || count(*) FILTER ($ IS NULL) AS value_statics"))
def value_statics(spark: SparkSession, sf: str) -> DataFrame:
    return profile.value_statics(table(spark, sf, "customer"), ["c_custkey", "c_nationkey", "c_mktsegment"])


@query(_profile_sql("customer", ["c_custkey", "c_nationkey", "c_mktsegment"], "count(DISTINCT $) < 20 AS is_categorical"))
def categorical_columns(spark: SparkSession, sf: str) -> DataFrame:
    return profile.categorical(table(spark, sf, "customer"), ["c_custkey", "c_nationkey", "c_mktsegment"])


_KEYS = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@query("WITH p AS (" + _profile_sql("customer", _KEYS, "count(*) AS n, count(DISTINCT $) AS d, count(*) FILTER ($ IS NULL) AS k") + """),
s AS (SELECT "column", CASE WHEN d / n >= 0.9 AND k / n <= 0.1 THEN (CASE WHEN d = n THEN 30 WHEN d / n > 0.98 THEN 20 ELSE 0 END) + (CASE WHEN k = 0 THEN 20 ELSE 0 END) + (CASE WHEN "column" IN ('c_custkey', 'c_nationkey') THEN 15 ELSE 5 END) ELSE 0 END::BIGINT AS key_score FROM p)
SELECT "column", key_score, key_score >= 25 AND key_score >= 0.8 * max(key_score) OVER () AS is_key FROM s""")
def key_scores(spark: SparkSession, sf: str) -> DataFrame:
    df = table(spark, sf, "customer")
    return profile.key_scores(profile.counts(df, _KEYS), {f.name: f.dataType for f in df.schema.fields}, "customer").select("column", "key_score", "is_key")


_REFS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_custkey", "nation", "n_nationkey")]


def _fk_sql(a: str, x: str, b: str, y: str) -> str:
    return f"SELECT '{x}' AS src_column, '{y}' AS ref_column, o AS orphans, round(s / greatest(1, r), 4) AS coverage, CASE WHEN o = 0 AND round(s / greatest(1, r), 4) > 0.3 THEN 'high' WHEN o = 0 AND round(s / greatest(1, r), 4) > 0.01 THEN 'medium' ELSE 'none' END AS confidence FROM (SELECT (SELECT count(DISTINCT {x}) FROM {a}) AS s, (SELECT count(DISTINCT {y}) FROM {b}) AS r, (SELECT count(DISTINCT {x}) FROM {a} WHERE {x} NOT IN (SELECT {y} FROM {b} WHERE {y} IS NOT NULL)) AS o)"


@query(" UNION ALL ".join(_fk_sql(*r) for r in _REFS))
def foreign_keys(spark: SparkSession, sf: str) -> DataFrame:
    return profile.foreign_keys([(table(spark, sf, a), x, table(spark, sf, b), y) for a, x, b, y in _REFS])


# ---- retrieval


@query("""WITH m AS (SELECT l_suppkey AS node, l_orderkey AS chunk FROM lineitem GROUP BY ALL), s AS (SELECT s_suppkey AS node, s_suppkey AS rank FROM supplier),
d AS (SELECT DISTINCT s_suppkey AS node, s_suppkey % 7 + 1 AS dst FROM supplier), o AS (SELECT chunk, min(rank) AS seed_order FROM m JOIN s USING (node) GROUP BY 1),
r AS (SELECT x.chunk, count(*) AS n FROM m x JOIN s USING (node) JOIN d USING (node) JOIN m y ON y.node = d.dst AND y.chunk = x.chunk GROUP BY 1) SELECT o.chunk, seed_order, coalesce(n, 0) AS relation_counts FROM o LEFT JOIN r USING (chunk)""")
def text_unit_rank(spark: SparkSession, sf: str) -> DataFrame:
    mentions = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("node"), F.col("l_orderkey").alias("chunk")).repartition("chunk").distinct()
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"))
    return text.rank_text_units(s.withColumn("rank", F.col("node")), mentions, s.select(F.col("node").alias("src"), (F.col("node") % 7 + 1).alias("dst")))


@query("SELECT o_custkey AS subquery_id, o_orderkey AS path, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) + 1)::INT AS rank FROM orders")
def rank_paths(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("subquery_id"), F.col("o_orderkey").alias("path"), (F.row_number().over(order) + 1).alias("rank"))


# ---- linking

_TRI = "list_distinct(list_transform(generate_series(1, length($) - 2), lambda i: substring($, i, 3)))"


@query(f"WITH k AS (SELECT DISTINCT p_type AS k, {_TRI.replace('$', 'lower(p_type)')} AS a FROM part WHERE length(p_type) >= 3), v AS (SELECT DISTINCT p_name AS v, {_TRI.replace('$', 'lower(p_name)')} AS b FROM part WHERE length(p_name) >= 3) SELECT k AS kid, 'p_name' AS \"column\", v AS value, s AS score FROM (SELECT k, v, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) AS s FROM k, v) WHERE s >= 0.3")
def similar_values(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    keys = p.select(F.col("p_type").alias("kid"), F.col("p_type").alias("keyword")).distinct()
    return linking.similar_values(keys, p.select(F.lit("p_name").alias("column"), F.col("p_name").alias("value")).distinct())


@query("WITH w AS (SELECT p_partkey AS qid, unnest(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS word, generate_subscripts(list_filter(regexp_split_to_array(lower(p_name), '[^\\p{L}\\p{N}_]+'), lambda x: x <> ''), 1) - 1 AS pos FROM part), v AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_type), '[^\\p{L}\\p{N}_]+')) AS word FROM part) SELECT qid, pos::INT AS pos, 'p_type' AS \"column\" FROM w JOIN v USING (word) WHERE word <> ''")
def cell_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return linking.cell_links(p.select(F.col("p_partkey").alias("qid"), F.col("p_name").alias("text")), p.select(F.lit("p_type").alias("column"), F.col("p_type").alias("value")).distinct())


@query(r"""WITH w AS (SELECT p_partkey AS qid, list_filter(regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM part), t AS (SELECT qid, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM w),
v AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(p_type), '[^\p{L}\p{N}_]+')) AS word FROM part), l AS (SELECT DISTINCT qid, pos FROM t JOIN v USING (word) WHERE word <> ''), i AS (SELECT qid, pos, pos - row_number() OVER (PARTITION BY qid ORDER BY pos) AS island FROM l)
SELECT qid, 'p_type' AS "column", min(pos)::INT AS start, count(*) AS length FROM i GROUP BY qid, island""")
def cell_link_islands(spark: SparkSession, sf: str) -> DataFrame:
    return linking.islands(cell_links(spark, sf))


@query(r"""WITH q AS (SELECT p_partkey AS qid, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\p{L}\p{N}_]+'), lambda x: x <> '') AS w FROM part), s AS (SELECT qid, w, unnest(generate_series(1, len(w))) AS i FROM q),
z AS (SELECT qid, w, i, unnest(generate_series(1, least(5, len(w) - i + 1))) AS n FROM s), g AS (SELECT DISTINCT qid, n, array_to_string(w[i : i + n - 1], ' ') AS gram FROM z), t AS (SELECT DISTINCT p_type AS name, lower(p_type) AS words FROM part),
l AS (SELECT qid, name, 'exact' AS kind, n FROM g JOIN t ON gram = words UNION ALL SELECT qid, name, 'prefix', n FROM g JOIN t ON length(gram) > 2 AND words <> gram AND starts_with(words, gram || ' '))
SELECT qid, name, arg_min(kind, (kind, -n)) AS kind, arg_min(n, (kind, -n))::INT AS n FROM l GROUP BY qid, name""")
def schema_links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    names = p.select(F.col("p_type").alias("name"), F.lower("p_type").alias("words")).distinct()
    return linking.schema_links(p.select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_type").alias("text")), names)


@query()
def sequence_ratios(spark: SparkSession, sf: str) -> DataFrame:
    return linking.sequence_ratio(table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), "p_name", "p_type")


# ---- evaluation: candidates are events of a user, their results the event type


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("idx"), F.col("props").alias("sql"), F.when(F.col("value") < 5, "ERROR").otherwise("CORRECT").alias("status"), F.col("event_type").alias("result"))


@query("""WITH c AS (SELECT user_id AS qid, event_id AS idx, props AS sql, event_type AS result FROM events WHERE NOT value < 5), t AS (SELECT qid, result, count(*) AS votes, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, min(idx)) AS r FROM c GROUP BY qid, result)
SELECT qid, votes, arg_min(idx, (length(sql), idx)) AS idx FROM c JOIN t USING (qid, result) WHERE r = 1 GROUP BY qid, votes""")
def exec_cluster_vote(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.vote(_candidates(spark, sf))


@query("SELECT user_id AS qid, coalesce(min(event_id) FILTER (NOT value < 5), min(event_id)) AS idx FROM events GROUP BY 1")
def first_executable(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.first_executable(_candidates(spark, sf))


@query("WITH k AS (SELECT user_id AS qid, event_id AS idx, round(value, 0) AS score, count(*) OVER (PARTITION BY user_id, event_type) AS k FROM events) SELECT qid, idx, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, k DESC, idx) AS r FROM k) WHERE r = 1")
def best_by_tests(spark: SparkSession, sf: str) -> DataFrame:
    scores = table(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("idx"), F.round("value", 0).alias("score"))
    return evaluate.best_by_tests(scores, _candidates(spark, sf))


_OUTCOME = "CASE WHEN value < 20 THEN 'error' WHEN value < 50 THEN 'incorrect' ELSE 'correct' END"


@query(f"WITH r AS (SELECT event_type AS stage, event_id AS id, {_OUTCOME} AS o FROM events) SELECT stage, count(*) FILTER (o = 'correct') AS correct, count(*) FILTER (o = 'incorrect') AS incorrect, count(*) FILTER (o = 'error') AS error, md5(coalesce(string_agg(lpad(id::VARCHAR, 10, '0'), ',' ORDER BY id) FILTER (o = 'incorrect'), '')) AS incorrect_ids FROM r GROUP BY 1")
def stage_stats(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.stage_stats(table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.col("event_id").alias("id"), F.expr(_OUTCOME).alias("outcome")))


@query("WITH n AS (SELECT l_orderkey, coalesce(max(l_linenumber) FILTER (l_returnflag = 'R'), 0) AS need FROM lineitem GROUP BY 1) SELECT k, round((SELECT count(*) FROM n WHERE need <= k) / (SELECT count(*) FROM n), 6) AS coverage FROM range(1, 101) t(k)")
def coverage_at_k(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.coverage_at_k(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("rank"), (F.col("l_returnflag") == "R").alias("used")))


@query("SELECT * FROM (VALUES ('set', true), ('bag', false), ('permuted', true)) t(kind, equal)")
def result_equality(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")
    rows = [("set", evaluate.equal_as_sets(o, o.distinct())), ("bag", evaluate.equal_as_bags(o, o.distinct())), ("permuted", evaluate.equal_under_permutation(o, o.select("o_orderpriority", "o_orderstatus")))]
    return spark.createDataFrame(rows, "kind string, equal boolean")


# ---- rendering and message windows


@query(r"""WITH k AS (SELECT p_partkey, regexp_replace(regexp_replace(lower('SELECT p_name, p_type FROM part WHERE p_size > ' || p_size || ' AND p_brand = ''' || p_brand || ''''), '''[^'']*''|\b[0-9]+(\.[0-9]+)?\b', '_', 'g'), '\b(p_name|p_brand|p_type|p_size|part)\b', '_', 'g') AS s FROM part) SELECT p_partkey, regexp_replace(s, '_( ?, ?_)+', '_', 'g') AS skeleton FROM k""")
def sql_skeletons(spark: SparkSession, sf: str) -> DataFrame:
    sql = F.concat(F.lit("SELECT p_name, p_type  FROM part WHERE p_size > "), F.col("p_size").cast("string"), F.lit(" AND p_brand = '"), "p_brand", F.lit("'"))
    return table(spark, sf, "part").select("p_partkey", rendering.skeleton(sql, ["part", "p_name", "p_type", "p_size", "p_brand"]).alias("skeleton"))


@query("""WITH t AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(p_name || ' ' || p_type, ' ') AS b FROM part), u AS (SELECT p_partkey, unnest(list_distinct(list_concat(a, b))) AS w, a, b FROM t)
SELECT p_partkey, round(sum(least(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w)))) / sum(greatest(len(list_filter(a, lambda x: x = w)), len(list_filter(b, lambda x: x = w)))), 6) AS score FROM u GROUP BY 1""")
def skeleton_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.split("p_name", " "), F.split(F.concat_ws(" ", "p_name", "p_type"), " ")
    return table(spark, sf, "part").select("p_partkey", F.round(rendering.multiset_jaccard(a, b), 6).alias("score"))


@query("SELECT n_regionkey, 'id,n_name,n_nationkey' || chr(13) || chr(10) || string_agg(r || ',' || n_name || ',' || n_nationkey, chr(13) || chr(10) ORDER BY r) AS context FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r FROM nation) GROUP BY 1")
def context_csv(spark: SparkSession, sf: str) -> DataFrame:
    return rendering.csv_context(table(spark, sf, "nation"), "n_regionkey", ["n_nationkey"], ["n_name", "n_nationkey"])


@query("""SELECT n_nationkey, '"D"."D"."REGION" -> "D"."D"."NATION"."' || n_name || '"' AS path FROM nation""")
def qualified_paths(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", rendering.qualified_path(F.concat(F.lit("REGION -> NATION."), "n_name"), "D").alias("path"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS r FROM conversations) WHERE role = 'system' OR r <= 4")
def memory_window(spark: SparkSession, sf: str) -> DataFrame:
    return rendering.memory_window(table(spark, sf, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query("WITH e AS (SELECT min(n_chars) AS lo, max(n_chars) AS hi FROM documents) SELECT least(20, floor((n_chars - lo) * 20 / (hi - lo)) + 1)::INT AS bin, count(*) AS n FROM documents, e GROUP BY 1")
def length_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rendering.length_histogram(table(spark, sf, "documents"), "n_chars")


@query("""WITH p AS (SELECT p_brand AS t, p_type AS c, count(*) AS cs FROM part GROUP BY 1, 2), s AS (SELECT *, sum(cs) OVER (PARTITION BY t) AS ts FROM p), b AS (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY ts DESC, t) AS r FROM (SELECT DISTINCT t, ts FROM s)) WHERE r <= 4)
SELECT t AS "table", c AS "column" FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY cs DESC, c) AS r FROM s WHERE t IN (FROM b)) WHERE r <= 3""")
def top_schema(spark: SparkSession, sf: str) -> DataFrame:
    per = table(spark, sf, "part").groupBy(F.col("p_brand").alias("table"), F.col("p_type").alias("column")).agg(F.count("*").alias("column_score"))
    return rendering.top_schema(per.withColumn("table_score", F.sum("column_score").over(Window.partitionBy("table"))), 4, 3)


@query("SELECT c_custkey, 'select db7.customer from db7.customer join customers on x.customer' AS q FROM customer")
def replaced_names(spark: SparkSession, sf: str) -> DataFrame:
    sql = F.lit("select customer from customer join customers on x.customer")
    return table(spark, sf, "customer").select("c_custkey", rendering.replace_names(sql, {"customer": "db7.customer"}).alias("q"))


@query("WITH c AS (SELECT user_id, md5(props || '|' || event_type) AS args_hash, min(event_id) AS event_id FROM events GROUP BY 1, 2) SELECT e.event_id, c.event_id AS hit FROM events e JOIN c ON c.user_id = e.user_id AND c.args_hash = md5(props || '|' || event_type) AND c.event_id < e.event_id")
def exact_cache_hits(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.md5(F.encode(F.concat_ws("|", "props", "event_type"), "utf-8")).alias("args_hash"))
    stored = e.groupBy("user_id", "args_hash").agg(F.min("event_id").alias("hit"))
    return e.join(stored, ["user_id", "args_hash"]).filter("hit < event_id").select("event_id", "hit")


@query("SELECT event_id, (event_id % 3)::BIGINT AS model FROM events")
def round_robin(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.pmod("event_id", F.lit(3)).cast("long").alias("model"))


from quillgraph import queries_evaluation, queries_files, queries_lineage, queries_linking, queries_retrieval, queries_runs, queries_schema, queries_stores, queries_values  # noqa: E402, F401  they register themselves
