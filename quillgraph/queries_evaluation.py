"""Queries of candidates, votes, values and names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions import columns as C
from quillgraph.operators import evaluate, examples, linking, text
from quillgraph.registry import query
from quillgraph.session import table
from quillgraph.sources import store

# candidates: an order's lines, their result the flag of the line


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("l_returnflag") == "N", "CORRECT").when(F.col("l_returnflag") == "A", "EMPTY").otherwise("ERROR")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), (F.col("l_linenumber") - 1).alias("step"), F.concat(F.lit("q"), "l_partkey").alias("sql"), status.alias("status"))


@query("SELECT l_orderkey AS qid, coalesce((max((l_linenumber, 'q' || l_partkey)) FILTER (l_returnflag = 'N'))[2], min((l_linenumber, 'q' || l_partkey))[2]) AS sql FROM lineitem GROUP BY 1")
def final_sql(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.final_sql(_steps(spark, sf))


@query("""WITH b AS (SELECT l_orderkey AS qid, min(l_linenumber) AS bad FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1) SELECT qid, l_linenumber - 1 AS step, CASE WHEN l_linenumber = 1 THEN 'candidate' ELSE 'revise_' || (l_linenumber - 1) END AS name, CASE l_returnflag WHEN 'N' THEN 'CORRECT' WHEN 'A' THEN 'EMPTY' ELSE 'ERROR' END AS status
FROM lineitem JOIN b ON qid = l_orderkey AND l_linenumber >= bad""")
def revisions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.revisions(_steps(spark, sf))


_SIZE = "z AS (SELECT l_orderkey AS qid, l_returnflag AS result, count(*) AS votes, min(l_linenumber) AS idx FROM lineitem GROUP BY 1, 2)"


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("qid"), F.col("l_linenumber").alias("idx"), F.col("l_returnflag").alias("result"))


@query(f"WITH {_SIZE} SELECT qid, idx, votes, round(votes / n, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY votes DESC, idx) AS r, sum(votes) OVER (PARTITION BY qid) AS n FROM z) WHERE r = 1")
def majority_votes(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.majority(_candidates(spark, sf))


@query("SELECT l_orderkey AS qid, count(DISTINCT l_returnflag) AS clusters, count(DISTINCT l_returnflag) > 1 AS needed FROM lineitem GROUP BY 1")
def tests_needed(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.tests_needed(_candidates(spark, sf))


@query("""SELECT l_orderkey AS qid, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 1 END, l_linenumber, 'q' || l_partkey)::INT - 1 AS idx, 'q' || l_partkey AS sql FROM lineitem""")
def candidate_pool(spark: SparkSession, sf: str) -> DataFrame:
    c = _steps(spark, sf).select("qid", F.col("step").alias("idx"), "sql")
    return evaluate.candidate_pool([c.filter("idx % 2 = 1"), c.filter("idx % 2 = 0")])


# ---- stores by key, through the table class


@query("SELECT md5(text) AS id, min(doc_id)::BIGINT AS doc_id FROM documents WHERE source <> 'src0' AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE source = 'src0') GROUP BY ALL")
def key_value_insert(spark: SparkSession, sf: str) -> DataFrame:
    """Inserts twice into a stored table and returns what the second insert added."""
    from quillgraph.session import scratch_path

    kept = store.KeyValueTable(spark, scratch_path(spark, "kv"), "id string, doc_id long")
    docs = table(spark, sf, "documents").select(F.md5(F.encode("text", "utf-8")).alias("id"), "doc_id", "source")
    first = lambda df: df.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    kept.insert_if_absent(first(docs.filter("source = 'src0'")))
    return kept.insert_if_absent(first(docs.filter("source <> 'src0'")))


@query("SELECT item_id AS pos, item_id * 7 AS id, d.lang FROM benchmark LEFT JOIN documents d ON d.doc_id = item_id * 7")
def key_value_get(spark: SparkSession, sf: str) -> DataFrame:
    from quillgraph.session import scratch_path

    kept = store.KeyValueTable(spark, scratch_path(spark, "kv"), "id long, lang string, n_chars long")
    kept.insert_if_absent(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars"))
    ids = table(spark, sf, "benchmark").select((F.col("item_id") * 7).alias("id"), F.col("item_id").alias("pos"))
    return kept.get(ids, ["lang"])


# ---- values and names

_GRAMS = "list_distinct(list_transform(generate_series(1, length($) - 2), lambda i: substr($, i, 3)))"


@query(f"""WITH k AS (SELECT p_partkey AS qid, p_type AS keyword FROM part WHERE p_partkey % 100 = 0), v AS (SELECT DISTINCT p_type AS value FROM part WHERE length(p_type) >= 3),
s AS (SELECT qid, value, len(list_intersect({_GRAMS.replace('$', 'keyword')}, {_GRAMS.replace('$', 'value')})) AS b, len({_GRAMS.replace('$', 'keyword')}) + len({_GRAMS.replace('$', 'value')}) AS n FROM k, v WHERE length(keyword) >= 3),
j AS (SELECT qid, value, round(b / (n - b), 6) AS jaccard FROM s WHERE round(b / (n - b), 6) >= 0.3) SELECT qid, value, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY jaccard DESC, value) AS r, max(jaccard) OVER (PARTITION BY qid) AS top FROM j) WHERE r <= 10 AND jaccard >= 0.9 * top""")
def value_hits(spark: SparkSession, sf: str) -> DataFrame:
    """Similar values, the best ten of a keyword, of which those near its best stay."""
    p = table(spark, sf, "part")
    grams = lambda c: C.ngrams(F.col(c), 3)
    v = p.select(F.col("p_type").alias("value")).distinct().select("value", F.explode(grams("value")).alias("g"))
    k = p.filter("p_partkey % 100 = 0").select(F.col("p_partkey").alias("qid"), F.col("p_type").alias("keyword")).select("qid", "keyword", F.explode(grams("keyword")).alias("g"))
    both = k.join(v, "g").groupBy("qid", "keyword", "value").agg(F.count("*").alias("both"))
    n = F.size(grams("keyword")) + F.size(grams("value"))
    scored = both.withColumn("jaccard", F.round(F.col("both") / (n - F.col("both")), 6)).filter(F.col("jaccard") >= 0.3)
    top = scored.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("jaccard"), "value"))).filter("r <= 10")
    return linking.near_best(top, ["qid"], "jaccard", 0.9).select("qid", "value", "jaccard")


@query("SELECT vec_id, round(avg(x * x), 6) AS mean_square FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def example_quality(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.explode("embedding").alias("x"))
    return e.groupBy("vec_id").agg(F.round(F.avg(F.col("x").cast("double") * F.col("x").cast("double")), 6).alias("mean_square"))


@query("SELECT least(7, count(*)) AS n FROM part")
def arbitrary_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The same seven rows twice: their union without repeats has seven."""
    p = table(spark, sf, "part").select("p_partkey")
    return examples.arbitrary(p, "p_partkey", 7).union(examples.arbitrary(p, "p_partkey", 7)).distinct().agg(F.count("*").alias("n"))


_FOLD = """WITH RECURSIVE i AS (SELECT l_orderkey, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS t, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS k FROM lineitem), """


@query(_FOLD + "f AS (SELECT l_orderkey, n, k, t AS s, 0 AS bin FROM i WHERE k = 1 UNION ALL SELECT i.l_orderkey, i.n, i.k, CASE WHEN f.s + i.t > 60 AND f.s > 0 THEN i.t ELSE f.s + i.t END, CASE WHEN f.s + i.t > 60 AND f.s > 0 THEN f.bin + 1 ELSE f.bin END FROM f JOIN i ON i.l_orderkey = f.l_orderkey AND i.k = f.k + 1) SELECT l_orderkey, n AS l_linenumber, bin FROM f")
def greedy_schema_bins(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("tokens"))
    return text.greedy_bins(items, "l_orderkey", "l_linenumber", "tokens", 60)


@query(_FOLD + "f AS (SELECT l_orderkey, n, k, CASE WHEN t <= 60 THEN t ELSE 0 END AS s, t <= 60 AS ok FROM i WHERE k = 1 UNION ALL SELECT i.l_orderkey, i.n, i.k, CASE WHEN f.s + i.t <= 60 THEN f.s + i.t ELSE f.s END, f.s + i.t <= 60 FROM f JOIN i ON i.l_orderkey = f.l_orderkey AND i.k = f.k + 1) SELECT l_orderkey, n AS l_linenumber FROM f WHERE ok")
def example_budget(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_quantity").cast("long").alias("tokens"))
    return text.skipping_budget(items, "l_orderkey", "l_linenumber", "tokens", 60)
