"""Documents to chunks, budgets over ordered rows, and records from extraction text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.columns import clean, content_id, number_or, split_markers


def chunks(docs: DataFrame, most: int = 1200, overlap: int = 100) -> DataFrame:
    """(full_doc_id, chunk_order_index, tokens, content, chunk_id): overlapping windows of words.

    Words are the default tokens; the tail window may lie inside the one before."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(most - overlap))
    cut = docs.select(F.col("doc_id").alias("full_doc_id"), words.alias("words")).filter(F.size("words") > 0)
    cut = cut.select("full_doc_id", "words", F.posexplode(starts).alias("chunk_order_index", "at"))
    content = F.array_join(F.slice("words", F.col("at") + 1, F.lit(most)), " ")
    out = cut.select("full_doc_id", "chunk_order_index", F.least(F.lit(most), F.size("words") - F.col("at")).alias("tokens"), content.alias("content"))
    return out.withColumn("chunk_id", content_id("chunk-", F.col("content")))


def budget_prefix(rows: DataFrame, group: list[str], order: list, tokens: str, budget: int) -> DataFrame:
    """Rows while the running token sum stays within the budget; the first overflow ends it."""
    run = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(tokens).over(run)).filter(F.col("running") <= budget)


def greedy_bins(rows: DataFrame, group: str, order: str, tokens: str, budget: int) -> DataFrame:
    """(group, order, bin): a new bin whenever the next row overflows; a fold, as sums start over.
    One group's items are folded in a row, so groups must be bounded (a schema's items)."""
    items = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("t")))).alias("items"))
    zero = F.expr("named_struct('bin', 0, 'sum', 0L, 'out', cast(array() as array<struct<o: bigint, bin: int>>))")

    def step(a, x):
        fresh = (a["sum"] + x["t"] > budget) & (a["sum"] > 0)
        b = F.when(fresh, a["bin"] + 1).otherwise(a["bin"])
        return F.struct(b.alias("bin"), F.when(fresh, x["t"]).otherwise(a["sum"] + x["t"]).alias("sum"), F.concat(a["out"], F.array(F.struct(x["o"].cast("bigint").alias("o"), b.alias("bin")))).alias("out"))

    return items.select(group, F.explode(F.aggregate("items", zero, step, lambda a: a["out"])).alias("x")).select(group, F.col("x.o").alias(order), "x.bin")


def skipping_budget(rows: DataFrame, group: str, order: str, tokens: str, budget: int) -> DataFrame:
    """(group, order): rows that fit in turn; one that overflows is skipped and later ones still count."""
    items = rows.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(tokens).cast("long").alias("t")))).alias("items"))
    zero = F.expr("named_struct('sum', 0L, 'out', cast(array() as array<bigint>))")

    def step(a, x):
        fits = a["sum"] + x["t"] <= budget
        return F.struct(F.when(fits, a["sum"] + x["t"]).otherwise(a["sum"]).alias("sum"), F.when(fits, F.concat(a["out"], F.array(x["o"].cast("bigint")))).otherwise(a["out"]).alias("out"))

    return items.select(group, F.explode(F.aggregate("items", zero, step, lambda a: a["out"])).alias(order))


def first_of_each(rows: DataFrame, key: str, order: list) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_r = 1").drop("_r")


RECORD, FIELD, DONE = "##", "<|>", "<|COMPLETE|>"


def records(texts: DataFrame) -> DataFrame:
    """(chunk_id, seq, fields) of extraction texts (chunk_id, raw): what stands between the first and last parenthesis of a record."""
    parts = texts.select("chunk_id", F.posexplode(split_markers(F.col("raw"), [RECORD, DONE])).alias("seq", "record"))
    inner = F.regexp_extract("record", r"\((.*)\)", 1)
    return parts.withColumn("inner", inner).filter("inner <> ''").select("chunk_id", "seq", split_markers(F.col("inner"), [FIELD]).alias("fields"))


def entities(rows: DataFrame) -> DataFrame:
    f = lambda i: clean(F.get("fields", F.lit(i)))
    ok = rows.filter((F.size("fields") >= 4) & (F.get("fields", F.lit(0)) == '"entity"'))
    return ok.select("chunk_id", "seq", clean(F.lower(F.get("fields", F.lit(1)))).alias("name"), f(2).alias("entity_type"), f(3).alias("description")).filter(F.trim("name") != "")


def relations(rows: DataFrame) -> DataFrame:
    f = lambda i: clean(F.get("fields", F.lit(i)))
    ok = rows.filter((F.size("fields") >= 5) & (F.get("fields", F.lit(0)) == '"relationship"'))
    weight = number_or(F.element_at("fields", -1), 1.0)
    return ok.select("chunk_id", "seq", clean(F.lower(F.get("fields", F.lit(1)))).alias("src"), clean(F.lower(F.get("fields", F.lit(2)))).alias("dst"), f(3).alias("description"), f(4).alias("keywords"), weight.alias("weight"))


def _joined(c: str):
    return F.array_join(F.array_sort(F.collect_set(c)), "<SEP>")


def merge_nodes(rows: DataFrame) -> DataFrame:
    """rows (name, entity_type, description, source_id, seq): the most frequent type, ties to the first seen."""
    per = rows.groupBy("name", "entity_type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    kind = per.groupBy("name").agg(F.max_by("entity_type", F.struct("n", -F.col("first"))).alias("entity_type"))
    rest = rows.groupBy("name").agg(_joined("description").alias("description"), _joined("source_id").alias("source_id"))
    return kind.join(rest, "name")


def merge_edges(rows: DataFrame) -> DataFrame:
    return rows.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), _joined("description").alias("description"), _joined("keywords").alias("keywords"), _joined("source_id").alias("source_id"))


def rank_text_units(seeds: DataFrame, mentions: DataFrame, edges: DataFrame) -> DataFrame:
    """(chunk, seed_order, relation_counts): chunks by the first seed (node, rank) that mentions them
    and by how many neighbours over out-edges of mentioning seeds they mention too. Mentions meet each
    other within a chunk; none are sent whole."""
    m = seeds.join(mentions, "node").select("node", "rank", "chunk")
    order = m.groupBy("chunk").agg(F.min("rank").alias("seed_order"))
    near = m.join(edges.select(F.col("src").alias("node"), "dst"), "node")
    both = near.join(mentions.select(F.col("node").alias("dst"), "chunk").hint("merge"), ["dst", "chunk"]).groupBy("chunk").agg(F.count("*").alias("relation_counts"))
    return order.join(both, "chunk", "left").select("chunk", "seed_order", F.coalesce("relation_counts", F.lit(0)).alias("relation_counts"))
