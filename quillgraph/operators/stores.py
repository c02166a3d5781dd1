"""Graph and vector stores as tables: upserts that merge, deletes that cascade, look-ups.

A store is a DataFrame; an operator returns the store's next state, which the caller writes. Nodes are
(node, props), edges (src, dst, props), vectors (id, vector, and any further columns).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.text import merge_edges, merge_nodes


def merged(old: Column, new: Column) -> Column:
    """Attributes of both maps; the new value where both have one. A null map has none."""
    none = F.expr("cast(map() as map<string,string>)")
    new = F.coalesce(new, none)
    return F.map_concat(F.map_filter(F.coalesce(old, none), lambda k, v: ~F.map_contains_key(new, k)), new)


def upsert_nodes(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """Known nodes take new attributes over and keep the others."""
    return nodes.join(new.withColumnRenamed("props", "fresh"), "node", "full_outer").select("node", merged(F.col("props"), F.col("fresh")).alias("props"))


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """As upsert_nodes; a new edge of which an end isn't there is left out."""
    ends = nodes.select("node")
    able = new.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    return edges.join(able.withColumnRenamed("props", "fresh"), ["src", "dst"], "full_outer").select("src", "dst", merged(F.col("props"), F.col("fresh")).alias("props"))


def look_up_nodes(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """ids (node) with there and props."""
    found = nodes.select("node", "props", F.lit(True).alias("there"))
    return ids.join(found, "node", "left").select("node", F.coalesce("there", F.lit(False)).alias("there"), "props")


def look_up_edges(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    found = edges.select("src", "dst", F.lit(True).alias("there"), *[c for c in edges.columns if c not in ("src", "dst")])
    return pairs.join(found, ["src", "dst"], "left").withColumn("there", F.coalesce("there", F.lit(False)))


def out_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("node").alias("src")), "src", "left_semi")


def in_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("node").alias("dst")), "dst", "left_semi")


def merge_into_nodes(stored: DataFrame, new: DataFrame, separator: str = "<SEP>") -> DataFrame:
    """stored and new (name, entity_type, description, source_id): new rows are seen first, so ties of types go to them.

    Joined descriptions and sources of the store are taken apart before they are merged again. new needs seq."""
    apart = lambda c: F.split(c, F.lit("\\Q" + separator + "\\E"))
    known = stored.join(new.select("name").distinct(), "name", "left_semi")
    last = F.lit((1 << 62) - 1)
    descriptions = known.select("name", "entity_type", F.explode(apart("description")).alias("description"), F.lit(None).cast("string").alias("source_id"))
    sources = known.select("name", "entity_type", F.lit(None).cast("string").alias("description"), F.explode(apart("source_id")).alias("source_id"))
    # one vote for the stored type, whatever the number of its descriptions
    kinds = new.select("name", "entity_type", "seq").union(known.select("name", "entity_type", last))
    per = kinds.groupBy("name", "entity_type").agg(F.count("*").alias("n"), F.min("seq").alias("first"))
    kind = per.groupBy("name").agg(F.max_by("entity_type", F.struct("n", -F.col("first"))).alias("kind"))
    both = new.select("name", "entity_type", "description", "source_id", "seq").union(descriptions.union(sources).withColumn("seq", last))
    changed = merge_nodes(both).join(kind, "name").select("name", F.col("kind").alias("entity_type"), "description", "source_id")
    return changed.union(stored.join(new.select("name"), "name", "left_anti").select("name", "entity_type", "description", "source_id"))


def merge_into_edges(stored: DataFrame, new: DataFrame, separator: str = "<SEP>") -> DataFrame:
    """(src, dst, weight, description, keywords, source_id): weights add up, texts join without repeats."""
    columns = ["src", "dst", "weight", "description", "keywords", "source_id"]
    apart = lambda c: F.split(c, F.lit("\\Q" + separator + "\\E"))
    known = stored.join(new.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
    texts = ["description", "keywords", "source_id"]
    parts = [known.select("src", "dst", F.lit(0.0).alias("weight"), *[F.explode(apart(c)).alias(c) if c == t else F.lit(None).cast("string").alias(c) for c in texts]) for t in texts]
    both = new.select(*columns).union(known.select("src", "dst", "weight", *[F.lit(None).cast("string").alias(c) for c in texts]))
    for part in parts:
        both = both.union(part)
    return merge_edges(both).select(*columns).union(stored.join(new.select("src", "dst"), ["src", "dst"], "left_anti").select(*columns))


def quoted_name(name: Column) -> Column:
    """Names of inserted entities are lower-cased and stand in quotes."""
    return F.concat(F.lit('"'), F.lower(name), F.lit('"'))


def custom_graph(chunks: DataFrame, entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a graph given as rows: chunks (source_id, chunk_id), entities (entity_name,
    entity_type, description, source_id), relations (src_id, tgt_id, description, keywords, weight,
    source_id). Unknown sources are UNKNOWN, ends of relations that no entity names become nodes."""
    known = chunks.select("source_id", "chunk_id").dropDuplicates(["source_id"])
    source = F.coalesce("chunk_id", F.lit("UNKNOWN")).alias("source_id")
    named = entities.join(known, "source_id", "left").select(
        quoted_name(F.col("entity_name")).alias("node"), F.coalesce("entity_type", F.lit("UNKNOWN")).alias("entity_type"), F.coalesce("description", F.lit("No description provided")).alias("description"), source
    )
    edges = relations.join(known, "source_id", "left").select(quoted_name(F.col("src_id")).alias("src"), quoted_name(F.col("tgt_id")).alias("dst"), F.coalesce("weight", F.lit(1.0)).alias("weight"), "description", "keywords", source)
    ends = edges.select(F.col("src").alias("node"), "source_id").union(edges.select("dst", "source_id")).groupBy("node").agg(F.min("source_id").alias("source_id"))
    missing = ends.join(named.select("node"), "node", "left_anti").select("node", F.lit("UNKNOWN").alias("entity_type"), F.lit("UNKNOWN").alias("description"), "source_id")
    return named.union(missing), edges


def upsert_vectors(stored: DataFrame, new: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """stored with new rows (id, content, ...) in place of those of the same id; embed adds vector, by
    batches inside the tasks."""
    made = embed(new) if embed else new
    return stored.join(made.select("id"), "id", "left_anti").unionByName(made, allowMissingColumns=True)


def delete_vectors(stored: DataFrame, gone: DataFrame, columns: tuple[str, ...] = ("id",)) -> DataFrame:
    """stored without rows that name one of gone (node) in any of the columns."""
    for c in columns:
        stored = stored.join(gone.select(F.col("node").alias(c)), c, "left_anti")
    return stored


def delete_entity(nodes: DataFrame, edges: DataFrame, entity_vectors: DataFrame, relation_vectors: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """All four stores without the nodes gone (node), their edges and vectors."""
    keep = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return nodes.join(gone, "node", "left_anti"), keep, delete_vectors(entity_vectors, gone, ("entity",)), delete_vectors(relation_vectors, gone, ("src", "dst"))


def hits_with_nodes(hits: DataFrame, nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """hits (node, ...) with the node's attributes and its degree as rank; hits of unknown nodes are left out."""
    return hits.join(nodes, "node").join(degrees.select("node", F.col("degree").alias("rank")), "node", "left").withColumn("rank", F.coalesce("rank", F.lit(0).cast("long")))


def stable_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges in a fixed order: ends sorted, rows by their label."""
    return edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct().withColumn("label", F.concat_ws(" -> ", "u", "v"))


def clean_name(name: Column) -> Column:
    """Names of components' nodes: trimmed and lower-cased."""
    return F.lower(F.trim(name))


def merge_chunk_map(ids: DataFrame, chunks: DataFrame) -> DataFrame:
    """ids (chunk_id, ...) with content; chunks that aren't there or are empty are left out."""
    return ids.join(chunks.select("chunk_id", "content"), "chunk_id").filter(F.col("content").isNotNull() & (F.col("content") != ""))
