"""Schema graphs from table profiles, and ranked paths over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.operators.schemas import edge_weight

#: Weights of schema edges. Fixed values.
KEY_WEIGHT, PLAIN_WEIGHT, REFERENCE_WEIGHT, COLUMN_PAIR_WEIGHT = 1.8, 1.0, 1.8, 1.2


def schema_graph(columns: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of columns (table, column, is_key) and references (table, column, ref_table, ref_column).

    Tables and columns are joined both ways; a reference's column edge outweighs the plain one, and
    its two columns are joined."""
    name = F.concat_ws(".", "table", "column")
    tables = columns.select(F.col("table").alias("node"), F.lit("table").alias("type")).distinct()
    nodes = tables.union(columns.select(name, F.lit("column")))
    own = columns.select(F.col("table").alias("src"), name.alias("dst"), F.when(F.col("is_key"), KEY_WEIGHT).otherwise(PLAIN_WEIGHT).alias("weight"))
    refs = references.select(F.col("table").alias("src"), name.alias("dst"), F.lit(REFERENCE_WEIGHT).alias("weight"))
    pairs = references.select(name.alias("src"), F.concat_ws(".", "ref_table", "ref_column").alias("dst"), F.lit(COLUMN_PAIR_WEIGHT).alias("weight"))
    one_way = own.union(refs).union(pairs).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    both = one_way.union(one_way.select(F.col("dst"), F.col("src"), "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    ends = nodes.select("node")
    return nodes, both.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


def ranked_paths(confident: DataFrame, found: DataFrame) -> DataFrame:
    """(subquery, rank, path, reward): the confident path of each sub-query first (reward 1), then found ones by score."""
    order = Window.partitionBy("subquery").orderBy(F.desc("score"), "path")
    rest = found.select("subquery", (F.row_number().over(order) + 1).alias("rank"), "path", F.col("score").alias("reward"))
    return confident.select("subquery", F.lit(1).alias("rank"), "path", F.lit(1.0).alias("reward")).union(rest)


def ranked_json(ranked: DataFrame) -> DataFrame:
    """(rank, json): a document for each rank with its sub-queries' paths."""
    paths = ranked.groupBy("rank", "subquery").agg(F.sort_array(F.collect_list(F.struct("path", "reward"))).alias("paths"))
    return paths.groupBy("rank").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct(F.col("subquery").alias("division"), "paths"))).alias("subqueries"))).alias("json"))


def node_features(nodes: DataFrame, degrees: DataFrame, profile: DataFrame) -> DataFrame:
    """nodes (node, type) with three feature blocks: meaning (neutral), structure, type and statistics."""
    wide = nodes.join(degrees, "node", "left").join(profile, "node", "left")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    structure = F.array(F.least(F.lit(1.0), F.coalesce("degree", F.lit(0)) / 20), flag(F.col("type") == "table"), flag(F.col("type") == "column"), flag(F.col("is_key")), flag(F.col("is_reference")))
    stats = F.array(flag(F.col("kind") == "integer"), flag(F.col("kind") == "text"), flag(F.col("kind") == "time"), F.coalesce("cardinality", F.lit(0.5)), F.coalesce("nullability", F.lit(0.5)))
    return wide.select("node", F.array_repeat(F.lit(0.5), 5).alias("meaning"), structure.alias("structure"), stats.alias("stats"))


def reweight(edges: DataFrame, features: DataFrame, blocks: DataFrame, block_weights: tuple[float, float, float] = (0.4, 0.3, 0.3)) -> DataFrame:
    """Edges (src, dst, weight) only: the weight times a share of the Gaussian kernel of the ends' features and
    a share of the means of the edge's own blocks (src, dst, relation, meaning, types)."""
    def kernel(c: str):
        d2 = F.aggregate(F.zip_with(f"a_{c}", f"b_{c}", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
        return F.exp(-0.8 * d2)

    side = lambda p, k: features.select(F.col("node").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("meaning", "structure", "stats")])
    wide = edges.join(side("a", "src"), "src").join(side("b", "dst"), "dst")
    like = sum((w * kernel(c) for w, c in zip(block_weights, ("meaning", "structure", "stats"), strict=True)), F.lit(0.0))
    own = edge_weight(like, [F.col("relation"), F.col("meaning"), F.col("types")])
    return wide.join(blocks, ["src", "dst"]).select("src", "dst", (F.col("weight") * own).alias("weight"))
