"""Database schemas as rows (table, column, ...): selections, unions, keys and their text forms.

Names are compared without case; the first spelling met is kept. Schema rows are small next to data,
but every operator is a join or an aggregate and doesn't depend on that.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _lowered(df: DataFrame) -> DataFrame:
    return df.withColumns({"_t": F.lower("table"), "_c": F.lower("column")})


def select_columns(schema: DataFrame, wanted: DataFrame) -> DataFrame:
    """The schema's rows of wanted (table, column)."""
    keys = wanted.select(F.lower("table").alias("_t"), F.lower("column").alias("_c")).distinct()
    return _lowered(schema).join(keys, ["_t", "_c"], "left_semi").drop("_t", "_c")


def union_schemas(*schemas: DataFrame) -> DataFrame:
    """(table, column) of all, in the order of the schemas and of pos within each; first spellings."""
    every = None
    for k, s in enumerate(schemas):
        part = s.select("table", "column", F.struct(F.lit(k).alias("k"), F.col("pos").cast("long").alias("pos")).alias("at"))
        every = part if every is None else every.union(part)
    tables = every.groupBy(F.lower("table").alias("_t")).agg(F.min_by("table", "at").alias("table"))
    columns = every.groupBy(F.lower("table").alias("_t"), F.lower("column").alias("_c")).agg(F.min_by("column", "at").alias("column"))
    return columns.join(tables, "_t").select("table", "column")


def add_missing(tentative: DataFrame, more: DataFrame) -> DataFrame:
    """tentative with the rows of more that it doesn't have."""
    return tentative.select("table", "column").union(_lowered(more).join(_lowered(tentative).select("_t", "_c").distinct(), ["_t", "_c"], "left_anti").select("table", "column"))


def add_fields(schema: DataFrame, fields: DataFrame) -> DataFrame:
    """schema with the other columns of fields (table, column, ...); null where it has none."""
    return _lowered(schema).join(_lowered(fields).drop("table", "column"), ["_t", "_c"], "left").drop("_t", "_c")


def missing_from(schema: DataFrame, correct: DataFrame) -> DataFrame:
    """(kind, table, column): tables and columns of correct that schema lacks; a missing table's columns aren't listed."""
    have, want = _lowered(schema), _lowered(correct)
    tables = want.join(have.select("_t").distinct(), "_t", "left_anti").groupBy("_t").agg(F.min("table").alias("table")).select(F.lit("table").alias("kind"), "table", F.lit(None).cast("string").alias("column"))
    columns = want.join(have.select("_t").distinct(), "_t", "left_semi").join(have.select("_t", "_c").distinct(), ["_t", "_c"], "left_anti").select(F.lit("column").alias("kind"), "table", "column")
    return tables.union(columns)


def closed_references(references: DataFrame, kept: DataFrame) -> DataFrame:
    """References (table, column, ref_table, ref_column) whose tables are both kept (table)."""
    t = kept.select(F.lower("table").alias("_t")).distinct()
    out = references.withColumns({"_t": F.lower("table"), "_r": F.lower("ref_table")}).join(t, "_t", "left_semi")
    return out.join(t.withColumnRenamed("_t", "_r"), "_r", "left_semi").drop("_t", "_r")


def connecting_columns(schema: DataFrame, references: DataFrame, selected: DataFrame) -> DataFrame:
    """(table, column) of selected tables that join them: keys (is_key), references into selected tables,
    columns referred to from them, and columns named like a key of another selected table."""
    t = selected.select(F.lower("table").alias("_t")).distinct()
    mine = _lowered(schema).join(t, "_t", "left_semi")
    closed = closed_references(references, selected)
    ends = closed.select(F.lower("table").alias("_t"), F.lower("column").alias("_c")).union(closed.select(F.lower("ref_table"), F.lower("ref_column"))).distinct()
    keys = mine.filter("is_key").select(F.col("_t").alias("_k"), "_c").distinct()
    # one row for each name: the only table with such a key, or null where several have it
    named = keys.groupBy("_c").agg(F.when(F.count("*") == 1, F.min("_k")).alias("_only"))
    wide = mine.join(ends.withColumn("_end", F.lit(True)), ["_t", "_c"], "left").join(named.withColumn("_named", F.lit(True)), "_c", "left")
    elsewhere = F.coalesce("_named", F.lit(False)) & (F.col("_only").isNull() | (F.col("_only") != F.col("_t")))
    return wide.filter(F.col("is_key") | F.coalesce("_end", F.lit(False)) | elsewhere).select("table", "column")


def reduction_rate(full: DataFrame, current: DataFrame) -> DataFrame:
    """(full, current, rate): by how many of a hundred columns the schema shrank."""
    n = full.agg(F.count("*").alias("full")).crossJoin(current.agg(F.count("*").alias("current")))  # a row each
    return n.withColumn("rate", F.round((F.col("full") - F.col("current")) / F.greatest(F.lit(1), F.col("full")) * 100, 2))


def merge_scores(scores: DataFrame) -> DataFrame:
    """(table, column, score): the highest score of an item over the splits it was scored in."""
    return scores.groupBy("table", "column").agg(F.max("score").alias("score"))


def composite_keys(references: DataFrame) -> DataFrame:
    """(group, table, ref_table, columns, ref_columns) of references (group, table, column, ref_table, ref_column, pos)."""
    x = F.array_sort(F.collect_list(F.struct("pos", "column", "ref_column")))
    out = references.groupBy("group", "table", "ref_table").agg(x.alias("x"))
    return out.select("group", "table", "ref_table", F.col("x.column").alias("columns"), F.col("x.ref_column").alias("ref_columns"))


def add_relationships(edges: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """edges (src, dst, weight) with those of new whose ends are nodes and that aren't there, in neither direction twice."""
    ends = nodes.select("node")
    able = new.select("src", "dst", "weight").join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    both = able.select("src", "dst", "weight").union(able.select("dst", "src", "weight")).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    return edges.select("src", "dst", "weight").union(both.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "weight"))


def column_listing(schema: DataFrame) -> DataFrame:
    """(table, line): 'table: a, b' with columns in order of pos."""
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "column"))), lambda x: x["column"]), ", ")
    return schema.groupBy("table").agg(F.concat(F.col("table"), F.lit(": "), names).alias("line"))


def key_lists(keys: DataFrame) -> DataFrame:
    """(table, columns) of keys (table, column, pos)."""
    return keys.groupBy("table").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "column"))), lambda x: x["column"]).alias("columns"))


def referenced_by(references: DataFrame) -> DataFrame:
    """References from both sides: (table, column, way, other_table, other_column)."""
    to = references.select("table", "column", F.lit("to").alias("way"), F.col("ref_table").alias("other_table"), F.col("ref_column").alias("other_column"))
    return to.union(references.select("ref_table", "ref_column", F.lit("from"), "table", "column"))


def implicit_targets(references: DataFrame, keys: DataFrame) -> DataFrame:
    """A reference without a column refers to the first key column of its table; keys (table, column, pos)."""
    first = keys.groupBy(F.col("table").alias("ref_table")).agg(F.min_by("column", "pos").alias("_first"))
    return references.join(first, "ref_table", "left").select("table", "column", "ref_table", F.coalesce("ref_column", "_first").alias("ref_column"))


def declared_keys(constraints: DataFrame, usage: DataFrame) -> DataFrame:
    """(table, column, ref_table, ref_column) of catalog views: constraints (name, ref_name) with ref_name
    null for keys, usage (name, table, column, pos)."""
    ref = usage.select(F.col("name").alias("ref_name"), F.col("table").alias("ref_table"), F.col("column").alias("ref_column"), "pos")
    own = constraints.join(usage, "name")
    return own.join(ref, ["ref_name", "pos"], "left").select("table", "column", "ref_table", "ref_column")


def skip_columns(schema: DataFrame, skipped: DataFrame) -> DataFrame:
    """schema without the columns listed for its database (db, column), or for all where db is null."""
    names = skipped.select("db", F.lower("column").alias("_c"))
    out = schema.withColumn("_c", F.lower("column")).join(names.filter("db is null").select("_c").distinct(), "_c", "left_anti")
    return out.join(names.filter("db is not null").distinct(), ["db", "_c"], "left_anti").drop("_c")


def summary_counts(schema: DataFrame, references: DataFrame) -> DataFrame:
    """One row: databases, schemas, tables, columns, tables with keys, tables with references, relationships."""
    full = F.struct("db", "schema", "table")
    one = schema.agg(F.count_distinct("db").alias("databases"), F.count_distinct(F.struct("db", "schema")).alias("schemas"), F.count_distinct(full).alias("tables"), F.count("*").alias("columns"), F.count_distinct(F.when(F.col("is_key"), full)).alias("key_tables"))
    two = references.agg(F.count_distinct("table").alias("reference_tables"), F.count("*").alias("relationships"))
    return one.crossJoin(two)  # a row each


def sample_values(df: DataFrame, key: str, columns: list[str], limit: int = 3) -> DataFrame:
    """(column, values): the values of the first rows by key, as text, in their order."""
    first = df.orderBy(key).limit(limit).select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    values = F.transform(F.array_sort(F.collect_list(F.struct(key, "x.value"))), lambda x: x["value"])
    return first.groupBy(F.col("x.column").alias("column")).agg(values.alias("values"))


def short_examples(values: DataFrame, most: int = 25, keep: int = 2) -> DataFrame:
    """(column, value): the first distinct short non-empty values of each column by pos."""
    fit = values.filter((F.length("value") > 0) & (F.length("value") <= most)).groupBy("column", "value").agg(F.min("pos").alias("pos"))
    return fit.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy("pos", "value"))).filter(F.col("r") <= keep).select("column", "value")


def displayable(value: Column, most: int = 50) -> Column:
    return F.length(value) < most


def contains_all(have: Column, need: Column) -> Column:
    return F.size(F.array_except(need, have)) == 0


def nested_paths(df: DataFrame) -> list[tuple[str, str]]:
    """(path, type) of all fields, nested ones with dots, elements of arrays as their own fields."""
    from pyspark.sql import types as T

    out = []

    def walk(prefix: str, t: T.DataType) -> None:
        if isinstance(t, T.ArrayType):
            walk(prefix, t.elementType)
        elif isinstance(t, T.StructType):
            for f in t.fields:
                path = f"{prefix}.{f.name}" if prefix else f.name
                out.append((path, f.dataType.simpleString()))
                walk(path, f.dataType)

    walk("", df.schema)
    return out


def schema_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(table, columns, references) of a schema graph: nodes (node, type), edges (src, dst, weight), columns named table.column."""
    own = nodes.filter("type = 'column'").select(F.substring_index("node", ".", 1).alias("table"), F.substring_index("node", ".", -1).alias("column"), F.col("node"))
    far = edges.filter(F.col("src").contains(".") & F.col("dst").contains(".")).select(F.substring_index("src", ".", 1).alias("table"), F.concat_ws(" = ", "src", "dst").alias("reference"))
    columns = own.groupBy("table").agg(F.array_sort(F.collect_set("column")).alias("columns"))
    refs = far.groupBy("table").agg(F.array_sort(F.collect_set("reference")).alias("references"))
    return columns.join(refs, "table", "left").select("table", "columns", F.coalesce("references", F.array().cast("array<string>")).alias("references"))


def edge_features(edges: DataFrame, profile: DataFrame) -> DataFrame:
    """edges (src, dst, kind) with three feature blocks: relation, names, types. profile: (node, table, type_name, is_key, is_reference)."""
    side = lambda p, k: profile.select(F.col("node").alias(k), *[F.col(c).alias(f"{p}_{c}") for c in ("table", "type_name", "is_key", "is_reference")])
    wide = edges.join(side("a", "src"), "src").join(side("b", "dst"), "dst")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    tokens = lambda c: F.array_distinct(F.split(F.lower(F.substring_index(c, ".", -1)), "_"))
    union = F.size(F.array_union(tokens("src"), tokens("dst")))
    names = F.size(F.array_intersect(tokens("src"), tokens("dst"))) / F.greatest(F.lit(1), union)
    relation = F.array(flag(F.col("kind") == "table_column"), flag(F.col("kind") == "reference"), flag(F.col("kind") == "same_table"), flag(F.col("a_is_key") | F.col("b_is_key")), flag(F.col("a_is_reference") | F.col("b_is_reference")))
    meaning = F.array(names, *[F.lit(0.5)] * 4)
    types = F.when(F.col("a_type_name") == F.col("b_type_name"), 1.0).when(F.col("a_type_name").isNull() | F.col("b_type_name").isNull(), 0.5).otherwise(0.0)
    return wide.select("src", "dst", relation.alias("relation"), meaning.alias("meaning"), F.array(types, flag(F.col("a_table") == F.col("b_table"))).alias("types"))


def edge_weight(node_similarity: Column, blocks: list[Column], weights: tuple[float, ...] = (0.4, 0.4, 0.2), own: tuple[float, float] = (0.4, 0.6)) -> Column:
    """own[0] * the ends' similarity + own[1] * the weighted means of the edge's feature blocks."""
    mean = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + x) / F.size(b)
    return own[0] * node_similarity + own[1] * sum((w * mean(b) for w, b in zip(weights, blocks, strict=True)), F.lit(0.0))


def network_diffusion(adj: DataFrame, k: int = 10) -> DataFrame:
    """(u, v, w) on the edges of adj: each node's k strongest neighbours, made symmetric, with a loop of one,
    rows summing to one, to the third power."""
    order = Window.partitionBy("u").orderBy(F.desc("w"), "v")
    top = adj.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("u", "v", "w")
    both = top.union(top.select("v", "u", "w")).groupBy("u", "v").agg((F.sum("w") / 2).alias("w"))
    nodes = adj.select("u").distinct()
    looped = both.union(nodes.select("u", F.col("u").alias("v"), F.lit(1.0).alias("w"))).groupBy("u", "v").agg(F.sum("w").alias("w"))
    p = looped.join(looped.groupBy("u").agg(F.sum("w").alias("t")), "u").select("u", "v", (F.col("w") / F.col("t")).alias("w"))
    step = lambda a: a.select("u", F.col("v").alias("m"), F.col("w").alias("x")).join(p.select(F.col("u").alias("m"), "v", "w"), "m").groupBy("u", "v").agg(F.sum(F.col("x") * F.col("w")).alias("w"))
    return step(step(p)).join(adj.select("u", "v"), ["u", "v"], "left_semi")


#: Weights of a schema's edges in a knowledge graph. Fixed values.
COLUMN_WEIGHT, REFERENCE_WEIGHT = 10.0, 15.0


def schema_to_graph(schema: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, kind, description), edges (src, dst, weight, keywords)) of schema rows (table, column,
    type) and references (table, column, ref_table, ref_column): tables, columns, what joins them."""
    name = F.concat_ws(".", "table", "column")
    tables = schema.groupBy("table").agg(F.count("*").alias("n")).select(F.col("table").alias("node"), F.lit("table").alias("kind"), F.format_string("Table %s with %d columns", "table", "n").alias("description"))
    columns = schema.select(name.alias("node"), F.lit("column").alias("kind"), F.format_string("Column %s of type %s in table %s", "column", "type", "table").alias("description"))
    own = schema.select(F.col("table").alias("src"), name.alias("dst"), F.lit(COLUMN_WEIGHT).alias("weight"), F.lit("contains").alias("keywords"))
    refs = references.select(F.col("table").alias("src"), F.col("ref_table").alias("dst"), F.lit(REFERENCE_WEIGHT).alias("weight"), F.concat_ws(" ", F.lit("references"), F.col("ref_column")).alias("keywords"))
    return tables.union(columns), own.union(refs)


def visible_graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, kind), edges with width): without blank or kindless nodes and weightless edges; widths
    from 0.5 to 4 by weight."""
    shown = nodes.filter(F.col("node").isNotNull() & (F.trim(F.col("node").cast("string")) != "") & F.col("kind").isNotNull())
    ends = shown.select("node")
    live = edges.filter("weight > 0").join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")
    span = live.agg(F.min("weight").alias("low"), F.max("weight").alias("high"))
    wide = live.crossJoin(F.broadcast(span))  # one row
    return shown, wide.withColumn("width", 0.5 + 3.5 * F.when(F.col("high") > F.col("low"), (F.col("weight") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(F.lit(1.0))).drop("low", "high")


def strongest_of_each_source(nodes: DataFrame, edges: DataFrame, always: DataFrame, most: int = 7) -> tuple[DataFrame, DataFrame]:
    """(nodes (node, source), edges) that an illustration shows: of each source the nodes with the largest
    summed strength, those always kept, and the edges (src, dst, strength) between them."""
    both = edges.select(F.col("src").alias("node"), "strength").union(edges.select("dst", "strength")).groupBy("node").agg(F.sum("strength").alias("s"))
    order = Window.partitionBy("source").orderBy(F.desc("s"), "node")
    ranked = nodes.join(both, "node", "left").na.fill(0.0, ["s"]).withColumn("r", F.row_number().over(order))
    kept = ranked.join(always.select("node", F.lit(True).alias("a")), "node", "left").filter((F.col("r") <= most) | F.col("a")).select("node", "source")
    ends = kept.select("node")
    return kept, edges.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


def known_columns(mentions: DataFrame, schema: DataFrame) -> DataFrame:
    """mentions (name 'table.column') that the schema has, spelt exactly so."""
    return mentions.join(schema.select(F.concat_ws(".", "table", "column").alias("name")).distinct(), "name", "left_semi")


def tasks_to_run(tasks: DataFrame, finished: DataFrame, first: int = 0, last: int | None = None, kind: str = "") -> DataFrame:
    """tasks (pos, id) of a range of places and a kind of id that aren't finished (id)."""
    some = tasks.filter((F.col("pos") >= first) & F.col("id").startswith(kind))
    return (some if last is None else some.filter(F.col("pos") < last)).join(finished.select("id"), "id", "left_anti")


def summarised(rows: DataFrame, limit: int, tokens: Column, summarise) -> DataFrame:
    """rows with descriptions of limit tokens and more replaced by summarise(description)."""
    return rows.withColumn("description", F.when(tokens < limit, F.col("description")).otherwise(summarise(F.col("description"))))


def sampled_answers(requests: DataFrame, samples: int, answer) -> DataFrame:
    """(request, answers): each request asked so many times, its answers in the order of asking."""
    asked = requests.select("request", "prompt", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("k")).withColumn("answer", answer(F.col("prompt"), F.col("k")))
    return asked.groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "answer"))), lambda x: x["answer"]).alias("answers"))


def function_summaries(names: DataFrame, functions: DataFrame, otherwise: str = "No summary") -> DataFrame:
    """names with summary, found by name or by category/name of functions (name, category, summary)."""
    keys = functions.select(F.col("name").alias("key"), "summary", F.lit(0).alias("p")).union(functions.select(F.concat_ws("/", "category", "name"), "summary", F.lit(1)))
    one = keys.groupBy("key").agg(F.min_by("summary", F.struct("p", "summary")).alias("summary"))
    return names.join(one.withColumnRenamed("key", "name"), "name", "left").withColumn("summary", F.coalesce("summary", F.lit(otherwise)))


def database_stats(schema: DataFrame) -> DataFrame:
    """(db, table, column) as one row: n_dbs, and the mean over them of tables, columns and columns a table."""
    tables = schema.groupBy("db", "table").agg(F.count_distinct("column").alias("columns"))
    dbs = tables.groupBy("db").agg(F.count("*").alias("tables"), F.sum("columns").alias("columns"))
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2)
    return dbs.agg(F.count("*").alias("n_dbs"), mean("tables").alias("tables"), mean("columns").alias("columns"), mean(F.col("columns") / F.col("tables")).alias("columns_per_table"))


def reference_classes(references: DataFrame) -> DataFrame:
    """(db, pos, key, ref_key) as db, key, head: keys that references connect, and the smallest of them.

    References are taken by pos: each joins the first class that holds one of its keys, so two classes
    that a later reference connects stay apart, and a key in both is told by the later class. A
    schema's references are one group; they are as many as its declared keys.
    """

    def work(g: pd.DataFrame) -> pd.DataFrame:
        classes, first = [], {}
        for a, b in g.sort_values(["pos", "key", "ref_key"])[["key", "ref_key"]].itertuples(index=False):
            at = min(first.get(a, len(classes)), first.get(b, len(classes)))
            if at == len(classes):
                classes.append(set())
            classes[at] |= {a, b}
            first[a] = first[b] = at
        heads = {k: min(c) for c in classes for k in c}
        return pd.DataFrame({"db": g["db"].iloc[0], "key": list(heads), "head": list(heads.values())})

    kind = references.schema["key"].dataType.simpleString()
    named = references.select("db", "pos", "key", "ref_key").dropna(subset=["key", "ref_key"])
    return named.groupBy("db").applyInPandas(work, f"db {references.schema['db'].dataType.simpleString()}, key {kind}, head {kind}")
