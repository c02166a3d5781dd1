"""What SQL statements read: tables, columns and the literals that columns are compared with.

A statement becomes rows, one a token, and all else is windows and joins over them, many statements
at once. Names with their dots are one token. A token's depth is the running sum of parentheses; a
parenthesis that begins with SELECT, like the statement itself, holds a scope for each SELECT in it,
and a token belongs to the innermost scope around it. Tables and aliases of a scope stand behind
FROM, JOIN and commas; a column is looked for in its own scope and then in those around it: by its
qualifier, or without one by the schema, first table first.

Statements are dealt once, by their id and before they become tokens; windows and joins within a
statement then meet where it lies, and what is told of a statement (its scopes and common tables)
stands beside its tokens. Only the schema is sent whole.

It reads what queries are made of, not a grammar: text that is no query gives what looks like one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that name neither a table nor a column. Fixed values of common SQL.
KEYWORDS = (
    "ALL", "AND", "ANY", "AS", "ASC", "BETWEEN", "BY", "CASE", "CAST", "COLLATE", "CROSS", "CURRENT", "DESC", "DISTINCT", "ELSE", "END", "ESCAPE", "EXCEPT",
    "EXISTS", "FALSE", "FETCH", "FIRST", "FOLLOWING", "FROM", "FULL", "GLOB", "GROUP", "HAVING", "ILIKE", "IN", "INNER", "INTERSECT", "INTERVAL", "IS", "JOIN",
    "LAST", "LATERAL", "LEFT", "LIKE", "LIMIT", "NATURAL", "NOT", "NULL", "NULLS", "OFFSET", "ON", "OR", "ORDER", "OUTER", "OVER", "PARTITION", "PRECEDING",
    "QUALIFY", "RANGE", "RECURSIVE", "REGEXP", "RIGHT", "RLIKE", "ROW", "ROWS", "SELECT", "THEN", "TRUE", "UNBOUNDED", "UNION", "USING", "VALUES", "WHEN",
    "WHERE", "WINDOW", "WITH",
)
#: Words that begin a part of a query; FROM's part holds its tables.
_PARTS = ("SELECT", "FROM", "WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "OFFSET", "FETCH", "QUALIFY", "WINDOW", "UNION", "INTERSECT", "EXCEPT")
_COMPARISONS = ("=", "==", "<>", "!=", "<", ">", "<=", ">=", "<=>")
_LIKES = ("LIKE", "ILIKE", "GLOB")
#: Statements that a task reads at once; windows sort their tokens.
STATEMENTS = 10_000
_NAME = r'(?:[\p{L}_][\p{L}\p{N}_$]*|"(?:[^"]|"")*"|`[^`]*`|\[[^\]\[]*\])'
_TOKEN = rf"(?s)--[^\n]*|/\*.*?\*/|'(?:[^']|'')*'|{_NAME}(?:\s*\.\s*{_NAME})*(?:\s*\.\s*\*)?|\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+|<=>|<>|<=|>=|!=|==|\|\||\S"


def parts(name: Column) -> Column:
    """A dotted name's parts without quotes."""
    found = F.regexp_extract_all(name, F.lit(_NAME), F.lit(0))
    return F.transform(found, lambda x: F.when(x.rlike(r'^["`\[]'), F.substr(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def tokens(statements: DataFrame) -> DataFrame:
    """(sid, pos, token, word, kind, depth) of statements (sid, sql): word is the token in upper case if it
    is a keyword, kind name, keyword, text, number or sign; a parenthesis counts to what it holds."""
    found = F.filter(F.regexp_extract_all("sql", F.lit(_TOKEN), F.lit(0)), lambda x: ~x.startswith("--") & ~x.startswith("/*"))
    spark = statements.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), statements.count() // STATEMENTS + 1)
    t = statements.select("sid", "sql").repartition(tasks, "sid").select("sid", F.posexplode(found).alias("pos", "token"))
    upper = F.upper("token")
    kind = F.when(F.col("token").startswith("'"), "text").when(F.col("token").rlike(r"^\.?\d"), "number").when(upper.isin(*KEYWORDS), "keyword").when(F.col("token").rlike(r'^[\p{L}_"`\[]'), "name").otherwise("sign")
    t = t.withColumn("kind", kind).withColumn("word", F.when((F.col("kind") == "keyword") | (F.col("kind") == "sign"), upper))
    opened = F.count_if(F.col("token") == "(").over(Window.partitionBy("sid").orderBy("pos"))
    closed = F.count_if(F.col("token") == ")").over(Window.partitionBy("sid").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("depth", opened - closed)


def scoped(statements: DataFrame) -> DataFrame:
    """Tokens with group (place of the parenthesis around, -1 for none), scope (place of the SELECT they
    belong to) and its level; scopes, the stretches (level, scope, from_, to_) of their statement."""
    t = tokens(statements)
    here = Window.partitionBy("sid", "depth").orderBy("pos")
    group = F.coalesce(F.max(F.when(F.col("token") == "(", F.col("pos"))).over(here), F.lit(-1))
    t = t.withColumn("group", F.when(F.col("depth") == 0, F.lit(-1)).otherwise(group))
    inside = Window.partitionBy("sid", "group").orderBy("pos")
    ends = t.withColumn("next", F.min(F.when(F.col("word") == "SELECT", F.col("pos"))).over(inside.rowsBetween(1, Window.unboundedFollowing)))
    closed = F.max(F.when((F.col("token") == ")") & (F.col("group") >= 0), F.col("pos"))).over(Window.partitionBy("sid", "group"))
    whole = Window.partitionBy("sid")
    ends = ends.withColumn("end", F.coalesce(closed, F.max("pos").over(whole)))
    stretch = F.struct(F.col("depth").alias("level"), F.col("pos").alias("scope"), F.col("pos").alias("from_"), F.coalesce(F.col("next") - 1, "end").alias("to_"))
    t = ends.withColumn("scopes", F.collect_list(F.when(F.col("word") == "SELECT", stretch)).over(whole)).drop("next", "end")
    best = F.array_max(around(F.col("pos")))
    return t.withColumn("scope", best["scope"]).withColumn("level", best["level"])


def around(pos: Column) -> Column:
    """The scopes that a place stands in."""
    return F.filter("scopes", lambda x: (pos >= x["from_"]) & (pos <= x["to_"]))


def _beside(t: DataFrame) -> DataFrame:
    """Tokens with the part of their scope that they stand in (part; only what isn't in parentheses of its
    own, direct) and with up to four tokens before (b1 ..) and three behind them (a1 ..)."""
    part = F.last(F.when((F.col("depth") == F.col("level")) & F.col("word").isin(*_PARTS), F.col("word")), True).over(Window.partitionBy("sid", "scope").orderBy("pos"))
    order = Window.partitionBy("sid").orderBy("pos")
    one = F.struct("token", "word", "kind")
    near = {f"b{k}": F.lag(one, k).over(order) for k in (1, 2, 3, 4)} | {f"a{k}": F.lead(one, k).over(order) for k in (1, 2, 3)}
    return t.withColumns({"part": part, "direct": F.col("depth") == F.col("level"), "behind": F.lead("scope").over(order)} | near)


def _last(name: Column) -> Column:
    return F.lower(F.element_at(parts(name), -1))


def _is(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class Lineage:
    """Tables, columns and literals of statements (sid, sql) under schema (table, column); names are
    compared without case and returned as the schema spells them."""

    def __init__(self, statements: DataFrame, schema: DataFrame):
        self.tokens = _beside(scoped(statements))
        self.schema = schema.select("table", "column", F.lower("table").alias("t"), F.lower("column").alias("c")).distinct()
        self.relations = self._relations()

    def _names_relation(self) -> Column:
        return (F.col("kind") == "name") & (F.col("part") == "FROM") & F.col("direct") & F.col("b1.word").isin("FROM", "JOIN", ",")

    def _relations(self) -> DataFrame:
        """(sid, scope, pos, alias, t): what FROM names; t is null for what isn't a table of the schema."""
        alias = F.when((F.col("a1.word") == "AS") & (F.col("a2.kind") == "name"), F.col("a2.token")).when(F.col("a1.kind") == "name", F.col("a1.token"))
        held = (F.col("kind") == "name") & (F.col("a1.word") == "AS") & (F.col("a2.token") == "(") & F.col("a3.word").isin("SELECT", "WITH", "VALUES")
        t = self.tokens.withColumn("ctes", F.collect_set(F.when(held, _last(F.col("token")))).over(Window.partitionBy("sid")))
        t = t.withColumn("query", F.max(_is(F.col("word") == "SELECT")).over(Window.partitionBy("sid", "group")))
        # a query in parentheses has its name behind them
        derived = (F.col("token") == ")") & F.col("query") & alias.isNotNull() & F.col("behind").isNotNull()
        named = _is(self._names_relation()) & ~_is(F.col("a1.token") == "(")
        name = F.when(named, _last(F.col("token")))
        found = t.filter(named | _is(derived)).select("sid", F.when(named, F.col("scope")).otherwise(F.col("behind")).alias("scope"), "pos", _last(F.when(named, F.coalesce(alias, "token")).otherwise(alias)).alias("alias"), name.alias("t"), "ctes")
        known = F.broadcast(self.schema.select("t").distinct().withColumn("known", F.lit(True)))
        table = F.when(F.col("known") & ~F.array_contains("ctes", F.col("t")), F.col("t"))
        return found.join(known, "t", "left").select("sid", "scope", "pos", "alias", table.alias("t"))

    def tables(self) -> DataFrame:
        """(sid, table)."""
        names = self.schema.groupBy("t").agg(F.min("table").alias("table"))
        return self.relations.filter("t is not null").select("sid", "t").distinct().join(F.broadcast(names), "t").select("sid", "table")

    def references(self) -> DataFrame:
        """(sid, pos, table, column): each token that names a column, with the table it is of."""
        labels = F.col("b1.word").isin("AS", ")", "END") | F.col("b1.kind").isin("name", "number", "text")
        other = labels | self._names_relation() | (F.col("a1.token") == "(") | (F.col("a1.kind") == "text") | F.col("token").endswith("*")
        use = self.tokens.filter((F.col("kind") == "name") & F.col("scope").isNotNull() & ~_is(other))
        name = parts(F.col("token"))
        use = use.select("sid", "pos", _last(F.col("token")).alias("c"), F.when(F.size(name) > 1, F.lower(F.element_at(name, -2))).alias("q"), F.explode(around(F.col("pos"))).alias("x"))
        seen = use.select("sid", "pos", "c", "q", F.col("x.scope").alias("outer"), "x.level")
        # of a table that has the column; a name that isn't one by its alias alone. Both sides lie by statement
        offered = self.relations.select("sid", F.col("scope").alias("outer"), F.col("pos").alias("place"), "alias", "t")
        met = seen.join(offered.hint("merge"), ["sid", "outer"]).filter(F.col("q").isNull() | (F.col("q") == F.col("alias")))
        spelt = self.schema.groupBy("t", "c").agg(F.min("table").alias("table"), F.min("column").alias("column"))
        met = met.join(F.broadcast(spelt), ["t", "c"], "left").filter(F.col("q").isNotNull() | F.col("table").isNotNull())
        nearest = F.max_by(F.struct("table", "column"), F.struct("level", -F.col("place"))).alias("x")  # in a struct, as a derived table's null counts
        return met.groupBy("sid", "pos").agg(nearest).select("sid", "pos", "x.table", "x.column").filter(F.col("table").isNotNull())

    def columns(self) -> DataFrame:
        """(sid, table, column)."""
        return self.references().select("sid", "table", "column").distinct()

    def literals(self, values: DataFrame | None = None) -> DataFrame:
        """(sid, table, column, literal, how): what columns are compared with; how is the comparison, IN or
        BETWEEN. values (table, column, value): of the literals of IN and LIKE those stay that a value of
        the column holds, those of LIKE without percent signs."""
        t = self.tokens
        no = lambda c: F.when(F.col(f"{c}.word") == "NOT", 1).otherwise(0)
        heads = t.filter((F.col("token") == "(") & (F.col("b1.word") == "IN") & ~_is(F.col("a1.word") == "SELECT"))
        heads = heads.select("sid", F.col("pos").alias("group"), (F.col("pos") - 2 - no("b2")).alias("at"))
        said = t.filter(F.col("kind").isin("text", "number"))
        listed = said.filter(F.col("b1.token").isin("(", ",")).join(heads.hint("merge"), ["sid", "group"]).select("sid", "at", "token", F.lit("IN").alias("how"))
        high = (F.col("b1.word") == "AND") & (F.col("b3.word") == "BETWEEN")
        how = F.when(F.col("b1.word").isin(*_COMPARISONS, *_LIKES, "BETWEEN"), F.col("b1.word")).when(high, F.lit("AND"))
        back = F.when(F.col("how") == "AND", F.lit(4) + no("b4")).otherwise(F.lit(2) + no("b2"))
        alone = said.withColumn("how", how).filter("how is not null").select("sid", (F.col("pos") - back).alias("at"), "token", F.when(F.col("how") == "AND", F.lit("BETWEEN")).otherwise(F.col("how")).alias("how"))
        inner = F.substr("token", F.lit(2), F.length("token") - 2)
        text = F.when(F.col("token").startswith("'"), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(F.col("token"))
        found = listed.union(alone).join(self.references().withColumnRenamed("pos", "at").hint("merge"), ["sid", "at"]).select("sid", "table", "column", text.alias("literal"), "how").distinct()
        if values is None:
            return found
        bare = F.when(F.col("how") == "IN", F.col("literal")).otherwise(F.replace("literal", F.lit("%"), F.lit("")))
        doubtful = found.filter(F.col("how").isin(*_LIKES, "IN")).withColumn("literal", bare)
        asked = doubtful.select("table", "column", "literal").distinct()
        held = asked.join(values.hint("merge"), ["table", "column"]).filter(F.contains(F.lower("value"), F.lower("literal"))).select("table", "column", "literal").distinct()
        return found.filter(~F.col("how").isin(*_LIKES, "IN")).union(doubtful.join(held.hint("shuffle_hash"), ["table", "column", "literal"]).select(*found.columns)).distinct()
