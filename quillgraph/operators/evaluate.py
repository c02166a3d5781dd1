"""Comparing query results, clustering candidates by result, and statistics of runs."""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_key(df: DataFrame):
    return F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in df.columns])), 256)


def equal_as_sets(a: DataFrame, b: DataFrame) -> bool:
    x, y = a.select(row_key(a).alias("k")).distinct(), b.select(row_key(b).alias("k")).distinct()
    return x.join(y, "k", "left_anti").isEmpty() and y.join(x, "k", "left_anti").isEmpty()


def equal_as_bags(a: DataFrame, b: DataFrame) -> bool:
    x = a.select(row_key(a).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    y = b.select(row_key(b).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    return x.join(y, ["k", "n"], "left_anti").isEmpty() and y.join(x, ["k", "n"], "left_anti").isEmpty()


def column_digests(df: DataFrame) -> list[tuple]:
    """An order-free digest of each column's values, in one pass."""
    def digest(c: str):
        h = F.xxhash64(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")))
        return F.struct(F.count(F.lit(1)), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h))

    row = df.agg(*[digest(c).alias(f"c{i}") for i, c in enumerate(df.columns)]).head()
    return [tuple(x) for x in row]


def equal_under_permutation(a: DataFrame, b: DataFrame, most: int = 5040) -> bool | None:
    """Equal bags for some order of b's columns; None if `most` orders that fit were compared in vain.

    Only columns with equal digests can stand for one another, so orders are built column by column."""
    if len(a.columns) != len(b.columns):
        return False
    da, db = column_digests(a), column_digests(b)
    if sorted(map(str, da)) != sorted(map(str, db)):
        return False
    named = a.toDF(*[f"c{i}" for i in range(len(da))])

    def orders(taken: tuple[int, ...]):
        if len(taken) == len(da):
            yield taken
            return
        for j, y in enumerate(db):
            if j not in taken and y == da[len(taken)]:
                yield from orders((*taken, j))

    for tried, order in enumerate(orders(())):
        if tried >= most:
            return None
        if equal_as_bags(named, b.select(*[F.col(f"`{b.columns[j]}`").alias(f"c{i}") for i, j in enumerate(order)])):
            return True
    return False


def run_sql(spark: SparkSession, sql: str) -> tuple[str, str | None]:
    """(status, digest of the result as a set): CORRECT, EMPTY or ERROR."""
    try:
        df = spark.sql(sql)
        keys = df.select(row_key(df).alias("k")).distinct().agg(F.count("*"), F.sum(F.xxhash64("k").cast("decimal(38,0)"))).head()
    except PySparkException:
        return "ERROR", None
    return ("EMPTY", "0") if not keys[0] else ("CORRECT", f"{keys[0]}:{keys[1]}")


def vote(candidates: DataFrame) -> DataFrame:
    """(qid, idx, votes): of candidates (qid, idx, sql, status, result) the shortest SQL of the largest result cluster, errors left out."""
    ok = candidates.filter("status <> 'ERROR'")
    size = ok.groupBy("qid", "result").agg(F.count("*").alias("votes"), F.min("idx").alias("first"))
    top = size.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("votes"), "first"))).filter("r = 1")
    members = ok.join(top.select("qid", "result", "votes"), ["qid", "result"])
    return members.groupBy("qid", "votes").agg(F.min(F.struct(F.length("sql"), "idx")).alias("p")).select("qid", F.col("p.idx").alias("idx"), "votes")


def first_executable(candidates: DataFrame) -> DataFrame:
    ok = F.min(F.when(F.col("status") != "ERROR", F.col("idx")))
    return candidates.groupBy("qid").agg(F.coalesce(ok, F.min("idx")).alias("idx"))


def best_by_tests(scores: DataFrame, clusters: DataFrame) -> DataFrame:
    """(qid, idx): highest summed test score; ties to the larger result cluster, then to the first."""
    total = scores.groupBy("qid", "idx").agg(F.sum("score").alias("score"))
    size = clusters.withColumn("k", F.count("*").over(Window.partitionBy("qid", "result")))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("k"), "idx")
    return total.join(size.select("qid", "idx", "k"), ["qid", "idx"]).withColumn("r", F.row_number().over(order)).filter("r = 1").select("qid", "idx", "score")


def stage_stats(runs: DataFrame) -> DataFrame:
    """runs (stage, id, outcome): counts and sorted ids by outcome."""
    count = lambda x: F.count_if(F.col("outcome") == x)
    ids = lambda x: F.array_join(F.array_sort(F.collect_list(F.when(F.col("outcome") == x, F.lpad(F.col("id").cast("string"), 10, "0")))), ",")
    return runs.groupBy("stage").agg(count("correct").alias("correct"), count("incorrect").alias("incorrect"), count("error").alias("error"), F.md5(ids("incorrect")).alias("incorrect_ids"))


def coverage_at_k(ranked: DataFrame, most: int = 100) -> DataFrame:
    """ranked (qid, rank, used): share of questions whose used items all lie in the first k."""
    need = ranked.groupBy("qid").agg(F.coalesce(F.max(F.when(F.col("used"), F.col("rank"))), F.lit(0)).alias("need"))
    at = need.groupBy("need").agg(F.count("*").alias("n"))
    ks = ranked.sparkSession.range(1, most + 1).select(F.col("id").alias("k"))
    total = F.sum("n").over(Window.partitionBy())
    run = F.sum("n").over(Window.orderBy("need"))  # at most a row for each rank
    steps = at.select("need", run.alias("covered"), total.alias("total"))
    return ks.join(steps, F.col("need") <= F.col("k"), "left").groupBy("k").agg(F.round(F.coalesce(F.max("covered") / F.max("total"), F.lit(0.0)), 6).alias("coverage"))


def tables_of(spark: SparkSession, sql: str) -> list[str]:
    """Names of the relations a query reads, by the engine's own parser."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    found, ctes = set(), set()
    import re

    for m in re.finditer(r"UnresolvedRelation \[([^\]]+)\]", plan.toString()):
        found.add(m[1].replace(", ", "."))
    for m in re.finditer(r"CTE \[([^\]]+)\]", plan.toString()):
        ctes |= set(m[1].split(", "))
    return sorted(found - ctes)


def frame_cells(df: DataFrame, digits: int = 2):
    """Values as text for comparing columns: numbers rounded, whole ones without a fraction."""
    from pyspark.sql import types as T

    def cell(f: T.StructField):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.NumericType,)):
            x = F.round(c.cast("double"), digits)
            return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
        return F.coalesce(c.cast("string"), F.lit("\x00"))

    return [F.coalesce(cell(f), F.lit("\x00")) for f in df.schema.fields]


def cell_digests(df: DataFrame) -> list[tuple]:
    cells = df.select(*[c.alias(f"c{i}") for i, c in enumerate(frame_cells(df))])
    return column_digests(cells)


def contains_columns(have: DataFrame, need: DataFrame) -> bool:
    """Each of need's columns equals, as a bag of rounded values, a column of have that no other took."""
    left = list(cell_digests(have))
    for d in cell_digests(need):
        if d not in left:
            return False
        left.remove(d)
    return True


def equal_frames(a: DataFrame, b: DataFrame) -> bool:
    """As many columns, and each one's bag of values is one of the other's."""
    return len(a.columns) == len(b.columns) and contains_columns(a, b)


def judged(spark: SparkSession, predicted: str, correct: str) -> str:
    """'--' where both queries give the same set of rows, else what went wrong."""
    status, digest = run_sql(spark, predicted)
    if status == "ERROR":
        return "error"
    return "--" if (status, digest) == run_sql(spark, correct) else "incorrect answer"


def validate(spark: SparkSession, sql: str, rows: int = 30) -> tuple[str, list]:
    """OK and at most so many rows, or ERROR and the message's first line."""
    try:
        return "OK", spark.sql(sql).limit(rows).collect()
    except PySparkException as e:
        return "ERROR", [str(e).splitlines()[0]]


def formatted(df: DataFrame, most: int = 20) -> str:
    """Rows and columns of a result and its first rows."""
    return f"Rows: {df.count()}, Columns: {len(df.columns)}, Results: {[tuple(r) for r in df.limit(most).collect()]}"


def final_sql(steps: DataFrame) -> DataFrame:
    """(qid, sql): of steps (qid, step, sql, status) the last executable one, else the first."""
    ok = F.max(F.when(F.col("status") == "CORRECT", F.struct("step", "sql")))["sql"]
    return steps.groupBy("qid").agg(F.coalesce(ok, F.min(F.struct("step", "sql"))["sql"]).alias("sql"))


def revisions(steps: DataFrame) -> DataFrame:
    """(qid, step, name, status): steps in chained names, from the one that needs a revision on."""
    name = F.when(F.col("step") == 0, F.lit("candidate")).otherwise(F.concat(F.lit("revise_"), F.col("step").cast("string")))
    bad = F.min(F.when(F.col("status") != "CORRECT", F.col("step"))).over(Window.partitionBy("qid"))
    return steps.withColumn("bad", bad).filter(F.col("step") >= F.col("bad")).select("qid", "step", name.alias("name"), "status")


def majority(candidates: DataFrame) -> DataFrame:
    """(qid, idx, votes, share): the first member of the largest cluster of equal results, ties to the
    cluster met first; share of all candidates that agree."""
    size = candidates.groupBy("qid", "result").agg(F.count("*").alias("votes"), F.min("idx").alias("idx"))
    n = candidates.groupBy("qid").agg(F.count("*").alias("n"))
    top = size.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("votes"), "idx"))).filter("r = 1")
    return top.join(n, "qid").select("qid", "idx", "votes", F.round(F.col("votes") / F.col("n"), 6).alias("share"))


def tests_needed(candidates: DataFrame) -> DataFrame:
    """(qid, clusters, needed): tests tell candidates apart only where results differ."""
    return candidates.groupBy("qid").agg(F.count_distinct("result").alias("clusters")).withColumn("needed", F.col("clusters") > 1)


def candidate_pool(generators: list[DataFrame]) -> DataFrame:
    """(qid, idx, sql) of all generators' candidates (qid, idx, sql), numbered anew in the generators' order."""
    out = None
    for k, g in enumerate(generators):
        part = g.select("qid", F.struct(F.lit(k), "idx").alias("at"), "sql")
        out = part if out is None else out.union(part)
    return out.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("at", "sql")) - 1).alias("idx"), "sql")
