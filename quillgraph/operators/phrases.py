"""Linking questions to cells by phrases, and settling which links of a question stay.

A question's words meet the words of a column's values by an equi-join. Neighbouring words linked to
one column are a run; a run that is a value as a whole links exactly, another in part. Where words
also name columns and tables, matches settled earlier decide later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_WORDS = r"\s+"


def words(text: Column) -> Column:
    """Lower-cased words between white space, with signs around them left out."""
    bare = F.transform(F.split(F.lower(text), _WORDS), lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(bare, lambda w: w != "")


def question_words(questions: DataFrame) -> DataFrame:
    """(qid, pos, word) of questions (qid, text)."""
    return questions.select("qid", F.posexplode(words(F.col("text"))).alias("pos", "word"))


def value_words(values: DataFrame) -> DataFrame:
    """(table, column, word): the words of values (table, column, value), each once: an index that is made
    once and met by any number of questions."""
    return values.select("table", "column", F.explode(F.split(F.lower(F.trim("value")), " ")).alias("word")).filter("word <> ''").distinct()


def runs(links: DataFrame) -> DataFrame:
    """links (qid, table, column, pos, word) with start and length of the run of neighbouring positions."""
    order = Window.partitionBy("qid", "table", "column").orderBy("pos")
    once = links.select("qid", "table", "column", "pos", "word").repartition("qid").distinct()  # dealt once, for all that follows
    marked = once.withColumn("run", F.col("pos") - F.row_number().over(order))
    return marked.groupBy("qid", "table", "column", "run").agg(
        F.min("pos").alias("start"), F.count("*").cast("int").alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase")
    ).drop("run")


def cell_phrases(questions: DataFrame, values: DataFrame, stop: tuple[str, ...] = ()) -> DataFrame:
    """(qid, table, column, start, length, phrase, kind): runs of a question's words that are words of a
    column's values; kind is exact where the run is a value, else partial. Numbers and stop words link with
    nothing, and so end a run. Words of questions stream past those of the values, which alone are held:
    a word that many questions share takes time in its task, not memory."""
    asked = question_words(questions).filter(~F.col("word").isin(*stop) & F.col("word").try_cast("double").isNull())
    found = runs(asked.join(value_words(values).hint("shuffle_hash"), "word"))
    whole = values.select("table", "column", F.lower(F.trim("value")).alias("phrase"), F.lit("exact").alias("kind")).distinct()
    return found.join(whole.hint("shuffle_hash"), ["table", "column", "phrase"], "left").select("qid", "table", "column", "start", "length", "phrase", F.coalesce("kind", F.lit("partial")).alias("kind"))


def number_links(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """(qid, pos, table, column, kind): numbers of a question with the columns (table, column, type) that
    hold numbers or times; kind is the type in upper case."""
    asked = question_words(questions).filter(F.col("word").try_cast("double").isNotNull()).select("qid", "pos")
    offered = columns.filter("type in ('number', 'time')").agg(F.collect_list(F.struct("table", "column", F.upper("type").alias("kind"))).alias("x"))
    # one row, a database's columns; each number is offered them in place
    return asked.join(offered).select("qid", "pos", F.explode("x").alias("x")).select("qid", "pos", "x.table", "x.column", "x.kind")


def settled(matches: DataFrame) -> DataFrame:
    """(qid, pos, what, name, kind): which of matches (qid, pos, what, name, kind) stay. A question's
    positions are settled one after another, those with fewer matches first, then in order. A position that
    shares none with those settled takes its exact ones, or all if it has none, and they are settled; another
    one keeps what it shares."""
    one = F.struct("what", "name", "kind")
    at = matches.groupBy("qid", "pos").agg(F.array_sort(F.collect_set(one)).alias("found"))
    line = F.array_sort(F.collect_list(F.struct(F.size("found").alias("n"), "pos", "found")))
    per = at.groupBy("qid").agg(line.alias("line"))
    kind = "array<struct<what:string,name:string,kind:string>>"
    start = F.struct(F.array().cast(kind).alias("known"), F.array().cast(f"array<struct<pos:int,kept:{kind}>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        shared = F.array_intersect(state["known"], x["found"])
        exact = F.filter(x["found"], lambda m: m["kind"] == "exact")
        fresh = F.when(F.size(exact) > 0, exact).otherwise(x["found"])
        kept = F.when(F.size(shared) > 0, shared).otherwise(fresh)
        return F.struct(
            F.when(F.size(shared) > 0, state["known"]).otherwise(F.concat(state["known"], fresh)).alias("known"),
            F.concat(state["out"], F.array(F.struct(x["pos"].alias("pos"), kept.alias("kept")))).alias("out"),
        )

    done = per.select("qid", F.aggregate("line", start, step, lambda s: s["out"]).alias("out"))
    return done.select("qid", F.explode("out").alias("x")).select("qid", "x.pos", F.explode("x.kept").alias("m")).select("qid", "pos", "m.what", "m.name", "m.kind")


def unsettled_cells(cells: DataFrame, matches: DataFrame) -> DataFrame:
    """Cell links (qid, pos, ..) of positions that name no column or table."""
    return cells.join(matches.select("qid", "pos").distinct(), ["qid", "pos"], "left_anti")
