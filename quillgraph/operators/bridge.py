"""Values that a question spells out, nearly: seeds by shared character pairs, then alignment.

A value is a candidate of a question if enough of its distinct character pairs stand in the question:
an alignment as good as asked for breaks at most 2 * 0.3 / 1.15 of a value's pairs, so none is lost.
Candidates are aligned in Arrow batches: the longest common block must begin where a word of the
question begins and end near a word's end; the words it touches are compared with the whole value.
A possessive ('s) behind the block counts in full, so what stands before one is a seed of its own.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.functions.columns import ngrams

#: Least likeness of a value and the words that it was found in; values of a column that are kept. Fixed values.
LEAST, TOP = 0.85, 2
#: Weights of a match's score against the value and against the words, beside its size. Fixed values.
SCORE_WEIGHT, WORDS_WEIGHT = 1e16, 1e8
#: Signs that end a word. Fixed values.
SEPARATORS = "'\"()`,.?! "
#: Words that are no value. Fixed values.
STOP_WORDS = frozenset(
    """who ourselves down only were him at weren't has few it's m again d haven been other we an own doing ma hers all haven't in but
    shouldn't does out aren you you'd himself isn't most y below is wasn't hasn them wouldn against this about there don that'll a being
    with your theirs its any why now during weren if should those be they o t of or me i some her do will yours for mightn nor
    needn the until couldn't he which yourself to needn't you're because their where it didn't ve whom should've can shan't on had have
    myself am don't under was won't these so as after above each ours hadn having wasn s doesn hadn't than by that both herself his
    wouldn't into doesn't before my won more are through same how what over ll yourselves up mustn mustn't she's re such didn you'll shan
    when you've themselves mightn't she from isn ain between once here shouldn our and not too very further while off couldn hasn't itself
    then did just aren't""".split()
)
#: Words that are a value only if they match in full, and terms that are none. Fixed values.
COMMON_WORDS, COMMON_TERMS = frozenset(("no", "yes", "many")), frozenset(("id",))


def likeness(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; places of the subsequence are bits of a number."""
    if not a and not b:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = 0
    for c in b:
        hit = row | where.get(c, 0)
        row = hit & ~(hit - ((row << 1) | 1))
    return 2 * row.bit_count() / (len(a) + len(b))


def touched(text: str, a: int, b: int) -> str | None:
    """The words of text that the block a to b touches, if it begins with a word and ends within two signs of one's end."""
    if a and text[a] not in SEPARATORS and text[a - 1] not in SEPARATORS:
        return None
    for end in range(b - 1, b + 3):
        if end >= len(text) or text[end] in SEPARATORS:
            return text[a : end + 1].strip(SEPARATORS)
    return None


def bridged(question: str, value: str) -> tuple[str, str, float, int] | None:
    """(matched part of the value, words of the question, score, size) of a value that a question holds."""
    text = question.strip()
    block = difflib.SequenceMatcher(None, [c.lower() for c in text], [c.lower() for c in value]).find_longest_match()
    words = touched(text, block.a, block.a + block.size) if block.size else None
    if words is None:
        return None
    part = value[block.b : block.b + block.size]
    said = (part.lower().strip(), words.lower().strip(), value.lower().strip())
    if not said[0] or said[0] in COMMON_TERMS or any(x in STOP_WORDS for x in said):
        return None
    if said[1].endswith(said[0] + "'s"):
        score = 1.0
    else:
        score = likeness(said[2], said[1]) if said[2].lstrip(SEPARATORS)[:1] == said[1].lstrip(SEPARATORS)[:1] else 0.0
    if score < LEAST or (score < 1 and (value.isupper() or any(x in COMMON_WORDS for x in said))):
        return None
    return part, words, score, block.size


def _letters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def _keyed(kind: str, grams: Column) -> Column:
    return F.transform(grams, lambda g: F.struct(F.lit(kind).alias("kind"), g.alias("gram")))


def candidates(questions: DataFrame, values: DataFrame) -> DataFrame:
    """(qid, table, column, value): pairs of questions (qid, text) and values (table, column, value, stripped)
    that can be as like as asked for."""
    low = F.lower(F.trim("text"))
    before = F.array_distinct(F.transform(F.regexp_extract_all(low, F.lit(r"(?s).'s"), F.lit(0)), lambda x: F.left(x, F.lit(1))))
    asked = questions.select("qid", F.explode(F.concat(_keyed("pair", ngrams(low, 2)), _keyed("one", _letters(low)), _keyed("own", before))).alias("s")).select("qid", "s.kind", "s.gram")
    v = values.withColumn("low", F.lower("value")).filter("length(low) > 0").withColumn("pairs", ngrams(F.col("low"), 2))
    needed = F.greatest(F.lit(1), F.size("pairs") - F.floor(2 * 0.3 / 1.15 * F.length("low")).cast("int"))
    single = F.when(F.length("low") == 1, _keyed("one", _letters(F.col("low")))).otherwise(_keyed("own", _letters(F.col("low"))))
    # a value of one letter before 's is met by the letter itself
    offered = v.select("table", "column", "value", needed.alias("needed"), F.explode(F.concat(_keyed("pair", F.col("pairs")), single)).alias("s")).select("table", "column", "value", "needed", "s.kind", "s.gram")
    met = asked.join(offered, ["kind", "gram"]).groupBy("qid", "table", "column", "value").agg(F.count_if(F.col("kind") == "pair").alias("pairs"), F.count_if(F.col("kind") != "pair").alias("others"), F.max("needed").alias("needed"))
    return met.filter("others > 0 or pairs >= needed").select("qid", "table", "column", "value")


def bridge_matches(questions: DataFrame, values: DataFrame, top: int = TOP) -> DataFrame:
    """(qid, table, column, value, words, score, size, rank): the best values of each column for each question.
    Of values with the same matched part the last in order stands for all; a column whose name has "name" in
    it takes full matches alone."""
    stripped = values.select("table", "column", F.regexp_replace("value", r"^\s+|\s+$", "").alias("value")).distinct()
    pairs = candidates(questions, stripped).join(questions.select("qid", "text"), "qid")
    fields = ["qid", "table", "column", "value", "part", "words", "score", "size"]

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*key, *got) for *key, text in zip(b["qid"], b["table"], b["column"], b["value"], b["text"]) if (got := bridged(text, key[3]))]
            yield pd.DataFrame(rows, columns=fields)

    qid = questions.schema["qid"].dataType.simpleString()
    found = pairs.select("qid", "table", "column", "value", "text").mapInPandas(align, f"qid {qid}, table string, column string, value string, part string, words string, score double, size int")
    one = found.groupBy("qid", "table", "column", "part").agg(F.max(F.struct("value", "words", "score", "size")).alias("x"), F.min("value").alias("first"))
    kept = one.filter(~F.contains("column", F.lit("name")) | (F.col("x.score") >= 1))
    # as one double, in which full matches whose sizes differ by one may be equal; then the first value goes first
    weight = SCORE_WEIGHT * F.col("x.score") + WORDS_WEIGHT * F.col("x.score") + F.col("x.size")
    order = Window.partitionBy("qid", "table", "column").orderBy(F.desc(weight), "first")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("qid", "table", "column", "x.value", "x.words", "x.score", "x.size", "rank")
