"""Reading model output: JSON bodies, tagged blocks, weights, lists and verdicts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def json_body(text: Column) -> Column:
    """From the first brace to the last, without line breaks, single quotes made double; null without one."""
    body = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(body != "", F.replace(F.regexp_replace(body, r"[\r\n]", ""), F.lit("'"), F.lit('"')))


def fenced(text: Column, language: str = "json") -> Column:
    """What stands in the first fence of the language, or in any fence, or the text itself."""
    own = F.regexp_extract(text, rf"(?s)```{language}\s*(.*?)```", 1)
    any_ = F.regexp_extract(text, r"(?s)```\w*\s*(.*?)```", 1)
    return stripped(F.when(own != "", own).when(any_ != "", any_).otherwise(text))


def keywords(text: Column) -> tuple[Column, Column]:
    """(low, high) keywords joined by ', '; null where the text has no such JSON or no words."""
    got = F.from_json(json_body(text), "low_level_keywords array<string>, high_level_keywords array<string>")
    join = lambda k: F.when(F.size(got[k]) > 0, F.array_join(got[k], ", "))
    return join("low_level_keywords"), join("high_level_keywords")


def sub_queries(text: Column) -> Column:
    """array<struct<query, source, target>>: of the JSON array in the text, or the text as one query of its own."""
    parsed = F.from_json(F.regexp_extract(text, r"(?s)\[.*\]", 0), "array<struct<query:string,source:string,target:string>>")
    whole = F.array(F.struct(stripped(text).alias("query"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("target")))
    return F.when(F.size(F.filter(parsed, lambda x: x["query"].isNotNull())) > 0, parsed).otherwise(whole)


def tagged(text: Column, tag: str) -> Column:
    """The trimmed contents of all <TAG> blocks."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), stripped)


def weights(text: Column, default: tuple[float, ...]) -> Column:
    """As many numbers as default has, rescaled to a sum of one, if they nearly have it; else default."""
    raw = F.transform(F.split(text, r"[,\s]+"), lambda x: x.try_cast("double"))
    numbers = F.filter(raw, lambda x: x.isNotNull())
    total = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x)
    fit = (F.size(numbers) == len(default)) & (F.abs(total - 1) < 0.1)
    return F.when(fit, F.transform(numbers, lambda x: x / total)).otherwise(F.array(*[F.lit(x) for x in default]))


def listed(text: Column) -> Column:
    """Items of the first bracketed list, without quotes and blanks."""
    inner = F.regexp_extract(text, r"(?s)\[(.*?)\]", 1)
    return F.filter(F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", "")), lambda x: x != "")


def verdict(text: Column) -> Column:
    """True for a yes in a JSON answer or as the first word, false for a no, else null."""
    said = F.lower(F.coalesce(F.get_json_object(json_body(text), "$.is_column_information_relevant"), F.regexp_extract(F.trim(text), r"^\W*(\w+)", 1)))
    return F.when(said == "yes", True).when(said == "no", False)


def sql_answer(text: Column) -> Column:
    """The SQL of a reply: of its JSON, of a fence, or from the first SELECT or WITH on."""
    got = F.get_json_object(F.regexp_extract(text, r"(?s)\{.*\}", 0), "$.SQL")
    in_fence = F.regexp_extract(text, r"(?s)```(?:sql)?\s*(.*?)```", 1)
    plain = F.regexp_extract(text, r"(?is)\b((?:SELECT|WITH)\b.*)$", 1)
    return stripped(F.coalesce(got, F.when(in_fence != "", in_fence), F.when(plain != "", plain), text))


def scores(text: Column) -> Column:
    """array<struct<candidate int, score double>> of lines like 'Candidate Response #2: [[0.5]]'."""
    found = F.regexp_extract_all(text, F.lit(r"#\d+:\s*\[\[?\s*[-0-9.]+"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"#(\d+)", 1).cast("int").alias("candidate"), F.regexp_extract(x, r"([-0-9.]+)$", 1).try_cast("double").alias("score")))


def cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Price of a call, prices being for a thousand tokens."""
    return tokens_in / 1000 * price_in + tokens_out / 1000 * price_out
