"""SQL text: clean-ups, normal forms, dialects and small renderings, all column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that names of metadata entities leave out. Fixed values of common English.
STOP_WORDS = ("the", "a", "an", "of", "in", "on", "for", "to", "and", "or", "is", "are", "with", "by")


def first_statement(sql: Column) -> Column:
    return F.trim(F.split_part(sql, F.lit(";"), F.lit(1)))


def joined_signs(sql: Column) -> Column:
    """Comparison signs with a space inside are joined."""
    return F.regexp_replace(sql, r"([<>!])\s+=", "$1=")


def without_comment(sql: Column) -> Column:
    """What stands before the first block comment."""
    return F.trim(F.split_part(sql, F.lit("/*"), F.lit(1)))


def without_distinct(sql: Column) -> Column:
    return F.regexp_replace(sql, r"(?i)\bdistinct\s+", "")


def normalize(sql: Column) -> Column:
    """The first statement with single quotes, one space between words, and lower case outside quotes."""
    flat = F.regexp_replace(F.replace(joined_signs(first_statement(sql)), F.lit('"'), F.lit("'")), r"\s+", " ")
    pieces = F.transform(F.split(flat, "'"), lambda x, i: F.when(i % 2 == 0, F.lower(x)).otherwise(x))
    return F.trim(F.array_join(pieces, "'"))


def dialect(name: Column) -> Column:
    """The back-end of a task by its id's beginning."""
    return F.when(name.startswith("bq") | name.startswith("ga"), "bigquery").when(name.startswith("local"), "local").otherwise("snowflake")


def truncated(text: Column, most: int, notice: str) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit(notice))).otherwise(text)


def percent(share: Column, digits: int = 2) -> Column:
    return F.format_string(f"%.{digits}f%%", share * 100)


def is_number(text: Column) -> Column:
    return text.try_cast("double").isNotNull()


def has_special(name: Column) -> Column:
    return name.rlike("[^A-Za-z0-9_]")


def unquoted(text: Column) -> Column:
    """Without one pair of quotes or back ticks around."""
    return F.regexp_replace(F.trim(text), r"(?s)^(['\"`])(.*)\1$", "$2")


def short_name(text: Column, most: int = 4, least: int = 2, otherwise: str = "metadata_entity") -> Column:
    """Dotted names in lower case; of others the first words that aren't stop words or short, joined by _."""
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\w\s]", " ")), r"\s+")
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) > least))
    name = F.array_join(F.slice(kept, 1, most), "_")
    return F.when(text.rlike(r"^\S+\.\S+$"), F.lower(text)).when(name == "", F.lit(otherwise)).otherwise(name)


def action(text: Column, name: str) -> Column:
    """The argument of Name(...) in an agent's reply, over lines; empty if there is none."""
    return F.regexp_extract(text, rf"(?s)\b{re.escape(name)}\((.*)\)", 1)


def split_definitions(rows: DataFrame, ddl: str = "ddl") -> DataFrame:
    """rows with definitions: what stands between a statement's outer parentheses, cut at commas outside others."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                parts, depth, at = [], 0, None
                for i, c in enumerate(t or ""):
                    if c == "(":
                        depth += 1
                        if depth == 1:
                            at = i + 1
                    elif c == ")":
                        if depth == 1:
                            parts.append(t[at:i].strip())
                            break
                        depth -= 1
                    elif c == "," and depth == 1:
                        parts.append(t[at:i].strip())
                        at = i + 1
                out.append([p for p in parts if p])
            yield pd.Series(out)

    return rows.withColumn("definitions", F.pandas_udf(work, "array<string>")(ddl))


def parenthesis_spans(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with spans: array of (start, end) of all balanced parentheses, inner ones first."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                opened, found = [], []
                for i, c in enumerate(t or ""):
                    if c == "(":
                        opened.append(i)
                    elif c == ")" and opened:
                        found.append({"start": opened.pop(), "end": i + 1})
                out.append(found)
            yield pd.Series(out)

    return rows.withColumn("spans", F.pandas_udf(work, "array<struct<start:int,end:int>>")(text))


def unicode_decoded(text: Column) -> Column:
    r"""\uXXXX escapes as their characters, one by one from the left."""
    parts = F.split(text, r"(?=\\u[0-9a-fA-F]{4})")
    char = lambda x: F.decode(F.unhex(F.substr(x, F.lit(3), F.lit(4))), "UTF-16BE")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\\u[0-9a-fA-F]{4}"), F.concat(char(x), F.substr(x, F.lit(7)))).otherwise(x)), "")
