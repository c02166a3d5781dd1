"""The corpus pipeline: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) with the columns of documents and works on all rows its
predecessor kept. Quality rules and toxicity drop documents and the lines that quality rules found
to be boilerplate; of near-duplicates the one with the smallest doc_id stays; personal data is
masked; packing returns the pieces of all remaining documents. n_chars follows the text.

Defined results: null and empty texts have no words and fail the quality rules, so no later stage sees
them; texts of any length go through every stage whole; rows of one id are judged each, but as
near-duplicates an id goes or stays with all its rows; a null doc_id is judged like any other and is no
near-duplicate of anything; of documents that are alike the smallest id stays; other columns, whatever
their names, are left out; empty tables give no rows, and without labels no document is toxic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import near_dup, packing, pii, quality, toxicity
from quillgraph.llm.shared import Scratch
from quillgraph.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select("doc_id", F.col(text).alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(quality.quality(docs.select(*COLUMNS)).filter("kept"), "clean_text")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    training = ~toxicity.held_out(F.col("doc_id"))
    scored = toxicity.with_toxicity(docs.select(*COLUMNS), table(spark, sf_dir, "labels"), training)
    return scored.filter("toxicity.predicted = 0").select(*COLUMNS)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = near_dup.near_duplicates(docs.select("doc_id", "text")).filter("not kept").select("doc_id")
    return docs.select(*COLUMNS).join(gone, "doc_id", "left_anti")


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _documents(pii.mask(pii.detect(docs.select(*COLUMNS))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_dup", near_dup_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: Training, restoring and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
