"""Incremental ingestion: each micro-batch inserts documents and chunks that aren't stored yet.

Ids come from contents, so a batch that runs again after a failure inserts nothing twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillgraph.functions.columns import content_id
from quillgraph.operators.text import chunks
from quillgraph.session import checkpoint_dir
from quillgraph.sources.store import KeyValueTable


def ingest_batch(docs: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(new documents, new chunks) of docs (text)."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    whole = docs.filter("text is not null").select(content_id("doc-", F.trim("text")).alias("id"), "text")
    new = KeyValueTable(spark, f"{root}/documents", "id string, text string").insert_if_absent(whole)
    cut = chunks(new.withColumnRenamed("id", "doc_id")).select(F.col("chunk_id").alias("id"), "full_doc_id", "chunk_order_index", "tokens", "content")
    made = KeyValueTable(spark, f"{root}/chunks", "id string, full_doc_id string, chunk_order_index int, tokens int, content string").insert_if_absent(cut)
    return new, made


def ingest_stream(spark: SparkSession, source: str, schema: str, root: str) -> StreamingQuery:
    """Follows a folder of Parquet files of documents until none is new."""
    rows = spark.readStream.schema(schema).parquet(source)
    return rows.writeStream.foreachBatch(lambda df, _: ingest_batch(df, root)).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
