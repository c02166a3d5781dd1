"""Shared folder handling for operators that cut lineage with a written table."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import checkpoint_dir


class Scratch:
    """Tables of one operator call in the cluster's shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        """Writes df once and returns the written table; later reads don't compute df again."""
        df.write.mode("overwrite").option("compression", codec).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(name))
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def map_with_ids(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, *ids: str) -> DataFrame:
    """mapInPandas in which the long columns `ids` cross as text: pandas makes doubles of a batch's whole
    numbers that stand beside a null, and so loses the digits of large ids."""
    text = schema
    for c in ids:
        text = text.replace(f"{c} long", f"{c} string")
    out = df.withColumns({c: F.col(c).cast("string") for c in ids if c in df.columns}).mapInPandas(work, text)
    return out.withColumns({c: F.col(c).cast("long") for c in ids})


@contextmanager
def conf(spark: SparkSession, **values: str) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
