"""Embedding texts in batches inside tasks, with retries that halve a batch, and keeping what is known."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Length of the vector that stands for a text that can't be embedded. Fixed value.
FAILED = 1536

Embedder = Callable[[list[str]], np.ndarray]


def embedded_batch(texts: list[str], embedder: Embedder, failed: int = FAILED) -> list[list[float]]:
    """Vectors of texts; a batch that fails is tried by halves, and a single text that fails is zero."""
    if not texts:
        return []
    try:
        return [list(map(float, v)) for v in embedder(texts)]
    except Exception:  # whatever the service raises
        if len(texts) == 1:
            return [[0.0] * failed]
    half = len(texts) // 2
    return embedded_batch(texts[:half], embedder, failed) + embedded_batch(texts[half:], embedder, failed)


def embed(rows: DataFrame, embedder: Embedder, content: str = "content", vector: str = "vector", batch: int = 32, failed: int = FAILED) -> DataFrame:
    """rows with vectors of their contents; null counts as empty."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            known = [t if isinstance(t, str) else "" for t in texts]
            yield pd.Series([v for a in range(0, len(known), batch) for v in embedded_batch(known[a : a + batch], embedder, failed)], dtype=object)

    return rows.withColumn(vector, F.pandas_udf(work, "array<double>").asNondeterministic()(content))


def embed_missing(rows: DataFrame, kept: DataFrame, embedder: Embedder) -> DataFrame:
    """(id, content, vector): vectors of kept (id, content, vector) where the content is the same, made for the others."""
    known = rows.join(kept.select("id", "content", "vector"), ["id", "content"])
    fresh = rows.join(kept.select("id", "content"), ["id", "content"], "left_anti")
    return known.select("id", "content", "vector").union(embed(fresh, embedder).select("id", "content", "vector"))


def dequantize(codes: Column, low: Column, high: Column, bits: int = 8) -> Column:
    """Values behind codes between the vector's extremes."""
    step = (high - low) / (2**bits - 1)
    return F.transform(codes, lambda x: x * step + low)
