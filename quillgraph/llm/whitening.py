"""Whitening of embeddings by the eigenvectors of their covariance.

Components become whole numbers, floor(1024 * c) + 100000, so that their sums by dimension are exact.
Rows are centred exactly by them: x - S div n is a whole number and only S mod n / n is rounded. The
Gramian of the centred rows, added up over tasks by Spark's RowMatrix, divided by n is the covariance;
its eigenvectors, over the roots of their eigenvalues, are the whitening, which the driver computes
and broadcasts. Both are as large as the square of the vectors' length, never as the rows. The
whitened rows are written once and their own covariance measured in the same way.

Defined results: rows whose vector is null or empty, holds null or non-finite entries or isn't of the
most frequent length (the shorter, if several are) are dropped; zero vectors remain, as do repeated
rows, each a row of the fit list, and rows of a null vec_id, which stays null; components whose
variance is no more than rounding (RANK of the largest eigenvalue) are left out, so vectors that are
all alike give no rows; scaled entries beyond 2^52 count as 2^52; a deviation beyond the range of
long is null; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import Scratch, map_with_ids

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
RANK = 1e-12
#: Sums are added in two parts, so that no number of rows below 2^32 makes them overflow.
_LOW = 30


def scaled(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    limit = float(1 << 52)
    whole = F.transform(v, lambda c: F.floor(F.greatest(F.lit(-limit), F.least(F.lit(limit), c * SCALE))).cast("long") + SHIFT)
    return vectors.filter(good).select(F.col("vec_id").cast("long"), whole.alias("x"))


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """(number of rows, exact sum of each dimension)."""
    parts = rows.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(
        F.count("*").alias("n"), F.sum(F.shiftright("c", _LOW)).alias("high"), F.sum(F.col("c").bitwiseAND((1 << _LOW) - 1)).alias("low")
    )
    got = sorted(parts.collect())  # a row a dimension
    return (got[0]["n"] if got else 0), [(r["high"] << _LOW) + r["low"] for r in got]


def centred(x: Column, n: int, total: list[int]) -> Column:
    """x - total / n, of which only the remainder's share is rounded."""
    whole, rest = F.array(*[F.lit(s // n) for s in total]), F.array(*[F.lit((s % n) / n) for s in total])
    return F.zip_with(F.zip_with(x, whole, lambda a, b: (a - b).cast("double")), rest, lambda a, b: a - b)


def covariance(rows: DataFrame, column: str, n: int) -> np.ndarray:
    """Of a column of centred array<double>."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors).computeGramianMatrix().toArray() / n


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors (vec_id, embedding) as vec_id, component, n, deviation, whitened, explained, identity_error."""
    scratch = Scratch(vectors.sparkSession, "whitening")
    rows = scratch.write(scaled(vectors), "scaled")
    most = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most:
        rows = rows.filter(F.size("x") == most["d"])
    n, total = sums(rows)
    empty = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not n:
        return vectors.sparkSession.createDataFrame([], empty)
    v = covariance(rows.select(centred(F.col("x"), n, total).alias("c")), "c", n)
    values, axes = np.linalg.eigh((v + v.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    keep = min(components, int((values > RANK * values[0]).sum())) if values[0] > 0 else 0
    if not keep:
        return vectors.sparkSession.createDataFrame([], empty)
    explained = values[:keep] / np.trace(v)
    whitening = vectors.sparkSession.sparkContext.broadcast((axes[:, :keep] / np.sqrt(values[:keep]), total))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matrix, s = whitening.value
        whole = np.array([a // n for a in s])
        rest = np.array([a % n for a in s])
        for b in batches:
            if not len(b):
                continue
            x = np.array(b["x"].tolist()) - whole
            yield pd.DataFrame({"vec_id": b["vec_id"], "deviation": pd.array(_deviations(x, rest, n), "Int64"), "whitened": list((x - rest / n) @ matrix)})

    made = scratch.write(map_with_ids(rows, work, "vec_id long, deviation long, whitened array<double>", "vec_id"), "whitened")
    scratch.drop("scaled")
    mean = made.agg(*[F.avg(F.get("whitened", F.lit(k))) for k in range(keep)]).head()
    again = covariance(made.select(F.zip_with("whitened", F.array(*map(F.lit, mean)), lambda a, b: a - b).alias("c")), "c", n)
    error = float(np.abs(again - np.eye(keep)).max())
    share = F.element_at(F.array(*[F.lit(float(e)) for e in explained]), F.col("component"))
    wide = made.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened")).withColumn("component", F.col("k") + 1)
    return wide.select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def _deviations(x: np.ndarray, rest: np.ndarray, n: int) -> list:
    """Exact sums of (n * x - rest)^2 by row, beyond the range of long null."""
    largest = n * (int(np.abs(x).max()) + 1)
    y = x if largest**2 * x.shape[1] < 1 << 63 else x.astype(object)
    return [d if d < 1 << 63 else None for d in ((y * n - rest) ** 2).sum(1).tolist()]
