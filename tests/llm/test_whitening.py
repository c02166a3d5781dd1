"""Whitening against the covariance computed whole, in exact fractions where results are exact."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import catalog, whitening


def held_to(rows, got, most=8):
    """rows: (vec_id, vector) that take part; got: collected rows."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    c = np.array([[float(Fraction(n * r[j] - total[j], n)) for j in range(d)] for r in x])
    v = c.T @ c / n
    values = np.linalg.eigvalsh(v)[::-1]
    keep = min(most, int((values > 1e-12 * values[0]).sum()))
    assert {r["n"] for r in got} == {n} and len(got) == n * keep
    assert {r["component"] for r in got} == set(range(1, keep + 1))
    (error,) = {r["identity_error"] for r in got}
    assert error <= 1e-4
    deviation = sorted((i, sum((n * r[j] - total[j]) ** 2 for j in range(d))) for (i, _), r in zip(rows, x))
    assert sorted((r["vec_id"], r["deviation"]) for r in got if r["component"] == 1) == deviation
    for k in range(1, keep + 1):
        (share,) = {r["explained"] for r in got if r["component"] == k}
        assert share == pytest.approx(values[k - 1] / np.trace(v), rel=1e-6)
    w = np.array([[r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == k] for k in range(1, keep + 1)]).T
    assert np.abs(w.T @ w / n - np.eye(keep)).max() <= 1e-6  # of the fit list, whose mean is 0
    c = c[np.argsort([i for i, _ in rows], kind="stable")]
    axes = c.T @ w / n / np.sqrt(values[:keep])  # w = c a / sqrt(e), so c'w / n = a sqrt(e)
    assert np.abs(np.linalg.norm(axes, axis=0) - 1).max() <= 1e-6
    assert np.abs(v @ axes - axes * values[:keep]).max() <= 1e-6 * values[0]
    assert np.abs(w - c @ axes / np.sqrt(values[:keep])).max() <= 1e-6 * np.abs(w).max()


def frame(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    return df.withColumns({x: F.lit(9) for x in ("component", "n", "deviation", "whitened", "explained", "identity_error", "x", "v")})


def test_query_equals_plain_version(spark):
    got = catalog.QUERIES["op13_whitening"](spark, "/root/testdata/sf0.01")
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()
    held_to([(r["vec_id"], r["embedding"]) for r in rows], got.collect())


def test_odd_rows(spark):
    """Null, broken and other lengths go; zeros, repeats and uneven scales stay."""
    rng = np.random.default_rng(0)
    rows = [(i, (rng.standard_normal(12) * 3.0 ** np.arange(12) / 700 + 5).tolist()) for i in range(200)] + [(300, [0.0] * 12), (2**53 + 1, [1.0] * 12), (2**53 + 3, [1.0] * 12)]
    odd = [(400, None), (401, []), (402, [1.0] * 11 + [None]), (403, [float("nan")] * 12), (404, [float("inf")] * 12), (405, [1.0] * 5)]
    held_to(rows, whitening.whiten(frame(spark, rows + odd)).collect())


def test_null_ids_stay(spark):
    rng = np.random.default_rng(1)
    rows = [(i if i % 3 else None, rng.standard_normal(4).tolist()) for i in range(60)] + [(2**53 + 1, [0.5] * 4)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert len(got) == 61 * 4 and sum(r["vec_id"] is None for r in got) == 80 and any(r["vec_id"] == 2**53 + 1 for r in got)


def test_few_dimensions_and_flat_ones(spark):
    """No more components than have variance."""
    rows = [(i, [float(i), 2.0 * i, 7.0, float(i * i % 17)]) for i in range(50)]
    held_to(rows, whitening.whiten(frame(spark, rows)).collect())
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).collect() == []
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])])).collect() == []


def test_large_entries(spark):
    """Beyond 2^52 entries are cut, and a deviation that no long holds is null."""
    rows = [(i, [float(i), -1e300 if i == 3 else 1.0]) for i in range(9)]
    got = whitening.whiten(frame(spark, rows)).collect()
    assert {r["deviation"] for r in got} == {None} and all(np.isfinite(r["whitened"]) for r in got)
    rows = [(i, [7e4 * i, 0.0]) for i in range(9)]
    held_to(rows, whitening.whiten(frame(spark, rows)).collect())


def test_empty_table(spark):
    assert whitening.whiten(frame(spark, [])).collect() == []
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
