"""A hot shingle's largest component isn't sent to its blocks; every pair of different components still meets."""

import pytest
from pyspark.sql import functions as F

from quillgraph.llm import near_dup


@pytest.mark.parametrize("large, others", [(3000, 10), (40, 30), (700, 600)])
def test_rows_sent_grow_with_the_others(spark, large, others):
    rows = [(1, d, 0 if d < large else 1 + d % 7, 8, 0) for d in range(large + others)]
    heads = spark.createDataFrame(rows, "shingle long, d long, c long, n long, at long")
    placed, sent = near_dup._dealt(heads, 75)
    up = lambda n: -(-n // near_dup.BLOCK)
    hot = large + others > near_dup.BLOCK
    assert placed.count() == large + others
    assert sent.count() == (others * (up(large) + up(others)) if hot else large + others)
    met = placed.join(sent, ["shingle", "major", "block"]).filter("c_a <> c_b and (major or d_a < d_b)").select(F.least("d_a", "d_b").alias("a"), F.greatest("d_a", "d_b").alias("b"))
    want = large * others + sum(x[2] != y[2] for i, x in enumerate(rows[large:]) for y in rows[large + i :])
    assert met.count() == met.distinct().count() == want
