"""Block search against all likenesses; the description index's recall and merging."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.operators import vector_index
from quillgraph.operators.vector_index import DescriptionIndex, Lists
from quillgraph.queries_values import letter_counts


def frames(spark, v, every=10):
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "id long, v array<double>, apart int")
    return df, df.filter(F.col("id") % every == 0).select(F.col("id").alias("qid"), F.col("v").alias("q"), "apart")


@pytest.mark.parametrize("measure", [vector_index.cosines, vector_index.nearness])
@pytest.mark.parametrize("apart", [True, False])
def test_search_equals_all_likenesses(spark, measure, apart, monkeypatch):
    """Many equal vectors, blocks much smaller than their number."""
    monkeypatch.setattr(vector_index, "BLOCK", 90)
    rng = np.random.default_rng(1)
    v = np.vstack([rng.standard_normal((150, 6)), np.tile(rng.standard_normal(6), (150, 1)), np.zeros((2, 6))])
    rows, queries = frames(spark, v)
    got = vector_index.search(rows if apart else rows.drop("apart"), queries, 7, measure=measure).collect()
    s = np.round(measure(v, v), 6)
    for q in range(0, len(v), 10):
        able = [i for i in range(len(v)) if i != q and (not apart or i % 3 != q % 3)]
        want = sorted(able, key=lambda i: (-s[q, i], i))[:7]
        mine = sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])
        assert [r["id"] for r in mine] == want and [r["score"] for r in mine] == [s[q, i] for i in want]


def test_search_above_a_limit(spark):
    v = np.random.default_rng(2).standard_normal((120, 4))
    rows, queries = frames(spark, v)
    got = {(r["qid"], r["id"]) for r in vector_index.search(rows, queries.drop("apart"), least=0.3).collect()}
    s = np.round(vector_index.cosines(v, v), 6)
    assert got == {(q, i) for q in range(0, 120, 10) for i in range(120) if i != q and s[q, i] >= 0.3}
    assert vector_index.search(rows.filter("false"), queries, 3).isEmpty()


@pytest.fixture(scope="module")
def described(spark, tmp_path_factory):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijklm"), rng.integers(3, 9))) for _ in range(200)]
    text = lambda: " ".join(rng.choice(words, rng.integers(1, 4)))
    rows = [(f"t{i % 9}", f"c{i}", text(), text() if i % 2 else "", None if i % 3 else text()) for i in range(700)]
    df = spark.createDataFrame(rows, "table string, column string, column_name string, column_description string, value_description string")
    path = str(tmp_path_factory.mktemp("d") / "index")
    return rows, DescriptionIndex(spark, path, letter_counts, Lists(8, 3)).build(df), path


def test_every_text_has_an_entry(spark, described):
    rows, _, path = described
    want = {(t, c, x) for t, c, *texts in rows for x in texts if x}
    entries = spark.read.parquet(f"{path}/entries")
    assert {(r["table"], r["column"], r["content"]) for r in entries.collect()} == want and entries.select("list").distinct().count() > 4


def test_recall_of_some_lists_and_of_all(spark, described):
    rows, index, path = described
    entries = spark.read.parquet(f"{path}/entries").select("entry", "vector").collect()
    v = np.array([r["vector"] for r in entries])
    ids = np.array([r["entry"] for r in entries])
    queries = spark.createDataFrame([(i, v[i].tolist()) for i in range(0, len(v), 9)], "qid long, q array<double>")
    s = np.round(v @ v.T, 6)
    for probes, least in ((3, 0.9), (None, 1.0)):
        again = DescriptionIndex(spark, path, letter_counts, Lists(8, probes))
        got = again.probe(queries, 10).collect()
        hit = total = 0
        for i in range(0, len(v), 9):
            mine = {r["entry"] for r in got if r["qid"] == i}
            want = ids[np.lexsort((ids, -s[i]))[:10]].tolist()
            hit, total = hit + len(mine & set(want)), total + 10
        assert hit >= least * total


def test_two_probes_merge_by_the_better(spark, described):
    rows, _, path = described
    index = DescriptionIndex(spark, path, letter_counts, Lists(8, None))
    asked = [(1, "abc def", "mmm", "kll"), (2, "a", "a", "b"), (3, None, "jjj", "k")]
    got = {(r["qid"], r["table"], r["column"]): r["score"] for r in index.similar_columns(spark.createDataFrame(asked, "qid long, question string, evidence string, keyword string"), None, 0.6).collect()}
    want = {}
    for qid, q, e, k in asked:
        for t, c, *texts in rows:
            for x in filter(None, texts):
                for said in (q, e):
                    score = round(float(np.dot(*letter_counts([" ".join(filter(None, (said, k))), x]))), 6)
                    if score >= 0.6:
                        want[qid, t, c] = max(score, want.get((qid, t, c), 0))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)
