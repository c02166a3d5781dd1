"""The persistent value index: additions, another session, recall, broken additions; entities like keywords."""

import difflib
import random

import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quillgraph.operators.linking import search_values
from quillgraph.operators.value_index import IndexSettings, ValueIndex, band_keys, similar_entities
from quillgraph.queries_values import letter_counts


def grams(text, n=3):
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def similarity(a, b, n=3):
    x, y = grams(a, n), grams(b, n)
    return len(x & y) / len(x | y) if x | y else 0.0


@pytest.fixture(scope="module")
def values():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrst") for _ in range(rnd.randint(4, 9))) for _ in range(60)]
    texts = sorted({" ".join(rnd.choices(words, k=rnd.randint(1, 4))) for _ in range(400)})
    return [("t" if i % 3 else "u", "c" if i % 2 else "d", x) for i, x in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "table string, column string, value string")


def changed(rnd, text):
    at = rnd.randrange(len(text))
    return text[:at] + rnd.choice("xyz") + text[at + 1 :]


def test_recall_after_additions_and_reopening(spark, values, tmp_path):
    path = str(tmp_path / "index")
    index = ValueIndex.create(spark, path, IndexSettings(buckets=4))
    index.add(frame(spark, values[:150]))
    index.add(frame(spark, [*values[100:], ("t", "c", None), values[200], values[200], ("t", "c", "ab"), ("t", "c", "")]))
    index.close()
    other = spark.newSession()
    again = ValueIndex.open(other, path)
    assert again.settings == IndexSettings(buckets=4)
    stored = other.table(again.values)
    assert stored.count() == len(values) + 2 == stored.distinct().count()
    rnd = random.Random(1)
    keywords = [(i, changed(rnd, v)) for i, (_, _, v) in enumerate(values)]
    got = {(r["kid"], r["table"], r["column"], r["value"]): r["score"] for r in again.probe(other.createDataFrame(keywords, "kid long, keyword string"), 1000, 0.4).collect()}
    want = {(i, *v): similarity(k, v[2]) for i, k in keywords for v in values if round(similarity(k, v[2]), 6) >= 0.4}
    assert got.keys() <= want.keys() and len(got) >= 0.99 * len(want) and len(want) > len(values) / 2
    assert all(abs(s - want[k]) < 1e-6 for k, s in got.items())
    again.close()


def test_probe_ranks_and_cuts(spark, values, tmp_path):
    index = ValueIndex.create(spark, str(tmp_path / "index"))
    index.add(frame(spark, values))
    asked = spark.createDataFrame([("a", values[5][2]), ("b", "zz"), ("c", None), ("d", ""), ("e", values[9][2])], "kid string, keyword string")
    got = index.probe(asked, 3).collect()
    assert {r["kid"] for r in got} == {"a", "e"} and all(r["place"] <= 3 for r in got)
    first = {r["kid"]: (r["value"], r["score"]) for r in got if r["place"] == 1}
    assert first == {"a": (values[5][2], 1.0), "e": (values[9][2], 1.0)}
    for kid in "ae":
        ranked = [r["score"] for r in sorted((r for r in got if r["kid"] == kid), key=lambda r: r["place"])]
        assert ranked == sorted(ranked, reverse=True)
    index.close()


def test_a_probe_moves_no_index(spark, values, tmp_path):
    """Keys are read bucket by bucket; only the keywords' side is exchanged where neither side is small."""
    index = ValueIndex.create(spark, str(tmp_path / "index"))
    index.add(frame(spark, values))
    asked = spark.createDataFrame([(1, "abc def")], "kid long, keyword string").select("kid", F.explode(band_keys(F.col("keyword"), index.settings)).alias("key"))
    plan = asked.hint("merge").join(spark.table(index.keys), "key")._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1
    index.close()


def test_broken_addition_is_mended(spark, values, tmp_path):
    """Keys whose values were never written are invisible, and the values can be added again."""
    index = ValueIndex.create(spark, str(tmp_path / "index"))
    index.add(frame(spark, values[:50]))
    at = F.unhex(F.md5(F.to_json(F.array("table", "column", "value"))))
    lost = frame(spark, values[50:60]).select(F.explode(band_keys(F.col("value"), index.settings)).alias("key"), at.alias("id"))
    lost.write.insertInto(index.keys)
    spark.catalog.refreshTable(index.keys)
    asked = spark.createDataFrame([(1, values[55][2])], "kid long, keyword string")
    assert values[55][2] not in {r["value"] for r in index.probe(asked, 100).collect()}
    index.add(frame(spark, values[50:60]))
    found = [r["value"] for r in index.probe(asked, 100).collect() if r["value"] == values[55][2]]
    assert found == [values[55][2]]
    index.close()


def test_an_index_is_not_overwritten(spark, tmp_path):
    path = str(tmp_path / "index")
    ValueIndex.create(spark, path).close()
    with pytest.raises(AnalysisException):
        ValueIndex.create(spark, path)


def test_entities_equal_brute_force(spark, values, tmp_path):
    index = ValueIndex.create(spark, str(tmp_path / "index"), IndexSettings(bands=128, rows=1))
    index.add(frame(spark, values))
    rnd = random.Random(3)
    keywords = [(i % 7, f"{changed(rnd, v)}" if i % 2 else f"name = {v}") for i, (_, _, v) in enumerate(rnd.sample(values, 25))]
    asked = spark.createDataFrame(keywords, "question long, keyword string")
    got = {(r["question"], r["table"], r["column"], r["value"]): (r["edit"], r["embedding"]) for r in similar_entities(index, asked, letter_counts).collect()}
    pieces = {(r["question"], r["piece"]) for r in search_values(asked).collect()}
    met = {}
    for q, p in pieces:
        hits = sorted(((-round(similarity(p, v[2]), 6), v) for v in values if grams(p) & grams(v[2])))[:10]
        for _, v in hits:
            ratio = difflib.SequenceMatcher(None, p.lower(), v[2].lower()).ratio()
            cosine = float(np.dot(*letter_counts([p, v[2]])))
            if ratio >= 0.3 and cosine >= 0.6:
                met.setdefault((q, v[0], v[1]), []).append((v[2], ratio, cosine))
    want = {}
    for k, rows in met.items():
        best = max(r for _, r, _ in rows)
        rows = [x for x in rows if x[1] >= 0.9 * best]
        best = max(c for _, _, c in rows)
        for value in {x[0] for x in rows if x[2] >= 0.9 * best}:
            kept = [x for x in rows if x[0] == value and x[2] >= 0.9 * best]
            want[(*k, value)] = (max(x[1] for x in kept), max(x[2] for x in kept))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in got)
    index.close()
