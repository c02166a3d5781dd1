"""Time limits, tokenizers, and orders over ranges."""

import random
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import ordered, running, tokens

ENDLESS = "SELECT count(*) FROM range(0, 1000000000000000, 1, 2) WHERE hash(id) = 1 AND id % 7 = 9"


def test_endless_statement_is_cancelled_and_others_run(spark):
    began = time.time()
    asked = [(1, "SELECT id FROM range(50)"), (2, ENDLESS), (3, "SELECT nothing FROM range(3)"), (4, "SELECT 1 WHERE false"), (5, "SELEC"), (6, "SELECT sum(id) FROM range(100)")]
    found = running.run_all(spark, asked, (8.0, 9.0), workers=6)
    assert [(o.id, o.status, len(o.rows)) for o in found] == [(1, running.CORRECT, 30), (2, running.TIMEOUT, 0), (3, running.WRONG, 0), (4, running.EMPTY, 0), (5, running.WRONG, 0), (6, running.CORRECT, 1)]
    assert found[1].tries == 2 and found[2].message and time.time() - began < 60
    assert spark.sparkContext.statusTracker().getActiveJobsIds() == []  # nothing goes on behind
    assert running.run(spark, 7, "SELECT 1").status == running.CORRECT


@pytest.fixture(scope="module")
def file_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tokenizers")
    return tokens.FileTokenizer(public.path("byte_bpe_50k.json"))


TEXTS = ["", None, "one two  three", "Ünï 😀 it's\n\nx", " lead and trail ", "word " * 500]


def test_ids_counts_and_text_again(spark, file_tokenizer):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for made in (file_tokenizer, tokens.CodePoints()):
        ids = tokens.token_ids(F.col("text"), made)
        got = df.select("text", ids.alias("ids"), tokens.token_count(F.col("text"), made).alias("n")).withColumn("again", tokens.token_text(F.col("ids"), made)).collect()
        want = made.encode([t or "" for t in TEXTS])
        assert [(r["ids"], r["n"], r["again"]) for r in got] == [(w, len(w), t or "") for w, t in zip(want, TEXTS)]


@pytest.mark.parametrize("most, overlap", [(7, 2), (3, 0), (1000, 10)])
def test_chunks_are_windows_of_tokens(spark, file_tokenizer, most, overlap):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {(r["full_doc_id"], r["chunk_order_index"]): (r["start"], r["tokens"], r["content"]) for r in tokens.token_chunks(df, file_tokenizer, most, overlap).collect()}
    want = {}
    for d, ids in enumerate(file_tokenizer.encode([t or "" for t in TEXTS])):
        for k, a in enumerate(range(0, len(ids), most - overlap)):
            part = ids[a : a + most]
            want[d, k] = (a, len(part), file_tokenizer.decode([part])[0].strip())
    assert got == want
    with pytest.raises(ValueError, match="overlap"):
        tokens.token_chunks(df, file_tokenizer, 5, 5)


def test_numbers_and_sums_over_ranges(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(40), i, None if i % 50 == 0 else rnd.randrange(9)) for i in range(2000)]
    df = spark.createDataFrame(rows, "a int, b int, v int").repartition(7)
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    got = ordered.numbered(df, [F.desc("a"), "b"], "n").collect()
    assert sorted((r["n"], r["a"], r["b"]) for r in got) == [(i + 1, a, b) for i, (a, b, _) in enumerate(want)]
    total, sums = 0, {}
    for a, b, v in want:
        total += v or 0
        sums[b] = total
    assert {r["b"]: r["s"] for r in ordered.running(df, [F.desc("a"), "b"], "v", "s").collect()} == sums
    assert ordered.numbered(df.filter("false"), ["a"], "n").isEmpty() and ordered.running(df.filter("false"), ["a"], "v", "s").isEmpty()
