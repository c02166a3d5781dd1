"""Large ids beside nulls keep their digits; equal scores go to the smaller id."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import ann, bpe, chat, near_dup, packing, token_files, toxicity

LARGE = [2**53 + 1, 2**53 + 3, None, -(2**53) - 1, 2**63 - 1]


@pytest.fixture(scope="module")
def docs(spark):
    words = "one two three four five six seven eight nine ten".split()
    rows = [(d, " ".join(words[i:] + words[:i])) for i, d in enumerate(LARGE)]
    return spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)


def ids(df, column="doc_id"):
    return sorted({r[column] for r in df.collect()}, key=str)


def test_ids_beside_nulls(spark, docs, tmp_path):
    want = sorted(LARGE, key=str)
    assert ids(bpe.round_trip(docs)) == want
    assert ids(near_dup.near_duplicates(docs)) == want
    assert ids(packing.pack_documents(docs)) == want
    token_files.write_tokens(docs, str(tmp_path))
    assert ids(token_files.read_tokens(spark, str(tmp_path))) == want


def test_conversation_ids_beside_nulls(spark):
    turns = spark.createDataFrame([(d, t, "user", "x") for d in LARGE for t in (2**60 + 1, None, 1)], "conv_id long, turn long, role string, text string").coalesce(1)
    formatted = chat.format_conversations(turns)
    assert ids(formatted, "conv_id") == sorted(LARGE, key=str) and ids(formatted, "turn") == sorted([2**60 + 1, None, 1], key=str)
    got = chat.digest_formatted(formatted).collect()
    assert sorted((r["conv_id"] for r in got), key=str) == sorted(LARGE, key=str) and {r["n_turns"] for r in got} == {3}


def test_repeated_ids_have_one_order(spark, tmp_path):
    rows = [(7, "b a c"), (7, "a"), (7, "c c c c"), (7, "a b c"), (None, "z")]
    seen = set()
    for k, order in enumerate((rows, rows[::-1])):
        path = str(tmp_path / str(k))
        token_files.write_tokens(spark.createDataFrame(order, "doc_id long, text string"), path)
        read = token_files.with_starts(token_files.read_tokens(spark, path), spark, path)
        seen.add(tuple(sorted((r["start"], r["ids_crc32"]) for r in read.collect())))
    assert len(seen) == 1


def test_conflicting_labels_have_no_part(spark):
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0), (None, 1)], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.labelled_sample(labels, F.lit(True)).collect()) == [(2, 1), (3, 0)]


@pytest.mark.parametrize("copies", [60, 3000])
def test_equal_scores_go_to_the_smaller_id(spark, copies):
    """Even ids are copies of one vector; others are scattered, of uneven norms."""
    rng = np.random.default_rng(2)
    one = rng.standard_normal(64)
    one /= np.linalg.norm(one)
    rows = [(i, (one if i % 2 == 0 else 0.2 * rng.random() * rng.standard_normal(64) / 8).tolist()) for i in range(2 * copies)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id").isin(0, 40, 2 * copies - 2), k=20, probing=ann.Probing(hashes=4)).collect()
    for q in (0, 40, 2 * copies - 2):
        mine = [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        assert mine == [i for i in range(0, 44, 2) if i != q][:20]


def test_equal_sums_of_different_vectors(spark):
    """Permuted components have one sum in exact numbers; where all rows are met the result is the brute force one."""
    rng = np.random.default_rng(5)
    base = rng.integers(-4, 5, 16) / 4
    v = np.array([rng.permutation(base) for _ in range(400)])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20, probing=ann.Probing(hashes=1, probes=8, tables=4, width=50.0)).collect()
    for q in range(0, 400, 20):
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(400), -s)).tolist() if i != q][:20]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
