"""Importance resampling against a plain version of its rules."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import resampling

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, run, buckets):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + m]).encode()) % buckets for m in range(1, run + 1) for i in range(len(w) - m + 1)]


def plain(docs, target, run=2, buckets=10_000, least=20, percent=25, seed=7):
    made = [(d, *features(t, run, buckets)) for d, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x, run, buckets)[1])
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets))))
    rows = []
    for d, n, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        rows.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    drawn = Counter()
    for i, r in enumerate(able[: percent * len(able) // 100]):
        drawn[(r[0], *r[2:], i + 1)] += 1
    rest = able[percent * len(able) // 100 :] + [r for r in rows if r[1] < least]
    return sorted([*drawn.elements(), *((r[0], *r[2:], None) for r in rest)], key=str)


def got(spark, docs, target, **how):
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({x: F.lit(1) for x in ("n_features", "weight", "score", "rank", "part", "place", "tie", "ids")})
    out = resampling.resample(df, spark.createDataFrame([(x, "en") for x in target], "text string, lang string"), **how)
    assert out.dtypes == [(x, "bigint") for x in ("doc_id", "n_features", "weight", "score", "rank")]
    return sorted((tuple(r) for r in out.collect()), key=str)


def texts(n, seed):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcxyzABCÉé09😀ß") for _ in range(rnd.randint(1, 9))) for _ in range(120)] + ["w" * 63, "w" * 64, "w" * 65, "Q" * 500]
    return ["".join(rnd.choice(words) + rnd.choice([" ", " ", "\n", "--", "\x7f", "_"]) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


ODD = [(None, "a b c " * 10), (None, None), (5, None), (6, ""), (7, "  -- "), (8, "x" * 300_000), (9, "word " * 60_000), (2**53 + 1, "a b c " * 10), (2**53 + 1, "a b c " * 10), (10, "q"), (11, "end"), (12, "start")]


@pytest.mark.parametrize("how", [{}, {"run": 3, "buckets": 300, "percent": 60, "least_words": 3, "seed": 1}, {"run": 1}])
def test_equals_plain_version(spark, how, monkeypatch):
    docs = [*enumerate(texts(150, 1), 100), *ODD]
    target = [*texts(10, 2), None, "", "a b c"]
    monkeypatch.setattr(resampling, "BLOCK", 2000)
    assert got(spark, docs, target, **how) == plain(docs, target, least=how.get("least_words", 20), **{k: v for k, v in how.items() if k != "least_words"})


def test_copies_of_one_id_spread_over_ranges(spark):
    """Rows alike in all are ranked each, and no range holds all of them."""
    docs = [(3, "one two three four five " * 5)] * 900 + [*enumerate(texts(300, 3), 100)]
    assert got(spark, docs, ["one two"]) == plain(docs, ["one two"])


def test_empty_tables(spark):
    assert got(spark, [], []) == [] and got(spark, [], ["a"]) == []
    docs = [*enumerate(texts(30, 4))]
    assert got(spark, docs, []) == plain(docs, [])


def test_more_buckets_than_the_stream_holds(spark):
    with pytest.raises(ValueError, match="uint16"):
        resampling.resample(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"), buckets=70_000)


def test_streams_hold_every_document(spark):
    data = "".join(texts(40, 5)).encode()
    ends = np.array([0, 0, 10, 10, 400, len(data)])
    words, offsets, stream = resampling.bucket_stream(np.frombuffer(data, np.uint8), ends)
    for i in range(5):
        part = data[ends[i] : ends[i + 1]]
        w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", part.lower())
        assert words[i] == len(w)
        assert stream[offsets[i] : offsets[i + 1]].tolist() == [zlib.crc32(b" ".join(w[j : j + m])) % 10_000 for m in (1, 2) for j in range(len(w) - m + 1)]
