"""Near-duplicate embeddings against all cosines."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import embedding_dup
from quillgraph.llm.embedding_dup import Hasher, Polytopes


def brute(rows, limit=0.95):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector or None)."""
    ids = [i for i, _ in rows]
    links = {i: set() for i in ids}
    for size in {len(v) for _, v in rows if v is not None}:
        mine = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == size and np.any(v)]
        if not mine:
            continue
        unit = np.array([v / np.linalg.norm(v) for _, v in mine])
        for a, b in zip(*np.nonzero(unit @ unit.T >= limit)):
            if a != b:
                links[mine[a][0]].add(mine[b][0])
    out = {}
    for i in sorted(ids):
        if i not in out:
            seen, front = {i}, [i]
            while front:
                new = {y for x in front for y in links[x]} - seen
                seen |= new
                front = list(new)
            out |= dict.fromkeys(seen, i)
    return sorted((i, len(links[i]), out[i], out[i] == i) for i in ids)


def got(spark, rows, settings=None, kind="double"):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    df = df.withColumns({x: F.lit(1) for x in ("v", "id", "n", "h", "salt", "copies", "component", "kept", "n_links", "label")})
    out = embedding_dup.near_duplicates(df, settings)
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    return sorted(tuple(r) for r in out.collect())


def cloud(rng, centres, each, noise, dim):
    v = rng.standard_normal((centres, dim))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).repeat(each, 0)
    v = v + noise * rng.standard_normal(v.shape) / np.sqrt(dim)
    return v * np.exp(rng.standard_normal((len(v), 1)))


@pytest.mark.parametrize("dim, noise, settings", [
    (64, 0.2, Polytopes()),
    (64, 0.23, Polytopes(crowd=2, block=7)),  # more hashes a bucket, and buckets cut in blocks
    (24, 0.22, Polytopes(crowd=20, probes=8, block=5)),
    (3, 0.2, Polytopes(block=20)),
    (20, 0.3, Polytopes(limit=0.9, probes=2)),
])
def test_equals_all_cosines(spark, dim, noise, settings):
    """Noise at which many pairs lie about the limit."""
    rng = np.random.default_rng(dim)
    v = np.vstack([cloud(rng, 25, 12, noise, dim), cloud(rng, 1, 80, noise, dim), rng.standard_normal((200, dim))])
    order = rng.permutation(len(v))
    rows = [(int(7 * k), v[i].tolist()) for k, i in enumerate(order)]
    want = brute(rows, settings.limit)
    assert sum(r[1] for r in want) > 300
    assert got(spark, rows, settings) == want


def test_copies_and_odd_rows(spark):
    """Copies count one another; ids beside nulls keep their digits; what has no direction links with nothing."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal(16).astype(np.float32).astype(float)
    near = (base + 0.02 * rng.standard_normal(16)).astype(np.float32).astype(float)
    rows = [(2**53 + 1 + 2 * i, base.tolist()) for i in range(300)] + [(i, near.tolist()) for i in range(50)] + [(60, (-base).tolist()), (61, (base * 4).tolist()), (62, base[:8].tolist()), (63, base[:8].tolist())]
    broken = [(70, None), (71, [0.0] * 16), (72, []), (73, [float("nan")] + [1.0] * 15), (74, [1.0, None]), (75, [float("inf")] * 16)]
    again = [(2**53 + 1, base.tolist()), (60, (-base).tolist()), (60, [9.0] * 16)]
    one = {60: min((-base).tolist(), [9.0] * 16)}  # the smaller vector stands for an id
    want = sorted([*brute([(i, one.get(i, v)) for i, v in rows]), *((i, 0, i, True) for i, _ in broken)])
    assert got(spark, [*rows, *broken, *again], kind="float") == want
    null = embedding_dup.near_duplicates(spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.0]), (4, [1.0, 2.0])], "vec_id long, embedding array<double>")).collect()
    assert sorted(map(tuple, null), key=str) == [(4, 0, 4, True), (None, 0, None, True)]


def test_large_group_of_near_copies_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = cloud(rng, 1, 500, 0.12, 64)
    assert got(spark, [(i, x.tolist()) for i, x in enumerate(v)], Polytopes(block=60)) == brute([(i, x.tolist()) for i, x in enumerate(v)])


def test_empty_table(spark):
    assert got(spark, []) == [] and got(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_extreme_norms(spark):
    v = [[1e200, 1e200], [1e-200, 1.01e-200], [1.0, -1.0], [5e-324, 5e-324]]
    assert got(spark, list(enumerate(v))) == [(0, 2, 0, True), (1, 2, 0, False), (2, 0, 2, True), (3, 2, 0, False)]


@pytest.mark.parametrize("classes, hashes", [(10_000, 1), (2_000_000, 2), (10**9, 3)])
def test_pairs_at_the_limit_meet(classes, hashes):
    """With as many hashes as so many vectors take, hardly a pair of cosine 0.95 misses all tables."""
    h = Hasher(Polytopes(), 64, classes)
    assert h.hashes == hashes
    rng = np.random.default_rng(9)
    a = rng.standard_normal((4000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((4000, 64))
    b -= (a * b).sum(1, keepdims=True) * a
    b = 0.95 * a + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    missed = np.ones(4000, bool)
    for t in range(h.tables):
        x, y = h.visits(a, t), h.visits(b, t)
        missed &= ~(embedding_dup.meets(x, y[:, 0]) | embedding_dup.meets(y, x[:, 0]))
    assert not missed.any()


def test_rotations_keep_lengths():
    x = np.random.default_rng(3).standard_normal((5, 32))
    y = embedding_dup.hadamard(x)
    assert np.allclose(np.linalg.norm(y, axis=1), np.sqrt(32) * np.linalg.norm(x, axis=1)) and np.allclose(embedding_dup.hadamard(y), 32 * x)
