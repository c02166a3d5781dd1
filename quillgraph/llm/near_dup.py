"""Near-duplicate documents by an LSH forest over MinHash signatures, confirmed on full shingle sets.

A document's set is its distinct 5-word shingles (A-Z lower-cased, ASCII white space). Documents
with equal sets are brought together first. The others' signatures are sorted in TREES orders,
each beginning at other hashes; documents that share the first DEPTH hashes of an order form a
region, and neighbours there, which share the longest prefixes, are candidates, as is each with
the region's first document, around which a large group of copies joins at once. A crowded region
is ordered by further hashes first (its depth adapts to its size).

Candidates are confirmed exactly, in two rounds. First each document's most often met one, which
joins a group of copies whatever its size; a region that then is one component leaves, so that the
second round sees only what is still apart. There all pairs of small regions are confirmed; the
documents of larger ones are open and joined exactly by prefix filter. Two linked sets share one of
the first n - ceil(0.75 n) + 1 shingles of each in any common order; the smaller one, as it must
share 2 * 0.75 / 1.75 of its own, already in its first seventh or so. The order is rarest first by
a table of hashed counts, so a shared passage or template brings few together. Every pair of open
documents in different components that meets so and can still link by sizes and places is
confirmed; hot shingles are cut in blocks, and none is left out: there only documents outside the
shingle's largest component are sent to all blocks, as that component's own pairs change nothing. Links inside a component that is
already joined change nothing and aren't confirmed.
So a pair of similarity s is missed only if it is in no common region, with probability
(1 - s^DEPTH)^TREES, 5e-6 at 0.75.

Defined results: null texts and texts without words are linked with nothing (n_shingles 0); texts
of any length are read whole; ties go to the smallest doc_id; repeated rows keep their rows and
share a component; a null doc_id takes no part and is its own result (component_id its own null,
or its copies' component; never kept); other columns, whatever their names, are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.shared import Scratch, conf, map_with_ids

SHINGLE = 5
TREES = 32
DEPTH = 4
#: Regions above this size are ordered by one more hash, above its multiples by FANOUT by further ones.
REGION = 512
FANOUT = 64
#: Regions up to this size are compared pair by pair, larger ones by prefix filter.
SMALL = 4
EDGES_PER_TASK = 50_000
#: Documents, or pairs with both texts, that a Python worker holds at once.
BATCH = 2000
#: Slots of hashed shingle counts; they order shingles only, so clashes cost time, not links.
COUNTS = 1 << 20
#: Documents of one shingle that a task meets at once; more are cut in blocks.
BLOCK = 512
PERCENT = 75

_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_POSITIONS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX1
    x = (x ^ (x >> np.uint64(33))) * _MIX2
    return x ^ (x >> np.uint64(33))


class _WordHashes(dict):
    """64-bit hash of each word met; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 48:
            self[word] = h
        return h

    def bound(self, most: int = 100_000) -> None:
        if len(self) > most:
            self.clear()


_words = _WordHashes()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return _mix((h * _POSITIONS[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h)))
    n = len(h) - SHINGLE + 1
    total = np.zeros(n, np.uint64)
    for j in range(SHINGLE):
        total += h[j : j + n] * _POSITIONS[j]
    return np.unique(_mix(total))


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)) or not len(a):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


@dataclass(frozen=True)
class Forest:
    trees: int = TREES
    depth: int = DEPTH
    seed: int = 7

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        k = self.trees * self.depth
        return rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, k, dtype=np.uint64)

    def signature(self, hashes: np.ndarray, perms: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        a, b = perms
        best = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(hashes), 2048):
            best = np.minimum(best, (hashes[i : i + 2048] * a[:, None] + b[:, None]).min(1))
        return (best >> np.uint64(32)).astype(np.uint32)

    def keys(self, signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By tree: its first hashes in one long, and the next ones, 16 bits of each, in order."""
        s = signature.reshape(self.trees, self.depth).astype(np.uint64)
        first = np.zeros(self.trees, np.uint64)
        for j in range(self.depth):
            first = _mix(first * _POSITIONS[1] + s[:, j] + np.uint64(j + 1))
        after = np.roll(s, -1, 0) >> np.uint64(16)
        deep = np.zeros(self.trees, np.uint64)
        for j in range(4):
            deep = deep << np.uint64(16) | after[:, j % self.depth]
        return first.view(np.int64), deep.view(np.int64)


_SIGNED = "doc_id long, n_shingles long, set_hash binary, first array<long>, deep array<long>"


def signatures(docs: DataFrame, forest: Forest) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        perms = forest.permutations()
        for b in batches:
            _words.bound()
            rows = []
            for text in b["text"]:
                s = shingles(text if isinstance(text, str) else None)
                if len(s):
                    first, deep = forest.keys(forest.signature(s, perms))
                    rows.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), first, deep))
                else:
                    rows.append((0, None, None, None))
            out = pd.DataFrame(rows, columns=["n_shingles", "set_hash", "first", "deep"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return map_with_ids(docs.select(F.col("doc_id").cast("long"), "text"), work, _SIGNED, "doc_id")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component): the smallest node reachable, for each node with an edge (a, b).

    Alternating star steps: nodes point their larger neighbours, then their smaller ones, at the
    smallest neighbour, until every edge points at its component's smallest node.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    e = scratch.write(e, f"{name}-0")
    mark, step = None, 0
    while True:
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head())
        if now == mark or now[0] == 0:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(e.select("b", "b").distinct())
        mark, step = now, step + 1
        few = 4 + now[0] // EDGES_PER_TASK  # short stages, however many partitions a shuffle has
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).coalesce(few).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).coalesce(few)
        down = large.groupBy("a").agg(F.min("b").alias("m")).coalesce(few)
        small = large.join(down, "a").coalesce(few)
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", "m")).filter("a <> b").distinct().coalesce(few)
        e = scratch.write(small, f"{name}-{step}")
        if step > 1:
            scratch.drop(f"{name}-{step - 2}")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose full sets link."""
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    wide = pairs.select("a", "b").join(a, "a").join(b, "b")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            _words.bound()
            known: dict[int, np.ndarray] = {}
            keep = []
            for i, j, s, t in zip(x["a"], x["b"], x["text_a"], x["text_b"]):
                for d, text in ((i, s), (j, t)):
                    if d not in known:
                        known[d] = shingles(text)
                keep.append(linked(known[i], known[j], percent))
            yield x.loc[keep, ["a", "b"]]

    return wide.mapInPandas(work, "a long, b long")


def _best_each(pairs: DataFrame) -> DataFrame:
    """The pairs that are some document's most often met one."""
    ends = pairs.select(F.col("a").alias("d"), "a", "b", "votes").union(pairs.select("b", "a", "b", "votes"))
    best = ends.groupBy("d").agg(F.max(F.struct("votes", (-F.col("a")).alias("x"), (-F.col("b")).alias("y"))).alias("p"))
    return best.select((-F.col("p.x")).alias("a"), (-F.col("p.y")).alias("b")).distinct()


_PLACED = ("tree", "first", "deep", "doc_id", "n")


def _live(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The rows of regions that hold several components so far, with their component c and the region's
    size and first document. What is joined already leaves here, so later rounds see what is still apart."""
    rows = rows.select(*_PLACED)
    if labels is None:
        placed = rows.withColumn("c", F.col("doc_id"))
    else:
        placed = rows.join(labels, F.col("doc_id") == F.col("node"), "left").select(*_PLACED, F.coalesce("component", "doc_id").alias("c"))
    crowd = placed.groupBy("tree", "first").agg(F.count("*").alias("size"), F.min(F.struct("doc_id", "n", "c")).alias("pivot"), F.min("c").alias("x"), F.max("c").alias("y"))
    return placed.join(crowd.filter("x <> y").drop("x", "y"), ["tree", "first"])


def _candidates(live: DataFrame, neighbours: int, percent: int) -> DataFrame:
    """(a, b, votes) in different components: each document with the next ones in each order and its
    region's first document, where their sizes allow a link."""
    shift = F.when(F.col("size") <= REGION, 63).when(F.col("size") <= REGION * FANOUT, 48).when(F.col("size") <= REGION * FANOUT**2, 32).otherwise(16)
    within = F.when(F.col("size") <= REGION, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col("deep"), shift))
    order = Window.partitionBy("tree", "first", "within").orderBy("deep", "doc_id")
    met = F.array(*[F.lead(F.struct("doc_id", "n", "c"), k).over(order) for k in range(1, neighbours + 1)], F.col("pivot"))
    able = lambda x: x.isNotNull() & (x["c"] != F.col("c")) & (100 * F.least(F.col("n"), x["n"]) >= percent * F.greatest(F.col("n"), x["n"]))
    pairs = live.withColumn("within", within).select("doc_id", "n", "c", met.alias("met")).select("doc_id", F.explode(F.filter("met", able)).alias("x"))
    return pairs.groupBy(F.least("doc_id", "x.doc_id").alias("a"), F.greatest("doc_id", "x.doc_id").alias("b")).agg(F.count("*").alias("votes"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, forest: Forest | None = None) -> DataFrame:
    """docs' (doc_id, text) as doc_id, n_shingles, component_id, kept."""
    with conf(docs.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH)}):
        return _near_duplicates(docs, percent, forest or Forest())


def _near_duplicates(docs: DataFrame, percent: int, forest: Forest) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "near-dup")
    signed = scratch.write(signatures(docs, forest), "signed")
    sets = scratch.write(signed.filter("set_hash is not null and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep")), "sets")
    reps = signed.join(sets, (signed["doc_id"] == sets["rep"]) & (signed["set_hash"] == sets["set_hash"]), "left_semi").dropDuplicates(["doc_id"])

    rows = reps.select("doc_id", F.col("n_shingles").alias("n"), F.posexplode(F.arrays_zip("first", "deep")).alias("tree", "x")).select("doc_id", "n", "tree", "x.first", "x.deep")
    live = scratch.write(_live(rows, None), "live-0")
    some = live.select("doc_id").distinct()
    texts = scratch.write(docs.select(F.col("doc_id").cast("long"), "text").join(some, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "texts")

    pairs = scratch.write(_candidates(live, 1, percent), "pairs")
    chosen = scratch.write(_best_each(pairs), "round-0")
    links = scratch.write(confirm(chosen, texts, percent), "links-0")
    labels = components(links, scratch, "components-0")

    live = scratch.write(_live(live, labels), "live-1")
    left = _candidates(live.filter(F.col("size") <= SMALL), SMALL - 1, percent).select("a", "b").union(_across(live, texts, percent, scratch))
    left = scratch.write(left.join(chosen, ["a", "b"], "left_anti").distinct(), "round-1")
    more = scratch.write(confirm(left, texts, percent), "links-1")
    if not more.isEmpty():  # edges of the components so far keep what was joined
        stars = labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        labels = components(more.union(stars), scratch, "components-1")

    rep_of = sets.join(labels, sets["rep"] == labels["node"], "left").select("set_hash", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(rep_of, "set_hash", "left")
    component = F.coalesce("component", "doc_id").alias("component_id")
    return out.select("doc_id", "n_shingles", component).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTS.bit_length() + 1)).astype(np.int64)


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How often shingles of each slot occur in texts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(COUNTS, np.int64)
        for b in batches:
            _words.bound()
            for text in b["text"]:
                np.add.at(total, _slots(shingles(text)), 1)
        slot = np.nonzero(total)[0]
        yield pd.DataFrame({"slot": slot, "n": total[slot]})

    out = np.zeros(COUNTS, np.int64)
    got = texts.select("text").mapInPandas(work, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def prefix(hashes: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The shingles, rarest first, one of which every set that links with this one has in its own prefix."""
    n = len(hashes)
    return hashes[np.lexsort((hashes, counts[_slots(hashes)]))][: n - -(-percent * n // 100) + 1]


def _across(live: DataFrame, texts: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b) in different components, of documents in regions of several components that are too large
    to compare pair by pair: all that can link by their prefixes, sizes and places."""
    open_ = live.filter(F.col("size") > SMALL).select("doc_id", "c").distinct()
    opened = scratch.write(texts.join(open_, "doc_id"), "open")
    counts = opened.sparkSession.sparkContext.broadcast(shingle_counts(opened))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            _words.bound()
            for d, c, text in zip(b["doc_id"], b["c"], b["text"]):
                s = shingles(text)
                head = prefix(s, counts.value, percent)
                yield pd.DataFrame({"shingle": head.view(np.int64), "d": d, "c": c, "n": len(s), "at": np.arange(len(head))})

    heads = scratch.write(opened.mapInPandas(work, "shingle long, d long, c long, n long, at long"), "prefixes")
    placed, sent = _dealt(heads, percent)
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("d_a") < F.col("d_b")))
    once = F.col("major") | (F.col("d_a") < F.col("d_b"))
    able = F.when(smaller, F.col("short_a")).otherwise(F.col("short_b"))
    sizes = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    # a pair's first common shingle says how many more it can share
    room = (100 + percent) * F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) >= percent * (F.col("n_a") + F.col("n_b"))
    met = placed.join(sent, ["shingle", "major", "block"]).filter((F.col("c_a") != F.col("c_b")) & once & able & sizes & room)
    return met.select(F.least("d_a", "d_b").alias("a"), F.greatest("d_a", "d_b").alias("b")).distinct()


def _dealt(heads: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(placed, sent) of shingles in several components: each row once in a block of its shingle, and the rows
    that meet those of a block. Of a hot shingle the rows of its largest component (major) have blocks of
    their own and are sent nowhere, so that a large group costs as many rows as there are others beside it."""
    each = heads.groupBy("shingle", "c").agg(F.count("*").alias("m"))
    met = each.groupBy("shingle").agg(F.sum("m").alias("size"), F.max(F.struct("m", "c")).alias("top"), F.count("*").alias("k")).filter("k > 1")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    hot = F.col("size") > BLOCK
    cut = met.select("shingle", F.when(hot, F.col("top.c")).alias("top"), F.when(hot, blocks(F.col("top.m"))).otherwise(0).alias("large"), F.when(hot, blocks(F.col("size") - F.col("top.m"))).otherwise(1).alias("small"))
    short = F.col("at") <= F.col("n") - F.expr(f"(2 * {percent} * n + {99 + percent}) div {100 + percent}")
    rows = heads.join(cut, "shingle").withColumn("short", short).withColumn("major", F.coalesce(F.col("c") == F.col("top"), F.lit(False)))
    named = lambda side: [F.col(x).alias(f"{x}_{side}") for x in ("d", "c", "n", "at", "short")]
    placed = rows.select("shingle", "major", F.pmod(F.xxhash64("d"), F.when(F.col("major"), F.col("large")).otherwise(F.col("small"))).cast("int").alias("block"), *named("a"))
    places = F.sequence(F.lit(0), F.col("small") + F.col("large") - 1)
    sent = rows.filter("not major").select("shingle", "small", F.explode(places).alias("place"), *named("b"))
    block = F.when(F.col("place") < F.col("small"), F.col("place")).otherwise(F.col("place") - F.col("small"))
    return placed, sent.withColumn("major", F.col("place") >= F.col("small")).withColumn("block", block).drop("small", "place")
