"""Target-distribution importance resampling of documents by hashed word runs.

Every text becomes a stream of buckets: each run of 1 to RUN consecutive words (A-Z lower-cased,
digits, letters and all beyond ASCII) falls in crc32 modulo BUCKETS. The streams are written once,
as packed little-endian uint16 in blocks of documents with the documents' offsets. Blocks are read
back and sorted, and their run lengths are the block's counts, which Spark adds up by bucket. A
bucket's gain compares its smoothed share in the target with that in the documents; a second read
of the streams gathers the gains and adds them up document by document (np.add.reduceat).

A document's score is its mean gain plus Gumbel noise of its id, so that the highest scores are a
draw without replacement in proportion to the weights. Ranks come from a sort by ranges of score:
a row's rank is its place in its range plus the rows of the ranges before; no task or driver sees
more than its range. The driver holds one count and one gain a bucket.

Checksums of all words of a block are made side by side, byte by byte; a run of words continues
the checksum of its first words. A block is at most BLOCK bytes of text or one document.

Defined results: a null or empty text has no features, weight 0 and isn't drawn; texts of any length
are read whole; a null doc_id hashes as an empty one and comes before others on ties; repeated rows
are scored and drawn each, and those alike in all are ranked in any order; the target's ids don't
matter; other columns, whatever their names, are left out; an empty table gives no rows, and with an
empty target the gains follow from the smoothing alone.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.shared import Scratch, conf

BUCKETS = 10_000
RUN = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text in a block, texts and blocks that a Python worker is sent at once.
BLOCK = 1 << 20
TEXTS, BLOCKS = 1000, 16
#: Bytes of a word that are hashed side by side with others; longer words go on alone.
SIDE_BY_SIDE = 64


def _letters() -> np.ndarray:
    """Each byte of a word as it counts, 0 for bytes between words."""
    out = np.zeros(256, np.uint8)
    for x in (*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(128, 256)):
        out[x] = x
    for x in range(ord("A"), ord("Z") + 1):
        out[x] = x + 32
    return out


def _checksum_steps() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = (c >> np.uint32(1)) ^ (c & np.uint32(1)) * np.uint32(0xEDB88320)
    return c


_LETTERS, _STEPS = _letters(), _checksum_steps()
_ALL = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte) -> np.ndarray:
    return _STEPS[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))


def _after(state: np.ndarray, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksum states after the bytes data[start : start + size] of each row."""
    order = np.argsort(SIDE_BY_SIDE - np.minimum(size, SIDE_BY_SIDE).astype(np.uint8), kind="stable")  # the longest first
    s, at = state[order], start[order]
    longer = len(size) - np.cumsum(np.bincount(np.minimum(size, SIDE_BY_SIDE), minlength=SIDE_BY_SIDE + 1))
    for k in range(SIDE_BY_SIDE):
        n = longer[k]
        if not n:
            break
        s[:n] = _step(s[:n], data[at[:n] + k])
    out = np.empty_like(s)
    out[order] = s
    for i in np.flatnonzero(size > SIDE_BY_SIDE):
        rest = data[start[i] + SIDE_BY_SIDE : start[i] + size[i]]
        out[i] = np.uint32(zlib.crc32(rest, int(out[i] ^ _ALL))) ^ _ALL
    return out


def bucket_stream(data: np.ndarray, ends: np.ndarray, run: int = RUN, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words by document, offsets, stream) of documents whose bytes lie one after another, document i
    from ends[i] to ends[i + 1]; its buckets are stream[offsets[i] : offsets[i + 1]]."""
    data = _LETTERS[data[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    inside = data != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True  # a word ends with its document
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    start = np.flatnonzero(after & (edge | ~before))
    size = np.flatnonzero(before & (edge | ~after)) - start
    first = np.searchsorted(start, ends)  # each document's first word
    words = np.diff(first)
    each = [np.maximum(words - m, 0) for m in range(run)]
    offsets = np.concatenate([[0], np.cumsum(sum(each))])
    document = np.repeat(np.arange(len(words)), words)
    stream = np.empty(offsets[-1], "<u2")
    state, place = np.full(len(start), _ALL, np.uint32), offsets[:-1].copy()
    for m in range(run):
        if m:
            state = _step(state[:-1], np.uint32(32))
        state = _after(state, data, start[m:], size[m:])
        whole = np.flatnonzero(document[: len(document) - m] == document[m:])  # runs that stay in a document
        d = document[whole]
        stream[place[d] + whole - first[d]] = (state[whole] ^ _ALL) % np.uint32(buckets)
        place += each[m]
    return words, offsets, stream


_STREAMS = "ids array<long>, words array<int>, offsets array<long>, stream binary"


def write_streams(texts: DataFrame, scratch: Scratch, name: str, run: int, buckets: int) -> DataFrame:
    """texts (id, text) as blocks of documents: ids, words, offsets in the block's stream, stream."""

    def one_row(values) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "").cast(pa.large_binary())
            if not len(text):
                continue
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(text):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + BLOCK, "right")) - 1)
                words, offsets, stream = bucket_stream(data, ends[at : to + 1], run, buckets)
                columns = [one_row(b.column(0)[at:to]), one_row(pa.array(words, pa.int32())), one_row(pa.array(offsets, pa.int64())), pa.array([stream.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", "words", "offsets", "stream"])
                at = to

    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are written as uint16")
    with conf(texts.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(TEXTS)}):
        return scratch.write(texts.mapInArrow(work, _STREAMS), name)


def bucket_counts(streams: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs: blocks are sorted and their runs counted, runs added up by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stream in b.column(0):
                s = np.sort(np.frombuffer(stream.as_buffer(), "<u2"))
                first = np.flatnonzero(np.diff(s.astype(np.int32), prepend=-1))
                yield pa.RecordBatch.from_arrays([pa.array(s[first], pa.int32()), pa.array(np.diff(first, append=len(s)), pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    with conf(streams.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(BLOCKS)}):
        got = streams.select("stream").mapInArrow(work, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log of the target's smoothed share over the documents', floored, by bucket."""
    s_all, t_all, n = int(raw.sum()), int(target.sum()), len(raw)
    ratio = lambda s, t: float((t + 1) * (s_all + n)) / float((s + 1) * (t_all + n))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


_WEIGHED = "doc_id long, n_words long, n_features long, weight long"


def weighed(streams: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean of the gains of a document's buckets."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, words, offsets, stream in zip(*b.columns):
                at = offsets.values.to_numpy()
                n = np.diff(at)
                total = np.zeros(len(n), np.int64)
                some = n > 0
                if some.any():
                    total[some] = np.add.reduceat(gain[np.frombuffer(stream.as_buffer(), "<u2")], at[:-1][some])
                columns = [ids.values, words.values.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return streams.mapInArrow(work, _WEIGHED)


def noise(doc_id, seed: int):
    """Thousandths of Gumbel noise, floored, from the first 32 bits of sha256 of "seed:doc_id"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_features, weight, score, rank; rank is null for what isn't drawn.
    target: (text). Of the documents with least_words words, floor(percent / 100 of them) are drawn."""
    scratch = Scratch(docs.sparkSession, "resampling")
    streams = write_streams(docs.select(F.col("doc_id").cast("long"), "text"), scratch, "documents", run, buckets)
    aims = write_streams(target.select(F.lit(None).cast("long").alias("id"), "text"), scratch, "target", run, buckets)
    gain = gains(bucket_counts(streams, buckets), bucket_counts(aims, buckets))
    with conf(docs.sparkSession, **{"spark.sql.execution.arrow.maxRecordsPerBatch": str(BLOCKS)}):
        scored = scratch.write(weighed(streams, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    scratch.drop("documents")
    scratch.drop("target")

    wanted = scored.filter(F.col("n_words") >= least_words)
    # rows alike in all else are dealt by their place in the written table, so no range holds them all
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("n_features"), F.asc("tie")]
    dealt = wanted.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    dealt = scratch.write(dealt.select("doc_id", "n_features", "weight", "score", F.spark_partition_id().alias("part"), place.alias("place")), "dealt")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = dealt.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    rank = F.col("before") + F.col("place") + 1
    drawn = dealt.join(F.broadcast(parts), "part")  # a row a task
    drawn = drawn.select("doc_id", "n_features", "weight", "score", F.when(rank <= F.expr(f"{percent} * all div 100"), rank).alias("rank"))
    return drawn.union(scored.filter(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))
