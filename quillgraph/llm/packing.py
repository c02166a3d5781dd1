"""Packing documents into fixed windows by non-negative least squares.

A document's whole windows are sequences of their own; what is left is its remainder, shorter
than a window. Shallow combinations of two or three remainder lengths that fill a window exactly
are enumerated, their repeat counts solved against the histogram of lengths by non-negative least
squares, rounded down to what the histogram holds, and dealt out to the remainders of each length
by rank. Remainders that no combination takes are laid end to end, longest first, and cut at the
windows; the last window's tokens are cut into powers of two, which need no padding.

The driver sees the histogram and the solution (bounded by the window), never documents: the rank
of a remainder within its length is its rank in its task plus the counts of the tasks before,
which a window over the (length, task) counts gives.

Defined results: a null or empty text is one piece of the end id alone; texts of any length are
encoded whole, also of a null doc_id, which stays null; remainders of equal length are told apart by
their place in their task; repeated rows are packed each; other columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.bpe import ByteBPE, text_batches
from quillgraph.llm.shared import Scratch, map_with_ids

WINDOW = 2048
END_ID = 1
#: Lengths that triples are made of: the most frequent ones. Pairs use every length.
TRIPLE_LENGTHS = 96


def combinations(histogram: np.ndarray, window: int = WINDOW, frequent: int = TRIPLE_LENGTHS) -> np.ndarray:
    """Rows of three lengths (0: none) that sum to the window, each length in the histogram."""
    there = histogram > 0
    there[0] = False
    found = [(a, window - a, 0) for a in range(window // 2, window) if there[a] and there[window - a]]
    top = [int(x) for x in np.argsort(-histogram, kind="stable")[:frequent] if there[x]]
    triples = set()
    for a in top:
        for b in top:
            c = window - a - b
            if 0 < c < window and there[c]:
                triples.add(tuple(sorted((a, b, c), reverse=True)))
    return np.array(found + sorted(triples), np.int64).reshape(-1, 3)


def solve_counts(combos: np.ndarray, histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """min ||A x - h|| with x >= 0 by multiplicative steps, which keep x non-negative; A has a
    column for each combination with how often it takes each length."""
    size = len(histogram)
    if not len(combos):
        return np.zeros(0)
    weight = np.ones(size)
    weight[0] = 0  # no length
    to = lambda x: np.bincount(combos.ravel(), weights=np.repeat(x, 3), minlength=size) * weight
    back = lambda y: (y * weight)[combos].sum(1)
    x = np.full(len(combos), histogram.sum() / (3.0 * len(combos)))
    target = back(histogram.astype(float))
    for _ in range(rounds):
        x *= target / np.maximum(back(to(x)), 1e-12)
    return x


def rounded(x: np.ndarray, combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """Whole repeat counts that the histogram can serve, largest first, then what still fits."""
    left = histogram.copy()
    out = np.zeros(len(combos), np.int64)
    for wanted in (np.floor(x).astype(np.int64), np.full(len(combos), np.iinfo(np.int64).max)):
        for j in np.argsort(-x, kind="stable"):
            lengths, times = np.unique(combos[j][combos[j] > 0], return_counts=True)
            n = int(min(wanted[j], (left[lengths] // times).min()))
            if n > 0:
                out[j] += n
                left[lengths] -= n * times
    return out


@dataclass
class Plan:
    """Where the remainder with rank t of a length goes. first_sequence: ids below are whole windows'."""

    window: int
    #: By length: ascending slot ends, and for each slot the first sequence id of its combination and the offset in it.
    ends: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    #: By length: ranks from here on are residual, laid end to end from this place.
    residual_from: np.ndarray
    residual_at: np.ndarray
    residual_sequence: int
    residual_total: int

    def pieces(self, length: int, rank: int) -> Iterator[tuple[int, int, int]]:
        """(sequence, offset, tokens) of a remainder, in order."""
        if rank < self.residual_from[length]:
            ends = self.ends[length]
            k = int(np.searchsorted(ends, rank, "right"))
            yield int(self.sequence[length][k]) + rank - (int(ends[k - 1]) if k else 0), int(self.offset[length][k]), length
            return
        at = int(self.residual_at[length]) + (rank - int(self.residual_from[length])) * length
        whole = self.residual_total // self.window
        while length:
            s, o = divmod(at, self.window)
            room, sequence = self.window - o, self.residual_sequence + s
            if s == whole:  # the last window: powers of two, largest first
                rest, skip = self.residual_total % self.window, 0
                while True:
                    power = 1 << (rest.bit_length() - 1)
                    if o < power:
                        break
                    o, rest, skip = o - power, rest - power, skip + 1
                room, sequence = power - o, sequence + skip
            n = min(room, length)
            yield sequence, o, n
            at, length = at + n, length - n


def plan(histogram: np.ndarray, whole_windows: int, window: int = WINDOW) -> Plan:
    combos = combinations(histogram, window)
    counts = rounded(solve_counts(combos, histogram), combos, histogram)
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    sequence = whole_windows
    for combo, n in zip(combos.tolist(), counts.tolist(), strict=True):
        if n:
            offset = 0
            for length in combo:
                if length:
                    slots[length].append((n, sequence, offset))
                    offset += length
            sequence += n
    used = np.zeros(window, np.int64)
    ends, first, offsets = {}, {}, {}
    for length, rows in slots.items():
        n, s, o = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        ends[length], first[length], offsets[length] = np.cumsum(n), s, o
        used[length] = n.sum()
    lengths = np.arange(window)
    tokens = (histogram - used) * lengths
    at = np.zeros(window, np.int64)
    at[::-1] = np.cumsum(tokens[::-1]) - tokens[::-1]
    return Plan(window, ends, first, offsets, used, at, sequence, int(tokens.sum()))


# ---- over documents

_TOKENS = "doc_id long, n int, part int, windows_before long, rank long, ids binary"


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, window: int) -> DataFrame:
    """ids of each document and, within its task, the whole windows before it and the rank of its
    remainder among those of the same length. Written once; a second computation may deal otherwise."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        bpe = ByteBPE.from_json(tokenizer)
        end = np.array([end_id], "<u2").tobytes()
        windows, ranks = 0, np.zeros(window, np.int64)
        for b in batches:
            texts = [x if isinstance(x, str) else "" for x in b["text"]]
            rows = []
            for a, z in text_batches(texts):
                flat, at = bpe.encode(texts[a:z])
                for i in range(z - a):
                    ids = flat[at[i] : at[i + 1]].tobytes() + end
                    n = len(ids) // 2
                    rows.append((n, part, windows, int(ranks[n % window]), ids))
                    windows += n // window
                    ranks[n % window] += 1
            out = pd.DataFrame(rows, columns=["n", "part", "windows_before", "rank", "ids"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return map_with_ids(docs.select(F.col("doc_id").cast("long"), "text"), work, _TOKENS, "doc_id")


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, window: int = WINDOW) -> DataFrame:
    """Pieces of all documents (doc_id, text) and their places."""
    tokenizer = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    scratch = Scratch(docs.sparkSession, "packing")
    tokens = scratch.write(tokenized(docs, tokenizer, end_id, window), "tokens")
    length = (F.col("n") % window).alias("length")
    counts = tokens.groupBy("part", length).agg(F.count("*").alias("docs"), F.sum(F.floor(F.col("n") / window)).alias("windows"))
    counts = scratch.write(counts, "counts")
    histogram = np.zeros(window, np.int64)
    whole = 0
    for r in counts.groupBy("length").agg(F.sum("docs").alias("docs"), F.sum("windows").alias("windows")).collect():  # a row for each length below the window
        histogram[r["length"]] = r["docs"]
        whole += r["windows"]
    histogram[0] = 0
    made = plan(histogram, whole, window)
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("part", "length", F.coalesce(F.sum("docs").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_before"))
    starts = counts.groupBy("part").agg(F.sum("windows").alias("windows")).select("part", F.coalesce(F.sum("windows").over(earlier), F.lit(0)).alias("part_windows"))
    wide = tokens.withColumn("length", length).join(ranks.join(starts, "part"), ["part", "length"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, n, r, w, raw in zip(b["doc_id"], b["n"], b["rank"] + b["rank_before"], b["windows_before"] + b["part_windows"], b["ids"]):
                ids = np.frombuffer(raw, "<u2").astype("<u4")
                start = 0
                places = [(int(w) + i, 0, window) for i in range(n // window)]
                if n % window:
                    places += made.pieces(int(n % window), int(r))
                for s, o, size in places:
                    rows.append((d, start, size, zlib.crc32(ids[start : start + size].tobytes()), n, s, o))
                    start += size
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PIECES.split(", ")])

    return map_with_ids(wide.select("doc_id", "n", "rank", "rank_before", "windows_before", "part_windows", "ids"), work, PIECES, "doc_id")
