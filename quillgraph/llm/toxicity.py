"""Toxicity by noisy-channel deobfuscation and the purity of word features.

Tokens that look disguised (signs among letters, letters set apart, long repetitions) become
character lattices: each sign may stand for letters, separators may be nothing, a space may be
nothing or the end of a word, a run of one letter may be one or two of it. A Viterbi search finds
the likeliest reading under a character trigram model whose counts come from all words of all
documents. The document is scored on its own words and on the restored ones. Long tokens and runs
are read in overlapping pieces.

A word's features are itself and its beginnings; a document's are also beginnings that two or three
different words share. Over a bounded sample of labelled documents (SAMPLE of each label, by id
hash) the documents that hold a feature are counted by label, after groups of copies in the sample
are cut to about one, as copies say nothing new. A word scores its purest feature's smoothed share
of toxic documents, a document a noisy or over its words.

The model is every gram met, packed to 16 bytes each, which the driver collects and broadcasts: it
grows with the distinct grams of the writing in use, not with the documents.

Defined results: null and empty texts score EMPTY (0); texts of any length are read whole; repeated
rows score alike; a labelled id with several rows takes part with each of its texts, one that has
none with none; null labels are left out, and so is an id labelled both ways; a null doc_id isn't
held out; without labels of both kinds all score 0; a score exactly
at the threshold is toxic; other columns, whatever their names, don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.shared import Scratch

EMPTY = 0.0
#: Labelled documents of each label that features are counted on, at most.
SAMPLE = 10_000
#: Needed documents of a feature; smoothing; purity from which a feature is kept.
SUPPORT = 6
PRIOR = 1.0
PURE = 0.9
THRESHOLD = 0.7

WORD = re.compile(r"[^\W\d_]+")
#: Signs and the letters they may stand for. Fixed values of common writing.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "h"}
SEPARATORS = "._-*~'`^/\\"
_SIGNS = re.escape("".join(LEET) + SEPARATORS)
#: What makes a token look disguised: signs between letters, a sign for a first letter, a letter three times over.
_DISGUISED = re.compile(rf"[^\W\d_][{_SIGNS}]+[^\W\d_]|^[0-9@$€£|][^\W\d_]")
_RUN = re.compile(r"(.)\1{3,}", re.DOTALL)
_TRIPLE = re.compile(r"([^\W\d_])\1\1")
#: Letters set apart by single spaces.
_SPACED = re.compile(r"(?<!\S)[^\W_](?: [^\W_]){3,}(?!\S)")
_TWO_ALONE = re.compile(r" \S \S ")
#: Longer tokens and runs are read in pieces that overlap by half.
PIECE = 64


def features(word: str) -> list[str]:
    out = ["=" + word]
    return out + ["^" + word[:n] for n in (4, 5, 6, 7) if len(word) >= n]


def document_features(words: set[str]) -> set[str]:
    """Features of single words, and beginnings that two or three different words share."""
    shared = Counter(w[:n] for w in words for n in (4, 5, 6, 7) if len(w) > n)
    return {f for w in words for f in features(w)} | {f"{k}^{p}" for p, m in shared.items() for k in (2, 3) if m >= k}


def pack(gram: str) -> int:
    """A gram of up to three characters as one number, 21 bits each, in the grams' order."""
    out = 0
    for c in gram:
        out = out << 21 | ord(c)
    return out


class CharModel:
    """Interpolated character trigrams over words between boundaries: by n, sorted packed grams and
    their running counts, so that a context's total is a difference of two."""

    def __init__(self, grams: dict[int, tuple[np.ndarray, np.ndarray]]):
        none = np.empty(0, np.int64)
        self.keys = {n: grams.get(n, (none, none))[0] for n in (1, 2, 3)}
        self.sums = {n: np.concatenate([[0], np.cumsum(grams.get(n, (none, none))[1])]) for n in (1, 2, 3)}
        self.vocabulary = max(2, len(self.keys[1]))
        self.memo: dict[tuple[str, str], float] = {}

    @classmethod
    def of(cls, counts: dict[str, int]) -> CharModel:
        out = {}
        for n in (1, 2, 3):
            rows = sorted((pack(g), m) for g, m in counts.items() if len(g) == n)
            out[n] = np.array([k for k, _ in rows], np.int64), np.array([m for _, m in rows], np.int64)
        return cls(out)

    def between(self, n: int, low: int, high: int) -> int:
        a, b = np.searchsorted(self.keys[n], (low, high))
        return int(self.sums[n][b] - self.sums[n][a])

    def cost(self, before: str, c: str) -> float:
        key = (before[-2:], c)
        if key not in self.memo:
            if len(self.memo) > 1_000_000:
                self.memo.clear()
            p = 1.0 / self.vocabulary
            for n in range(min(2, len(before)) + 1):
                context = pack(before[len(before) - n :]) if n else 0
                gram = context << 21 | ord(c)
                total = self.between(n + 1, context << 21, context + 1 << 21)
                p = (self.between(n + 1, gram, gram + 1) + 8 * p) / (total + 8)
            self.memo[key] = -math.log(p)
        return self.memo[key]


#: Between two words in a reading: the end of one and the beginning of the next.
BREAK = "\x03\x02"


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """For each sign, (letters it may be, channel cost)."""
    out: list[list[tuple[str, float]]] = []
    for run in re.finditer(r"(.)\1*", token.lower(), re.DOTALL):
        c, n = run[1], len(run[0])
        if c.isalpha():
            reads = [(c, 0.0 if n == 1 else 0.3), (c * 2, 0.0 if n == 2 else 0.6)] if n > 1 else [(c, 0.0)]
        else:
            reads = [(x, 0.7) for x in LEET.get(c, "")]
            reads += [(x * 2, 0.9) for x, _ in list(reads)] if n > 1 else []
            if c in SEPARATORS or c.isspace() or not reads:
                reads.append(("", 0.2 if c.isspace() or c in SEPARATORS else 3.0))
            if c.isspace():
                reads.append((BREAK, 0.2))
        out.append(reads)
    return out


def restore(token: str, model: CharModel) -> str:
    """The likeliest words behind a token, with spaces between."""
    states: dict[str, tuple[float, str]] = {"\x02": (0.0, "")}
    for reads in lattice(token):
        new: dict[str, tuple[float, str]] = {}
        for before, (cost, word) in states.items():
            for letters, channel in reads:
                c, context = cost + channel, before
                for x in letters:
                    if x == "\x02":  # a new word, whatever came before
                        context = x
                        continue
                    c += model.cost(context, x)
                    context = (context + x)[-2:]
                if context not in new or c < new[context][0]:
                    new[context] = (c, word + letters)
        states = new
    return min((cost + model.cost(before, "\x03"), word) for before, (cost, word) in states.items())[1].replace(BREAK, " ")


def pieces(token: str) -> list[str]:
    """The token, or overlapping pieces of a long one. Runs above three read as three."""
    token = _RUN.sub(r"\1\1\1", token)
    return [token] if len(token) <= PIECE else [token[i : i + PIECE] for i in range(0, len(token) - PIECE // 2, PIECE // 2)]


def disguised(token: str) -> bool:
    return not token.isalpha() and _DISGUISED.search(token) is not None or _TRIPLE.search(token) is not None


def spaced(text: str) -> list[str]:
    """Runs of letters set apart in a lower-cased text."""
    return [m[0] for m in _SPACED.finditer(text)] if _TWO_ALONE.search(text) else []


def suspects(text: str) -> list[str]:
    return [t for t in text.split() if disguised(t)] + spaced(text)


def char_counts(docs: DataFrame) -> DataFrame:
    """(n, gram, count): packed character 1- to 3-grams of all words of all documents; a task sends each
    gram once for as many as it holds at a time."""

    def rows(grams: dict[int, Counter]) -> Iterator[pd.DataFrame]:
        for n, found in grams.items():
            yield pd.DataFrame({"n": np.full(len(found), n, np.int32), "gram": np.fromiter(found, np.int64, len(found)), "count": np.fromiter(found.values(), np.int64, len(found))})
            found.clear()

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams: dict[int, Counter] = {1: Counter(), 2: Counter(), 3: Counter()}
        tokens: Counter = Counter()
        for b in batches:
            for text in b["text"]:
                if isinstance(text, str):
                    tokens.update(text.lower().split())
                if len(tokens) > 100_000:
                    _add_grams(tokens, grams)
                    tokens.clear()
                    if len(grams[3]) > 2_000_000:
                        yield from rows(grams)
        _add_grams(tokens, grams)
        yield from rows(grams)

    return docs.select("text").mapInPandas(work, "n int, gram long, count long").groupBy("n", "gram").agg(F.sum("count").alias("count"))


def words_in(token: str) -> list[str]:
    return [token] if token.isalpha() else WORD.findall(token)


def _add_grams(tokens: Counter, grams: dict[int, Counter]) -> None:
    """Adds the grams of counted tokens' words, each word between boundary signs."""
    words = [(w, n) for t, n in tokens.items() for w in words_in(t)]
    if not words:
        return
    points = np.frombuffer("".join("\x02" + w + "\x03" for w, _ in words).encode("utf-32-le"), np.uint32)
    size = np.fromiter((len(w) + 2 for w, _ in words), np.int64, len(words))
    weight = np.repeat(np.fromiter((n for _, n in words), np.int64, len(words)), size)
    place = np.arange(len(points)) - np.repeat(np.cumsum(size) - size, size)
    for n in (1, 2, 3):  # grams that end at each sign of a word; the first sign only begins
        ends = np.nonzero(place >= max(1, n - 1))[0]
        key = np.zeros(len(ends), np.uint64)
        for j in range(n - 1, -1, -1):
            key = key << np.uint64(21) | points[ends - j].astype(np.uint64)
        found, inverse = np.unique(key, return_inverse=True)
        total = np.bincount(inverse, weights=weight[ends]).astype(np.int64)
        held = grams[n]
        for k, m in zip(found.tolist(), total.tolist(), strict=True):
            held[k] += m


def labelled_sample(labels: DataFrame, is_training, most: int = SAMPLE) -> DataFrame:
    """At most `most` labelled documents of each label, by id hash; an id with both labels has none."""
    rows = labels.filter("doc_id is not null and toxic is not null").filter(is_training).groupBy("doc_id").agg(F.min(F.col("toxic").cast("int")).alias("toxic"), F.max(F.col("toxic").cast("int")).alias("other"))
    rows = rows.filter("toxic = other").drop("other")
    pick = lambda x: rows.filter(F.col("toxic") == x).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pick(1).union(pick(0))


def _content_hashes(text: str | None) -> tuple[int, int, int] | None:
    """Three smallest-hash signatures of the 3-word shingles, which copies with few edits mostly share."""
    w = WORD.findall(text.lower()) if isinstance(text, str) else []
    if not w:
        return None
    grams = {" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))}
    h = np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), np.uint64, len(grams))
    return tuple(int((h * m).min() >> np.uint64(1)) for m in (np.uint64(1), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)))


def feature_purity(docs: DataFrame, sample: DataFrame) -> dict[str, float]:
    """Smoothed share of toxic documents by feature, for pure enough ones."""
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # a sample of bounded size

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, x, *h) for d, x, t in zip(b["doc_id"], b["toxic"], b["text"]) if (h := _content_hashes(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "toxic", "h0", "h1", "h2"])

    signed = texts.mapInPandas(sign, "doc_id long, toxic int, h0 long, h1 long, h2 long")
    for h in ("h0", "h1", "h2"):  # what one signature misses of a group of copies, the next takes
        signed = signed.groupBy(h).agg(F.min(F.struct("doc_id", "toxic", *[x for x in ("h0", "h1", "h2") if x != h])).alias("x")).select(h, "x.*")
    single = Scratch(docs.sparkSession, "toxicity").write(signed.select("doc_id", "toxic"), "sample")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                if isinstance(text, str):  # a sampled id may have a row without text
                    counts[toxic].update(document_features(set(WORD.findall(text.lower()))))
        found = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"feature": pd.Series(found, dtype=object), "a": pd.Series([counts[1][f] for f in found], dtype="int64"), "n": pd.Series([counts[0][f] + counts[1][f] for f in found], dtype="int64")})

    rows = docs.select("doc_id", "text").join(F.broadcast(single), "doc_id").mapInPandas(work, "feature string, a long, n long")
    counts = rows.groupBy("feature").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).filter(F.col("a") >= SUPPORT)
    pure = counts.select("feature", (F.col("a") / (F.col("n") + PRIOR)).alias("p")).filter(F.col("p") >= PURE)
    return {r["feature"]: r["p"] for r in pure.collect()}  # features of the bounded sample


class Scorer:
    """Scores words once and keeps them, up to a bound."""

    def __init__(self, purity: dict[str, float], grams: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.purity, self.model = purity, CharModel(grams)
        #: Beginnings whose sharing scores, and the first letters of all that scores.
        self.stems = {f[2:] for f in purity if f[0] in "23" and f[1:2] == "^"}
        self.heads = {f.lstrip("23=^")[:4] for f in purity}
        self.tokens: dict[str, tuple] = {}

    def word(self, w: str) -> tuple[float, tuple[str, ...]]:
        """(score, scoring beginnings)."""
        if w[:4] not in self.heads:
            return 0.0, ()
        return max((self.purity.get(f, 0.0) for f in features(w)), default=0.0), tuple(w[:n] for n in (4, 5, 6, 7) if len(w) > n and w[:n] in self.stems)

    def restored(self, token: str) -> list[tuple[str, float]]:
        cut = pieces(token)
        words = {w for x in cut if len(cut) == 1 or " " in x or disguised(x) for w in WORD.findall(restore(x, self.model))}
        return [(w, p * 0.95) for w in words if (p := self.word(w)[0])]

    def token(self, t: str) -> tuple:
        """What a token adds: (scoring words, scoring beginnings by word, restored words); empty for most."""
        seen = [(w, *self.word(w)) for w in words_in(t)]
        scored = tuple((w, p) for w, p, _ in seen if p)
        shared = tuple((w, x) for w, _, x in seen if x)
        hidden = tuple(self.restored(t)) if disguised(t) else ()
        return (scored, shared, hidden) if scored or shared or hidden else ()

    def text(self, text: str) -> tuple[float, int]:
        """(score, number of disguised tokens that restored to a scoring word)."""
        low = text.lower()
        known = self.tokens
        if len(known) > 200_000:
            known.clear()
        found: dict[str, float] = {}
        hidden: list[tuple[str, float]] = []
        stems: dict[str, set[str]] = {}
        for t in set(low.split()):
            got = known.get(t)
            if got is None:
                got = self.token(t)
                if len(t) <= 64:
                    known[t] = got
            if got:
                found.update(got[0])
                for w, beginnings in got[1]:
                    for x in beginnings:
                        stems.setdefault(x, set()).add(w)
                hidden += got[2]
        for stem, words in stems.items():
            p = max((self.purity.get(f"{k}^{stem}", 0.0) for k in (2, 3) if len(words) >= k), default=0.0)
            if p:
                found[f"^{stem[:4]}"] = max(p, found.get(f"^{stem[:4]}", 0.0))
        for run in spaced(low):
            hidden += self.restored(run)
        new = {w: p for w, p in hidden if w not in found}
        return 1 - math.prod(1 - p for p in sorted([*found.values(), *new.values()])), len(new)


def with_toxicity(docs: DataFrame, labels: DataFrame, is_training) -> DataFrame:
    """docs with toxicity: struct of score, predicted and n_restored, learnt from labels (doc_id, toxic)
    of rows for which is_training holds."""
    sample = labelled_sample(labels, is_training)
    purity = feature_purity(docs, sample)
    counts = char_counts(docs).toArrow()
    grams = {}
    for n in (1, 2, 3):
        mine = counts.filter(pc.field("n") == n).sort_by("gram")
        grams[n] = mine["gram"].to_numpy(), mine["count"].to_numpy()
    broadcast = docs.sparkSession.sparkContext.broadcast((purity, grams))

    @F.pandas_udf("score double, predicted int, n_restored int")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(*broadcast.value)
        for texts in batches:
            out = pd.DataFrame([scorer.text(t) if isinstance(t, str) and t else (EMPTY, 0) for t in texts], columns=["score", "n_restored"])
            out["predicted"] = out["score"] >= THRESHOLD
            yield out[["score", "predicted", "n_restored"]].astype({"predicted": "int32", "n_restored": "int32"})

    # not deterministic for the planner alone: it would run twice where a filter and a result both read it
    return docs.withColumn("toxicity", score.asNondeterministic()("text"))


def toxicity(docs: DataFrame, labels: DataFrame, is_training) -> DataFrame:
    """(doc_id, score, predicted, n_restored) of docs (doc_id, text); see with_toxicity."""
    return with_toxicity(docs.select("doc_id", "text"), labels, is_training).select("doc_id", "toxicity.score", "toxicity.predicted", "toxicity.n_restored")


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
