"""Byte-level BPE encoding and decoding in numpy.

Words of similar length share a padded matrix, a row each. Every round each row merges its
leftmost pair of minimum rank; pair ranks are looked up in an open-addressed hash table, the row
closes up behind the merge, and rows without a pair left leave the matrix.

Defined results: a null or empty text has no ids and decodes to no bytes; texts of any length,
also without a space, are encoded whole; repeated rows are encoded each; a null doc_id stays null;
other columns, whatever their names, are left out; an empty table gives no rows;
texts are cut at the added tokens of a tokenizers file, each of which is one id.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import encoding
from quillgraph.llm.shared import map_with_ids

NONE = np.int32(np.iinfo(np.int32).max)
_loaded: dict[str, ByteBPE] = {}


class PairTable:
    """(left id, right id) -> rank of the merged token, linear probing over a power of two of slots."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        size = 1 << max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - size.bit_length() + 1)
        self.mask = np.int64(size - 1)
        self.keys = np.full(size, -1, np.int64)
        self.values = np.full(size, NONE, np.int32)
        keys = np.array([a << 32 | b for a, b in pairs], np.int64)
        values = np.array(list(pairs.values()), np.int32)
        slots = self._slot(keys)
        self.probes = 0
        while len(keys):  # a round places one key a free slot, the rest go on to the next slot
            self.probes += 1
            free = self.keys[slots] == -1
            _, first = np.unique(np.where(free, slots, -1 - np.arange(len(slots))), return_index=True)
            first = first[free[first]]
            self.keys[slots[first]], self.values[slots[first]] = keys[first], values[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, slots = keys[left], values[left], (slots[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """NONE where the pair doesn't merge or a side is padding (negative)."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], NONE)
        open_ = np.nonzero((found != keys) & (found != -1) & (keys >= 0))[0]
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


class ByteBPE:
    """first, last: the ids a word's bytes start from; last for its final byte where words have an end mark."""

    def __init__(self, pairs: dict[tuple[int, int], int], first: list[int], last: list[int] | None = None, spaces_join: bool = True, prepare: Callable[[str], str] | None = None):
        self.pairs = PairTable(pairs)
        self.first, self.last = np.array(first, np.int32), None if last is None else np.array(last, np.int32)
        self.spaces_join, self.prepare = spaces_join, prepare
        self.bytes_of: list[bytes] = []
        self.text_of: list[str] = []

    @classmethod
    def from_ranks(cls, path: str) -> ByteBPE:
        """A file of base64 tokens and ranks, the id being the rank. Merging must reach every token,
        as a word that is a token has to come out as that token."""
        if path not in _loaded:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
            made = cls(_splits(ranks), [ranks[bytes([i])] for i in range(256)])
            made.bytes_of = [b""] * (max(ranks.values()) + 1)
            for token, r in ranks.items():
                made.bytes_of[r] = token
            made.text_of = [str(i) for i in range(len(made.bytes_of))]
            tokens = list(ranks)
            flat, ends = made._merge_words(tokens)
            assert len(flat) == len(tokens) and (flat == np.array([ranks[t] for t in tokens])).all(), "a token is out of reach of merges"
            _loaded[path] = made
        return _loaded[path]

    @classmethod
    def from_json(cls, path: str) -> ByteBPE:
        """A tokenizers file of kind BPE over byte characters, with or without word ends. A merge's
        order is its rank; ids are looked up afterwards."""
        if path not in _loaded:
            kept = json.loads(Path(path).read_text())
            model, vocab = kept["model"], kept["model"]["vocab"]
            end = model["end_of_word_suffix"] or ""
            merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            # rank ids: characters first, then each merge's result in order
            names = list(dict.fromkeys([*byte_characters(), *(c + end for c in byte_characters())]))
            base = len(names)
            rank = {n: i for i, n in enumerate(names)}
            pairs: dict[tuple[int, int], int] = {}
            for a, b in merges:
                rank.setdefault(a + b, len(rank))
                pairs[rank[a], rank[b]] = rank[a + b]
            assert len(rank) == base + len(merges)
            chars = byte_characters()
            lower = end != ""
            made = cls(pairs, [rank[c] for c in chars], [rank[c + end] for c in chars] if end else None, spaces_join=not lower, prepare=_lowered if lower else None)
            made.ids_of = np.array([vocab[n] for n in rank], np.int32)
            assert not any(x[k] for x in kept["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")), "an added token isn't plain"
            made.added = {x["content"]: x["id"] for x in kept["added_tokens"]}
            _loaded[path] = made
        return _loaded[path]

    ids_of: np.ndarray | None = None
    #: Texts that are one id wherever they stand, looked for before anything is prepared.
    added: dict[str, int] = {}

    def merge_matrix(self, letters: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, padded with -1; their number) of each row of bytes."""
        n, w = letters.shape
        ids = np.where(np.arange(w) < lengths[:, None], self.first[letters], -1).astype(np.int32)
        if self.last is not None:
            r = np.arange(n)
            ids[r, lengths - 1] = self.last[letters[r, lengths - 1]]
        out = np.full((n, w), -1, np.int32)
        rows = np.arange(n)
        ranks = np.full((n, max(1, w - 1)), NONE, np.int32)
        if w > 1:
            ranks[:] = self.pairs.ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, w - 1)
        while len(rows):
            at = ranks.argmin(1)  # the first, so the leftmost of equal ranks
            r = np.arange(len(rows))
            best = ranks[r, at]
            over = best == NONE
            if over.any():
                out[rows[over], : ids.shape[1]] = ids[over]
                go = ~over
                ids, ranks, rows, at, best = ids[go], ranks[go], rows[go], at[go], best[go]
                r = r[: len(rows)]
                if not len(rows):
                    break
            w = ids.shape[1]
            # close up: what stands right of the merged pair moves one to the left
            right_of = np.arange(w - 1) > at[:, None]
            closed = np.where(right_of, ids[:, 1:], ids[:, :-1])
            shut = np.where(right_of[:, :-1], ranks[:, 1:], ranks[:, :-1]) if w > 2 else ranks[:, :0]
            closed[r, at] = best
            ids = closed
            if w == 2:
                ranks = np.full((len(rows), 1), NONE, np.int32)
                continue
            ranks = shut
            last = w - 2
            right = np.where(at < last, ids[r, np.minimum(at + 1, last)], -1)
            left = np.where(at > 0, ids[r, np.maximum(at - 1, 0)], -1)
            fresh = self.pairs.ranks(np.concatenate([best, left]), np.concatenate([right, best]))
            inner = at < last
            ranks[r[inner], at[inner]] = fresh[: len(r)][inner]
            before = at > 0
            ranks[r[before], at[before] - 1] = fresh[len(r) :][before]
        return out, (out >= 0).sum(1)

    def _merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(words), np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words))
        return self._flat(encoding.Words(data, np.cumsum(length) - length, length, np.zeros(len(words), np.int64), 1))

    def _flat(self, words: encoding.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of each word)."""
        buckets, number = encoding.distinct(words)
        flat, counts = [], []
        for letters, lengths in buckets:
            step = max(1, 1_500_000 // letters.shape[1])
            for a in range(0, len(letters), step):
                ids, n = self.merge_matrix(letters[a : a + step], lengths[a : a + step])
                flat.append(ids[ids >= 0])
                counts.append(n)
        pool = np.concatenate(flat) if flat else np.empty(0, np.int32)
        count = np.concatenate(counts) if counts else np.empty(0, np.int64)
        begin = np.cumsum(count) - count
        n = count[number]
        ends = np.cumsum(n)
        index = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(begin[number], n)
        out = pool[index]
        return (out if self.ids_of is None else self.ids_of[out]), n

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(uint16 ids of all texts, one after another; where each text's ids begin, and the end)."""
        if not any(a in x for x in texts for a in self.added):
            return self._encode_plain(texts)
        pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        pieces = [pattern.split(x) for x in texts]  # text, token, text, ..., text
        flat, at = self._encode_plain([p for x in pieces for p in x[::2]])
        ends = np.cumsum([len(x) // 2 + 1 for x in pieces])
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        flat = np.insert(flat, at[1:][inner], np.array([self.added[p] for x in pieces for p in x[1::2]], "<u2"))
        tokens = np.cumsum([len(x) // 2 for x in pieces])
        return flat, np.concatenate([[0], at[ends] + tokens])

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.prepare is not None:
            texts = [self.prepare(x) for x in texts]
        if not texts:
            return np.empty(0, "<u2"), np.zeros(1, np.int64)
        words = encoding.cut(texts, self.spaces_join)
        flat, n = self._flat(words)
        per_text = np.bincount(words.text, weights=n, minlength=len(texts)).astype(np.int64)
        return flat.astype("<u2"), np.concatenate([[0], np.cumsum(per_text)])

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _splits(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    return {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(other)) for b in range(256)]


def _lowered(text: str) -> str:
    # character by character: the final sigma isn't looked at
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()


def text_batches(texts: list[str], most: int = 3_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters in all; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


ROUND_TRIP = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes each text of docs (doc_id, text), decodes the ids and digests both."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBPE.from_ranks(path)
        for b in batches:
            texts = [x if isinstance(x, str) else "" for x in b["text"]]
            rows = []
            for a, z in text_batches(texts):
                flat, at = bpe.encode(texts[a:z])
                for i in range(z - a):
                    got = flat[at[i] : at[i + 1]].tolist()
                    rows.append((len(got), hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, got)).encode()).hexdigest(), hashlib.sha256(bpe.decode(got)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return map_with_ids(docs.select(F.col("doc_id").cast("long"), "text"), work, ROUND_TRIP, "doc_id")
