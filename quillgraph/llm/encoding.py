"""Cutting whole texts into the words a tokenizer merges separately, in numpy.

A batch of texts becomes one array of code points and one of UTF-8 bytes. Word starts follow
from the classes of neighbouring code points (letter, number, white space, other), so that no
regular expression runs over the texts. Equal words are brought together exactly, on their bytes.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE, GAP = range(5)
#: White space as the tokenizers' libraries have it (Unicode White_Space).
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(0x110000)), np.uint8, 0x110000)
    table[_WHITE] = SPACE
    return table


class Words:
    """Words of a batch: byte offsets in `data`, and the number of the text each belongs to."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, text: np.ndarray, texts: int):
        self.data, self.start, self.length, self.text, self.texts = data, start, length, text, texts


def cut(texts: list[str], spaces_join: bool) -> Words:
    """spaces_join: a space before a word is its first byte and white space makes words too
    (byte-level BPE's pattern); otherwise white space is dropped and numbers stand alone."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(joined.encode(), np.uint8)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))) - 1
    kind = classes()[points]
    kind[ends] = GAP
    start = np.empty(len(kind), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start[ends] = True
    start[ends[:-1] + 1] = True
    if spaces_join:
        word = np.nonzero((kind[1:] < SPACE) & (kind[:-1] == SPACE))[0] + 1  # a word after white space
        start[word - 1] = True
        start[word[points[word - 1] == 0x20]] = False
    else:
        start |= kind == NUMBER
    quote = np.nonzero((points == 0x27) & start)[0]
    for tail in ("s", "t", "re", "ve", "m", "ll", "d"):
        n = len(tail)
        q = quote[quote + n < len(points)]
        for j, c in enumerate(tail, 1):
            q = q[points[q + j] == ord(c)]
        start[q + 1] = False
        start[q + n + 1] = True
    at = np.nonzero(start)[0]
    wide = len(data) != len(points)
    sizes = (1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)).astype(np.int64) if wide else None
    offset = np.concatenate([[0], np.cumsum(sizes)]) if wide else np.arange(len(points) + 1)
    bounds = np.append(at, len(points))
    begin = offset[bounds]
    keep = kind[at] != GAP
    if not spaces_join:
        keep &= kind[at] != SPACE
    text = np.searchsorted(ends, at[keep])
    return Words(data, begin[:-1][keep], np.diff(begin)[keep], text, len(texts))


def distinct(words: Words) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """([(matrix, lengths)] of distinct words by length bucket, padded with zeros; the number of
    each word's distinct word, counted through the buckets)."""
    buckets: list[tuple[np.ndarray, np.ndarray]] = []
    number = np.empty(len(words.start), np.int64)
    total, low = 0, 0
    longest = int(words.length.max(initial=0))
    widths = [4, 8, 12, 16, 24, 32]
    while widths[-1] < longest:
        widths.append(widths[-1] * 2)
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    for width in widths:
        rows = np.nonzero((words.length > low) & (words.length <= width))[0]
        low = width
        if not len(rows):
            continue
        lengths = words.length[rows]
        if width <= 8:  # the bytes and, as words hold no zero padding of their own, the length make the key
            at = words.start[rows]
            key = np.zeros(len(rows), np.uint64)
            for j in range(width):
                key |= np.where(lengths > j, padded[at + j], 0).astype(np.uint64) << np.uint64(8 * (7 - j))
            zero = (words.data == 0).any()
            if zero:
                key2 = np.stack([key, lengths.astype(np.uint64)], 1).copy().view("V16").ravel()
                _, first, inverse = np.unique(key2, return_index=True, return_inverse=True)
            else:
                _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
            first_rows = rows[first]
        else:
            first_parts, inverse = [], np.empty(len(rows), np.int64)
            found = 0
            step = max(1, 40_000_000 // width)
            for a in range(0, len(rows), step):  # so that the matrix of very long words stays small
                r = rows[a : a + step]
                m = _matrix(words.data, words.start[r], words.length[r], width)
                keyed = np.concatenate([m, words.length[r].astype(np.int64)[:, None].view(np.uint8).reshape(len(r), 8)], 1)
                _, f, i = np.unique(np.ascontiguousarray(keyed).view(f"V{width + 8}").ravel(), return_index=True, return_inverse=True)
                first_parts.append(r[f])
                inverse[a : a + step] = i + found
                found += len(f)
            first_rows = np.concatenate(first_parts)
        number[rows] = inverse + total
        total += len(first_rows)
        step = max(1, 20_000_000 // width)
        for a in range(0, len(first_rows), step):
            r = first_rows[a : a + step]
            buckets.append((_matrix(words.data, words.start[r], words.length[r], width), words.length[r]))
    return buckets, number


def _matrix(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int) -> np.ndarray:
    cols = np.arange(width)
    index = np.minimum(start[:, None] + cols, len(data) - 1)
    return np.where(cols < length[:, None], data[index], 0).astype(np.uint8)
