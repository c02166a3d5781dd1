"""Tokens of texts by a given tokenizer: ids, counts, text again, and chunks with overlap.

A tokenizer is an object with encode and decode over lists, sent to the tasks once; texts cross in
Arrow batches. The default counts code points, which needs no file. A batch is worked off in pieces of
bounded length, and only chunks leave a task, never a whole text's ids.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.functions.columns import content_id


#: Code points of texts that a task encodes at once; a longer text is a piece of its own.
PIECE = 1 << 18


class Tokenizer(Protocol):
    def encode(self, texts: list[str]) -> list[list[int]]: ...

    def decode(self, ids: list[list[int]]) -> list[str]: ...


class CodePoints:
    def encode(self, texts: list[str]) -> list[list[int]]:
        return [list(map(ord, t)) for t in texts]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return ["".join(map(chr, x)) for x in ids]


@lru_cache(4)
def _loaded(path: str):
    from tokenizers import Tokenizer as Library

    made = Library.from_file(path)
    made.encode_special_tokens = True
    return made


@dataclass(frozen=True)
class FileTokenizer:
    """A tokenizer file, read where it is used; its folder must be there on every executor."""

    path: str

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in _loaded(self.path).encode_batch(texts, add_special_tokens=False)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return _loaded(self.path).decode_batch(ids, skip_special_tokens=False)


def _pieces(lengths: Iterable[int]) -> Iterator[slice]:
    """Neighbours whose lengths together stay within a piece."""
    begin = total = at = 0
    for at, n in enumerate(lengths, 1):
        if total and total + n > PIECE:
            yield slice(begin, at - 1)
            begin, total = at - 1, 0
        total += n
    if at > begin:
        yield slice(begin, at)


def _encoded(tokenizer: Tokenizer, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
    said = [t if isinstance(t, str) else "" for t in texts]
    for piece in _pieces(map(len, said)):
        for ids in tokenizer.encode(said[piece]):
            yield np.asarray(ids, np.int32)


def token_ids(text: Column, tokenizer: Tokenizer) -> Column:
    """array<int>; null counts as empty."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(_encoded(tokenizer, texts)), dtype=object)

    return F.pandas_udf(work, "array<int>")(text)


def token_count(text: Column, tokenizer: Tokenizer) -> Column:
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([len(x) for x in _encoded(tokenizer, texts)], dtype="int32")

    return F.pandas_udf(work, "int")(text)


def token_text(ids: Column, tokenizer: Tokenizer) -> Column:
    """The text of ids; null ids stay null."""

    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            said: list[str] = []
            for piece in _pieces([0 if x is None else len(x) for x in rows]):
                said += tokenizer.decode([[] if x is None else [int(i) for i in x] for x in rows.iloc[piece]])
            yield pd.Series([None if x is None else t for x, t in zip(rows, said, strict=True)], dtype=object)

    return F.pandas_udf(work, "string")(ids)


def token_chunks(docs: DataFrame, tokenizer: Tokenizer | None = None, most: int = 1200, overlap: int = 100) -> DataFrame:
    """(full_doc_id, chunk_order_index, start, tokens, content, chunk_id) of docs (doc_id, text): windows of
    tokens, each beginning most - overlap behind the one before; the tail may lie inside the one before it.
    Contents are trimmed; texts without tokens have no chunk."""
    tokenizer = tokenizer or CodePoints()
    if not 0 <= overlap < most:
        raise ValueError("overlap must be less than a chunk's tokens")
    step = most - overlap

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for piece in _pieces([len(t or "") for t in texts]):
                found = [(row, k, begin, ids[begin : begin + most]) for row, ids in enumerate(_encoded(tokenizer, texts[piece]), piece.start) for k, begin in enumerate(range(0, len(ids), step))]
                # what overlaps is decoded twice, so chunks go out in pieces too
                for part in _pieces([len(ids) for *_, ids in found]):
                    row, order, begin, ids = zip(*found[part], strict=True)
                    said = tokenizer.decode([x.tolist() for x in ids])
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(row)), pa.array(order, pa.int32()), pa.array(begin, pa.int32()), pa.array([len(x) for x in ids], pa.int32()), pa.array(said, pa.string())],
                        names=["full_doc_id", "chunk_order_index", "start", "tokens", "content"],
                    )

    schema = T.StructType([T.StructField("full_doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.IntegerType()) for c in ("chunk_order_index", "start", "tokens")), T.StructField("content", T.StringType())])
    out = docs.select("doc_id", "text").mapInArrow(work, schema).withColumn("content", F.regexp_replace("content", r"^\s+|\s+$", ""))
    return out.withColumn("chunk_id", content_id("chunk-", F.col("content")))
