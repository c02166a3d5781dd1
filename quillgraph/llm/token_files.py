"""Token files: canonical length-limited Huffman codes over ids, from global counts.

Writing: texts are encoded once into a scratch table; ids are counted over all documents; a
canonical code of at most MAX_BITS bits follows from the counts. Each document's ids become one
independent run of bits, cut in segments of SEGMENT ids whose bit offsets are kept as checkpoints.
Documents are then dealt into shards by ranges of doc_id and written in ascending order as blocks.
Reading: a block is decoded by table look-up, all its segments side by side from their checkpoints.

The files are a folder: codebook/ (one row: code lengths by id) and shards/ (Parquet rows
shard, block, doc_ids, counts, bit_lengths, checkpoints, payload). Spark commits them, so a lost
executor's part files never count.

Defined results: a null or empty text holds only the end id; repeated doc_ids are kept, in order of
their number of ids and then of their coded bits; null doc_ids come first, and the least long reads
back as one; other columns are ignored; an empty
table gives files without blocks.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillgraph.llm.bpe import ByteBPE, text_batches
from quillgraph.llm.shared import Scratch, map_with_ids

MAX_BITS = 16
SEGMENT = 256
END_ID = 2
DOCS_PER_BLOCK = 512
#: Ids of a block at most, unless one document alone has more.
IDS_PER_BLOCK = 1 << 20
#: Ids of a shard, about, where a session's shuffle partitions would make larger ones.
IDS_PER_SHARD = 1 << 26


# ---- the code


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `most` bits (package-merge); ids without a count get 0."""
    used = np.nonzero(counts)[0]
    lengths = np.zeros(len(counts), np.int64)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    assert len(used) <= 1 << most
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(object)
    plain = [(int(w), i) for i, w in enumerate(weights)]
    # rounds of pairing; a package remembers how many of the lightest leaves each level has
    levels: list[list[int]] = []
    row = [w for w, _ in plain]
    kinds: list[list[bool]] = [[True] * len(row)]
    for _ in range(most - 1):
        packages = [row[i] + row[i + 1] for i in range(0, len(row) - 1, 2)]
        merged = list(heapq.merge(((w, 0) for w, _ in plain), ((w, 1) for w in packages)))
        row = [w for w, _ in merged]
        kinds.append([k == 0 for _, k in merged])
    levels.extend(kinds)
    take = 2 * len(order) - 2
    for kind in reversed(levels):  # the first `take` items of a level: leaves count, packages open two below
        head = np.array(kind[:take], bool)
        leaves = int(head.sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.nonzero(lengths)[0]
    order = used[np.lexsort((used, lengths[used]))]
    n = lengths[order]
    code, last = 0, 0
    steps = np.zeros(len(order), np.uint64)
    for i, size in enumerate(n.tolist()):
        code <<= size - last
        last = size
        steps[i] = code
        code += 1
    codes[order] = steps
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for each MAX_BITS-bit window of the stream."""
    ids, sizes = np.zeros(1 << MAX_BITS, np.uint16), np.ones(1 << MAX_BITS, np.uint8)
    used = np.nonzero(lengths)[0]
    order = used[np.lexsort((used, lengths[used]))]
    spans = np.int64(1) << (MAX_BITS - lengths[order])
    at = np.concatenate([[0], np.cumsum(spans)])
    ids[: at[-1]] = np.repeat(order, spans)
    sizes[: at[-1]] = np.repeat(lengths[order], spans)
    return ids, sizes


def pack(ids: np.ndarray, at: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all documents, each from a full byte; where each begins, and the end; bit offset of each id in its document)."""
    size = lengths[ids]
    bits = np.concatenate([[0], np.cumsum(size)])
    n_bits = bits[at[1:]] - bits[at[:-1]]
    begin = np.concatenate([[0], np.cumsum((n_bits + 7) // 8)])
    inner = bits[:-1] - np.repeat(bits[at[:-1]], np.diff(at))
    pos = inner + np.repeat(begin[:-1] * 8, np.diff(at))
    word = pos >> 5
    value = codes[ids] << (np.uint64(64) - (pos & 31).astype(np.uint64) - size.astype(np.uint64))
    out = np.zeros(int(begin[-1]) // 4 + 3, np.uint64)
    if len(ids):
        first = np.nonzero(np.concatenate([[True], word[1:] != word[:-1]]))[0]
        # disjoint bits, so sums are unions
        out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").view(np.uint8)[: int(begin[-1])], begin, inner


def unpack(payload: np.ndarray, starts: np.ndarray, counts: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """ids of segments beginning at bit `starts`, all decoded side by side, one id a round."""
    ids, sizes = table
    data = np.concatenate([payload, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]  # 24 bits from each byte
    order = np.argsort(-counts, kind="stable")
    pos, n = starts[order].copy(), counts[order]
    base = (np.cumsum(counts) - counts)[order]
    out = np.empty(int(counts.sum()), np.uint16)
    alive = len(n)
    for step in range(int(n[0]) if len(n) else 0):
        while n[alive - 1] <= step:
            alive -= 1
        p = pos[:alive]
        seen = (window[p >> 3] >> (24 - MAX_BITS - (p & 7)).astype(np.uint32)) & ((1 << MAX_BITS) - 1)
        out[base[:alive] + step] = ids[seen]
        p += sizes[seen]
    return out


# ---- writing

_ENCODED = "doc_id long, n int, ids binary"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None) -> DataFrame:
    """(doc_id, n, ids): uint16 little-endian ids of each whole text, with the end id."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = ByteBPE.from_json(tokenizer)
        tail = b"" if end_id is None else np.array([end_id], "<u2").tobytes()
        for b in batches:
            texts = [x if isinstance(x, str) else "" for x in b["text"]]
            ids: list[bytes] = []
            for a, z in text_batches(texts):
                flat, at = bpe.encode(texts[a:z])
                ids += [flat[at[i] : at[i + 1]].tobytes() + tail for i in range(z - a)]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n": [len(x) // 2 for x in ids], "ids": ids})

    return map_with_ids(docs.select(F.col("doc_id").cast("long"), "text"), work, _ENCODED, "doc_id")


def id_counts(encoded: DataFrame, vocabulary: int = 1 << 16) -> np.ndarray:
    """Global counts; a task sends one row for each id that it met."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(vocabulary, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["ids"]), "<u2"), minlength=vocabulary)
        used = np.nonzero(total)[0]
        yield pd.DataFrame({"id": used.astype(np.int32), "n": total[used]})

    rows = encoded.select("ids").mapInPandas(work, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in rows.toLocalIterator():  # at most a row for each id of the vocabulary
        counts[r["id"]] = r["n"]
    return counts


#: What stands for a null doc_id in the files.
_NULL = np.iinfo(np.int64).min


def _stored_ids(ids: pd.Series) -> np.ndarray:
    """Long ids that crossed as text."""
    return np.fromiter((_NULL if x is None else int(x) for x in ids), np.int64, len(ids))


_CODED = "shard int, doc_id long, n int, bits long, checkpoints binary, payload binary"


def _coded(encoded: DataFrame, lengths: np.ndarray, bounds: np.ndarray) -> DataFrame:
    """Each document's bits and, for each of its segments, the bit offset in it. Its shard is the
    number of bounds up to its doc_id, so ascending shards hold ascending doc_ids."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = canonical_codes(lengths)
        for b in batches:
            sizes = b["n"].to_numpy()
            cut = np.flatnonzero(np.diff(np.cumsum(sizes) // IDS_PER_BLOCK, prepend=0)).tolist()
            for x, z in zip([0, *cut], [*cut, len(b)], strict=True):  # so many ids at a time that their bits stay small
                if x == z:
                    continue
                part = b.iloc[x:z]
                ids = [np.frombuffer(v, "<u2") for v in part["ids"]]
                at = np.concatenate([[0], np.cumsum([len(v) for v in ids])]).astype(np.int64)
                data, begin, inner = pack(np.concatenate(ids), at, codes, lengths)
                flat = data.tobytes()
                yield pd.DataFrame(
                    {
                        "shard": np.searchsorted(bounds, _stored_ids(part["doc_id"]), "right").astype(np.int32),
                        "doc_id": part["doc_id"],
                        "n": part["n"],
                        "bits": np.diff(begin) * 8,
                        "checkpoints": [inner[at[i] : at[i + 1] : SEGMENT].astype("<u4").tobytes() for i in range(len(ids))],
                        "payload": [flat[begin[i] : begin[i + 1]] for i in range(len(ids))],
                    }
                )

    return map_with_ids(encoded, work, _CODED, "doc_id")


_BLOCKS = "shard int, block int, doc_ids binary, counts binary, bit_lengths binary, checkpoints binary, payload binary"


def _blocks(coded: DataFrame) -> DataFrame:
    """coded: shard and _CODED, sorted by shard and doc_id within a partition."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []
        shard, block, size = None, 0, 0

        def close() -> tuple:
            d, n, bits, points, data = zip(*held, strict=True)
            return (shard, block, np.array(d, "<i8").tobytes(), np.array(n, "<u4").tobytes(), np.array(bits, "<u8").tobytes(), b"".join(points), b"".join(data))

        for b in batches:
            out = []
            for s, d, n, bits, points, data in zip(b["shard"], _stored_ids(b["doc_id"]), b["n"], b["bits"], b["checkpoints"], b["payload"]):
                if held and (s != shard or len(held) >= DOCS_PER_BLOCK or size + n > IDS_PER_BLOCK):
                    out.append(close())
                    block = block + 1 if s == shard else 0
                    held, size = [], 0
                shard = s
                held.append((d, n, bits, points, data))
                size += n
            if out:
                yield pd.DataFrame(out, columns=[x.split()[0] for x in _BLOCKS.split(", ")])
        if held:
            yield pd.DataFrame([close()], columns=[x.split()[0] for x in _BLOCKS.split(", ")])

    return coded.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(work, _BLOCKS)


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID, shards: int | None = None) -> None:
    """Encodes docs (doc_id, text) and writes the token files to path."""
    spark = docs.sparkSession
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    scratch = Scratch(spark, "tokens")
    encoded = scratch.write(encode_documents(docs, tokenizer, end_id), "encoded")
    counts = id_counts(encoded)
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.astype(np.uint8).tobytes()), MAX_BITS, SEGMENT)], "lengths binary, max_bits int, segment int").coalesce(1).write.mode("overwrite").parquet(f"{path}/codebook")
    shards = shards or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.sum()) // IDS_PER_SHARD)
    cuts = docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [i / shards for i in range(1, shards)], 0.2 / shards) if shards > 1 else []
    bounds = np.unique(np.clip(np.array([x for x in cuts if x is not None], np.float64), -(2.0**63), 2.0**63 - 1024)).astype(np.int64)
    sorted_ = _coded(encoded, lengths, bounds).repartition(len(bounds) + 1, "shard").sortWithinPartitions("shard", "doc_id", "n", "payload")
    _blocks(sorted_).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{path}/shards")
    scratch.drop("encoded")


# ---- reading

_READ = "shard int, block int, place int, doc_id long, n_tokens long, ids_crc32 long, ids binary"


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(shard, block, place, doc_id, n_tokens, ids_crc32, ids): the documents of token files, ids as little-endian uint32."""
    book = spark.read.parquet(f"{path}/codebook").head()
    lengths = np.frombuffer(bytes(book["lengths"]), np.uint8).astype(np.int64)
    segment = book["segment"]
    schema = T._parse_datatype_string(_BLOCKS)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = decode_table(lengths)
        for b in batches:
            for s, k, d, n, bits, points, data in zip(*(b[c] for c in b.columns)):
                docs, n = np.frombuffer(d, "<i8"), np.frombuffer(n, "<u4").astype(np.int64)
                begin = np.cumsum(np.frombuffer(bits, "<u8").astype(np.int64)) - np.frombuffer(bits, "<u8").astype(np.int64)
                parts = (n + segment - 1) // segment
                which = np.repeat(np.arange(len(n)), parts)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(parts) - parts, parts)
                starts = begin[which] + np.frombuffer(points, "<u4")
                counts = np.minimum(segment, n[which] - nth * segment)
                ids = unpack(np.frombuffer(data, np.uint8), starts, counts, table).astype("<u4")
                at = np.concatenate([[0], np.cumsum(n)])
                raw = [ids[at[i] : at[i + 1]].tobytes() for i in range(len(n))]
                known = pd.Series(docs).astype("Int64").mask(docs == _NULL)
                yield pd.DataFrame({"shard": s, "block": k, "place": np.arange(len(n)), "doc_id": known, "n_tokens": n, "ids_crc32": [zlib.crc32(x) for x in raw], "ids": raw})

    return spark.read.schema(schema).parquet(f"{path}/shards").mapInPandas(work, _READ)


def with_starts(read: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """read with start: ids of all documents before it. Totals of shards and blocks come from the
    block headers; only totals of shards are summed in one place, a row each."""
    sizes = F.aggregate(F.sequence(F.lit(0), F.expr("cast(length(counts) / 4 as int) - 1")), F.lit(0).cast("long"), lambda a, i: a + _u32(F.col("counts"), i))
    blocks = spark.read.schema(T._parse_datatype_string(_BLOCKS)).parquet(f"{path}/shards").select("shard", "block", sizes.alias("total"))
    shards = blocks.groupBy("shard").agg(F.sum("total").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = shards.select("shard", F.coalesce(before, F.lit(0)).alias("shard_start"))
    inner = F.sum("n_tokens").over(Window.partitionBy("shard").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1))
    return read.withColumn("inner", F.coalesce(inner, F.lit(0))).join(shards, "shard").withColumn("start", F.col("shard_start") + F.col("inner")).drop("inner", "shard_start")


def _u32(data, i):
    at = lambda j: F.conv(F.hex(F.substring(data, i * 4 + 1 + j, F.lit(1))), 16, 10).cast("long")
    return at(0) + at(1) * 256 + at(2) * 65536 + at(3) * 16777216
