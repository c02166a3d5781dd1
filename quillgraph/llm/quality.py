"""Quality rules: repetition inside a document and line frequency across documents, in Catalyst only.

A document's lines, of any length but not blank, are normalised and hashed. For each host (column
source) and line the distinct documents holding it are counted; a line above the limit is
boilerplate there and is removed, and a document whose text is mostly such lines is depleted and
rejected. Copies of one document must not make its body look like boilerplate, so documents are
told apart by content: a document is the set of its normalised lines.

Defined results: null and empty texts have no words and fail the base rule; a null source is a
host of its own; texts and lines of any length are whole; a line exactly at the limit stays, and so
does a document that loses exactly the allowed share; repeated rows are treated each and count as
one document; a null doc_id is a row as any other; other columns are kept, but columns that have a
result's name are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"
NOT_BLANK = lambda x: x.rlike("[^\\x20\\x09-\\x0D]")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_pct: int = 50
    #: A line in more distinct documents of a host than this is boilerplate.
    max_documents_per_host: int = 50
    #: A document that loses more than this share of its word characters is depleted.
    max_removed_share: float = 0.7


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES), "")


def _repeat_words(words: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Each window becomes one long, its hash above and its position in the low bits, so that a
    sort of primitives brings equal windows together; neighbours are confirmed on the full hash.
    The repeated starts, sorted again, give the covered words.
    """

    def hashed(w: Column, i: Column) -> Column:
        return F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def count(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w)))
        return let(bits, lambda k: let(packed(w, k), lambda x: let(starts(w, k, x), covered)))

    def unit(k: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), k)

    def packed(w: Column, k: Column) -> Column:
        keys = let(-unit(k), lambda high: F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: hashed(w, i).bitwiseAND(high).bitwiseOR(i.cast("long"))))
        return F.sort_array(keys)

    def starts(w: Column, k: Column, keys: Column) -> Column:
        at = lambda x: x.bitwiseAND(unit(k) - 1).cast("int")
        equal = lambda x, y: F.call_function("shiftrightunsigned", x.bitwiseXOR(y), k) == 0
        near = F.zip_with(keys, F.slice(keys, F.lit(2), F.size(keys)), lambda x, y: F.when(equal(x, y), F.array(at(x), at(y))))
        held = F.filter(near, lambda p: p.isNotNull() & (hashed(w, F.get(p, F.lit(0))) == hashed(w, F.get(p, F.lit(1)))))
        return F.sort_array(F.array_distinct(F.flatten(held)))

    def covered(found: Column) -> Column:
        n = F.size(found)
        step = lambda x, i: F.when(i == n - 1, F.lit(3)).otherwise(F.least(F.lit(3), F.get(found, i + 1) - x))
        return F.aggregate(F.transform(found, step), F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(count(words))


def text_measures(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce("text", F.lit(""))

    def measures(w: Column) -> Column:
        # words have no spaces, so one space between them leaves each as it is
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    lines = F.filter(F.split(text, "\n"), NOT_BLANK)
    return docs.withColumns(
        {
            "_m": let(words_of(text), measures),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        }
    ).withColumns({k: F.col(f"_m.{k}") for k in ("n_words", "word_chars", "n_repeat_words")}).drop("_m")


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(line))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(normal_line(line))


def _lines(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), NOT_BLANK)


def frequent_lines(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """(host, line): hashes of the lines that more documents of a host hold than the limit."""
    hashed = docs.select(F.col("source").alias("host"), F.sort_array(F.array_distinct(F.transform(_lines(F.col("text")), _line_hash))).alias("lines"))
    held = hashed.select("host", F.xxhash64("lines").alias("document"), F.explode("lines").alias("line"))
    return held.distinct().groupBy("host", "line").count().filter(F.col("count") > rules.max_documents_per_host).select("host", "line")


def removed_lines(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """(row, lines, removed_chars, n_removed): hashes of the frequent lines of each row that holds some,
    their word characters and how many they are. docs needs a column row; rows with the same row must be
    alike, and a line counts once for each of its places."""
    measured = F.transform(_lines(F.col("text")), lambda x: F.struct(_line_hash(x).alias("line"), F.length(F.regexp_replace(x, SPACES, "")).alias("chars")))
    held = docs.select("row", F.col("source").alias("host"), F.posexplode(measured).alias("place", "x")).select("row", "host", "place", "x.line", "x.chars")
    found = frequent_lines(docs, rules)
    joined = held.join(found, held["host"].eqNullSafe(found["host"]) & (held["line"] == found["line"]), "left_semi")
    gone = joined.groupBy("row").agg(F.collect_set(F.struct("place", "line", "chars")).alias("gone"))
    chars = F.aggregate("gone.chars", F.lit(0).cast("long"), lambda a, x: a + x)
    return gone.select("row", F.array_distinct("gone.line").alias("lines"), chars.alias("removed_chars"), F.size("gone").cast("long").alias("n_removed"))


MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_removed_lines", "removed_share", "kept", "clean_text")


def quality(docs: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """docs (doc_id, text, source) with the measures, base_failed, n_removed_lines, removed_share, kept
    and clean_text, which is the text without its boilerplate lines."""
    rules = rules or QualityRules()
    docs = docs.drop(*MADE, "_m", "_at", "_row", "_frequent", "_chars", "_n")
    # rows of one id are told apart by content; equal rows have the same lines and need no telling
    row = F.struct(F.col("doc_id"), F.xxhash64("source", "text").alias("content"))
    names = {"row": "_row", "lines": "_frequent", "removed_chars": "_chars", "n_removed": "_n"}
    found = removed_lines(docs.select(row.alias("row"), "source", "text"), rules).withColumnsRenamed(names)
    wide = text_measures(docs).withColumn("_at", row)
    wide = wide.join(found, wide["_at"].eqNullSafe(found["_row"]), "left")
    keep = lambda x: ~(NOT_BLANK(x) & F.array_contains(F.col("_frequent"), _line_hash(x)))
    some = F.col("_frequent").isNotNull()
    clean = F.when(some, F.array_join(F.filter(F.split("text", "\n"), keep), "\n")).otherwise(F.col("text"))
    share = F.when(some, F.col("_chars") / F.col("word_chars")).otherwise(F.lit(0.0))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))
    return (
        wide.withColumns({"clean_text": clean, "base_failed": failed, "n_removed_lines": F.coalesce("_n", F.lit(0).cast("long")), "removed_share": share})
        .withColumn("kept", ~F.col("base_failed") & (F.col("removed_share") <= rules.max_removed_share))
        .drop("_row", "_at", "_frequent", "_chars", "_n")
    )
