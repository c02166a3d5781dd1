"""Column helpers, all inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that can't stand as names without quotes. Fixed values.
RESERVED = (
    "account", "all", "alter", "and", "any", "as", "asc", "between", "by", "case", "cast", "check", "column", "connect", "connection", "constraint",
    "create", "cross", "current", "database", "delete", "desc", "distinct", "drop", "else", "end", "except", "exists", "false", "following", "for", "from",
    "full", "grant", "group", "having", "ilike", "in", "increment", "inner", "insert", "intersect", "into", "is", "issue", "join", "lateral", "left", "like",
    "localtime", "localtimestamp", "minus", "natural", "not", "null", "of", "on", "or", "order", "organization", "qualify", "regexp", "revoke", "right",
    "rlike", "row", "rows", "sample", "schema", "select", "set", "some", "start", "table", "tablesample", "then", "to", "trigger", "true", "try_cast",
    "union", "unique", "update", "using", "values", "view", "when", "whenever", "where", "with",
)
#: Signs that need quotes in a name. Fixed values.
NAME_SIGNS = r"""[-+*/()\[\] .&|!@#$^~`=<>?,;:'"%]"""


def content_id(prefix: str, text: Column) -> Column:
    return F.concat(F.lit(prefix), F.md5(F.encode(text, "utf-8")))


def clean(text: Column) -> Column:
    """Trimmed, common HTML entities resolved, control characters dropped."""
    out = F.trim(text)
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.regexp_replace(out, r"[\x00-\x1f\x7f-\x9f]", "")


def split_markers(text: Column, markers: list[str]) -> Column:
    """Pieces between any of the literal markers, trimmed, blanks dropped."""
    pattern = "|".join(r"\Q" + m + r"\E" for m in markers)
    return F.filter(F.transform(F.split(text, pattern), lambda x: F.trim(x)), lambda x: x != "")


def number_or(text: Column, default: float) -> Column:
    return F.when(text.rlike(r"^[-+]?[0-9]*\.?[0-9]+$"), text.cast("double")).otherwise(F.lit(default))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rescaled_cosine(a: Column, b: Column) -> Column:
    """max(0, (cos + 1) / 2); an empty or zero vector is like nothing (0)."""
    zero = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(b) == 0) | (dot(a, a) == 0) | (dot(b, b) == 0)
    return F.when(zero, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (cosine(a, b) + 1) / 2))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))


def quantize(v: Column, bits: int = 8) -> Column:
    """array<int> codes between the vector's extremes; a constant vector is all zeros."""
    low, high = F.array_min(v).cast("double"), F.array_max(v).cast("double")
    scale = F.when(high > low, (2**bits - 1) / (high - low)).otherwise(F.lit(0.0))
    return F.transform(v, lambda x: F.rint((x.cast("double") - low) * scale).cast("int"))


def ngrams(text: Column, n: int) -> Column:
    """Distinct character n-grams; shorter texts have none."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, many).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def quote_identifier(name: Column) -> Column:
    """Quoted where it has signs, starts with a digit, isn't upper case or is reserved; quotes inside are doubled."""
    odd = (name == "") | name.rlike(NAME_SIGNS) | name.rlike(r"^\p{Nd}") | (name != F.upper(name)) | F.lower(name).isin(*RESERVED)
    return F.when(odd, F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(name)


def column_value(text: Column) -> tuple[Column, Column]:
    """Both sides of the first equals sign, trimmed; without one, the text and null."""
    at = F.instr(text, "=")
    return F.when(at > 0, F.trim(F.substring(text, F.lit(1), at - 1))).otherwise(text), F.when(at > 0, F.trim(F.substr(text, at + 1)))


def pieces(text: Column) -> Column:
    """The text and, at each space, what stands before and after it."""
    words = F.split(text, " ")
    cut = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.array(F.array_join(F.slice(words, F.lit(1), i), " "), F.array_join(F.slice(words, i + 1, F.size(words) - i), " ")))
    return F.when(F.size(words) > 1, F.concat(F.array(text), F.flatten(cut))).otherwise(F.array(text))


def expansions(text: Column) -> Column:
    """The distinct pieces of a text."""
    return F.array_distinct(pieces(text))


def clean_sql(text: Column) -> Column:
    """The first statement on one line, with split comparison signs joined."""
    out = F.regexp_replace(F.split_part(text, F.lit(";"), F.lit(1)), r"\s+", " ")
    return F.trim(F.regexp_replace(out, r"([<>!])\s+=", "$1="))
