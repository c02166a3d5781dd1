"""Personal data: regular expressions propose, checksums confirm, context words weigh; Catalyst only.

Each kind's pattern runs over the text once for its matches and once for the text between them;
running sums of both lengths give the places. A candidate's validator (octets, Luhn, digits,
mod-97) must hold; context words just before a candidate raise its score, and kinds that a pattern
alone can't establish count only above a score. Patterns are possessive and anchored at the start
of a run of their own characters, so that long runs cost one pass and no stack.

Base kinds: email, ip, card, phone. Further ones: cards and phones in usual groupings, iban (mod-97), secret (access keys, and values
assigned to or shortly after a secret's name), phone_local (no plus sign, context needed).

Defined results: null and empty texts have no spans; places are code points, end exclusive; kinds
may overlap and are all listed; spans with the same start are listed in the kinds' order; texts of
any length are read whole; repeated rows are treated each; a null doc_id is a row as any other;
other columns are kept, but a column pii is replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTEXT_CHARS = 32
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A text without it has no match; None: always look.
    needs: str | None
    score: float
    context: str | None
    boost: float = 0.3


#: In the order that spans with the same start take.
KINDS = (
    # a run of local characters begins where the previous match ended or after another character
    Kind("email", rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, "mail|contact|e-mail"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", 0.7, r"\bip\b|address|host|server"),
    Kind("card", r"(?:\G|(?<![0-9]))[0-9](?:[\x20-]?[0-9])++", None, 0.8, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+", 0.8, "phone|tel|call|mobile|fax"),
    # the base patterns run through neighbouring digits and then fail whole; these take the usual groupings only
    Kind("card", r"(?<![0-9])(?:[0-9]{14,19}+|[0-9]{4}(?:[\x20-][0-9]{4}){3}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])", None, 0.8, None),
    Kind("phone", r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{4}(?![0-9])", "+", 0.8, None),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])", None, 0.8, "iban|account|bank|konto|cuenta|compte"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|[0-9A-Za-z_-]{16,}+)", None, 0.2, "password|passwd|secret|token|api.?key|access.?key", 0.6),
    Kind("phone_local", r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])", None, 0.3, "phone|tel|call|mobile|fax", 0.4),
)
BASE = ("email", "ip", "card", "phone")
THRESHOLD = 0.6
BLOCK = 256


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """digits: a string of digits only."""
    back = F.reverse(F.transform(F.split(digits, ""), lambda x: F.when(x == "", F.lit(0)).otherwise(x.cast("int"))))
    doubled = lambda x, i: F.when(i % 2 == 0, x).when(x > 4, 2 * x - 9).otherwise(2 * x)
    return F.aggregate(F.transform(back, doubled), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    flat = F.replace(iban, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(flat, F.lit(5)), F.substr(flat, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c < "A", F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda a, c: F.when(c == "", a).otherwise((F.when(value(c) > 9, a * 100).otherwise(a * 10) + value(c)) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(14, 19), luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind == "iban":
        n = F.length(F.replace(match, F.lit(" "), F.lit("")))
        return F.when(n.between(15, 34), mod97(match)).otherwise(F.lit(False))
    if kind == "secret":
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return F.lit(True)


def _places(text: Column, kind: Kind) -> Column:
    """array<struct<start int, m string, before string>> of all matches. Sums run inside blocks of
    matches and over blocks, so that many matches don't copy a growing array each."""
    empty = F.expr("cast(array() as array<struct<start: int, m: string, before: string>>)")

    def pieces(gaps: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
        return F.zip_with(F.slice(gaps, F.lit(1), F.size(gaps) - 1), found, lambda g, m: F.struct(g.alias("g"), m.alias("m")))

    def block(items: Column, at: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            start = a["at"] + F.length(x["g"])
            span = F.struct(start.cast("int").alias("start"), x["m"].alias("m"), F.right(x["g"], F.lit(CONTEXT_CHARS)).alias("before"))
            return F.struct((start + F.length(x["m"])).cast("int").alias("at"), F.concat(a["out"], F.array(span)).alias("out"))

        return F.aggregate(items, F.struct(at.alias("at"), empty.alias("out")), step)

    def all_blocks(items: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(items), F.lit(BLOCK))
        step = lambda a, b: _let(block(F.slice(items, b, F.lit(BLOCK)), a["at"]), lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], r["out"]).alias("out")))
        return F.aggregate(firsts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a["out"])

    spans = _let(F.split(text, kind.pattern), lambda gaps: F.when(F.size(gaps) < 2, empty).otherwise(_let(pieces(gaps), all_blocks)))
    return spans if kind.needs is None else F.when(F.contains(text, F.lit(kind.needs)), spans).otherwise(empty)


SPAN = "array<struct<start: int, k: int, end: int, score: double>>"


def _spans(text: Column, k: int, kind: Kind) -> Column:
    lifted = F.lit(kind.boost) if kind.context else F.lit(0.0)

    def scored(x: Column) -> Column:
        near = F.lower(x["before"]).rlike(kind.context) if kind.context else F.lit(False)
        sure = F.lit(kind.score) if kind.name != "secret" else F.when(x["m"].startswith("AKIA"), F.lit(0.9)).otherwise(F.lit(kind.score))
        score = F.least(F.lit(1.0), sure + F.when(near, lifted).otherwise(F.lit(0.0)))
        return F.struct(x["start"].alias("start"), F.lit(k).alias("k"), (x["start"] + F.length(x["m"])).cast("int").alias("end"), score.alias("score"))

    held = F.filter(_places(text, kind), lambda x: _valid(kind.name, x["m"]))
    out = F.transform(held, scored)
    return out if k < len(BASE) else F.filter(out, lambda x: x["score"] >= THRESHOLD)


def _beside(more: Column, base: Column) -> Column:
    """Spans of `more` that aren't in `base`; places are compared as longs, which are hashed."""
    key = lambda x: x["start"].cast("long") * (1 << 31) + x["end"]
    new = F.array_except(F.transform(more, key), F.transform(base, key))
    k, score = F.get(more, F.lit(0))["k"], F.get(more, F.lit(0))["score"]
    span = lambda x: F.struct(F.call_function("shiftright", x, F.lit(31)).cast("int").alias("start"), k.alias("k"), x.bitwiseAND((1 << 31) - 1).cast("int").alias("end"), score.alias("score"))
    return F.when(F.size(more) == 0, more).otherwise(F.transform(new, span))


def detect(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with pii: array of (start, k, end, score), sorted; k is the kind's place in KINDS."""
    body = F.coalesce(F.col(text), F.lit(""))
    has_digit = body.rlike("[0-9]")
    found = [_spans(body, k, kind) for k, kind in enumerate(KINDS)]
    none = F.expr(f"cast(array() as {SPAN})")
    for k, kind in enumerate(KINDS[len(BASE) :], len(BASE)):
        if kind.name in BASE:
            base = found[BASE.index(kind.name)]
            pair = F.array(F.struct(base.alias("base"), found[k].alias("more")))
            found[k] = None
            found[BASE.index(kind.name)] = F.flatten(F.transform(pair, lambda p: F.concat(p["base"], _beside(p["more"], p["base"]))))
    found = [x for x in found if x is not None]
    digits = F.when(has_digit, F.concat(*found[1:])).otherwise(none)
    return docs.withColumn("pii", F.sort_array(F.concat(found[0], digits)))


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(x.name) for x in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(detected: DataFrame) -> DataFrame:
    base = F.filter("pii", lambda x: x["k"] < len(BASE))
    count = lambda k: F.size(F.filter("pii", lambda x: x["k"] == k)).cast("long")
    return detected.select("doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(BASE)], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii")).alias("spans"))


#: Code points of a slab, from which masking takes what stands between spans.
SLAB = 1024


def mask(detected: DataFrame, text: str = "text") -> DataFrame:
    """detected with every span in `text` replaced by [KIND]; overlapping spans are masked together.

    What stands between spans is taken from slabs of the text and gathered in blocks of spans, so
    that the work grows with the text's length and not with its square."""
    labels = F.array(*[F.lit(f"[{x.name.upper()}]") for x in KINDS])
    none = F.expr("cast(array() as array<string>)")

    def between(slabs: Column, low: Column, high: Column) -> Column:
        i, j = F.floor(low / SLAB).cast("int"), F.floor(high / SLAB).cast("int")
        slab = lambda k: F.coalesce(F.get(slabs, k), F.lit(""))
        one = F.substr(slab(i), low % SLAB + 1, high - low)
        whole = F.when(j > i + 1, F.array_join(F.slice(slabs, i + 2, j - i - 1), "")).otherwise(F.lit(""))
        more = F.concat(F.substr(slab(i), low % SLAB + 1), whole, F.substr(slab(j), F.lit(1), high % SLAB))
        return F.when(i == j, one).otherwise(more)

    def masked(slabs: Column) -> Column:
        def step(a: Column, x: Column) -> Column:
            fresh = F.concat(a["out"], F.array(F.concat(between(slabs, a["at"], x["start"]), F.get(labels, x["k"]))))
            return F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] >= a["at"], fresh).otherwise(a["out"]).alias("out"))

        def block(a: Column, first: Column) -> Column:
            made = F.aggregate(F.slice("pii", first, F.lit(BLOCK)), F.struct(a["at"].alias("at"), none.alias("out")), step)
            return _let(made, lambda r: F.struct(r["at"].alias("at"), F.concat(a["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

        start = F.struct(F.lit(0).alias("at"), none.alias("out"))
        rest = lambda a: F.concat(F.array_join(a["out"], ""), between(slabs, a["at"], F.greatest(a["at"], F.length(text))))
        return F.aggregate(F.sequence(F.lit(1), F.size("pii"), F.lit(BLOCK)), start, block, rest)

    slabs = F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{SLAB}}}"), F.lit(0))
    return detected.withColumn(text, F.when(F.size("pii") > 0, _let(slabs, masked)).otherwise(F.col(text)))
