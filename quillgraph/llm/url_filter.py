"""URL filters by rules and a tree of path templates.

Each host's paths form a tree of segments. Segments that are numbers or hashes become a wildcard
at once, keeping their ending; below each node, a position with more than FAN_OUT different
segments becomes a wildcard too. Labels are the verdicts of the rules; where a rule fits a page,
it decides, and elsewhere the tree does.

A template's evidence is its own labelled pages and, as its host may hold none, those of the same
template on other hosts, which count as BORROW pages at most. Sibling templates whose shares of
blocked pages don't differ statistically are merged into branches, with or without labels of their
own, and judged on their sum. A branch's purity is smoothed towards its parent's share, that one's
towards the host's, the host's towards the share of all. A template is rejected when its branch's
purity is high.

Paths are counted by (host, shape) first, so a host with a third of all pages is a few rows; the
tree is built level by level on those counts. A path that no other shares its template with keeps
the rest of its segments, so there are as many levels as paths go on together.

Defined results: null urls and urls without :// have an empty host and path, fit no rule and are
judged as any other; paths of any length and depth are read whole; siblings with equal
shares are taken in order of their templates and merge; a purity exactly at the limit rejects;
repeated rows are judged each and counted each; other columns, whatever their names, are left out;
an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillgraph.llm.shared import Scratch

#: (host, path, verdict): fits the host and its subdomains where the path begins with the rule's.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


@dataclass(frozen=True)
class TreeSettings:
    #: Levels of the tree, what lies below being one segment; None: all that paths have.
    max_depth: int | None = None
    fan_out: int = 20
    #: Labelled pages that the prior counts as.
    weight: float = 5.0
    #: Labelled pages that the same template on other hosts counts as, at most.
    borrow: float = 20.0
    #: Siblings whose shares lie within so many standard errors are one branch.
    similar: float = 1.96
    reject: float = 0.8


def parts(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):  # the longest last, so it wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shape(path: Column, depth: int | None) -> Column:
    """Segments with numbers and hashes as wildcards; what lies below the last level, if there is one, is one segment."""
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    ending = lambda x: F.regexp_extract(x, r"(\.[A-Za-z0-9]{1,5})$", 1)
    numbered = lambda x: x.rlike(r"^[0-9]+(\.[A-Za-z0-9]{1,5})?$") | x.rlike(r"^(?=.*[0-9])[0-9a-fA-F-]{8,}(\.[A-Za-z0-9]{1,5})?$")
    general = F.transform(segments, lambda x: F.when(numbered(x), F.concat(F.lit("*"), ending(x))).otherwise(x))
    if depth is None:
        return general
    return F.when(F.size(general) > depth, F.concat(F.slice(general, 1, depth - 1), F.array(F.lit("**")))).otherwise(general)


def template_verdicts(pages: DataFrame, settings: TreeSettings, scratch: Scratch) -> DataFrame:
    """(host, shape, template, purity) of pages (host, shape, verdict)."""
    counts = pages.groupBy("host", "shape").agg(F.count("*").alias("n"), F.count("verdict").alias("labelled"), F.count_if(F.col("verdict") == "block").alias("blocked"))
    columns = counts.columns
    open_, ended, level = scratch.write(counts.withColumn("template", F.lit("")), "counts"), [], 0
    while True:
        child = F.get("shape", F.lit(level))
        groups = open_.groupBy("host", "template").agg(F.count("*").alias("alike"), F.count_distinct(child).alias("children"))
        rest = F.array_join(F.transform(F.slice("shape", level + 1, F.greatest(F.lit(0), F.size("shape") - level)), lambda x: F.concat(F.lit("/"), x)), "")
        last = (F.col("alike") == 1) | (F.size("shape") <= level)
        name = F.when(F.col("children") > settings.fan_out, F.lit("*")).otherwise(child)
        named = F.concat("template", F.when(last, rest).otherwise(F.concat(F.lit("/"), name)))
        step = open_.join(groups, ["host", "template"]).select(*columns, named.alias("template"), (~last & (F.size("shape") > level + 1)).alias("open"))
        step = scratch.write(step, f"level-{level}")
        ended.append(step.filter("not open").drop("open"))
        open_ = step.filter("open").drop("open")
        level += 1
        if open_.isEmpty():
            break
    nodes = reduce(DataFrame.union, ended)

    templates = nodes.withColumn("parent", F.regexp_extract("template", r"(?s)^(.*)/[^/]*$", 1)).groupBy("host", "parent", "template").agg(F.sum("labelled").alias("m"), F.sum("blocked").alias("b"))
    templates = scratch.write(templates, "templates")
    total = templates.agg((F.sum("b") / F.greatest(F.lit(1), F.sum("m"))).alias("p")).head()[0] or 0.0
    w = settings.weight
    smooth = lambda b, m, prior: (b + w * prior) / (m + w)
    hosts = templates.groupBy("host").agg(smooth(F.sum("b"), F.sum("m"), total).alias("host_share"))
    parents = templates.groupBy("host", "parent").agg(F.sum("b").alias("pb"), F.sum("m").alias("pm")).join(hosts, "host")
    parents = parents.select("host", "parent", smooth(F.col("pb"), F.col("pm"), F.col("host_share")).alias("prior"))

    everywhere = templates.groupBy("template").agg(F.sum("m").alias("all_m"), F.sum("b").alias("all_b"))
    wide = templates.join(everywhere, "template")
    lent = F.least(F.lit(settings.borrow), F.col("all_m") - F.col("m"))
    known = wide.select("host", "parent", "template", "m", "b", lent.alias("lent"), (lent * (F.col("all_b") - F.col("b")) / F.greatest(F.lit(1), F.col("all_m") - F.col("m"))).alias("lent_b"))
    known = known.select("host", "parent", "template", (F.col("m") + F.col("lent")).alias("m"), (F.col("b") + F.col("lent_b")).alias("b"))
    # siblings in order of their shares; a gap that is no accident begins a new branch. Without any
    # evidence a template is alone, and its parent's share decides
    known = known.withColumn("share", F.when(F.col("m") > 0, F.col("b") / F.col("m")))
    order = Window.partitionBy("host", "parent").orderBy("share", "template")
    b, m, s = (F.lag(x).over(order) for x in ("b", "m", "share"))
    pooled = (F.col("b") + b) / (F.col("m") + m)
    error = F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-9)) * (1 / F.col("m") + 1 / m))
    fresh = F.when(s.isNull(), 1).when(F.col("share") - s > settings.similar * error, 1).otherwise(0)
    branch = F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))
    branches = known.withColumn("fresh", fresh).withColumn("branch", branch)
    merged = branches.groupBy("host", "parent", "branch").agg(F.sum("b").alias("branch_b"), F.sum("m").alias("branch_m"))
    judged = branches.join(merged, ["host", "parent", "branch"]).join(parents, ["host", "parent"])
    judged = judged.select("host", "template", smooth(F.col("branch_b"), F.col("branch_m"), F.col("prior")).alias("purity"))
    return nodes.select("host", "shape", "template").join(judged, ["host", "template"])


def filter_urls(pages: DataFrame, rules: tuple = RULES, settings: TreeSettings | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of pages (page_id, url)."""
    settings = settings or TreeSettings()
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = parts(F.col("url"))
    wide = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("fit", rule_of(F.col("host"), F.col("path"), rules)).withColumn("shape", shape(F.col("path"), settings.max_depth))
    wide = scratch.write(wide.select("page_id", "host", "path", "shape", "fit.rule", "fit.verdict"), "pages")
    judged = template_verdicts(wide.select("host", "shape", "verdict"), settings, scratch)
    method = F.when(F.col("purity") >= settings.reject, "block").otherwise("allow")
    out = wide.join(judged, ["host", "shape"], "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("verdict", method).alias("verdict"), "template", "purity")


