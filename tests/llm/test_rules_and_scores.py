"""Toxicity, URL tree, quality verdicts, nearest neighbours and the pipeline against brute force and odd inputs."""

import collections
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillgraph.llm import ann, catalog, near_dup, packing, pii, quality, toxicity, url_filter
from quillgraph.session import table

SF = "/root/testdata/sf0.001"


def docs_frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")


# ---- op3


def model_of(words):
    grams = collections.Counter()
    for w in words:
        t = "\x02" + w + "\x03"
        for i in range(1, len(t)):
            for g in {t[i], t[i - 1 : i + 1], t[max(0, i - 2) : i + 1]}:
                grams[g] += 1
    return toxicity.CharModel.of(grams)


def test_spaces_break_words():
    model = model_of("you are a such an idiot stupid moron loser hello there trash and the".split() * 20)
    for token, words in (("a s t u p i d", "a stupid"), ("s u c h a m o r o n", "such a moron"), ("s t u p i d", "stupid")):
        assert toxicity.spaced(token) == [token] and toxicity.restore(token, model) == words
    scorer = toxicity.Scorer({"=stupid": 0.95, "=moron": 0.95, "^idio": 0.95}, {n: (model.keys[n], np.diff(model.sums[n])) for n in (1, 2, 3)})
    assert all(scorer.text(t)[0] > 0.7 for t in ("you are a s t u p i d one", "s u c h a m o r o n", "stu" + "u" * 300 + "pid", "- " * 300 + "1d10t " + "x" * 300, "p-q-r-" * 40 + " 1d10t"))
    assert scorer.text("hello there")[0] == 0 == scorer.text("")[0]


def test_character_model_equals_counting():
    """Costs by sorted arrays equal those from plain counts."""
    words = "alpha beta gamma delta été über".split()
    model, grams = model_of(words), collections.Counter()
    for w in words:
        t = "\x02" + w + "\x03"
        for i in range(1, len(t)):
            grams.update({t[i], t[i - 1 : i + 1]} | ({t[i - 2 : i + 1]} if i > 1 else set()))
    vocabulary = len([g for g in grams if len(g) == 1])
    for before, c in (("\x02", "a"), ("al", "p"), ("zz", "q"), ("\x02é", "t"), ("t", "a")):
        p = 1 / vocabulary
        for n in range(min(2, len(before)) + 1):
            context = before[len(before) - n :] if n else ""
            total = sum(m for g, m in grams.items() if len(g) == n + 1 and g[:-1] == context)
            p = (grams[context + c] + 8 * p) / (total + 8)
        assert math.isclose(model.cost(before, c), -math.log(p))


def test_character_counts_equal_brute_force(spark):
    texts = ["Ab ab1cd é", None, "", "x" * 500, "Ab"]
    want = collections.Counter()
    for t in texts:
        for w in toxicity.WORD.findall((t or "").lower()):
            b = "\x02" + w + "\x03"
            for i in range(1, len(b)):
                want[b[i]] += 1
                want[b[i - 1 : i + 1]] += 1
                if i > 1:
                    want[b[i - 2 : i + 1]] += 1
    got = {(r["n"], r["gram"]): r["count"] for r in toxicity.char_counts(docs_frame(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert got == {(len(g), toxicity.pack(g)): m for g, m in want.items()}


def test_toxicity_odd_rows(spark):
    """Repeated ids, one of them without text; null ids and labels; clashing columns; one label only."""
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeiourstnlm") for _ in range(rnd.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(30)) + (" idiot loser" if i % 2 == 0 else ""), "s") for i in range(80)]
    rows += [(0, None, "s"), (0, "another idiot text", "s"), (None, "no id but an idiot loser", "s")]
    docs = docs_frame(spark, rows).withColumns({"score": F.lit("x"), "toxicity": F.lit(1), "predicted": F.lit(None).cast("int")})
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(80)] + [(0, 1), (3, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels, F.lit(True)).collect()
    assert len(got) == 83 and {r["predicted"] for r in got if r["doc_id"] is None} == {1}
    assert sorted(r["predicted"] for r in got if r["doc_id"] == 0) == [0, 1, 1]
    none = toxicity.toxicity(docs, labels.filter("toxic = 0"), F.lit(True))
    assert {r["score"] for r in none.collect()} == {0.0}


# ---- op4


def tree_by_hand(urls, rules, s):
    """The tree in plain Python: {url: verdict} of urls that no rule decides, and all purities."""
    pages = []
    for url in urls:
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        path = path if path.startswith("/") else ""
        fits = [(len(h + p), v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        shape = []
        for x in filter(None, path.split("/")):
            ending = re.search(r"\.[A-Za-z0-9]{1,5}$", x)
            number = re.fullmatch(r"[0-9]+(\.[A-Za-z0-9]{1,5})?", x) or re.fullmatch(r"(?=.*[0-9])[0-9a-fA-F-]{8,}(\.[A-Za-z0-9]{1,5})?", x)
            shape.append("*" + (ending[0] if ending else "") if number else x)
        if s.max_depth and len(shape) > s.max_depth:
            shape = [*shape[: s.max_depth - 1], "**"]
        pages.append((url, host, shape, max(fits)[1] if fits else None))
    names = ["" for _ in pages]
    for level in range(max((len(p[2]) for p in pages), default=0)):
        children = collections.defaultdict(set)
        for (_, host, shape, _), name in zip(pages, names):
            if len(shape) > level:
                children[host, name].add(shape[level])
        names = [name if len(p[2]) <= level else name + "/" + ("*" if len(children[p[1], name]) > s.fan_out else p[2][level]) for p, name in zip(pages, names)]
    own, over, parent, hosts = (collections.defaultdict(lambda: [0, 0]) for _ in range(4))
    up = lambda name: name.rpartition("/")[0]
    for (_, host, _, verdict), name in zip(pages, names):
        for counts, key in ((own, (host, name)), (over, name), (parent, (host, up(name))), (hosts, host)):
            counts[key][0] += verdict is not None
            counts[key][1] += verdict == "block"
    m, b = (sum(x[k] for x in hosts.values()) for k in (0, 1))
    smooth = lambda counts, prior: (counts[1] + s.weight * prior) / (counts[0] + s.weight)
    purity = {}
    for host, above in parent:
        near = []
        for (h, name), (m1, b1) in own.items():
            if (h, up(name)) == (host, above):
                others = over[name][0] - m1
                lent = min(s.borrow, others)
                near.append([m1 + lent, b1 + lent * (over[name][1] - b1) / max(1, others), name])
        near.sort(key=lambda x: (x[0] > 0, x[1] / x[0] if x[0] else 0, x[2]))
        prior = smooth(parent[host, above], smooth(hosts[host], b / max(1, m)))
        branches = []
        for x in near:
            if branches and branches[-1][-1][0] and x[0]:
                y = branches[-1][-1]
                pool = (x[1] + y[1]) / (x[0] + y[0])
                if x[1] / x[0] - y[1] / y[0] <= s.similar * math.sqrt(max(pool * (1 - pool), 1e-9) * (1 / x[0] + 1 / y[0])):
                    branches[-1].append(x)
                    continue
            branches.append([x])
        for branch in branches:
            p = smooth([sum(x[0] for x in branch), sum(x[1] for x in branch)], prior)
            purity |= {(host, x[2]): p for x in branch}
    return {url: (verdict or ("block" if purity[host, name] >= s.reject else "allow"), purity[host, name], verdict) for (url, host, _, verdict), name in zip(pages, names)}


def test_url_tree_equals_brute_force(spark):
    rnd = random.Random(4)
    hosts = ["a.com", "b.com", "www.c.com", "d.net", "e.net", "x.org", "example.org", "m.example.org", "HOST.com"]
    segment = lambda: rnd.choice(["de", "fr", "es", "en", "x", "1", "22.html", "0a1b2c3d", *(f"w{i}" for i in range(30))])
    urls = sorted({f"http://{rnd.choice(hosts)}/" + "/".join([rnd.choice(["de", "fr", "es", "en"]), *(segment() for _ in range(rnd.randint(0, 3)))]) + rnd.choice(["", "/", "?q", "#x/y"]) for _ in range(1500)})
    urls += ["http://d.net", "x", "http://", "http://deep.net/" + "a/" * 60, "://"]
    settings = url_filter.TreeSettings(fan_out=8, max_depth=3)
    want = tree_by_hand(urls, url_filter.RULES, settings)
    got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), settings=settings).collect()
    for r in got:
        verdict, purity, _ = want[urls[r["page_id"]]]
        assert math.isclose(r["purity"], purity, rel_tol=1e-9) and (r["verdict"] == verdict or abs(purity - settings.reject) < 1e-9), urls[r["page_id"]]


def test_url_tree_of_deep_paths(spark):
    """Paths that go on together far below, long ones of their own, and a wide level at depth 15."""
    same = "/".join("abcdefghijklmn")
    urls = [f"http://x.{end}/{lang}/{same}/w{i}/z{i % 3}" for end in ("com", "net") for lang in ("de", "fr") for i in range(25)]
    urls += [f"http://y.com/{lang}/{same}/q/r/{k}" for lang in ("de", "es") for k in "st"] + ["http://y.net/" + "k/" * 900, "http://z.net/" + "k/" * 3 + "e", "http://z.net/" + "k/" * 3]
    settings = url_filter.TreeSettings()
    want = tree_by_hand(urls, url_filter.RULES, settings)
    for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), settings=settings).collect():
        verdict, purity, _ = want[urls[r["page_id"]]]
        assert math.isclose(r["purity"], purity, rel_tol=1e-9) and r["verdict"] == verdict, urls[r["page_id"]][:60]


def test_url_tree_tells_templates_of_a_host_apart(spark):
    """No rule fits net: /es/ is blocked and /fr/ allowed wherever they are labelled."""
    urls = [f"http://h{i % 4}.{end}/{lang}/{i}" for end in ("com", "net", "example.org") for lang in ("de", "en", "es", "fr") for i in range(60)]
    settings = url_filter.TreeSettings()
    want = tree_by_hand(urls, url_filter.RULES, settings)
    got = {urls[r["page_id"]]: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), settings=settings).collect()}
    assert all((got[u]["verdict"], got[u]["rule"] is None) == (want[u][0], want[u][2] is None) for u in urls)
    free = {lang: {got[u]["verdict"] for u in urls if got[u]["rule"] is None and f".net/{lang}/" in u} for lang in ("de", "es", "fr")}
    assert free["es"] == {"block"} and free["fr"] == {"allow"}
    assert len({round(r["purity"], 6) for r in got.values() if r["host"] == "h1.net"}) > 1


def test_url_filter_odd_rows(spark):
    """Repeated rows are judged each; clashing columns are left out; equal shares merge."""
    rows = [(1, "http://a.com/de/1"), (1, "http://a.com/de/1"), (2, None), (None, "http://a.com/es/1"), (3, "http://b.com/de/1"), (4, "http://b.com/it/1")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("x") for c in ("host", "path", "verdict", "template", "purity", "shape")})
    got = url_filter.filter_urls(df).collect()
    assert len(got) == 6 and [r["verdict"] for r in got if r["page_id"] == 1] == ["block", "block"]
    assert {r["host"] for r in got if r["page_id"] == 2} == {""}


# ---- op5


def verdicts_by_hand(rows, rules):
    norm = lambda x: x.strip(" ").lower()
    lines = lambda t: [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    held = collections.defaultdict(set)
    for _, t, source in rows:
        mine = frozenset(map(norm, lines(t)))
        for x in mine:
            held[source, x].add(mine)
    out = []
    for _, t, source in rows:
        gone = [x for x in lines(t) if len(held[source, norm(x)]) > rules.max_documents_per_host]
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        share = len(re.sub(r"[\x20\x09-\x0D]", "", "".join(gone))) / max(1, sum(map(len, words)))
        grams = [tuple(words[j : j + 3]) for j in range(len(words) - 2)]
        seen = collections.Counter(grams)
        marked = {k for j, g in enumerate(grams) if seen[g] > 1 for k in (j, j + 1, j + 2)}
        failed = len(words) < rules.min_words or 100 * len(marked) > rules.max_repeat_pct * len(words)
        clean = "\n".join(x for x in t.split("\n") if x not in gone) if gone else t
        out.append((len(gone), clean, not failed and share <= rules.max_removed_share))
    return out


def test_quality_verdicts_equal_brute_force(spark):
    rnd = random.Random(11)
    shared = ["Home", "a menu line of middling length", "x" * 240, " ".join(["long licence passage"] * 30), "#|"]
    own = lambda n: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    rows = []
    for i in range(150):
        picks = [rnd.choice([x, x.upper(), f"  {x} "]) for x in rnd.sample(shared, rnd.randint(0, 5))] + [own(rnd.choice([3, 12, 60]))]
        rnd.shuffle(picks)
        rows.append((rnd.randrange(100), "\n".join(picks) if i % 17 else None, rnd.choice(["s", "t", None])))
    rows += [rows[3]] * 4 + [(None, rows[5][1], "s"), (None, rows[6][1], "t"), (7, "", "s")]
    rules = quality.QualityRules(min_words=15, max_repeat_pct=101, max_documents_per_host=6)
    docs = docs_frame(spark, rows).withColumns({c: F.lit("x") for c in ("kept", "_row", "_m", "n_removed_lines", "removed_chars", "row", "host", "line", "lines")})
    got = sorted(((r["doc_id"], r["text"], r["source"], r["n_removed_lines"], r["clean_text"], r["kept"]) for r in quality.quality(docs, rules).collect()), key=str)
    want = sorted(((*row, *v) for row, v in zip(rows, verdicts_by_hand(rows, rules))), key=str)
    assert got == want and {v[2] for v in verdicts_by_hand(rows, rules)} == {True, False}


# ---- op7


def recall(spark, v, probing, k=20):
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, k=k, probing=probing).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, len(v), 20):
        s = v @ v[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.argsort(-s)[:k].tolist()))
    return hit / (k * len(range(0, len(v), 20)))


def test_recall_of_the_registered_setting(spark):
    got = collections.defaultdict(set)
    for r in catalog.QUERIES["op7_ann"](spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].add(r["vec_id"])
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").filter("embedding is not null").collect()
    ids, v = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], float)
    hit = total = 0
    for q in got:
        s = v @ v[ids == q][0]
        s[ids == q] = -np.inf
        hit, total = hit + len(got[q] & set(ids[np.argsort(-s)[:20]].tolist())), total + 20
    assert hit >= 0.9 * total


def test_recall_with_structure_sees_few_rows(spark):
    """Where data have structure, the fitted number of projections finds neighbours in small buckets."""
    rng = np.random.default_rng(3)
    v = rng.standard_normal((40, 32)).repeat(50, 0) + 0.1 * rng.standard_normal((2000, 32))
    assert recall(spark, v, ann.Probing(tables=4, bucket=60)) >= 0.9


def test_search_odd_rows(spark):
    """Repeated ids are one vector, lengths other than the usual one take no part."""
    rng = np.random.default_rng(1)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(100)]
    odd = [rows[20], rows[3], (3, [9.0] * 8), (None, [1.0] * 8), (200, [1.0] * 5), (201, []), (202, [float("inf")] * 8), (203, [None] * 8)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"rank": F.lit(0), "v": F.lit(1), "query_id": F.lit(2)})
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=10, probing=ann.Probing(hashes=2)).collect()
    pairs = [(r["query_id"], r["vec_id"]) for r in got]
    assert len(pairs) == len(set(pairs)) == 50 and {p[0] for p in pairs} == set(range(0, 100, 20))
    few = ann.search(df.limit(3), F.lit(True), k=10).collect()
    assert len(few) == 6


# ---- pipeline


def test_pipeline_stages(spark):
    """Each stage on odd rows: nulls, empty and long texts, repeated rows, extra columns, an empty table."""
    rnd = random.Random(8)
    own = lambda n=70: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(n))
    base = own()
    rows = [(1, base, "s"), (2, base, "s"), (3, own() + " mail a@b.cd now", "s"), (4, None, "s"), (5, "", None), (6, own(9000), "t"), (None, own(), None), (3, own(), "s")]
    docs = docs_frame(spark, rows).withColumn("kept", F.lit(1))
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["quality"](spark, docs, SF)
    assert kept.columns == list(corpus_pipeline.COLUMNS) and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "3", "3", "6", "None"]
    clean = stages["toxicity"](spark, kept, SF)
    assert clean.columns == list(corpus_pipeline.COLUMNS) and clean.count() == 6
    single = stages["near_dup"](spark, clean, SF)
    assert single.columns == list(corpus_pipeline.COLUMNS) and sorted(str(r["doc_id"]) for r in single.collect()) == ["1", "3", "3", "6", "None"]
    masked = stages["pii"](spark, single, SF)
    assert masked.columns == list(corpus_pipeline.COLUMNS) and sum("[EMAIL]" in r["text"] and "a@b.cd" not in r["text"] for r in masked.collect()) == 1
    assert masked.filter("n_chars <> length(text)").count() == 0
    packed = stages["packing"](spark, masked, SF)
    assert packed.select("doc_id").distinct().count() == 4
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_equals_its_operators(spark):
    """run() against the operators applied one by one to what stays, in plain Python."""
    docs = table(spark, SF, "documents")
    q = {r["doc_id"]: r["clean_text"] for r in quality.quality(docs).filter("kept").collect()}
    made = docs_frame(spark, [(i, t, "s") for i, t in q.items()])
    bad = {r["doc_id"] for r in toxicity.toxicity(made, table(spark, SF, "labels"), ~toxicity.held_out(F.col("doc_id"))).collect() if r["score"] >= 0.7}
    q = {i: t for i, t in q.items() if i not in bad}
    sets = {i: set(near_dup.shingles(t).tolist()) for i, t in q.items()}
    first: dict[int, int] = {i: i for i in q}

    def find(i):
        while first[i] != i:
            i = first[i]
        return i

    for i in q:
        for j in q:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                first[b] = a
    q = {i: t for i, t in q.items() if find(i) == i}
    text = {r["doc_id"]: r["text"] for r in pii.mask(pii.detect(docs_frame(spark, [(i, t, "s") for i, t in q.items()]))).collect()}
    want = sorted((r["doc_id"], r["doc_tokens"]) for r in packing.pack_documents(docs_frame(spark, [(i, t, "s") for i, t in text.items()])).select("doc_id", "doc_tokens").distinct().collect())
    got = sorted((r["doc_id"], r["doc_tokens"]) for r in corpus_pipeline.run(spark, SF).select("doc_id", "doc_tokens").distinct().collect())
    assert got == want and len(got) > 20


# ---- SQL


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "labels", "conversations", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({catalog.ORACLES[name]}) x").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(str, want))
