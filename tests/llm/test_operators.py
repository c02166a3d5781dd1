"""Training-data operators against brute force, exact round trips and odd inputs."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillgraph.llm import ann, bpe, chat, near_dup, packing, pii, quality, token_files, toxicity, url_filter

ODD = [None, "", " ", "a", "  two  spaces ", "x\n \ny", "It's 12'34 don't", "\x00a\x1c b\u3000c", "ΑΣ ΣΑΣ é é 😀", "w" * 3000, "one two three four\n" * 400]


def frame(spark, texts, extra=False):
    rows = [(i, t, "en", f"src{i % 2}", 0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({"score": F.lit(1), "first": F.lit("x"), "start": F.lit(0), "kept": F.lit(True)}) if extra else df


def many(n=300, seed=1):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("abcdeé'1 ") for _ in range(rnd.randint(1, 7))) for _ in range(150)]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(0, 120))) for _ in range(n)]
    for i in range(0, n, 3):  # copies with a word changed
        words = texts[rnd.randrange(n)].split(" ")
        if len(words) > 20:
            words[rnd.randrange(len(words))] = "changed"
        texts[i] = " ".join(words)
    return texts


# ---- op1


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(digits(m)) <= 15),
    )
    found = sorted((m.start(), k, m.end(), n) for k, (n, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0]))
    return ",".join(f"{n}:{s}:{e}" for s, _, e, n in found)


def test_pii_equals_brute_force(spark):
    rnd = random.Random(3)
    texts = ODD + ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111-", "+1 (988) 555-2485 4111111111111111", "a@b.c " * 600, "9" * 2000, "GB82 WEST 1234 5698 7654 32"]
    texts += ["".join(rnd.choice("0123456789..--  ++@@ab()é") for _ in range(rnd.randint(0, 90))) for _ in range(400)]
    got = {r["doc_id"]: r for r in pii.digest(pii.detect(frame(spark, texts, extra=True))).collect()}
    for i, t in enumerate(texts):
        assert got[i]["base_sha256"] == hashlib.sha256(base_spans(t or "").encode()).hexdigest(), t
    assert "iban:0:27" in got[len(ODD) + 6]["spans"]
    spans = got[len(ODD) + 3]["spans"]
    assert "phone:0:17" in spans and "card:18:34" in spans


def test_pii_mask(spark):
    df = frame(spark, ["hi a@b.cd 1.2.3.4", None, "clean"])
    assert [r["text"] for r in pii.mask(pii.detect(df)).orderBy("doc_id").collect()] == ["hi [EMAIL] [IP]", None, "clean"]


def test_pii_mask_equals_brute_force(spark):
    """Long texts, many spans, overlaps and places about the slabs' edges."""
    rnd = random.Random(12)
    bits = ["a@b.cd", "1.2.3.4", "+1 988 555 2485", "4111 1111 1111 1111", " ", "é", "\n", "word ", "x" * 500, "😀" * 300]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 40))) for _ in range(150)] + ["x" * 1017 + " a@b.cd", "y" * 1024 + " a@b.cd", "a@b.cd " * 3000, "z" * 5000]
    found = pii.detect(frame(spark, texts))
    got = {r["doc_id"]: r["text"] for r in pii.mask(found).collect()}
    for r in found.collect():
        t, at, out = texts[r["doc_id"]], 0, []
        for start, k, end, _ in r["pii"]:
            if start >= at:
                out += [t[at:start], f"[{pii.KINDS[k].name.upper()}]"]
            at = max(at, end)
        assert got[r["doc_id"]] == "".join(out) + t[at:]


# ---- op2, op6, op9


@pytest.mark.parametrize("n, most", [(1, 16), (2, 16), (5, 3), (700, 11)])
def test_code_lengths(n, most):
    rng = np.random.default_rng(n)
    counts = np.zeros(2000, np.int64)
    counts[rng.choice(2000, n, replace=False)] = (rng.pareto(0.3, n) * 5 + 1).clip(1, 1e15).astype(np.int64)
    lengths = token_files.code_lengths(counts, most)
    assert lengths.max() <= most and (lengths > 0).sum() == n and (n == 1 or (2.0 ** -lengths[lengths > 0]).sum() == 1)


def library_ids(name, text, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_token_files_round_trip(spark, tmp_path):
    texts = ODD + many(60)
    path = "file://" + str(tmp_path / "files")
    token_files.write_tokens(frame(spark, texts, extra=True), path, shards=3)
    got = sorted(tuple(r) for r in token_files.with_starts(token_files.read_tokens(spark, path), spark, path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    start = 0
    for i, t in enumerate(texts):
        ids = library_ids("word_bpe_49k.json", t, 2)
        assert got[i] == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_byte_bpe_equals_library():
    import tiktoken

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab é1'sn \n\t  ,.!😀\x1c 'rvemldtΣ\x00") for _ in range(rnd.randint(0, 60))) for _ in range(800)]
    made = bpe.ByteBPE.from_ranks(path)
    flat, at = made.encode(texts)
    for i, t in enumerate(texts):
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == want.encode_ordinary(t) and made.decode(ids) == t.encode()


def test_packing_places_every_id_once(spark):
    texts = ODD + many(80)
    rows = [tuple(r) for r in packing.pack_documents(frame(spark, texts, extra=True), window=64).collect()]
    windows = {}
    for i, t in enumerate(texts):
        ids = library_ids("byte_bpe_50k.json", t, 1)
        at = 0
        for _, start, n, crc, total, sequence, offset in sorted(r for r in rows if r[0] == i):
            assert start == at and n > 0 and total == len(ids) and crc == zlib.crc32(ids[start : start + n].tobytes())
            windows.setdefault(sequence, []).append((offset, n))
            at += n
        assert at == len(ids)
    for places in windows.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64 and at & (at - 1) == 0


def test_added_tokens_equal_library(spark, tmp_path):
    from tokenizers import Tokenizer

    rnd = random.Random(8)
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n y  <|ENDOFTEXT|>", "plain", None, "<|startoftext|>É <|endoftext", "<|endoftext|> <|startoftext|>"]
    texts += ["".join(rnd.choice(["<|endoftext|>", "<|startoftext|>", "<|", " ", "  ", "don't", "É9", "\n"]) for _ in range(rnd.randint(0, 12))) for _ in range(200)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        library = Tokenizer.from_file(public_tokenizers.path(name))
        flat, at = bpe.ByteBPE.from_json(public_tokenizers.path(name)).encode([t or "" for t in texts])
        want = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [flat[at[i] : at[i + 1]].tolist() for i in range(len(texts))] == want
        if name == "word_bpe_49k.json":
            path = "file://" + str(tmp_path / "added")
            token_files.write_tokens(frame(spark, texts), path, shards=3)
            for r in token_files.read_tokens(spark, path).collect():
                ids = np.array([*want[r["doc_id"]], 2], "<u4")
                assert (r["n_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(ids.tobytes()))
        else:
            for r in packing.pack_documents(frame(spark, texts), window=64).collect():
                ids = np.array([*want[r["doc_id"]], 1], "<u4")
                assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())


# ---- op3


def test_restoring_disguised_words():
    grams = {}
    for w in ("idiot", "stupid", "moron", "loser", "pathetic", "hello", "there", "trash") * 20:
        t = "\x02" + w + "\x03"
        for i in range(1, len(t)):
            for g in (t[i], t[i - 1 : i + 1], t[max(0, i - 2) : i + 1]):
                grams[g] = grams.get(g, 0) + 1
    model = toxicity.CharModel.of(grams)
    for token, word in (("1d10t", "idiot"), ("s t u p i d", "stupid"), ("m.o.r.o.n", "moron"), ("l000ser", "loser"), ("p@thetic", "pathetic"), ("idiooooot", "idiot"), ("tr@$h", "trash")):
        assert toxicity.suspects(f"a {token} b"[1:]) and toxicity.restore(token, model) == word


def test_toxicity_learns_and_reads_disguise(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("aeiourstnlm") for _ in range(rnd.randint(3, 8)))
    texts = [" ".join(word() for _ in range(30)) + (" idiot loser" if i % 4 == 0 else "") for i in range(200)] + ["you 1d10t there", None, "", "fine words here"]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(7, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels, ~toxicity.held_out(F.col("doc_id"))).collect()}
    assert all(got[i]["predicted"] == int(i % 4 == 0) for i in range(200))
    assert got[200]["predicted"] == 1 and got[201]["score"] == 0 and got[202]["score"] == 0 and got[203]["predicted"] == 0


# ---- op4


def test_url_rules_and_tree(spark):
    odd = [(1, None), (2, "x"), (3, "http://"), (4, "HTTP://A.Example.ORG/es/1?x#y"), (5, "http://org"), (6, "a://b://c/d"), (7, "http://xorg/"), (8, "http://é.ORG:80/en/1"), (9, "http://h/" + "a/" * 500)]
    blocked = [(100 + i, f"http://bad.com/de/{i}") for i in range(40)] + [(200 + i, f"http://bad.com/en/{i}") for i in range(30)] + [(300 + i, f"http://good.com/fr/{i}") for i in range(40)] + [(400, "http://good.com/en/1")]
    got = {r["page_id"]: r for r in url_filter.filter_urls(spark.createDataFrame(odd + blocked, "page_id long, url string")).collect()}
    assert (got[1]["host"], got[1]["path"], got[1]["rule"]) == ("", "", None)
    assert (got[4]["host"], got[4]["path"], got[4]["rule"], got[4]["verdict"]) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[4]["rule"] == "example.org/es/" and got[5]["rule"] is None and got[7]["rule"] is None and got[8]["rule"] is None and got[8]["host"] == "é.org:80"
    assert got[6]["host"] == "b:" and got[100]["rule"] == "com/de/" and got[200]["verdict"] == "block" and got[400]["verdict"] == "allow"


# ---- op5


def test_quality_equals_brute_force(spark):
    texts = ODD + many(120) + ["a b c d a b c e a b c", "x y z " * 30]
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        seen = {g: grams.count(g) for g in set(grams)} if len(grams) < 2000 else {g: 2 for g in set(grams)}
        marked = {k for j, g in enumerate(grams) if seen[g] > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(marked)), t
        assert r["base_failed"] == (len(w) < 50 or 100 * len(marked) > 50 * len(w))


def test_boilerplate_goes_and_copies_stay(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("aeiourstnlm") for _ in range(rnd.randint(3, 8)))
    line = "this line stands in very many documents"
    body = lambda: " ".join(word() for _ in range(80))
    copy = "\n".join(" ".join(word() for _ in range(12)) for _ in range(8))
    texts = [f"{body()}\n{line}" for _ in range(8)] + ["\n".join([line.replace("very", "very")] * 12 + [word() for _ in range(3)])] + [copy] * 30
    rules = quality.QualityRules(max_documents_per_host=3, max_repeat_pct=200)
    got = {r["doc_id"]: r for r in quality.quality(frame(spark, texts).withColumn("source", F.lit("s")), rules).collect()}
    assert all(got[i]["kept"] and got[i]["n_removed_lines"] == 1 and line not in got[i]["clean_text"] for i in range(8))
    assert not got[8]["kept"] and all(got[i]["kept"] and got[i]["n_removed_lines"] == 0 for i in range(9, 39))


def test_boilerplate_of_several_lines(spark):
    """Documents that share all lines but one are as many as they are."""
    rnd = random.Random(6)
    shared = [f"shared menu or footer line number {j}" for j in range(20)]
    texts = ["\n".join([*shared, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(12))]) for _ in range(60)] + ["\n".join(shared)] * 5
    got = quality.quality(frame(spark, texts).withColumn("source", F.lit("s"))).collect()
    assert all(r["n_removed_lines"] == 20 and not r["kept"] for r in got)


def test_boilerplate_of_any_length(spark):
    rnd = random.Random(7)
    passage, own = " ".join(["all rights are reserved to the holders of this licence"] * 9), lambda: " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60))
    texts = [f"Home\n\n{own()}\n{passage}" for _ in range(60)]
    got = quality.quality(frame(spark, texts).withColumn("source", F.lit("s"))).collect()
    assert all(r["n_removed_lines"] == 2 and r["clean_text"] == "\n" + texts[r["doc_id"]].split("\n")[2] for r in got)


# ---- op7


def test_search_recall_and_order(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((600, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(0))
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=10, probing=ann.Probing(hashes=3)).collect()
    assert {r["vec_id"] for r in got}.isdisjoint({900, 901, 902}) and {r["query_id"] for r in got} == set(range(0, 600, 20))
    ids = np.array([*range(600), 903])
    all_ = np.vstack([v, v[:1]])
    hit = 0
    for q in range(0, 600, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        s = all_ @ v[q]
        s[ids == q] = -np.inf
        hit += len({m[1] for m in mine} & set(ids[np.lexsort((ids, -s))[:10]].tolist()))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
    assert hit >= 0.9 * 300


@pytest.mark.parametrize("spread, probing, least", [(0.3, ann.Probing(hashes=4), 0.9), (2.0, ann.Probing(hashes=4), 0.9), (1.0, ann.Probing(hashes=12, tables=1, probes=1), 1.0)])
def test_search_with_uneven_norms(spark, spread, probing, least):
    """The last case meets too few vectors by its cells, so all are scored."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal((1000, 64))
    v *= (np.exp(spread * rng.standard_normal(1000)) / np.linalg.norm(v, axis=1))[:, None]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, k=20, probing=probing).collect()
    hit = 0
    for q in range(0, 1000, 20):
        s = v @ v[q]
        s[q] = -np.inf
        mine = {r["vec_id"] for r in got if r["query_id"] == q}
        assert len(mine) == 20
        hit += len(mine & set(np.argsort(-s)[:20].tolist()))
    assert hit >= least * 1000


# ---- op8


def word_sets(texts):
    """Sets of 5-word shingles as tuples of strings, apart from the operator's own hashes."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for t in texts]
    return [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]


def smallest_reachable(sets):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(i) for i in range(len(sets))]


def test_near_duplicates_equal_brute_force(spark):
    texts = ODD + many(200) + ["same words only here"] * 3
    sets = word_sets(texts)
    want = smallest_reachable(sets)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(frame(spark, texts, extra=True)).collect()}
    for i in range(len(texts)):
        assert (got[i]["n_shingles"], got[i]["component_id"], got[i]["kept"]) == (len(sets[i]), want[i], want[i] == i)


def test_near_duplicates_of_a_family_at_the_limit(spark):
    """Documents of one template that mostly lie just below the limit: few pairs link, and none may be lost."""
    rnd = random.Random(22)
    new = lambda: f"w{rnd.randrange(10**9)}"
    base = [new() for _ in range(600)]
    texts = []
    for _ in range(400):
        w = list(base)
        for at in rnd.sample(range(600), 11):
            w[at] = new()
        texts.append(" ".join(w))
    want = smallest_reachable(word_sets(texts))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert len(set(want)) > 1 and [got[i] for i in range(len(texts))] == want


def test_near_duplicates_odd_rows(spark):
    """Repeated rows share a component, null ids take no part, very long texts are whole."""
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (4, long), (3, long + " more"), (5, None)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got), key=str) == sorted([(1, 2, 1, True)] * 2 + [(None, 2, 1, False), (4, 59_996, 3, False), (3, 59_997, 3, True), (5, 0, 5, True)], key=str)


def test_near_duplicates_in_a_region_of_many_components(spark):
    rnd = random.Random(9)
    new = lambda n: [f"w{rnd.randrange(10**9)}" for _ in range(n)]
    template, bodies = new(200), [new(35) for _ in range(900)]
    # four words of its body are all that joins each of the last 30 to one of the others
    texts = [" ".join(template + b) for b in bodies] + [" ".join(template + b[:4] + new(31)) for b in bodies[::30]]
    sets = [set(near_dup.shingles(t).tolist()) for t in texts]
    similar = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    want = [*range(900), *range(0, 900, 30)]
    assert all((similar(i, j) >= 0.75) == (want[i] == want[j]) for i in range(len(texts)) for j in range(i))
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == want


# ---- op10


def test_chat_round_trip(spark):
    texts = ODD + [r"\### Assistant: </turn> ok", "<image:0> \\l \\\\h ### x", "### a\n</turn>\n<turn>"]
    rows = [(i % 4, i, ("user", "assistant", None)[i % 3], t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("x"))
    got = {r["conv_id"]: r for r in chat.digest_formatted(chat.format_conversations(df)).collect()}
    for c in range(4):
        mine = [r for r in rows if r[0] == c]
        loss = "".join(t or "" for _, _, role, t in mine if role == "assistant")
        r = got[c]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role or ''}\n{t or ''}\n" for _, _, role, t in mine).encode()).hexdigest()
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_parts():
    out = chat.format_turn("user", None, '[{"type": "text", "text": "see <image:9>"}, {"type": "image", "ref": "a.png", "width": 57, "height": 28}, {"type": "audio", "ref": "b.wav", "seconds": 2}]')
    assert chat.read_segment(out["segment"])[1] == "see <image:9><image:0><audio:1>" and out["expanded_tokens"] == 3 + 50


# ---- all: empty tables


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, [])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    token_files.write_tokens(docs, "file://" + str(tmp_path / "none"), shards=2)
    frames = [
        pii.digest(pii.detect(docs)), token_files.read_tokens(spark, "file://" + str(tmp_path / "none")), toxicity.toxicity(docs, labels, F.lit(True)),
        url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string")), quality.quality(docs), bpe.round_trip(docs),
        ann.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True)), near_dup.near_duplicates(docs), packing.pack_documents(docs),
        chat.digest_formatted(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    ]
    assert [f.count() for f in frames] == [0] * 10
