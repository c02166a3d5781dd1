"""Queries over the training-data tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import ann, bpe, chat, embedding_dup, near_dup, packing, pii, quality, resampling, token_files, toxicity, url_filter, whitening
from quillgraph.llm.shared import Scratch
from quillgraph.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_query
def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = r"\### Assistant: </turn> ok"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], turns.schema)
    return chat.digest_formatted(chat.format_conversations(turns.unionByName(extra)))


@_query
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_lines", "removed_share")


@_query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@_query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "token-files").root
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    read = token_files.read_tokens(spark, path).drop("ids")
    return token_files.with_starts(read, spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


@_query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@_query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


@_query
def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the vectors have no structure to follow: 0.9 recall takes cells wide enough to see most of them (README)
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, probing=ann.Probing(hashes=4))


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.toxicity(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out(F.col("doc_id")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_restored")


@_query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))


@_query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("text"))


@_query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@_query
def op12_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dup.near_duplicates(table(spark, sf_dir, "embeddings"))


# ---- SQL for the operators that SQL can state

_COUNT = lambda text, what: f"(length({text}) - length(replace({text}, '{what}', ''))) // {len(what)}"
_ESCAPED = lambda text: f"length({text}) + " + " + ".join(_COUNT(text, x) for x in ("\\", "<turn>", "</turn>", "<image:", "<audio:", "<document:", "### "))

ORACLES["op10_chat_format"] = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum({_ESCAPED("role")} + {_COUNT("role", " ").replace("' '", "chr(10)")} + {_ESCAPED("text")} + 19)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens FROM t GROUP BY conv_id"""

ORACLES["op8_near_dup"] = """WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY 1) r ON r.a = d.doc_id"""

ORACLES["op5_quality_rules"] = r"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
p AS (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS i FROM w WHERE len(w) > 2),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
c AS (SELECT r, count(DISTINCT i + k) AS n FROM g, (VALUES (0), (1), (2)) AS v(k) WHERE n > 1 GROUP BY r),
l AS (SELECT r, source, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS line FROM d),
n AS (SELECT r, source, line, lower(trim(line, ' ')) AS norm, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM l),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM n GROUP BY r),
s AS (SELECT r, source, list_sort(list(DISTINCT norm)) AS lines FROM n GROUP BY r, source),
f AS (SELECT source, norm FROM (SELECT DISTINCT source, lines, unnest(lines) AS norm FROM s) x GROUP BY source, norm HAVING count(*) > 50),
x AS (SELECT r, count(*) AS n, sum(chars) AS chars FROM n JOIN f ON n.norm = f.norm AND n.source IS NOT DISTINCT FROM f.source GROUP BY r),
m AS (SELECT d.r, doc_id, len(w.w)::BIGINT AS n_words, list_sum(list_transform(w.w, lambda y: length(y)))::BIGINT AS chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
coalesce(u.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS n_removed_lines, coalesce(x.chars, 0) AS removed FROM d JOIN w USING (r) LEFT JOIN u USING (r) LEFT JOIN c USING (r) LEFT JOIN x USING (r)),
o AS (SELECT doc_id, n_words, coalesce(chars, 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_removed_lines::BIGINT AS n_removed_lines, CASE WHEN n_removed_lines > 0 THEN removed::DOUBLE / chars ELSE 0.0 END AS removed_share FROM m)
SELECT *, NOT base_failed AND removed_share <= 0.7 AS kept FROM o"""

# checksums bit by bit over a feature's bytes, once for each distinct feature
ORACLES["op11_resampling"] = r"""WITH x AS (SELECT 'd' AS k, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark),
r AS (SELECT row_number() OVER () AS r, k, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda y: y <> '') AS w FROM x),
f AS (SELECT r, k, unnest(w || list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM r),
h AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM f) q),
b AS (SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(generate_series(1, len(x) - 1, 2), lambda i: [('0x' || substr(x, i, 2))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))), lambda c, y: xor(xor(c, y) >> 1, 3988292384 * (xor(c, y) & 1))), 4294967295) % 10000 AS b FROM h),
c AS (SELECT b, count(*) FILTER (k = 'd') AS s, count(*) FILTER (k = 't') AS t FROM f JOIN b USING (f) GROUP BY b),
n AS (SELECT sum(s)::BIGINT AS s, sum(t)::BIGINT AS t FROM c),
g AS (SELECT b, floor(1000 * ln((c.t + 1) * (n.s + 10000) / ((c.s + 1) * (n.t + 10000))))::BIGINT AS g FROM c, n),
m AS (SELECT r, count(*) AS n, floor(sum(g) / count(*))::BIGINT AS weight FROM f JOIN b USING (f) JOIN g USING (b) WHERE k = 'd' GROUP BY r),
d AS (SELECT r.r, id AS doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || id::VARCHAR), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM r LEFT JOIN m USING (r) WHERE k = 'd'),
o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS all FROM d WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * o.all // 100 THEN rank END::BIGINT AS rank FROM d LEFT JOIN o USING (r)"""

ORACLES["op12_embedding_dup"] = """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a, min(b) AS c FROM reach GROUP BY a), n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id"""
