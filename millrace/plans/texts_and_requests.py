"""Queries over texts, vectors, messages, stores and histories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.catalog import register
from millrace.functions import text as t
from millrace.operators import relevance as r
from millrace.sources import derived as s

from .detection import _q
from .texts import JSON_ARRAYS_SQL, json_arrays

docs = lambda sp, d: s.table(sp, d, "documents")
EST = "CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(length(text) / {c} + 0.5)) END::BIGINT"
register("token_estimate", lambda sp, d: docs(sp, d).select("doc_id", t.estimated_tokens(F.col("text")).alias("tokens")), f"SELECT doc_id, {EST.format(c=4.0)} AS tokens FROM documents")
MODELS = ["claude-3", "gpt-4o-mini", "gemini-pro", "o1", "mistral"]


def _by_model(sp, d):
    model = F.element_at(F.array(*map(F.lit, MODELS)), (F.col("turn") % 5 + 1).cast("int"))
    c = s.table(sp, d, "conversations").withColumn("model", model)
    return c.groupBy("model", t.backend(F.col("model")).alias("backend")).agg(F.sum(t.estimated_tokens(F.col("text"), t.chars_per_token(F.col("model")))).alias("tokens"))


register("token_by_model", _by_model, f"WITH c AS (SELECT *, ['claude-3', 'gpt-4o-mini', 'gemini-pro', 'o1', 'mistral'][(turn % 5 + 1)::INT] AS model FROM conversations) SELECT model, CASE WHEN model IN ('gpt-4o-mini', 'o1') THEN 'bpe' ELSE 'estimate' END AS backend, sum({EST.format(c='(CASE WHEN starts_with(model, ' + chr(39) + 'claude-' + chr(39) + ') THEN 3.5 ELSE 4.0 END)')})::BIGINT AS tokens FROM c GROUP BY model")
register(
    "content_hashes",
    lambda sp, d: docs(sp, d).select("doc_id", *[t.key(F.col("text"), k).alias(k) for k in ("payload", "row", "item", "field", "cluster")]),
    'SELECT doc_id, substr(md5(text), 1, 24) AS payload, substr(sha256(text), 1, 12) AS "row", substr(md5(text), 1, 16) AS item, substr(sha256(text), 1, 8) AS field, substr(md5(text), 1, 8) AS cluster FROM documents',
)
register("json_minify", lambda sp, d: json_arrays(sp, d).select("doc_id", t.minified_json(F.col("text")).alias("text")), f"WITH {JSON_ARRAYS_SQL} SELECT doc_id, regexp_replace(regexp_replace(text, '\": ', '\":', 'g'), ', (\"|\\{{)', ',\\1', 'g') AS text FROM json_arrays")
register("json_bloat", lambda sp, d: json_arrays(sp, d).select("doc_id", F.regexp_count("text", F.lit(r"\},\{|\}, \{|\},\n")).alias("n")).select("doc_id", F.round(F.when(F.col("n") < 4, 0.0).otherwise(F.least(F.lit(1.0), F.col("n") / 49)), 6).alias("bloat")), f"WITH {JSON_ARRAYS_SQL} SELECT doc_id, round(CASE WHEN n < 4 THEN 0.0 ELSE least(1.0, n / 49.0) END::DOUBLE, 6) AS bloat FROM (SELECT doc_id, len(regexp_extract_all(text, '\\}},\\{{|\\}}, \\{{|\\}},\\n')) AS n FROM json_arrays)")


def _voice(sp, d):
    words = t.voice_words(F.concat(F.lit("um, "), F.col("text"), F.lit(" Actually!")))
    return s.table(sp, d, "conversations").select("conv_id", "turn", F.size(words).alias("kept"), F.octet_length(F.array_join(words, " ")).alias("cleaned_chars"))


register(
    "voice_clean",
    _voice,
    r"""WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array('um, ' || text || ' Actually!', '\s+'), lambda w: w <> '' AND lower(regexp_replace(w, '^[^A-Za-z0-9'']+|[^A-Za-z0-9'']+$', '', 'g')) NOT IN ('um', 'uh', 'erm', 'ah', 'like', 'basically', 'actually')) AS k FROM conversations)
SELECT conv_id, turn, len(k)::INT AS kept, strlen(array_to_string(k, ' '))::INT AS cleaned_chars FROM w""",
)


def _sanitize(sp, d):
    m = F.create_map(F.lit("api-key"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("Access_Token"), F.col("c_name"), F.lit("note"), F.concat(F.lit("["), F.repeat(F.col("c_name"), 5)))
    c = s.table(sp, d, "customer").select("c_custkey", t.sanitized(m, 60).alias("m"))
    return c.select("c_custkey", F.explode("m").alias("field", "value"))


register(
    "sanitize_fields",
    _sanitize,
    "SELECT c_custkey, f AS field, CASE WHEN f IN ('api-key', 'Access_Token') THEN '__REDACTED__' WHEN f = 'note' THEN '__LARGE_JSON_ARRAY__' ELSE c_mktsegment END AS value FROM customer CROSS JOIN (SELECT unnest(['api-key', 'segment', 'Access_Token', 'note']) AS f)",
)
register(
    "query_anchors",
    lambda sp, d: s.table(sp, d, "pages").select("page_id", F.explode(t.query_anchors(F.col("url"))).alias("anchor")),
    rf"""WITH a AS (SELECT page_id, unnest(list_concat(regexp_extract_all(url, {_q(t.UUID)}), regexp_extract_all(url, {_q(t.NUMBER_ID)}), regexp_extract_all(url, {_q(t.HOST)}), regexp_extract_all(url, {_q(t.QUOTED)}, 1), regexp_extract_all(url, {_q(t.EMAIL)}))) AS x FROM pages)
SELECT DISTINCT page_id, lower(x) AS anchor FROM a WHERE lower(x) NOT IN ('e.g', 'i.e', 'etc.')""",
)
register("hybrid_alpha", lambda sp, d: docs(sp, d).select("doc_id", t.hybrid_alpha(F.col("text")).alias("alpha")), f"SELECT doc_id, CASE WHEN regexp_matches(text, {_q(t.UUID)}) THEN 0.85 WHEN len(regexp_extract_all(text, {_q(t.NUMBER_ID)})) >= 2 THEN 0.75 WHEN len(regexp_extract_all(text, {_q(t.NUMBER_ID)})) = 1 THEN 0.65 WHEN regexp_matches(lower(text), {_q(t.HOST)}) OR regexp_matches(lower(text), {_q(t.EMAIL)}) THEN 0.6 ELSE 0.5 END::DOUBLE AS alpha FROM documents")
_KIND = "CASE WHEN strlen(html) > 256 THEN CASE WHEN length(html) - length(regexp_replace(html, '[A-Za-z0-9+/=_-]', '', 'g')) >= 0.95 * length(html) AND len(list_distinct(string_split(html, ''))) >= 16 THEN 'base64' WHEN len(regexp_extract_all(html, '<[A-Za-z/!]')) >= 3 THEN 'html' ELSE 'string' END END"
register(
    "opaque_cells",
    lambda sp, d: s.table(sp, d, "pages").select("page_id", t.opaque_kind(F.col("html")).alias("kind"), t.opaque_marker(F.col("html")).alias("marker")),
    f"SELECT page_id, {_KIND} AS kind, CASE WHEN {_KIND} IS NULL THEN html ELSE '<<ccr:' || substr(sha256(html), 1, 12) || ',' || {_KIND} || ',' || CASE WHEN strlen(html) < 1024 THEN strlen(html) || 'B' ELSE printf('%.1fKB', strlen(html) / 1024.0) END || '>>' END AS marker FROM pages",
)
register("marker_keys", lambda sp, d: s.table(sp, d, "pages").select("page_id", F.explode(t.marker_keys(F.concat(F.lit("a "), t.opaque_marker(F.col("html"))))).alias("hash")), "SELECT page_id, substr(sha256(html), 1, 12) AS hash FROM pages WHERE strlen(html) > 256")


def _images(sp, d):
    o = s.table(sp, d, "part").select("p_partkey", (F.col("p_size") * 50 + 7).alias("w"), (F.col("p_size") * 60 + 3).alias("h"))
    hex4 = lambda c: F.lpad(F.hex(c), 8, "0")
    data = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hex4(F.col("w").cast("long")), hex4(F.col("h").cast("long")), F.lit("0806")))
    found = o.withColumn("i", t.image_header(data))
    return found.select("p_partkey", "i.format", "i.width", "i.height", t.image_advice(F.lit(26), F.col("i.width"), F.col("i.height")).alias("advice"))


register("image_header", _images, "SELECT p_partkey, 'png' AS format, p_size * 50 + 7 AS width, p_size * 60 + 3 AS height, CASE WHEN (p_size * 50 + 7)::DOUBLE * (p_size * 60 + 3) / 1e6 > 4 THEN 'large' ELSE 'small' END AS advice FROM part")



def _jpegs(sp, d):
    o = s.table(sp, d, "part").select("p_partkey", (F.col("p_size") * 50 + 7).alias("w"), (F.col("p_size") * 60 + 3).alias("h"))
    hex2 = lambda c: F.lpad(F.hex(c.cast("long")), 4, "0")
    data = F.unhex(F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), hex2(F.col("h")), hex2(F.col("w")), F.lit("03012200021101031101FFD9")))
    return o.select("p_partkey", t.image_size(data).alias("i")).select("p_partkey", "i.format", "i.width", "i.height")


register("image_size", _jpegs, "SELECT p_partkey, 'jpeg' AS format, p_size * 50 + 7 AS width, p_size * 60 + 3 AS height FROM part")

# ---- relevance
TOK = f"regexp_extract_all(lower(text), {_q(t.TERMS)})"
BM25 = f"""d AS (SELECT doc_id, {TOK} AS t FROM documents), c AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM d), cf AS (SELECT doc_id, n, term, count(*) AS f FROM c GROUP BY ALL),
q AS (SELECT query_id, term, count(*) AS qf FROM (SELECT item_id AS query_id, unnest({TOK}) AS term FROM benchmark) GROUP BY ALL), mean AS (SELECT avg(len(t)) AS mean FROM d),
g AS (SELECT query_id, doc_id, sum(ln(2.0) * f * 2.5 / (f + 1.5 * (0.25 + 0.75 * n / mean)) * qf) AS raw, count(*) AS matched, max((strlen(term) >= 8)::INT) AS long FROM cf JOIN q USING (term) CROSS JOIN mean GROUP BY query_id, doc_id),
bm AS (SELECT query_id, doc_id, least(1.0, least(1.0, raw / 10.0) + CASE WHEN long = 1 THEN 0.3 ELSE 0 END)::DOUBLE AS score, matched FROM g)"""


def _bm25(sp, d):
    return r.bm25(docs(sp, d), s.table(sp, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


register("bm25_scores", lambda sp, d: _bm25(sp, d).withColumn("score", F.round("score", 6)), f"WITH {BM25} SELECT query_id, doc_id, round(score, 6) AS score, matched FROM bm")
register(
    "bm25_rank",
    lambda sp, d: _bm25(sp, d).withColumn("score", F.round("score", 6)).withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "doc_id"))).filter("place <= 10").select("query_id", "doc_id", "place"),
    f"WITH {BM25} SELECT query_id, doc_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, doc_id) AS place FROM bm) WHERE place <= 10",
)
register("bm25_boosted", lambda sp, d: _bm25(sp, d).select("query_id", "doc_id", F.round(r.boosted(F.col("score"), F.col("matched")), 6).alias("score")), f"WITH {BM25} SELECT query_id, doc_id, round(CASE WHEN matched >= 2 THEN least(1.0, greatest(score, 0.3) + 0.2) ELSE greatest(score, 0.3) END, 6) AS score FROM bm")


def _cosine(sp, d):
    e = s.table(sp, d, "embeddings")
    return r.nearest(e.select("vec_id", F.col("embedding").alias("v")), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 10)


register(
    "cosine_topk",
    _cosine,
    """WITH j AS (SELECT q.vec_id AS query_id, e.vec_id, round(least(1.0, greatest(0.0, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))))), 5) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM j) WHERE place <= 10""",
)

# ---- messages
messages = s.messages
M = s.MESSAGES_SQL
register("frozen_count", lambda sp, d: messages(sp, d).groupBy("req_id").agg(F.coalesce(F.max(F.when(F.col("ttl").isNotNull(), F.col("msg_idx"))) + 1, F.lit(0)).alias("frozen")), f"WITH {M} SELECT req_id, coalesce(max(msg_idx) FILTER (WHERE ttl IS NOT NULL) + 1, 0) AS frozen FROM messages GROUP BY req_id")
register(
    "ttl_order_violations",
    lambda sp, d: messages(sp, d).withColumn("short", F.max(F.when(F.col("ttl") == "5m", 1)).over(W.partitionBy("req_id").orderBy("msg_idx").rowsBetween(W.unboundedPreceding, -1))).filter("ttl = '1h' AND short = 1").select("req_id", "msg_idx"),
    f"WITH {M} SELECT req_id, msg_idx FROM (SELECT *, max(CASE WHEN ttl = '5m' THEN 1 END) OVER (PARTITION BY req_id ORDER BY msg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS short FROM messages) WHERE ttl = '1h' AND short = 1",
)


def _latest(sp, d):
    m = messages(sp, d)
    floor = m.groupBy("req_id").agg(F.coalesce(F.max(F.when(F.col("ttl").isNotNull(), F.col("msg_idx"))) + 1, F.lit(0)).alias("frozen"))
    live = m.join(floor, "req_id").filter("role = 'user' AND msg_idx >= frozen")
    return live.groupBy("req_id").agg(F.max("msg_idx").alias("msg_idx"))


FROZEN = "fr AS (SELECT req_id, coalesce(max(msg_idx) FILTER (WHERE ttl IS NOT NULL) + 1, 0) AS frozen FROM messages GROUP BY req_id), latest AS (SELECT m.req_id, max(msg_idx) AS msg_idx FROM messages m JOIN fr USING (req_id) WHERE role = 'user' AND msg_idx >= frozen GROUP BY m.req_id)"
register("latest_user_message", _latest, f"WITH {M}, {FROZEN} SELECT * FROM latest")
HOT = ["tool_use", "thinking", "redacted_thinking", "compaction"]


def _manifest(sp, d):
    m = messages(sp, d).join(_latest(sp, d).withColumnRenamed("msg_idx", "live"), "req_id", "left")
    size = F.octet_length("text")
    action = F.when(F.col("live").isNull() | (F.col("msg_idx") != F.col("live")), "frozen").when(F.col("block_type").isin(HOT), "hot").when(size < 512, "below_threshold").otherwise("candidate")
    return m.select("req_id", "msg_idx", action.alias("action"), size.alias("bytes"), t.estimated_tokens(F.col("text")).alias("tokens"))


register("live_zone_manifest", _manifest, f"WITH {M}, {FROZEN} SELECT m.req_id, m.msg_idx, CASE WHEN l.msg_idx IS NULL OR m.msg_idx <> l.msg_idx THEN 'frozen' WHEN block_type IN ('tool_use', 'thinking', 'redacted_thinking', 'compaction') THEN 'hot' WHEN strlen(text) < 512 THEN 'below_threshold' ELSE 'candidate' END AS action, strlen(text)::INT AS bytes, {EST.format(c=4.0)} AS tokens FROM messages m LEFT JOIN latest l ON m.req_id = l.req_id")
register("manifest_totals", lambda sp, d: _manifest(sp, d).groupBy("action").agg(F.count(F.lit(1)).alias("blocks"), F.sum("tokens").alias("tokens")), f"WITH {M}, {FROZEN}, a AS (SELECT CASE WHEN l.msg_idx IS NULL OR m.msg_idx <> l.msg_idx THEN 'frozen' WHEN block_type IN ('tool_use', 'thinking', 'redacted_thinking', 'compaction') THEN 'hot' WHEN strlen(text) < 512 THEN 'below_threshold' ELSE 'candidate' END AS action, {EST.format(c=4.0)} AS tokens FROM messages m LEFT JOIN latest l ON m.req_id = l.req_id) SELECT action, count(*) AS blocks, sum(tokens)::BIGINT AS tokens FROM a GROUP BY action")


def _pairs(sp, d):
    later = W.partitionBy("req_id").orderBy("msg_idx").rangeBetween(1, W.unboundedFollowing)
    m = messages(sp, d).withColumn("response_idx", F.min(F.when(F.col("block_type") == "tool_result", F.col("msg_idx"))).over(later))
    return m.filter("block_type = 'tool_use' AND response_idx IS NOT NULL").groupBy("req_id", F.col("msg_idx").alias("call_idx")).agg(F.min("response_idx").alias("response_idx"))


register("tool_pairs", _pairs, f"WITH {M} SELECT c.req_id, c.msg_idx AS call_idx, min(a.msg_idx) AS response_idx FROM messages c JOIN messages a ON c.req_id = a.req_id AND c.block_type = 'tool_use' AND a.block_type = 'tool_result' AND a.msg_idx > c.msg_idx GROUP BY ALL")
register("retrieve_antijoin", lambda sp, d: messages(sp, d).join(messages(sp, d).filter("block_type = 'tool_use' AND ttl IS NOT NULL").select("req_id").distinct(), "req_id", "left_anti").select("req_id", "msg_idx"), f"WITH {M} SELECT req_id, msg_idx FROM messages WHERE req_id NOT IN (SELECT req_id FROM messages WHERE block_type = 'tool_use' AND ttl IS NOT NULL)")
# How subscription clients name themselves in a user agent.
CLIENTS = ["claude-cli/", "claude-code/", "codex-cli/", "cursor/", "claude-vscode/", "github-copilot/", "anthropic-cli/", "antigravity/"]


def _auth(sp, d):
    e = s.table(sp, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "Cursor/1.2").otherwise("curl/8").alias("agent"), F.when(F.col("event_id") % 4 == 1, "Bearer sk-abc").when(F.col("event_id") % 4 == 2, "Bearer a.b.c").when(F.col("event_id") % 4 == 3, "Basic x").alias("auth"))
    return e.select("event_id", t.auth_mode(F.col("agent"), F.col("auth"), CLIENTS).alias("mode"))


register("auth_mode", _auth, "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'subscription' WHEN event_id % 4 = 1 THEN 'payg' WHEN event_id % 4 IN (2, 3) THEN 'oauth' ELSE 'payg' END AS mode FROM events")
register("policy_gain", lambda sp, d: s.table(sp, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(t.mutation_gain(F.col("l_quantity"), F.col("l_partkey"), F.col("l_linenumber").cast("double"), F.col("l_discount") * 10), 4).alias("gain"), F.round(t.break_even_reads(F.col("l_quantity"), F.col("l_partkey")), 4).alias("reads")), "SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * (1.25::DOUBLE + 0.1::DOUBLE * (greatest(l_linenumber, 0.0::DOUBLE) - 1)) - least(1.0::DOUBLE, greatest(0.0::DOUBLE, l_discount * 10)) * (1.25::DOUBLE - 0.1::DOUBLE) * (l_partkey + l_quantity), 4) AS gain, round((1.25::DOUBLE - 0.1::DOUBLE) / 0.1::DOUBLE * (l_partkey / l_quantity), 4) AS reads FROM lineitem")

# ---- histories
H = s.EXEC_HISTORY_SQL


def _buckets(df, key):
    g = df.groupBy(F.col(key).alias("bucket")).agg(F.count(F.lit(1)).alias("runs"), F.sum("original_bytes").alias("original_bytes"), F.sum("bytes_saved").alias("bytes_saved"))
    return g.withColumn("tokens_saved", F.floor(F.col("bytes_saved") / 4)).orderBy(F.desc("bytes_saved"), "bucket").limit(20)


HB = "SELECT {k} AS bucket, count(*) AS runs, sum(original_bytes)::BIGINT AS original_bytes, sum(bytes_saved)::BIGINT AS bytes_saved, (sum(bytes_saved) // 4)::BIGINT AS tokens_saved FROM exec_history GROUP BY 1 ORDER BY bytes_saved DESC, bucket LIMIT 20"
register("history_by_filter", lambda sp, d: _buckets(s.exec_history(sp, d), "filter"), f"WITH {H} " + HB.format(k="filter"))
register("history_by_command", lambda sp, d: _buckets(s.exec_history(sp, d).withColumn("first", F.substring_index("command", " ", 2)), "first"), f"WITH {H} " + HB.format(k="array_to_string(string_split(command, ' ')[1:2], ' ')"))
register("history_totals", lambda sp, d: s.exec_history(sp, d).agg(F.count(F.lit(1)).alias("runs"), F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"), F.sum("bytes_saved").alias("bytes_saved")), f"WITH {H} SELECT count(*) AS runs, sum(original_bytes)::BIGINT AS original_bytes, sum(compressed_bytes)::BIGINT AS compressed_bytes, sum(bytes_saved)::BIGINT AS bytes_saved FROM exec_history")
register(
    "retrieval_feedback",
    lambda sp, d: s.exec_history(sp, d).withColumn("hash", F.substring(F.md5(F.concat("command", (F.col("event_id") % 100).cast("string")).cast("binary")), 1, 24)).groupBy("filter").agg(F.count(F.lit(1)).alias("retrievals"), F.count_distinct("hash").alias("hashes"), (F.count(F.lit(1)) - F.count_distinct("hash")).alias("duplicates"), F.sum("original_bytes").alias("bytes")),
    f"WITH {H} SELECT filter, count(*) AS retrievals, count(DISTINCT h) AS hashes, count(*) - count(DISTINCT h) AS duplicates, sum(original_bytes)::BIGINT AS bytes FROM (SELECT *, md5(command || (event_id % 100)::VARCHAR) AS h FROM exec_history) GROUP BY filter",
)


def _discover(sp, d):
    """Each output is paired with the last command before it."""
    e = s.exec_history(sp, d).withColumn("is_command", F.col("event_id") % 3 == 0)
    last = F.last(F.when(F.col("is_command"), F.col("command")), True).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    p = e.withColumn("paired", last).filter(~F.col("is_command") & F.col("paired").isNotNull())
    return p.groupBy(F.col("paired").alias("command")).agg(F.count(F.lit(1)).alias("outputs"), F.sum("bytes_saved").alias("bytes_saved"))


register("discover_pairs", _discover, f"WITH {H}, p AS (SELECT *, last_value(CASE WHEN event_id % 3 = 0 THEN command END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paired FROM exec_history) SELECT paired AS command, count(*) AS outputs, sum(bytes_saved)::BIGINT AS bytes_saved FROM p WHERE event_id % 3 <> 0 AND paired IS NOT NULL GROUP BY paired")
register("eval_report", lambda sp, d: _discover(sp, d).agg(F.sum("outputs").alias("outputs"), F.sum("bytes_saved").alias("bytes_saved")).select("outputs", "bytes_saved", (F.col("bytes_saved") > 0).alias("pass")), f"WITH {H}, p AS (SELECT *, last_value(CASE WHEN event_id % 3 = 0 THEN command END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS paired FROM exec_history) SELECT count(*) AS outputs, sum(bytes_saved)::BIGINT AS bytes_saved, sum(bytes_saved) > 0 AS pass FROM p WHERE event_id % 3 <> 0 AND paired IS NOT NULL")

# ---- store
def _store(sp, d):
    """hash, original, created_at, row: one put per document."""
    return docs(sp, d).select(t.key(F.col("text"), "payload").alias("hash"), F.octet_length("text").alias("bytes"), (F.col("doc_id") * 7 % 5000).alias("created_at"), "doc_id")


STORE = "store AS (SELECT substr(md5(text), 1, 24) AS hash, strlen(text)::INT AS bytes, doc_id * 7 % 5000 AS created_at, doc_id FROM documents)"
register("store_put_latest", lambda sp, d: _store(sp, d).withColumn("n", F.row_number().over(W.partitionBy("hash").orderBy(F.desc("created_at"), F.desc("doc_id")))).filter("n = 1").select("hash", "bytes", "created_at"), f"WITH {STORE} SELECT hash, bytes, created_at FROM (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY created_at DESC, doc_id DESC) AS n FROM store) WHERE n = 1")
register("store_ttl_get", lambda sp, d: _store(sp, d).groupBy("hash").agg(F.max("created_at").alias("created_at")).filter(F.col("created_at") + 1800 > 4000), f"WITH {STORE} SELECT hash, max(created_at) AS created_at FROM store GROUP BY hash HAVING max(created_at) + 1800 > 4000")
register("store_evict_fifo", lambda sp, d: _store(sp, d).groupBy("hash").agg(F.min("created_at").alias("inserted")).orderBy(F.desc("inserted"), "hash").limit(100), f"WITH {STORE} SELECT hash, min(created_at) AS inserted FROM store GROUP BY hash ORDER BY inserted DESC, hash LIMIT 100")
register("store_roundtrip", lambda sp, d: docs(sp, d).select("doc_id", t.key(F.col("text"), "payload").alias("hash"), F.md5(F.col("text").cast("binary")).alias("m")).join(_store(sp, d).groupBy("hash").agg(F.max("bytes").alias("bytes")), "hash").select("doc_id", "bytes"), "SELECT doc_id, strlen(text)::INT AS bytes FROM documents")
