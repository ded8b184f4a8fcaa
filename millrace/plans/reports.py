"""Queries of reports, typed arrays, noise and bucketed tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.catalog import register
from millrace.functions import text as t
from millrace.operators import compaction, diffs, json_rows, relevance, reports
from millrace.sources import derived as s

from .changes import DIFF
from .changes import parts as diff_parts
from .json_rows import ANOM, E, O, events, orders
from .texts_and_requests import _bm25


def raw_items(sp, d):
    """Values of several JSON types, one array per user."""
    k = F.col("event_id") % 7
    raw = F.when(F.col("array_id") % 4 == 0, F.col("value").cast("string")).when(F.col("array_id") % 4 == 1, F.concat(F.lit('"'), F.col("event_type"), F.lit('"'))).when(F.col("array_id") % 4 == 2, F.lit('{"a": 1}')).when(k == 0, "true").when(k == 1, "null").when(k == 2, "[1]").otherwise("17")
    return s.event_items(sp, d).select("array_id", "idx", raw.alias("raw"))


RAW = f"{s.EVENT_ITEMS_SQL}, raw AS (SELECT array_id, idx, CASE WHEN array_id % 4 = 0 THEN '1' WHEN array_id % 4 = 1 THEN '\"x\"' WHEN array_id % 4 = 2 THEN '{{\"a\": 1}}' WHEN event_id % 7 = 0 THEN 'true' WHEN event_id % 7 = 1 THEN 'null' WHEN event_id % 7 = 2 THEN '[1]' ELSE '17' END AS raw FROM event_items), tag AS (SELECT array_id, idx, CASE json_type(raw) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'bool' WHEN 'NULL' THEN 'null' ELSE 'number' END AS tag FROM raw)"
register("array_classify", lambda sp, d: reports.array_types(raw_items(sp, d)), f"WITH {RAW} SELECT array_id, CASE WHEN count(DISTINCT tag) <> 1 THEN 'mixed' ELSE CASE any_value(tag) WHEN 'object' THEN 'dict' WHEN 'array' THEN 'nested' WHEN 'null' THEN 'mixed' ELSE any_value(tag) END END AS array_type FROM tag GROUP BY array_id")
register("mixed_array_groups", lambda sp, d: raw_items(sp, d).groupBy("array_id", reports.type_tag(F.col("raw")).alias("tag")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first")), f"WITH {RAW} SELECT array_id, tag, count(*) AS n, min(idx) AS first FROM tag GROUP BY ALL")
register("uuid_shape", lambda sp, d: s.table(sp, d, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.regexp_replace(F.md5(F.col("text").cast("binary")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).otherwise(F.md5(F.col("text").cast("binary"))).rlike(json_rows.UUID).alias("is_uuid")), "SELECT doc_id, doc_id % 2 = 0 AS is_uuid FROM documents")
register("combined_output", lambda sp, d: s.table(sp, d, "conversations").select("conv_id", "turn", F.md5(reports.combined_output(F.col("text"), F.when(F.col("role") == "user", F.lit("warn"))).cast("binary")).alias("m")), "SELECT conv_id, turn, md5(CASE WHEN role <> 'user' THEN text WHEN text = '' THEN '[stderr]' || chr(10) || 'warn' ELSE text || chr(10) || '[stderr]' || chr(10) || 'warn' END) AS m FROM conversations")


def _sample(sp, d):
    items = s.event_items(sp, d)
    odd = json_rows.anomalies(events(sp, d)).withColumn("odd", F.lit(True))
    return reports.smart_sample(items.join(odd, ["array_id", "idx"], "left"), {"odd": F.col("odd"), "error": F.col("event_type") == "error"})


register(
    "smart_sample",
    _sample,
    f"""WITH {E}, {ANOM}, f AS (SELECT e.array_id, e.idx, a.idx IS NOT NULL OR event_type = 'error' AS must, count(*) OVER (PARTITION BY e.array_id) AS n FROM event_items e LEFT JOIN anom a ON e.array_id = a.array_id AND e.idx = a.idx)
SELECT array_id, idx, must FROM (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY CASE WHEN must THEN 0 WHEN idx < 3 THEN 1 WHEN idx >= n - 2 THEN 2 ELSE 3 END, idx) AS turn FROM f) WHERE must OR turn <= 15""",
)
register(
    "filter_diff_summary",
    lambda sp, d: reports.diff_summary(s.diff_lines(sp, d), 1).select("doc_id", "pos"),
    rf"""WITH {s.DIFF_LINES_SQL}, a AS (SELECT *, regexp_matches(content, '^(diff --git|\+\+\+ |--- |@@)') AS header, regexp_matches(content, '^[+-]') AND NOT regexp_matches(content, '^(\+\+\+|---)') AS change, sum(starts_with(content, '@@')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS hunk FROM diff_lines)
SELECT doc_id, pos FROM (SELECT *, sum(change::INT) OVER (PARTITION BY doc_id, hunk ORDER BY pos) AS place FROM a) WHERE header OR (change AND place <= 1)""",
)


def _noise_bloat(sp, d):
    """The share of a diff's bytes in lock files and white-space changes; 0 for short diffs."""
    n = diffs.noise(diff_parts(sp, d))
    g = n.groupBy("doc_id").agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"), F.coalesce(F.sum(F.when(F.col("lockfile") | F.col("whitespace_only"), F.col("bytes"))), F.lit(0)).alias("droppable"))
    return g.select("doc_id", F.round(F.when(F.col("lines") < 30, 0.0).otherwise(F.col("droppable") / F.col("bytes")), 6).alias("bloat"))


register(
    "bloat_noise",
    _noise_bloat,
    rf"""WITH {DIFF}, z AS (SELECT doc_id, file_no, count(*) AS lines, sum(strlen(content) + 1) AS bytes, regexp_matches(any_value(new_path), '{diffs.LOCKFILE}') OR coalesce(list(regexp_replace(substr(content, 2), '\s', '', 'g') ORDER BY pos) FILTER (WHERE kind = 'add') = list(regexp_replace(substr(content, 2), '\s', '', 'g') ORDER BY pos) FILTER (WHERE kind = 'delete'), FALSE) AS drop FROM parts WHERE file_no > 0 GROUP BY doc_id, file_no)
SELECT doc_id, round(CASE WHEN sum(lines) < 30 THEN 0.0 ELSE coalesce(sum(bytes) FILTER (WHERE drop), 0)::DOUBLE / sum(bytes) END::DOUBLE, 6) AS bloat FROM z GROUP BY doc_id""",
)


def _buckets(sp, d):
    """The rows of each array, by the value of its discriminator."""
    c = orders(sp, d)
    disc = compaction.discriminators(c).select("array_id", "field")
    return c.join(disc, ["array_id", "field"]).groupBy("array_id", "field", F.col("str").alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))


register(
    "compaction_buckets",
    _buckets,
    f"""WITH {O}, n AS (SELECT array_id, count(DISTINCT idx) AS n_items FROM cells GROUP BY array_id), k AS (SELECT array_id, field FROM (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY buckets DESC, field) AS k FROM (SELECT c.array_id, field, count(str) AS texts, count(DISTINCT str) AS buckets, any_value(n_items) AS n_items FROM cells c JOIN n ON c.array_id = n.array_id GROUP BY c.array_id, field) WHERE texts = n_items AND buckets BETWEEN 2 AND 8 AND buckets::DOUBLE / n_items <= 0.7) WHERE k = 1)
SELECT c.array_id, c.field, str AS bucket, count(*) AS n, min(idx) AS first FROM cells c JOIN k ON c.array_id = k.array_id AND c.field = k.field GROUP BY ALL""",
)
H = s.EXEC_HISTORY_SQL
register("learn_rules", lambda sp, d: reports.learned(s.exec_history(sp, d)), f"WITH {H} SELECT CASE WHEN sum(bytes_saved) >= 1000000 THEN 'rewrite' WHEN count(*) >= 20 THEN 'watch' ELSE 'none' END AS kind, command, count(*) AS runs, sum(bytes_saved)::BIGINT AS bytes_saved FROM exec_history GROUP BY command")
register("batch_totals", lambda sp, d: s.exec_history(sp, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("files"), F.sum("original_bytes").alias("original_bytes"), F.sum("compressed_bytes").alias("compressed_bytes"), F.round(F.sum("compressed_bytes") / F.sum("original_bytes"), 6).alias("ratio")), f"WITH {H} SELECT user_id, count(*) AS files, sum(original_bytes)::BIGINT AS original_bytes, sum(compressed_bytes)::BIGINT AS compressed_bytes, round(sum(compressed_bytes)::DOUBLE / sum(original_bytes), 6) AS ratio FROM exec_history GROUP BY user_id")
register("raw_output_kept", lambda sp, d: s.exec_history(sp, d).withColumn("exit_code", (F.col("event_id") % 10 == 0).cast("int")).filter((F.col("original_bytes") >= 500) & ((F.col("exit_code") != 0) | (F.col("compressed_bytes") * 2 < F.col("original_bytes")))).withColumn("place", F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("event_id")))).filter("place <= 20").select("user_id", "event_id"), f"WITH {H} SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM exec_history WHERE original_bytes >= 500 AND (event_id % 10 = 0 OR compressed_bytes * 2 < original_bytes)) WHERE place <= 20")


def _query_of(sp, d):
    """The words of the latest user message, 512 bytes of them, ended at a character."""
    m = s.messages(sp, d).filter("role = 'user'").groupBy("req_id").agg(F.max(F.struct("msg_idx", "text")).alias("m"))
    from millrace.functions.detection import byte_prefix

    return m.select("req_id", byte_prefix(F.col("m.text"), 512).alias("query")).select("req_id", F.octet_length("query").alias("bytes"), F.char_length("query").alias("chars"))


register("latest_user_query", _query_of)


def _hybrid(sp, d):
    """The mix by name: BM25 and the lexical cosine, by what the query names."""
    found = relevance.scorer("hybrid")(s.table(sp, d, "documents"), s.table(sp, d, "benchmark").select(F.col("item_id").alias("query_id"), "text"))
    return found.withColumn("score", F.round("score", 6))


register("hybrid_scores", _hybrid)
