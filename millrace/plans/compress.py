"""Sizing, tables, sequential scans and the whole compression of a table of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.functions import detection, text
from millrace.operators import compaction, crush, diffs, lines, matches, rendering, sequential, sizing
from millrace.sources import derived as s
from millrace.sources import working

from .json_rows import E, O, events, orders
from .lines import LOGS, logs
from .texts import rejoined, texts


def items(sp, d):
    return logs(sp, d).select(F.col("doc_id").alias("array_id"), F.col("pos").alias("idx"), F.col("content").alias("item"))


CURVE = f"""{LOGS}, w AS (SELECT doc_id, pos, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') AS w FROM l),
p AS (SELECT doc_id, pos, unnest(range(1, len(w))) AS k, w FROM w), f AS (SELECT doc_id, w[k] AS a, w[k + 1] AS b, min(pos) AS pos FROM p GROUP BY doc_id, w[k], w[k + 1]),
c AS (SELECT l.doc_id AS array_id, l.pos AS idx, sum(coalesce(n, 0)) OVER (PARTITION BY l.doc_id ORDER BY l.pos)::BIGINT AS covered FROM l LEFT JOIN (SELECT doc_id, pos, count(*) AS n FROM f GROUP BY ALL) n ON l.doc_id = n.doc_id AND l.pos = n.pos)"""
register("bigram_curve", lambda sp, d: sizing.bigram_curve(items(sp, d)), f"WITH {CURVE} SELECT * FROM c")
register(
    "knee_point",
    lambda sp, d: sizing.knees(sizing.bigram_curve(items(sp, d))),
    f"""WITH {CURVE}, g AS (SELECT *, count(*) OVER (PARTITION BY array_id) AS n, min(covered) OVER (PARTITION BY array_id) AS lo, max(covered) OVER (PARTITION BY array_id) AS hi FROM c),
h AS (SELECT *, (covered - lo)::DOUBLE / nullif(hi - lo, 0) - idx::DOUBLE / nullif(n - 1, 0) AS gain FROM g)
SELECT array_id, any_value(n) AS n, CASE WHEN any_value(n) < 3 THEN NULL WHEN any_value(lo) = any_value(hi) THEN 1 WHEN max(gain) < 0.05 THEN NULL ELSE arg_max(idx, (gain, -idx)) + 1 END AS knee FROM h GROUP BY array_id""",
)


register("simhash_clusters", lambda sp, d: sizing.near_equal_clusters(items(sp, d)))
register("optimal_sizes", lambda sp, d: sizing.sizes(items(sp, d), 1.0, 3, 40))
SCHEMA = """n AS (SELECT array_id, count(DISTINCT idx) AS n_items FROM cells GROUP BY array_id), g AS (SELECT array_id, field, count(*) AS freq, count(*) FILTER (WHERE str IS NULL AND num IS NULL) AS nulls,
  CASE WHEN count(str) > 0 OR count(num) = 0 THEN 'string' WHEN bool_and(num = floor(num)) THEN 'int' ELSE 'float' END AS type_tag FROM cells GROUP BY array_id, field),
schema_ AS (SELECT g.array_id, field, freq, freq < n_items OR nulls > 0 AS nullable, type_tag, row_number() OVER (PARTITION BY g.array_id ORDER BY freq DESC, field) AS place, n_items FROM g JOIN n ON g.array_id = n.array_id)"""
register("compaction_schema", lambda sp, d: compaction.schemas(orders(sp, d)), f"WITH {O}, {SCHEMA} SELECT * FROM schema_")
register(
    "compaction_discriminator",
    lambda sp, d: compaction.discriminators(orders(sp, d)),
    f"WITH {O}, n AS (SELECT array_id, count(DISTINCT idx) AS n_items FROM cells GROUP BY array_id) SELECT array_id, field, buckets FROM (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY buckets DESC, field) AS k FROM (SELECT c.array_id, field, count(str) AS texts, count(DISTINCT str) AS buckets, any_value(n_items) AS n_items FROM cells c JOIN n ON c.array_id = n.array_id GROUP BY c.array_id, field) WHERE texts = n_items AND buckets BETWEEN 2 AND 8 AND buckets::DOUBLE / n_items <= 0.7) WHERE k = 1",
)
CELL = "CASE WHEN kind = 'string' THEN str WHEN num = floor(num) THEN num::BIGINT::VARCHAR ELSE num::DECIMAL(18,2)::VARCHAR END"
HEADER = "hd AS (SELECT array_id, '[' || any_value(n_items) || ']{' || string_agg(field || ':' || type_tag || CASE WHEN nullable THEN '?' ELSE '' END, ',' ORDER BY place) || '}' || chr(10) AS header FROM schema_ GROUP BY array_id)"
_QUOTED = f"CASE WHEN regexp_matches({CELL}, '[,\"\\n\\r]') THEN '\"' || replace({CELL}, '\"', '\"\"') || '\"' ELSE coalesce({CELL}, '') END"
register(
    "csv_schema_render",
    lambda sp, d: compaction.csv_tables(events(sp, d)),
    f"WITH {E}, {SCHEMA}, {HEADER}, r AS (SELECT c.array_id, idx, string_agg({_QUOTED}, ',' ORDER BY place) AS line FROM cells c JOIN schema_ s ON c.array_id = s.array_id AND c.field = s.field GROUP BY c.array_id, idx) SELECT r.array_id, any_value(header) || string_agg(line || chr(10), '' ORDER BY idx) AS text FROM r JOIN hd ON r.array_id = hd.array_id GROUP BY r.array_id",
)
_JSON_CELL = f"CASE WHEN str IS NOT NULL THEN to_json(str)::VARCHAR ELSE coalesce({CELL}, 'null') END"
register(
    "compaction_json",
    lambda sp, d: compaction.json_tables(orders(sp, d)),
    f"""WITH {O}, {SCHEMA}, r AS (SELECT s.array_id, i.idx, string_agg({_JSON_CELL}, ',' ORDER BY place) AS line FROM (SELECT DISTINCT array_id, idx FROM cells) i JOIN schema_ s ON i.array_id = s.array_id LEFT JOIN cells c ON c.array_id = i.array_id AND c.idx = i.idx AND c.field = s.field GROUP BY s.array_id, i.idx),
b AS (SELECT array_id, count(*) AS n, string_agg('[' || line || ']', ',' ORDER BY idx) AS body FROM r GROUP BY array_id),
h AS (SELECT array_id, string_agg('{{"name":"' || field || '","type":"' || type_tag || CASE WHEN nullable THEN '","nullable":true}}' ELSE '"}}' END, ',' ORDER BY place) AS spec FROM schema_ GROUP BY array_id)
SELECT b.array_id, '{{"_compaction":"table","_schema":[' || spec || '],"_kept":' || n || ',"_total":' || n || ',"_rows":[' || body || ']}}' AS text FROM b JOIN h ON b.array_id = h.array_id""",
)
register(
    "markdown_kv_render",
    lambda sp, d: compaction.kv_tables(orders(sp, d)),
    f"WITH {O}, {SCHEMA}, {HEADER}, r AS (SELECT c.array_id, idx, '- ' || string_agg(c.field || ': ' || {CELL}, chr(10) || '  ' ORDER BY place) AS line FROM cells c JOIN schema_ s ON c.array_id = s.array_id AND c.field = s.field GROUP BY c.array_id, idx) SELECT r.array_id, any_value(header) || string_agg(line || chr(10), '' ORDER BY idx) AS text FROM r JOIN hd ON r.array_id = hd.array_id GROUP BY r.array_id",
)


def traces(sp, d):
    """Log lines in which some are stack frames."""
    e = F.col("pos") % 10
    frame = F.when(e == 2, "Traceback (most recent call last)").when(e == 3, F.concat(F.lit('  File "a.py", line '), F.col("pos").cast("string"))).when(e == 4, F.lit("    raise")).when(e == 7, F.lit("    at com.acme.Main(Main.java)")).otherwise(F.concat(F.lit("1. "), F.col("content")))
    return logs(sp, d).withColumn("content", frame)


register("stack_trace_groups", lambda sp, d: sequential.stack_traces(traces(sp, d)))
register("log_template_fold", lambda sp, d: sequential.log_templates(rejoined(logs(sp, d))))
register(
    "log_template_mine",
    lambda sp, d: logs(sp, d).groupBy(F.regexp_replace("content", r"\d+", "<*>").alias("template")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).filter("n >= 3"),
    f"WITH {LOGS} SELECT regexp_replace(content, '\\d+', '<*>', 'g') AS template, count(*) AS n, count(DISTINCT doc_id) AS docs FROM l GROUP BY 1 HAVING count(*) >= 3",
)


def compress(sp, d):
    """Detection, then the compressor of each type: one report row per text.

    The typed texts are written once, and every type is a filter on them. Arrays, sources and
    diffs are compressed where they stand, a text in a row; logs and searches, which rank their
    lines, meet their texts' sizes again by key, without the texts. Nothing gets longer: a result
    is taken only if it saves bytes. What is lost can be found in the store by its hash."""
    c = F.col
    typed = detection.with_content_type(texts(sp, d)).withColumn("k", F.concat_ws(":", "origin", c("doc_id").cast("string")))
    lossy = c("content_type").isin("source_code", "build", "search", "diff")
    t = working.written(typed.withColumns({"whole": F.octet_length("text"), "lossy_key": F.when(lossy, text.key(c("text"), "payload"))}), "typed", "content_type")
    of = lambda *kinds: t.filter(c("content_type").isin(*kinds))
    split = lambda df: df.select(c("k").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    sized = lambda df, out: df.select(*thin, F.octet_length(out).alias("small"))
    thin = ["k", "origin", "doc_id", "content_type", "whole", "lossy_key"]
    as_is = of("html", "text").select(*thin, F.lit(None).cast("int").alias("small"))
    arrays = sized(of("json_array"), text.minified_json(c("text")))
    sources = sized(of("source_code"), lines.source_text(c("text")))
    changes = sized(diffs.compressed_texts(of("diff")), "out")
    # A log of fewer lines stays whole.
    builds = lines.log_text(split(of("build").filter(F.length("text") - F.length(F.replace("text", F.lit("\n"))) >= lines.LEAST_LINES - 1)))
    builds = builds.select(c("doc_id").alias("k"), F.octet_length("compressed").alias("small"))
    found = working.written(matches.parsed(split(of("search")).repartition("doc_id")).withColumn("score", matches.match_score(c("text"), [])), "matches")
    searches = rendering.search_texts(matches.selected(found), found).select(c("doc_id").alias("k"), F.octet_length("text").alias("small"))
    ranked = of("build", "search").select(*thin).join(builds.unionByName(searches), "k", "left")
    j = as_is.unionByName(arrays).unionByName(sources).unionByName(changes).unionByName(ranked)
    saves = F.coalesce(c("small") < c("whole"), F.lit(False))
    small = F.when(saves, c("small")).otherwise(c("whole"))
    return j.select("origin", "doc_id", "content_type", c("whole").alias("original_bytes"), small.alias("compressed_bytes"), (c("whole") - small).alias("bytes_saved"), F.when(saves, c("lossy_key")).alias("hash"))


register("pipeline_compress", compress)
register("log_selection_adaptive", lambda sp, d: lines.log_selection(traces(sp, d)).select("doc_id", "pos", "level", F.round("score", 6).alias("score")))
register("search_select_adaptive", lambda sp, d: matches.selected(matches.parsed(s.search_lines(sp, d)).withColumn("score", matches.match_score(F.col("text"), ["the"]))).select("doc_id", "file", "line_number", "place"))


def _raw_events(sp, d):
    raw = F.concat(F.lit('{"event_type":"'), "event_type", F.lit('","value":'), F.col("value").cast("string"), F.lit("}"))
    return s.event_items(sp, d).withColumn("raw", raw)


def _crush(sp, d):
    """The events of each user as an array, crushed by the strategy that its statistics ask for."""
    text_of = F.concat_ws("|", "ts", "event_type")
    return crush.crush_arrays(events(sp, d), _raw_events(sp, d), text_of, F.col("event_type"), F.col("value"), F.col("event_type") == "error", "value")


register("crush_array", lambda sp, d: _crush(sp, d).select("array_id", "n_items", "n_kept", F.md5(F.col("text").cast("binary")).alias("text_md5"), "hash"))
