"""Queries over tags, anchors and query matches."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.operators import anchors, markup
from millrace.sources import derived as s


def tagged(sp, d):
    text = F.concat(F.lit("<note id='1>'>keep "), F.col("text"), F.lit("</note> and <b>"), F.col("doc_id").cast("string"), F.lit("</b> <ref n=\"2\"/> tail"))
    return s.table(sp, d, "documents").select("doc_id", text.alias("text"))


def _roundtrip(sp, d):
    p = markup.protect(tagged(sp, d))
    return p.select("doc_id", F.size("blocks").alias("blocks"), markup.restored(F.col("text"), F.col("blocks")).alias("text"))


register("tag_protect", lambda sp, d: markup.protect(tagged(sp, d)).select("doc_id", "text"), "SELECT doc_id, '{{TAG_0}} and <b>' || doc_id || '</b> {{TAG_1}} tail' AS text FROM documents")
register("tag_roundtrip", _roundtrip, "SELECT doc_id, 2 AS blocks, '<note id=''1>''>keep ' || text || '</note> and <b>' || doc_id || '</b> <ref n=\"2\"/> tail' AS text FROM documents")


def _tags(sp, d):
    names = s.table(sp, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("<([A-Za-z][A-Za-z0-9]*)"), F.lit(1)))).alias("tag"))
    return names.select("page_id", "tag", markup.is_html_tag(F.col("tag")).alias("known"))


_HTML = "[" + ", ".join(f"'{t}'" for t in sorted(markup.HTML_TAGS)) + "]"
register("html_tags_known", _tags, f"WITH t AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) SELECT page_id, tag, list_contains({_HTML}, lower(tag)) AS known FROM t")
register("anchor_rows", lambda sp, d: anchors.anchors(s.event_items(sp, d), F.concat_ws("|", "ts", "event_type"), F.col("value"), "time_series"))
NAMES = ["signup", "-05 "]
register("query_anchor_match", lambda sp, d: s.event_items(sp, d).filter(anchors.matches_anchors(F.concat_ws("|", "ts", "event_type"), NAMES)).select("array_id", "idx"), f"WITH {s.EVENT_ITEMS_SQL} SELECT array_id, idx FROM event_items WHERE contains(ts || '|' || event_type, 'signup') OR contains(ts || '|' || event_type, '-05 ')")
HASH = hashlib.sha256(b"o_orderpriority").hexdigest()[:8]
register(
    "preserve_field_match",
    lambda sp, d: s.order_items(sp, d).filter(anchors.matches_preserved({"o_orderstatus": F.col("o_orderstatus"), "o_orderpriority": F.col("o_orderpriority")}, [HASH], F.lit("Show 1-URGENT ones"))).select("array_id", "idx"),
    f"WITH {s.ORDER_ITEMS_SQL} SELECT array_id, idx FROM order_items WHERE contains(lower(o_orderpriority), 'show 1-urgent ones') OR contains('show 1-urgent ones', lower(o_orderpriority))",
)
