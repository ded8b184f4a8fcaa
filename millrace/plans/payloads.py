"""Queries over raw requests and nested documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.functions.bpe import counter
from millrace.operators import payloads, relevance
from millrace.sources import derived as s

from .texts import JSON_ARRAYS_SQL, json_arrays


def requests(sp, d):
    """req_id, body: each conversation as a request."""
    m = s.messages(sp, d).withColumn("content", F.array(F.struct(F.lit("text").alias("type"), F.repeat("text", 2).alias("text"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return m.groupBy("req_id").agg(F.to_json(F.struct(F.lit("any").alias("model"), ordered.alias("messages"))).alias("body"))


def secrets(sp, d):
    """doc_id, text: each customer as a nested JSON document with fields to hide."""
    user = F.struct(F.col("c_name").alias("Token"), F.repeat("c_name", 40).alias("note"))
    auth = F.struct(F.col("c_name").alias("api_key"), F.array(user).alias("users"))
    return s.table(sp, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.to_json(F.struct(F.col("c_custkey").alias("id"), auth.alias("auth"), F.col("c_mktsegment").alias("segment"))).alias("text"))


_USERS = '[\n      {\n        "Token": "__REDACTED__",\n        "note": "__LONG_STRING__"\n      }\n    ]'
register(
    "sanitize_documents",
    lambda sp, d: payloads.sanitized_documents(secrets(sp, d)),
    f"""SELECT c_custkey AS doc_id, '{{
  "id": ' || c_custkey || ',
  "auth": {{
    "api_key": "__REDACTED__",
    "users": {_USERS}
  }},
  "segment": "' || c_mktsegment || '"
}}' || chr(10) AS text, 2::BIGINT AS redacted_fields, 1::BIGINT AS placeholder_strings FROM customer""",
)
register("live_zone_rewrite", lambda sp, d: payloads.rewrite_requests(requests(sp, d)).select("req_id", "blocks", "tokens_saved", "status", F.octet_length("body").alias("bytes")))
register("live_zone_untouched", lambda sp, d: payloads.rewrite_requests(requests(sp, d)).filter("blocks = 0").join(requests(sp, d).withColumnRenamed("body", "original"), "req_id").select("req_id", (F.col("body") == F.col("original")).alias("same")))
register(
    "document_tables",
    lambda sp, d: payloads.compact_documents(json_arrays(sp, d)).select("doc_id", "text"),
    f"WITH {JSON_ARRAYS_SQL} SELECT array_id AS doc_id, CASE WHEN count(*) < 2 THEN '[{{\"o_orderkey\":' || any_value(o_orderkey) || ',\"o_orderstatus\":\"' || any_value(o_orderstatus) || '\",\"o_orderpriority\":\"' || any_value(o_orderpriority) || '\"}}]' ELSE '[' || count(*) || ']{{o_orderkey:int,o_orderpriority:string,o_orderstatus:string}}' || chr(10) || string_agg(o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus || chr(10), '' ORDER BY idx) END AS text FROM order_items GROUP BY array_id",
)


def _likeness(sp, d):
    """Cosine of hashed vectors of each benchmark text and the documents that share a term with it."""
    items = s.table(sp, d, "benchmark")
    q = payloads.hashed_vectors(items, "item_id")
    v = payloads.hashed_vectors(s.table(sp, d, "documents"), "doc_id").withColumnRenamed("vector", "other")
    terms = lambda df, key: df.select(key, F.explode(F.array_distinct(relevance.terms(F.col("text")))).alias("w"))
    rare = terms(s.table(sp, d, "documents"), "doc_id").join(terms(items, "item_id").filter(F.octet_length("w") >= relevance.LONG_TERM), "w").select("item_id", "doc_id").distinct()
    return rare.join(q, "item_id").join(v, "doc_id").select("item_id", "doc_id", F.round(relevance.cosine(F.col("vector"), F.col("other")), 6).alias("score"))


register("hashed_similarity", _likeness)


register("bpe_token_counts", lambda sp, d: s.table(sp, d, "conversations").select("conv_id", "turn", counter()(F.col("text")).alias("tokens")))
