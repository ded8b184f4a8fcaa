"""Inputs derived from the star-schema tables: JSON-like arrays, logs, search results, diffs, requests.

Every derivation exists twice, as a DataFrame and as DuckDB SQL (the constants named *_SQL hold
CTE bodies), so that a query and its oracle start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _indexed(df: DataFrame, array: str, *order: str) -> DataFrame:
    return df.withColumn("idx", F.row_number().over(W.partitionBy(array).orderBy(*order)) - 1).withColumnRenamed(array, "array_id")


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array of dicts per user: event_id, ts (ISO text), event_type, value."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "event_type", "value")
    return _indexed(e, "user_id", "event_id")


EVENT_ITEMS_SQL = """event_items AS (
  SELECT user_id AS array_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type, value,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx FROM events)"""


def order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One array of dicts per customer: o_orderkey, o_orderstatus, o_totalprice, o_orderpriority."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    return _indexed(o, "o_custkey", "o_orderkey")


ORDER_ITEMS_SQL = """order_items AS (
  SELECT o_custkey AS array_id, o_orderkey, o_orderstatus, o_totalprice, o_orderpriority,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS idx FROM orders)"""

EVENT_FIELDS = {"event_id": "numeric", "ts": "string", "event_type": "string", "value": "numeric"}
ORDER_FIELDS = {"o_orderkey": "numeric", "o_orderstatus": "string", "o_totalprice": "numeric", "o_orderpriority": "string"}


def long_form(items: DataFrame, fields: dict[str, str]) -> DataFrame:
    """array_id, idx, field, kind, str, num: one row per item and field, without a shuffle."""
    cells = [F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), (F.col(f) if k == "string" else F.lit(None).cast("string")).alias("str"), (F.col(f).cast("double") if k == "numeric" else F.lit(None).cast("double")).alias("num")) for f, k in fields.items()]
    return items.select("array_id", "idx", F.inline(F.array(*cells)))


def long_form_sql(name: str, items: str, fields: dict[str, str]) -> str:
    rows = [f"SELECT array_id, idx, '{f}' AS field, '{k}' AS kind, {f if k == 'string' else 'NULL::VARCHAR'} AS str, {f + '::DOUBLE' if k == 'numeric' else 'NULL::DOUBLE'} AS num FROM {items}" for f, k in fields.items()]
    return f"{name} AS (" + " UNION ALL ".join(rows) + ")"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_no, content: one log per user."""
    e = table(spark, sf_dir, "events")
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARNING").when(F.col("event_type") == "view", "DEBUG").when((F.col("event_type") == "click") & (F.col("event_id") % 3 == 0), "FAILED").otherwise("INFO")
    content = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), level, F.lit(" "), F.col("event_type"), F.lit(": user "), F.col("user_id").cast("string"), F.lit(" took "), F.floor("value").cast("string"), F.lit(" ms at /srv/app/"), (F.col("event_id") % 9).cast("string"), F.lit("/x"))
    return e.select(F.col("user_id").alias("doc_id"), (F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1).alias("line_no"), content.alias("content"))


LOG_LINES_SQL = """log_lines AS (
  SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS line_no,
         strftime(ts, '%Y-%m-%d %H:%M:%S') || ' ' || CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' THEN 'WARNING'
           WHEN event_type = 'view' THEN 'DEBUG' WHEN event_type = 'click' AND event_id % 3 = 0 THEN 'FAILED' ELSE 'INFO' END
         || ' ' || event_type || ': user ' || user_id::VARCHAR || ' took ' || floor(value)::BIGINT::VARCHAR || ' ms at /srv/app/' || (event_id % 9)::VARCHAR || '/x' AS content FROM events)"""


def search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, content: result lists of `file:line:text`, one list per 40 documents."""
    d = table(spark, sf_dir, "documents")
    content = F.concat(F.col("source"), F.lit("/part"), (F.col("doc_id") % 3).cast("string"), F.lit(".txt:"), F.col("n_chars").cast("string"), F.lit(":"), F.replace("text", F.lit("\n"), F.lit(" ")))
    return d.select(F.floor(F.col("doc_id") / 40).alias("doc_id"), (F.col("doc_id") % 40).alias("pos"), content.alias("content"))


SEARCH_LINES_SQL = """search_lines AS (
  SELECT doc_id // 40 AS doc_id, doc_id % 40 AS pos, source || '/part' || (doc_id % 3)::VARCHAR || '.txt:' || n_chars::VARCHAR || ':' || replace(text, chr(10), ' ') AS content FROM documents)"""


def _diff_items(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list]:
    """Line items, n: their order in a supplier's diff; and the ten lines of each."""
    item = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")).alias("n"))
    order, number, part, quantity = (F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity"))
    name = F.concat(F.when(F.col("l_orderkey") % 11 == 0, F.lit("deps/Cargo.lock")).otherwise(F.concat(F.lit("orders/"), order, F.lit(".csv"))))
    lines = [
        F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name),
        F.concat(F.lit("--- a/"), name),
        F.concat(F.lit("+++ b/"), name),
        F.concat(F.lit("@@ -"), number, F.lit(",5 +"), number, F.lit(",5 @@")),
        F.concat(F.lit(" part "), part),
        F.lit(" unit: each"),
        F.lit(" state: open"),
        F.concat(F.lit("-quantity "), F.floor("l_quantity").cast("string")),
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit("+quantity  "), F.floor("l_quantity").cast("string"))).otherwise(F.concat(F.lit("+quantity "), (F.floor("l_quantity") + 1).cast("string"), F.lit(" fix"))),
        F.lit(" end"),
    ]
    return item, lines


def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos, content: one diff per supplier, a file per order, a hunk per line item."""
    item, lines = _diff_items(spark, sf_dir)
    return item.select(F.col("l_suppkey").alias("doc_id"), F.posexplode(F.array(*lines)).alias("k", "content"), "n").select("doc_id", ((F.col("n") - 1) * 10 + F.col("k")).alias("pos"), "content")


def diff_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the lines of each diff joined; its items are gathered, not its lines."""
    item, lines = _diff_items(spark, sf_dir)
    parts = item.select(F.col("l_suppkey").alias("doc_id"), "n", F.concat_ws("\n", *lines).alias("part")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("n", "part"))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.transform("parts", lambda x: x["part"]), "\n").alias("text"))


DIFF_LINES_SQL = """diff_items AS (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS n,
         CASE WHEN l_orderkey % 11 = 0 THEN 'deps/Cargo.lock' ELSE 'orders/' || l_orderkey::VARCHAR || '.csv' END AS name FROM lineitem
), diff_lines AS (
  SELECT l_suppkey AS doc_id, (n - 1) * 10 + k AS pos, CASE k
    WHEN 0 THEN 'diff --git a/' || name || ' b/' || name WHEN 1 THEN '--- a/' || name WHEN 2 THEN '+++ b/' || name
    WHEN 3 THEN '@@ -' || l_linenumber::VARCHAR || ',5 +' || l_linenumber::VARCHAR || ',5 @@'
    WHEN 4 THEN ' part ' || l_partkey::VARCHAR WHEN 5 THEN ' unit: each' WHEN 6 THEN ' state: open'
    WHEN 7 THEN '-quantity ' || floor(l_quantity)::BIGINT::VARCHAR
    WHEN 8 THEN CASE WHEN l_linenumber % 4 = 0 THEN '+quantity  ' || floor(l_quantity)::BIGINT::VARCHAR ELSE '+quantity ' || (floor(l_quantity)::BIGINT + 1)::VARCHAR || ' fix' END
    ELSE ' end' END AS content
  FROM diff_items CROSS JOIN (SELECT unnest(range(10)) AS k))"""


def exec_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """command, filter, original_bytes, compressed_bytes, bytes_saved, timestamp order by event_id."""
    e = table(spark, sf_dir, "events")
    command = F.when(F.col("event_type") == "error", "cargo test --all").when(F.col("event_type") == "click", "git status").when(F.col("event_type") == "view", "ls -la src").when(F.col("event_type") == "signup", "npm run build").otherwise("docker ps")
    original, compressed = F.floor(F.col("value") * 100).cast("long"), F.floor(F.col("value") * 40).cast("long")
    return e.select("event_id", "user_id", command.alias("command"), F.concat(F.lit("exec:"), F.col("event_type")).alias("filter"), original.alias("original_bytes"), compressed.alias("compressed_bytes"), (original - compressed).alias("bytes_saved"))


EXEC_HISTORY_SQL = """exec_history AS (
  SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'cargo test --all' WHEN 'click' THEN 'git status' WHEN 'view' THEN 'ls -la src' WHEN 'signup' THEN 'npm run build' ELSE 'docker ps' END AS command,
         'exec:' || event_type AS filter, floor(value * 100)::BIGINT AS original_bytes, floor(value * 40)::BIGINT AS compressed_bytes, floor(value * 100)::BIGINT - floor(value * 40)::BIGINT AS bytes_saved FROM events)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """req_id, msg_idx, role, block_type, text, ttl (of a cache marker, or null)."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "user", F.when(F.col("turn") % 4 == 0, "tool_result").otherwise("text")).when((F.col("role") == "assistant") & (F.col("turn") % 5 == 1), "tool_use").otherwise("text")
    ttl = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, "5m").when((F.col("conv_id") + F.col("turn")) % 7 == 3, "1h")
    return c.select(F.col("conv_id").alias("req_id"), F.col("turn").alias("msg_idx"), "role", kind.alias("block_type"), "text", ttl.alias("ttl"))


MESSAGES_SQL = """messages AS (
  SELECT conv_id AS req_id, turn AS msg_idx, role,
         CASE WHEN role = 'user' THEN CASE WHEN turn % 4 = 0 THEN 'tool_result' ELSE 'text' END WHEN role = 'assistant' AND turn % 5 = 1 THEN 'tool_use' ELSE 'text' END AS block_type,
         text, CASE WHEN (conv_id + turn) % 7 = 0 THEN '5m' WHEN (conv_id + turn) % 7 = 3 THEN '1h' END AS ttl FROM conversations)"""
