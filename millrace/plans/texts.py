"""One table of texts of every content type, and its DuckDB twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources import derived


def rejoined(lines: DataFrame, pos: str = "pos") -> DataFrame:
    """doc_id, text: the lines of each document in order, joined by newlines."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(pos), F.col("content"))))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["content"]), "\n").alias("text"))


def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: the orders of each customer as a JSON array of dicts."""
    items = derived.order_items(spark, sf_dir)
    item = F.concat(F.lit('{"o_orderkey": '), F.col("o_orderkey").cast("string"), F.lit(', "o_orderstatus": "'), F.col("o_orderstatus"), F.lit('", "o_orderpriority": "'), F.col("o_orderpriority"), F.lit('"}'))
    ordered = F.array_sort(F.collect_list(F.struct("idx", item.alias("content"))))
    return items.groupBy(F.col("array_id").alias("doc_id")).agg(F.concat(F.lit("["), F.array_join(F.transform(ordered, lambda x: x["content"]), ", "), F.lit("]")).alias("text"))


JSON_ARRAYS_SQL = derived.ORDER_ITEMS_SQL + """, json_arrays AS (
  SELECT array_id AS doc_id, '[' || string_agg('{"o_orderkey": ' || o_orderkey::VARCHAR || ', "o_orderstatus": "' || o_orderstatus || '", "o_orderpriority": "' || o_orderpriority || '"}', ', ' ORDER BY idx) || ']' AS text FROM order_items GROUP BY array_id)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text: sources with names of several scripts, JSON behind white space, and summaries of tools."""
    k = F.col("p_partkey").cast("string")
    python = F.concat(F.lit("import os\n\ndef größe"), k, F.lit("(x):\n    return x\n\nclass Élan"), k, F.lit(":\n    @staticmethod\n    def été():\n        pass"))
    rust = F.concat(F.lit("use std::fmt;\npub struct S"), k, F.lit(";\nimpl S {\n    fn f() {}\n}\n#[test]"))
    json = F.concat(F.lit("\n\t [{\"a\": "), k, F.lit("}, {\"a\": 2}]\r\n"))
    summary = F.concat(F.lit("collected "), k, F.lit(" items\n=== FAILURES ===\nTests: "), k, F.lit("\n"), k, F.lit(" passed, 2 failed\nBuild of x succeeded\nTotal "), k)
    e = F.col("p_partkey") % 4
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("doc_id"), F.when(e == 0, python).when(e == 1, rust).when(e == 2, json).otherwise(summary).alias("text"))


SAMPLES_SQL = """samples AS (SELECT p_partkey AS doc_id, CASE p_partkey % 4
  WHEN 0 THEN 'import os' || chr(10) || chr(10) || 'def größe' || p_partkey || '(x):' || chr(10) || '    return x' || chr(10) || chr(10) || 'class Élan' || p_partkey || ':' || chr(10) || '    @staticmethod' || chr(10) || '    def été():' || chr(10) || '        pass'
  WHEN 1 THEN 'use std::fmt;' || chr(10) || 'pub struct S' || p_partkey || ';' || chr(10) || 'impl S {' || chr(10) || '    fn f() {}' || chr(10) || '}' || chr(10) || '#[test]'
  WHEN 2 THEN chr(10) || chr(9) || ' [{"a": ' || p_partkey || '}, {"a": 2}]' || chr(13) || chr(10)
  ELSE 'collected ' || p_partkey || ' items' || chr(10) || '=== FAILURES ===' || chr(10) || 'Tests: ' || p_partkey || chr(10) || p_partkey || ' passed, 2 failed' || chr(10) || 'Build of x succeeded' || chr(10) || 'Total ' || p_partkey END AS text FROM part)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """origin, doc_id, text"""
    t = derived.table
    parts = [
        ("documents", t(spark, sf_dir, "documents").select("doc_id", "text")),
        ("pages", t(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))),
        ("logs", rejoined(derived.log_lines(spark, sf_dir), "line_no")),
        ("searches", rejoined(derived.search_lines(spark, sf_dir))),
        ("diffs", derived.diff_texts(spark, sf_dir)),
        ("arrays", json_arrays(spark, sf_dir)),
        ("samples", samples(spark, sf_dir)),
    ]
    out = None
    for origin, df in parts:
        df = df.select(F.lit(origin).alias("origin"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        out = df if out is None else out.unionByName(df)
    return out


TEXTS_SQL = ", ".join(
    [
        derived.LOG_LINES_SQL,
        derived.SEARCH_LINES_SQL,
        derived.DIFF_LINES_SQL,
        JSON_ARRAYS_SQL,
        SAMPLES_SQL,
        """texts AS (
  SELECT 'documents' AS origin, doc_id::BIGINT AS doc_id, text FROM documents
  UNION ALL SELECT 'pages', page_id::BIGINT, html FROM pages
  UNION ALL SELECT 'logs', doc_id::BIGINT, string_agg(content, chr(10) ORDER BY line_no) FROM log_lines GROUP BY doc_id
  UNION ALL SELECT 'searches', doc_id::BIGINT, string_agg(content, chr(10) ORDER BY pos) FROM search_lines GROUP BY doc_id
  UNION ALL SELECT 'diffs', doc_id::BIGINT, string_agg(content, chr(10) ORDER BY pos) FROM diff_lines GROUP BY doc_id
  UNION ALL SELECT 'arrays', doc_id::BIGINT, text FROM json_arrays
  UNION ALL SELECT 'samples', doc_id::BIGINT, text FROM samples)""",
    ]
)
