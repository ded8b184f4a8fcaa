"""Streams over the tables, run to their end; each equals its batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.sources import derived as s
from millrace.sources import working
from millrace.streaming import flows


def _stream(sp, d, name):
    return flows.table_stream(sp, d, name, s.table(sp, d, name).schema)


def _totals(sp, d):
    e = _stream(sp, d, "events")
    history = e.select(F.concat(F.lit("exec:"), "event_type").alias("filter"), (F.floor(F.col("value") * 100) - F.floor(F.col("value") * 40)).cast("long").alias("bytes_saved"))
    return flows.drained(flows.history_totals(history), working.folder(sp, "totals"), "complete")


def _sized(sp, d):
    return flows.drained(flows.sized(_stream(sp, d, "conversations")), working.folder(sp, "sized"), "append")


def _windows(sp, d):
    e = _stream(sp, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    w = flows.drained(e.withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("n")), working.folder(sp, "windows"), "complete")
    return w.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n")


register("stream_history_totals", _totals, f"WITH {s.EXEC_HISTORY_SQL} SELECT filter, count(*) AS runs, sum(bytes_saved)::BIGINT AS bytes_saved FROM exec_history GROUP BY filter")
register("stream_sized", _sized, "SELECT substr(md5(text), 1, 24) AS hash, strlen(text)::INT AS bytes, CASE WHEN text = '' THEN 0 ELSE greatest(1, floor(length(text) / 4.0 + 0.5)) END::BIGINT AS tokens FROM conversations")
register("stream_daily_events", _windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
