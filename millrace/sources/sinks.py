"""Sinks: compressed texts, reports, event logs, and Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def texts(df: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One folder per name, each with its text."""
    df.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("overwrite").partitionBy("name").text(path)


def reports(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def totals(report: DataFrame) -> DataFrame:
    """One row: files, failures and bytes of a report with status, original_bytes, compressed_bytes."""
    return report.agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("status") != "ok", 1)).alias("failed"), F.coalesce(F.sum("original_bytes"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("compressed_bytes"), F.lit(0)).alias("compressed_bytes"))


def worth_a_copy(raw: DataFrame) -> DataFrame:
    """Outputs whose raw text is kept beside the filtered one: 500 bytes or more, and failed or more than halved."""
    return raw.filter((F.col("original_bytes") >= 500) & ((F.col("exit_code") != 0) | (F.col("filtered_bytes") * 2 < F.col("original_bytes"))))


def markdown(df: DataFrame, most: int = 50) -> str:
    """A Markdown table of the first rows; bars are escaped."""
    rows = [tuple(r) for r in df.limit(most).collect()]
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    return "\n".join(lines) + "\n"
