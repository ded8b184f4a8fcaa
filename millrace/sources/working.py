"""A folder that all executors share, for tables that later steps read more than once."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: list[str] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new folder's path under spark.checkpoint.dir; only a local session without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="millrace-"))
        root = _LOCAL[0]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df from Parquet: computed once, and read by every step that follows; `by`, a string column, has a folder for
    each value, in row groups that can be dealt out, so that a step on one value reads no other."""
    path = folder(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if by:
        writer = writer.option("parquet.block.size", 16 << 20).partitionBy(by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)
