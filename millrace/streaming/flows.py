"""The same expressions over streams: history totals, compression of each row, an idempotent store, windows of event time.

Event-time windows are an addition of this engine; histories carry time as a column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.text import estimated_tokens, key


def table_stream(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """One table of a folder, a Parquet file or a folder of such files, as a stream.

    A stream's path must be a folder or a pattern, which matches either."""
    return spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parque[t]")


def history_totals(history: DataFrame) -> DataFrame:
    """Runs and bytes saved by filter; for complete or update mode."""
    return history.groupBy("filter").agg(F.count(F.lit(1)).alias("runs"), F.sum("bytes_saved").alias("bytes_saved"))


def windowed_totals(events: DataFrame, time: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by window of event time, with a watermark; for append mode."""
    return events.withWatermark(time, late).groupBy(F.window(time, width)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sized(texts: DataFrame) -> DataFrame:
    """Stateless: hash, bytes and tokens of each text."""
    return texts.select(key(F.col("text"), "payload").alias("hash"), F.octet_length("text").alias("bytes"), estimated_tokens(F.col("text")).alias("tokens"))


def put_stream(texts: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str):
    """Hands each micro-batch, without repeated hashes, to a store; batches that come again are the store's to merge."""
    return texts.writeStream.foreachBatch(lambda df, n: put(df.dropDuplicates(["hash"]), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what is there now into Parquet under a folder that executors share, and reads it back.

    A batch is a folder of its own, overwritten if it comes again; of complete results the last one counts."""
    spark, path = stream.sparkSession, f"{folder}/batches"

    def write(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/all" if mode == "complete" else f"{path}/batch={n}")

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/all" if mode == "complete" else path).select(*stream.columns)
