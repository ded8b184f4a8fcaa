"""A content-addressed store as Parquet files: put, compact, get, evict. Rows: hash, original, created_at (seconds), ttl_seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions.text import key

TTL, CAPACITY = 1800, 1000


class Store:
    """Puts append; the newest row of a hash counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def put(self, texts: DataFrame, now: Column, ttl: int = TTL, column: str = "text") -> None:
        rows = texts.select(key(F.col(column), "payload").alias("hash"), F.col(column).alias("original"), now.cast("long").alias("created_at"), F.lit(ttl).cast("long").alias("ttl_seconds"))
        rows.dropDuplicates(["hash"]).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        d = self.spark.read.schema("hash string, original string, created_at long, ttl_seconds long").parquet(self.path)
        newest = d.groupBy("hash").agg(F.max(F.struct("created_at", "ttl_seconds", "original")).alias("r"))
        return newest.select("hash", "r.original", "r.created_at", "r.ttl_seconds")

    def live(self, now: Column | int) -> DataFrame:
        now = F.lit(now) if isinstance(now, int) else now
        return self.rows().filter(F.col("created_at") + F.col("ttl_seconds") > now)

    def get(self, hashes: DataFrame, now: Column | int) -> DataFrame:
        """hash, original of those hashes that are alive."""
        return self.live(now).join(hashes.select("hash").distinct(), "hash", "left_semi").select("hash", "original")

    def newest(self, capacity: int = CAPACITY) -> DataFrame:
        """What a store of this capacity holds: the last put first."""
        return self.rows().orderBy(F.desc("created_at"), "hash").limit(capacity)

    def compact(self, target: str, now: Column | int) -> Store:
        """The live rows, rewritten elsewhere."""
        self.live(now).select("hash", "original", "created_at", "ttl_seconds").write.mode("overwrite").parquet(target)
        return Store(self.spark, target)
