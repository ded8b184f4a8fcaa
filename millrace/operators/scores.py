"""Information score of items, and selection in arrays of texts or numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .json_rows import ERROR_WORDS, SIGMAS, k_split, value_key


def information(cells: DataFrame, items: DataFrame, length: Column) -> DataFrame:
    """array_id, idx, score: 0.4 rareness of values, 0.3 length, 0.3 rare or missing fields."""
    whole = W.partitionBy("array_id")
    n = items.groupBy("array_id").agg(F.count(F.lit(1)).alias("n"))
    d = cells.withColumn("same", F.count(F.lit(1)).over(W.partitionBy("array_id", "field", value_key())))
    fields = cells.groupBy("array_id", "field").agg(F.count(F.lit(1)).alias("freq")).join(n, "array_id")
    kinds = fields.groupBy("array_id").agg(F.count(F.when(F.col("freq") < 0.2 * F.col("n"), 1)).alias("rare"), F.count(F.when(F.col("freq") >= 0.8 * F.col("n"), 1)).alias("common"))
    per = d.join(fields, ["array_id", "field"]).groupBy("array_id", "idx").agg(F.avg(1 - F.col("same") / F.col("n")).alias("rareness"), F.count(F.when(F.col("freq") < 0.2 * F.col("n"), 1)).alias("has_rare"), F.count(F.when(F.col("freq") >= 0.8 * F.col("n"), 1)).alias("has_common"))
    sized = items.select("array_id", "idx", length.alias("len")).withColumns({"lo": F.min("len").over(whole), "hi": F.max("len").over(whole), "n": F.count(F.lit(1)).over(whole)})
    j = sized.join(per, ["array_id", "idx"]).join(kinds, "array_id")
    long = F.when((F.col("n") < 2) | (F.col("lo") == F.col("hi")), 0.5).otherwise((F.col("len") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)))
    shape = F.when(F.col("n") < 2, 0.5).otherwise(F.coalesce(0.5 * F.col("has_rare") / F.nullif(F.col("rare"), F.lit(0)), F.lit(0.0)) + F.coalesce(0.5 * (F.col("common") - F.col("has_common")) / F.nullif(F.col("common"), F.lit(0)), F.lit(0.0)))
    rare = F.when(F.col("n") < 2, 0.5).otherwise(F.col("rareness"))
    return j.select("array_id", "idx", (rare * 0.4 + long * 0.3 + F.least(F.lit(1.0), shape) * 0.3).alias("score"))


def _strided(d: DataFrame, must: Column, k: Column, extra: Column, distinct: Column | None) -> DataFrame:
    """Rows that must stay, and others at an even stride up to k plus `extra`; of equal contents one."""
    whole = W.partitionBy("array_id")
    d = d.withColumn("must", must).withColumn("room", F.greatest(F.lit(0), k - F.sum(F.col("must").cast("int")).over(whole)))
    d = d.withColumns({"stride": F.greatest(F.lit(1), F.floor((F.col("n") - 1) / (F.col("room") + 1))), "more": extra})
    step = ~F.col("must") & (F.col("room") > 0) & (F.col("idx") % F.col("stride") == 0)
    d = d.withColumn("step", step)
    if distinct is not None:
        same = W.partitionBy("array_id", distinct)
        d = d.withColumn("known", F.max(F.col("must").cast("int")).over(same)).withColumn("turn", F.row_number().over(W.partitionBy("array_id", "step", distinct).orderBy("idx")))
        d = d.withColumn("step", F.col("step") & (F.col("known") == 0) & (F.col("turn") == 1))
    d = d.withColumn("place", F.row_number().over(W.partitionBy("array_id", "step").orderBy("idx")))
    cap = k + F.col("more") - F.sum(F.col("must").cast("int")).over(whole)
    return d.withColumn("cap", cap).filter(F.col("must") | (F.col("step") & (F.col("place") <= F.col("cap")))).select("array_id", "idx")


def crushed_texts(items: DataFrame, k: int = 15) -> DataFrame:
    """array_id, idx of the texts kept (items: array_id, idx, item): errors, odd lengths, both ends, and an even stride of distinct ones."""
    whole = W.partitionBy("array_id")
    size = F.char_length("item").cast("double")
    d = items.withColumns({"n": F.count(F.lit(1)).over(whole), "mean": F.avg(size).over(whole), "sd": F.stddev_samp(size).over(whole)})
    front, back, _ = k_split(F.lit(k))
    error, odd = F.lower("item").rlike("|".join(ERROR_WORDS)), F.coalesce((F.col("sd") > 0) & (F.abs(size - F.col("mean")) > SIGMAS * F.col("sd")), F.lit(False))
    d = d.withColumns({"error": error, "odd": odd})
    d = d.withColumn("extra", F.sum(F.col("error").cast("int")).over(whole) + F.sum(F.col("odd").cast("int")).over(whole))
    must = (F.col("n") <= 8) | F.col("error") | F.col("odd") | (F.col("idx") < front) | (F.col("idx") >= F.col("n") - back)
    return _strided(d, must, F.lit(k), F.col("extra"), F.col("item"))


def crushed_numbers(items: DataFrame, k: int = 15) -> DataFrame:
    """array_id, idx of the numbers kept (items: array_id, idx, num): outliers, change points, both ends, and an even stride."""
    whole, order = W.partitionBy("array_id"), W.partitionBy("array_id").orderBy("idx")
    d = items.withColumns({"n": F.count(F.lit(1)).over(whole), "mean": F.avg("num").over(whole), "sd": F.stddev_samp("num").over(whole), "before": F.avg("num").over(order.rowsBetween(-5, -1)), "after": F.avg("num").over(order.rowsBetween(0, 4))})
    front, back, _ = k_split(F.lit(k))
    odd = F.coalesce((F.col("sd") > 0) & (F.abs(F.col("num") - F.col("mean")) > SIGMAS * F.col("sd")), F.lit(False))
    change = F.coalesce((F.col("n") > 10) & (F.col("idx") >= 5) & (F.col("idx") < F.col("n") - 5) & (F.col("sd") > 0) & (F.abs(F.col("after") - F.col("before")) > SIGMAS * F.col("sd")), F.lit(False))
    d = d.withColumns({"odd": odd, "change": change}).withColumn("extra", F.sum(F.col("odd").cast("int")).over(whole))
    must = (F.col("n") <= 8) | F.col("odd") | F.col("change") | (F.col("idx") < front) | (F.col("idx") >= F.col("n") - back)
    return _strided(d, must, F.lit(k), F.col("extra"), None)
