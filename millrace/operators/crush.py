"""Arrays end to end: the rows that a strategy keeps, the crushed text with its marker, and what was dropped.

Items: array_id, idx, raw (the JSON of the item). Nothing is lost: the dropped rows of an array
are one entry of the store, and the marker in the crushed text names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions.text import key

from . import json_rows

#: Arrays of fewer items are left alone; an array keeps so many rows, besides those that must stay.
LEAST, MOST = 5, 15


def planned(items: DataFrame, strategies: DataFrame, must: Column, cluster: Column, score: Column, change: Column, most: int = MOST, reach: int = 2) -> DataFrame:
    """items with keep: whether the strategy of their array keeps a row.

    strategies: array_id, strategy. Rows that must stay (errors, anomalies) stay under every
    strategy. One exchange by array serves all of them: a strategy is a rank within its array.
    cluster, score and change give a row's cluster key, its score and whether it is a change point."""
    whole = W.partitionBy("array_id")
    d = items.join(strategies.select("array_id", "strategy"), "array_id", "left")
    d = d.withColumns({"_must": F.coalesce(must, F.lit(False)), "_n": F.count(F.lit(1)).over(whole), "_cluster": cluster, "_score": score, "_change": F.coalesce(change, F.lit(False)).cast("int")})
    d = d.withColumns(
        {
            "_near": F.max("_change").over(whole.orderBy("idx").rowsBetween(-reach, reach)),
            "_top": F.row_number().over(whole.orderBy(F.desc("_score"), "idx")),
            "_in": F.row_number().over(W.partitionBy("array_id", "_cluster").orderBy("idx")),
        }
    )
    edge = (F.col("idx") < 3) | (F.col("idx") >= F.col("_n") - 2)
    first = F.when(F.col("strategy") == "time_series", edge | (F.col("_near") == 1)).when(F.col("strategy") == "cluster", F.col("_in") <= 2).when(F.col("strategy") == "top_n", F.col("_top") <= most).otherwise(edge)
    rank = F.when(F.col("_must"), 0).when(first, 1).otherwise(F.when(F.col("strategy") == "smart_sample", 2).otherwise(3))
    d = d.withColumn("_rank", rank).withColumn("_turn", F.row_number().over(whole.orderBy("_rank", "idx")))
    whole_stays = (F.col("_n") < LEAST) | F.coalesce(F.col("strategy").isin("none", "skip"), F.lit(True))
    keep = whole_stays | F.col("_must") | ((F.col("_rank") <= 2) & (F.col("_turn") <= most))
    return d.withColumn("keep", keep).select(*items.columns, "strategy", "keep")


def crushed(planned: DataFrame) -> DataFrame:
    """array_id, n_items, n_kept, text, hash, dropped: the kept rows as JSON with a last row that
    names what was dropped, and the dropped rows for the store (null if there are none)."""

    def rows(kept: bool) -> Column:
        found = F.collect_list(F.when(F.col("keep") == kept, F.struct("idx", "raw")))
        return F.array_join(F.transform(F.array_sort(found), lambda x: x["raw"]), ",")

    g = planned.groupBy("array_id").agg(F.count(F.lit(1)).alias("n_items"), F.count(F.when(F.col("keep"), 1)).alias("n_kept"), rows(True).alias("_kept"), rows(False).alias("_gone"))
    some = F.col("n_kept") < F.col("n_items")
    g = g.withColumn("dropped", F.when(some, F.concat(F.lit("["), "_gone", F.lit("]")))).withColumn("hash", key(F.col("dropped"), "row"))
    marker = F.concat(F.lit('{"_ccr_dropped":"<<ccr:'), "hash", F.lit(" "), (F.col("n_items") - F.col("n_kept")).cast("string"), F.lit('_rows_offloaded>>"}'))
    text = F.concat(F.lit("["), F.concat_ws(",", F.when(F.col("_kept") != "", F.col("_kept")), F.when(some, marker)), F.lit("]"))
    return g.select("array_id", "n_items", "n_kept", text.alias("text"), "hash", "dropped")


def crush_arrays(cells: DataFrame, items: DataFrame, text: Column, cluster: Column, score: Column, must: Column, change_field: str) -> DataFrame:
    """The whole way: statistics of the cells choose a strategy, the strategy rows, the rows the text."""
    how = json_rows.strategies(cells, items, text)
    points = json_rows.change_points(cells).filter(F.col("field") == change_field).select("array_id", F.col("position").cast("long").alias("idx")).withColumn("_point", F.lit(True))
    odd = json_rows.anomalies(cells).select("array_id", F.col("idx").cast("long").alias("idx")).distinct().withColumn("_odd", F.lit(True))
    d = items.withColumn("idx", F.col("idx").cast("long")).join(points, ["array_id", "idx"], "left").join(odd, ["array_id", "idx"], "left")
    return crushed(planned(d, how, must | F.coalesce("_odd", F.lit(False)), cluster, score, F.col("_point")))
