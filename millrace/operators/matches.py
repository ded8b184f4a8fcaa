"""Search results: parsing, scoring and selection of `file:line:text` rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .lines import importance, once
from .sizing import sizes

MATCH = r"^((?:[A-Za-z]:[\\/])?.*?[^:-])[:-](\d+)[:-](.*)$"
BUMPS = {"error": 0.5, "warning": 0.4, "importance": 0.3}


def parsed(lines: DataFrame) -> DataFrame:
    """doc_id, pos, file, line_number, text of the lines that are matches."""
    c = F.col("content")
    d = lines.select("doc_id", "pos", F.regexp_extract(c, MATCH, 1).alias("file"), F.regexp_extract(c, MATCH, 2).alias("n"), F.regexp_extract(c, MATCH, 3).alias("text"))
    return d.filter("file <> ''").select("doc_id", "pos", "file", F.col("n").cast("long").alias("line_number"), "text")


def match_score(text: Column, words: list[str]) -> Column:
    """0.3 for each context word of three bytes or more, a bump by importance; 1 at most."""
    total = F.lit(0.0)
    for w in words:
        if len(w.encode()) > 2:
            total = total + F.when(F.lower(text).contains(w.lower()), 0.3).otherwise(0.0)

    def bump(category: Column) -> Column:
        out = F.when(F.lit(False), 0.0)
        for name, b in BUMPS.items():
            out = out.when(category == name, b)
        return out.otherwise(0.0)

    return F.least(F.lit(1.0), total + once(importance(text, "search"), bump))


def file_ranks(matches: DataFrame) -> DataFrame:
    """doc_id, file, n, total, place: files by total score, then by name."""
    g = matches.groupBy("doc_id", "file").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("total"), "file")))


def totals(matches: DataFrame) -> DataFrame:
    """doc_id, total: how many matches carry the information of a result list, 5 to 30."""
    ranks = file_ranks(matches).select("doc_id", "file", "place")
    text = F.concat_ws(":", "file", F.col("line_number").cast("string"), "text")
    d = matches.join(ranks, ["doc_id", "file"])
    d = d.withColumn("idx", F.row_number().over(W.partitionBy("doc_id").orderBy("place", "pos")) - 1)
    return sizes(d.select(F.col("doc_id").alias("array_id"), "idx", text.alias("item")), 1.0, 5, 30).select(F.col("array_id").alias("doc_id"), F.col("k").alias("total"))


def selected(matches: DataFrame, per_file: int = 5, total: int | None = None, files: int = 15) -> DataFrame:
    """The matches kept: the best files; in each the first, the last and the best scored. In all as many as carry
    the list's information; `total` takes the place of that number."""
    ranks = file_ranks(matches).filter(F.col("place") <= files).select("doc_id", "file", "place")
    d = matches.join(ranks, ["doc_id", "file"])
    d = d.withColumn("_copy", F.row_number().over(W.partitionBy("doc_id", "file", "line_number", "text").orderBy("pos")))
    w = W.partitionBy("doc_id", "file")
    d = d.withColumns({"_first": F.row_number().over(w.orderBy("pos")), "_last": F.row_number().over(w.orderBy(F.desc("pos")))}).filter("_copy = 1")
    d = d.withColumn("_rank", F.row_number().over(w.orderBy(F.when(F.col("_first") == 1, 0).when(F.col("_last") == 1, 1).otherwise(2), F.desc("score"), "line_number", "pos"))).filter(F.col("_rank") <= per_file)
    d = d.withColumn("_turn", F.row_number().over(W.partitionBy("doc_id").orderBy("place", "_rank")))
    d = d.join(totals(matches), "doc_id") if total is None else d.withColumn("total", F.lit(total))
    return d.filter(F.col("_turn") <= F.col("total")).select("doc_id", "file", "line_number", "text", "score", "place")


def search_bloat(matches: DataFrame, least: int = 10, clustered: float = 10.0) -> DataFrame:
    """doc_id, bloat: how far the matches per file exceed one, over the clustering threshold."""
    g = matches.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file").alias("files"))
    return g.select("doc_id", F.when(F.col("n") < least, 0.0).otherwise(F.least(F.lit(1.0), (F.col("n") / F.col("files") - 1) / clustered)).alias("bloat"))
