"""Reports over histories and outputs, types of mixed arrays, and the sample strategy as one set of flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TYPES = ["object", "string", "number", "bool", "array"]
NAMES = {"object": "dict", "string": "string", "number": "number", "bool": "bool", "array": "nested"}


def type_tag(raw: Column) -> Column:
    """The JSON type of a raw value by its first character."""
    c = F.left(F.ltrim(raw), F.lit(1))
    return F.when(c == "{", "object").when(c == "[", "array").when(c == '"', "string").when(c.isin("t", "f"), "bool").when(c == "n", "null").otherwise("number")


def array_types(items: DataFrame) -> DataFrame:
    """array_id, array_type: the one type all items have, else mixed. items: array_id, idx, raw."""
    g = items.groupBy("array_id").agg(F.collect_set(type_tag(F.col("raw"))).alias("tags"))
    out = F.when(F.size("tags") != 1, "mixed")
    for tag, name in NAMES.items():
        out = out.when(F.col("tags")[0] == tag, name)
    return g.select("array_id", out.otherwise("mixed").alias("array_type"))


def combined_output(stdout: Column, stderr: Column) -> Column:
    """stdout, and stderr behind a mark if there is any."""
    return F.when(F.coalesce(stderr, F.lit("")) == "", stdout).when(F.coalesce(stdout, F.lit("")) == "", F.concat(F.lit("[stderr]\n"), stderr)).otherwise(F.concat(stdout, F.lit("\n[stderr]\n"), stderr))


def smart_sample(items: DataFrame, flags: dict[str, Column], most: int = 15, head: int = 3, tail: int = 2) -> DataFrame:
    """Items with a flag, the first and the last ones; flagged ones all stay, the rest share what is left of `most`."""
    whole = W.partitionBy("array_id")
    must = F.lit(False)
    for f in flags.values():
        must = must | F.coalesce(f, F.lit(False))
    d = items.withColumns({"must": must, "n": F.count(F.lit(1)).over(whole)})
    rank = F.when(F.col("must"), 0).when(F.col("idx") < head, 1).when(F.col("idx") >= F.col("n") - tail, 2).otherwise(3)
    d = d.withColumn("turn", F.row_number().over(whole.orderBy(rank, "idx")))
    return d.filter(F.col("must") | (F.col("turn") <= most)).select("array_id", "idx", "must")


def diff_summary(lines: DataFrame, per_hunk: int = 8) -> DataFrame:
    """Headers of files and hunks, and the first changes of each hunk."""
    c = F.col("content")
    header = c.rlike(r"^(diff --git|\+\+\+ |--- |@@)")
    change = c.rlike(r"^[+-]") & ~c.rlike(r"^(\+\+\+|---)") & ~header
    order = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    d = lines.withColumns({"header": header, "change": change, "hunk": F.sum(c.startswith("@@").cast("int")).over(order)})
    d = d.withColumn("place", F.sum(F.col("change").cast("int")).over(W.partitionBy("doc_id", "hunk").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    return d.filter(F.col("header") | (F.col("change") & (F.col("place") <= per_hunk))).select("doc_id", "pos", "content")


def learned(history: DataFrame, least_runs: int = 20, least_saved: int = 1_000_000) -> DataFrame:
    """kind, command, evidence: which commands to run through the engine, by their history."""
    g = history.groupBy("command").agg(F.count(F.lit(1)).alias("runs"), F.sum("bytes_saved").alias("bytes_saved"))
    kind = F.when(F.col("bytes_saved") >= least_saved, "rewrite").when(F.col("runs") >= least_runs, "watch").otherwise("none")
    return g.select(kind.alias("kind"), "command", "runs", "bytes_saved")
