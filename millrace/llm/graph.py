"""Connected components of an undirected graph, by alternating large and small stars.

Each round gives every node the least node it knows and hangs its neighbours there; the rounds
needed grow with the logarithm of the longest path. Neighbourhoods are never collected: a
round is an aggregate and a join back, in which Spark can split the rows of a hot hub.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize


def joined_apart(rows: DataFrame, grouped: DataFrame, key: str) -> DataFrame:
    """rows joined with one row per key of grouped. A hash of the key goes along as a key of its
    own: the aggregate behind `grouped` is not dealt by that pair, so both sides get an exchange
    made for this join, and Spark can split a hot key's rows over tasks."""
    spread = F.xxhash64(key).alias("__mr_spread")
    return rows.select("*", spread).join(grouped.select("*", spread).hint("merge"), ["__mr_spread", key]).drop("__mr_spread")


def _star(edges: DataFrame) -> DataFrame:
    """(u, v) with every v hung to the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return joined_apart(edges, least, "u").select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is the least node of its component."""
    now = materialize(edges.filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _star(down)
        before, now = now, materialize(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(before)
        # The edges as a set no longer change: every node hangs directly to its root.
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
