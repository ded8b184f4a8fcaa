"""Relevance of texts for queries: BM25 with constant idf, cosine, and their mix."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions.text import TERMS, hybrid_alpha

K1, B, MOST, LONG_TERM, BONUS = 1.5, 0.75, 10.0, 8, 0.3
BROADCAST_TERMS = 200_000


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERMS), F.lit(0))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id, score, matched: every document that shares a term with a query.

    docs: doc_id, text; queries: query_id, text. Texts are dealt once by their id; counts, the
    join with the terms asked for and the sums of a pair then stay in place, as the terms of
    BROADCAST_TERMS or fewer are broadcast (more meet their rows in a join on the term).
    idf is the constant ln 2."""
    d = docs.select("doc_id", "text").repartition("doc_id").select("doc_id", terms(F.col("text")).alias("t")).withColumn("n", F.size("t"))
    mean = docs.select(F.avg(F.size(terms(F.col("text")))).alias("mean")).scalar()
    asked = queries.select("query_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qf"))
    few = asked.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS
    counts = d.select("doc_id", "n", F.explode("t").alias("term")).groupBy("doc_id", "n", "term").agg(F.count(F.lit(1)).alias("f"))
    j = counts.join(F.broadcast(asked) if few else asked.hint("merge"), "term").withColumn("mean", mean)
    one = F.log(F.lit(2.0)) * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("n") / F.col("mean"))) * F.col("qf")
    g = j.groupBy("query_id", "doc_id").agg(F.sum(one).alias("raw"), F.count(F.lit(1)).alias("matched"), F.max((F.octet_length("term") >= LONG_TERM).cast("int")).alias("long"))
    score = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("raw") / MOST) + F.when(F.col("long") == 1, BONUS).otherwise(0.0))
    return g.select("query_id", "doc_id", score.alias("score"), "matched")


def boosted(score: Column, matched: Column) -> Column:
    """A BM25 score that has to stand alone."""
    floor = F.when(matched > 0, F.greatest(score, F.lit(0.3))).otherwise(score)
    return F.when(matched >= 2, F.least(F.lit(1.0), floor + 0.2)).otherwise(floor)


def lexical(docs: DataFrame, queries: DataFrame, places: int = 256) -> DataFrame:
    """query_id, doc_id, score: cosine of term counts in hashed places, for pairs that share a place."""
    def vector(df: DataFrame, of: str) -> DataFrame:
        e = df.select(of, F.explode(terms(F.col("text"))).alias("w")).groupBy(of, F.pmod(F.xxhash64("w"), F.lit(places)).alias("slot")).agg(F.count(F.lit(1)).alias("c"))
        return e.withColumn("norm", F.sqrt(F.sum(F.col("c") * F.col("c")).over(W.partitionBy(of))))

    d = vector(docs, "doc_id").select("doc_id", "slot", F.col("c").alias("dc"), F.col("norm").alias("dn"))
    g = vector(queries, "query_id").join(d, "slot").groupBy("query_id", "doc_id").agg(F.sum(F.col("c") * F.col("dc") / (F.col("norm") * F.col("dn"))).alias("cos"))
    return g.select("query_id", "doc_id", F.least(F.lit(1.0), "cos").alias("score"))


def hybrid(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """BM25 and the lexical cosine, mixed by what the query names."""
    b, v = bm25(docs, queries), lexical(docs, queries).withColumnRenamed("score", "cos")
    a = queries.select("query_id", hybrid_alpha(F.col("text")).alias("alpha"))
    j = b.join(v, ["query_id", "doc_id"], "left").join(a, "query_id")
    return j.select("query_id", "doc_id", (F.col("alpha") * F.col("score") + (1 - F.col("alpha")) * F.coalesce("cos", F.lit(0.0))).alias("score"))


SCORERS = {"bm25": bm25, "embedding": lexical, "hybrid": hybrid}


def scorer(tier: str):
    """The scorer (docs, queries) of a tier's name, whatever its case."""
    if tier.lower() not in SCORERS:
        raise ValueError(f"no scorer is called {tier}; there are {', '.join(sorted(SCORERS))}")
    return SCORERS[tier.lower()]


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 2_048) -> DataFrame:
    """query_id, vec_id, score, place: the k vectors of the highest cosine for each query, exactly.

    vectors: vec_id, v; queries: query_id, q. Queries go out in blocks of bounded size; a batch of
    vectors meets a block in one matrix product and sends on k rows a query at most."""
    numbered = queries.withColumn("block", F.floor(F.pmod(F.xxhash64("query_id"), F.lit(1 << 30)) / F.greatest(F.lit(1), F.floor(F.lit(float((1 << 30) * block)) / F.greatest(F.lit(1), F.lit(queries.count()))))).cast("int"))
    blocks = numbered.groupBy("block").agg(F.collect_list("query_id").alias("ids"), F.collect_list("q").alias("qs"))
    names = [r.block for r in blocks.select("block").collect()] or [0]
    spread = vectors.withColumn("block", F.explode(F.array(*map(F.lit, names)))).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    left, right = spread.groupBy("block", "salt"), blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))).groupBy("block", "salt")

    def best(v: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if v.empty or b.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = np.array(v["v"].tolist(), np.float64), np.array(b["qs"].iloc[0].tolist(), np.float64)
        norm = np.sqrt((x * x).sum(axis=1))[None, :] * np.sqrt((q * q).sum(axis=1))[:, None]
        score = np.divide(q @ x.T, norm, out=np.zeros_like(norm), where=norm > 0).clip(0, 1).round(5)
        ids = v["vec_id"].to_numpy()
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score))[:, :k]
        return pd.DataFrame({"query_id": np.repeat(b["ids"].iloc[0], order.shape[1]), "vec_id": ids[order].ravel(), "score": np.take_along_axis(score, order, axis=1).ravel()})

    found = left.cogroup(right).applyInPandas(best, "query_id long, vec_id long, score double")
    return found.withColumn("place", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine clamped to [0, 1]; 0 for a zero vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norm))).otherwise(0.0)
