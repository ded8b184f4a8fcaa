"""A corpus pipeline: each stage works on all that its predecessor kept.

1. toxicity: documents that score at or above the threshold go.
2. near_duplicates: of each group of near copies one document stays.
3. repeated_spans: every string of 200 bytes that starts twice is cut out of the texts.
4. mixing: documents are repeated or dropped so that each source meets its target.
5. packing: the texts become sequences of 2048 tokens; one row per piece.

All but the last return the columns of documents. Equal inputs give equal results. No stage
can be said in SQL (a trained model, banded hashes, a tokenizer), so ORACLE_SQL is None and
the tests hold run() against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm import mixing, near_duplicates, packing, repeated_spans, toxicity
from millrace.llm.shared import documents, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.deduplicate(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated_spans.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_digest(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_spans", cut_repeats),
    ("mixing", mix_sources),
    ("packing", pack_tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each but the last is written as Parquet and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
