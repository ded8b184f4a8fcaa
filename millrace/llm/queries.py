"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, language_model, licenses, mixing, near_duplicates, packing, quality, repeated_spans, token_counts, toxicity
from .shared import documents, table

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": lambda spark, sf_dir: mixing.mixed_sizes(documents(spark, sf_dir)),
        "op2_repeated_spans": lambda spark, sf_dir: repeated_spans.repeat_digest(documents(spark, sf_dir)),
        "op3_token_counts": lambda spark, sf_dir: token_counts.token_counts(documents(spark, sf_dir)),
        "op4_lm_scores": lambda spark, sf_dir: language_model.lm_scores(documents(spark, sf_dir)),
        "op5_toxicity": lambda spark, sf_dir: toxicity.toxic_scores(documents(spark, sf_dir), table(spark, sf_dir, "labels")),
        "op6_packing": lambda spark, sf_dir: packing.packed_digest(documents(spark, sf_dir)),
        "op7_quality": lambda spark, sf_dir: quality.quality(documents(spark, sf_dir), table(spark, sf_dir, "labels")),
        "op8_licenses": lambda spark, sf_dir: licenses.license_scan(documents(spark, sf_dir)).withColumn("licenses", F.array_join("licenses", ",")),
        "op9_jaccard_join": lambda spark, sf_dir: near_duplicates.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links"),
        "op10_fingerprints": lambda spark, sf_dir: fingerprints.edit_probe(documents(spark, sf_dir)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op2_repeated_spans": repeated_spans.SQL, "op8_licenses": licenses.SQL, "op9_jaccard_join": near_duplicates.SQL}
