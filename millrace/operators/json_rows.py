"""Statistics, outliers, patterns and row selection over arrays of dicts in long form.

Input is one row per item and field: array_id, idx, field, kind ('numeric' or 'string'), str,
num (see millrace.sources.derived.long_form). All windows share the partitioning
(array_id, field) or array_id, so a chain of them costs one exchange each.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Thresholds of the analyzer and the selector.
CHANGE_WINDOW, SIGMAS = 5, 2.0
ERROR_WORDS = ["error", "exception", "failed", "failure", "critical", "fatal", "crash", "panic", "abort", "timeout", "denied", "rejected"]
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}.*)?$"
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
BASE_REDUCTION = {"time_series": 0.7, "cluster": 0.8, "top_n": 0.6, "smart_sample": 0.5}

ARRAY_FIELD = ["array_id", "field"]


def value_key() -> Column:
    """What makes a value distinct: a missing value counts as one of its own."""
    return F.coalesce(F.when(F.col("kind") == "numeric", F.col("num").cast("string")).otherwise(F.col("str")), F.lit("\u0000"))


def field_stats(cells: DataFrame) -> DataFrame:
    """One row per array and field: type, counts, uniqueness, and numeric or text statistics."""
    return cells.groupBy(*ARRAY_FIELD, "kind").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(value_key()).alias("unique_count"),
        F.min("num").alias("min_val"),
        F.max("num").alias("max_val"),
        F.avg("num").alias("mean_val"),
        F.when(F.count("num") > 1, F.var_samp("num")).when(F.count("num") == 1, F.lit(0.0)).alias("variance"),
        F.avg(F.char_length("str").cast("double")).alias("avg_length"),
    ).withColumns({"unique_ratio": F.col("unique_count") / F.col("n"), "is_constant": F.col("unique_count") == 1})


def top_values(cells: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent texts of each field; of equal counts the one seen first."""
    counts = cells.filter("kind = 'string' AND str IS NOT NULL").groupBy(*ARRAY_FIELD, "str").agg(F.count(F.lit(1)).alias("c"), F.min("idx").alias("first"))
    return counts.withColumn("place", F.row_number().over(W.partitionBy(*ARRAY_FIELD).orderBy(F.desc("c"), "first"))).filter(F.col("place") <= k).select(*ARRAY_FIELD, "str", "c", "place")


def change_candidates(cells: DataFrame, window: int = CHANGE_WINDOW, sigmas: float = SIGMAS) -> DataFrame:
    """Positions where the means of the values before and after differ by more than sigmas deviations."""
    order = W.partitionBy(*ARRAY_FIELD).orderBy("idx")
    whole = W.partitionBy(*ARRAY_FIELD)
    d = cells.filter("kind = 'numeric' AND num IS NOT NULL").select(
        *ARRAY_FIELD,
        (F.row_number().over(order) - 1).alias("position"),
        F.count(F.lit(1)).over(whole).alias("n"),
        F.stddev_samp("num").over(whole).alias("sd"),
        F.avg("num").over(order.rowsBetween(-window, -1)).alias("before"),
        F.avg("num").over(order.rowsBetween(0, window - 1)).alias("after"),
    )
    return d.filter((F.col("n") >= 2 * window) & (F.col("sd") > 0) & (F.col("position") >= window) & (F.col("position") < F.col("n") - window) & (F.abs(F.col("after") - F.col("before")) > sigmas * F.col("sd"))).select(*ARRAY_FIELD, "position")


def change_points(cells: DataFrame, window: int = CHANGE_WINDOW) -> DataFrame:
    """Candidates, of which each has to lie more than `window` behind the last one kept (one pass over each field's)."""

    @F.pandas_udf("array<int>")
    def kept(lists: pd.Series) -> pd.Series:
        def one(positions) -> list[int]:
            out: list[int] = []
            for x in sorted(positions):
                if not out or x - out[-1] > window:
                    out.append(int(x))
            return out

        return lists.map(one)

    lists = change_candidates(cells, window).groupBy(*ARRAY_FIELD).agg(F.collect_list("position").alias("all"))
    return lists.select(*ARRAY_FIELD, F.explode(kept("all")).alias("position"))


def temporal_fields(cells: DataFrame) -> DataFrame:
    """Fields that hold times: ISO texts in more than half of the first ten items, or unix times."""
    sample = (F.col("idx") < 10) & F.col("str").isNotNull()
    found = cells.groupBy(*ARRAY_FIELD, "kind").agg(
        F.count(F.when(sample, 1)).alias("sampled"), F.count(F.when(sample & F.col("str").rlike(ISO), 1)).alias("iso"), F.min("num").alias("low")
    )
    unix = F.col("low").between(1e9, 2e9) | F.col("low").between(1e12, 2e12)
    return found.filter(((F.col("kind") == "string") & (F.col("sampled") > 0) & (F.col("iso") / F.col("sampled") > 0.5)) | ((F.col("kind") == "numeric") & unix)).select(*ARRAY_FIELD)


def entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters over its maximum; 0 for fewer than two distinct ones."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    distinct = F.array_distinct(letters)
    n = F.size(letters)
    bits = F.aggregate(distinct, F.lit(0.0), lambda a, c: a - (F.size(F.filter(letters, lambda x: x == c)) / n) * F.log2(F.size(F.filter(letters, lambda x: x == c)) / n))
    return F.when(F.size(distinct) < 2, 0.0).otherwise(bits / F.log2(F.least(F.size(distinct), n).cast("double")))


def sequential_fields(cells: DataFrame, most: int | None = None) -> DataFrame:
    """Numeric fields that count up: sorted steps of 0.5 to 2, mostly ascending in order. Columns: is_sequential."""
    d = cells.filter("kind = 'numeric' AND num IS NOT NULL")
    if most:
        d = d.filter(F.col("idx") < most)
    by_value = F.col("num") - F.lag("num").over(W.partitionBy(*ARRAY_FIELD).orderBy("num", "idx"))
    by_place = F.col("num") - F.lag("num").over(W.partitionBy(*ARRAY_FIELD).orderBy("idx"))
    g = d.select(*ARRAY_FIELD, by_value.alias("step"), by_place.alias("move")).groupBy(*ARRAY_FIELD).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("step").alias("mean_step"),
        F.avg(F.when(F.col("step").between(0.5, 2.0), 1.0).when(F.col("step").isNotNull(), 0.0)).alias("even"),
        F.avg(F.when(F.col("move") >= 0, 1.0).when(F.col("move").isNotNull(), 0.0)).alias("up"),
    )
    return g.select(*ARRAY_FIELD, F.coalesce((F.col("n") >= 5) & F.col("mean_step").between(0.5, 2.0) & (F.col("even") > 0.8) & (F.col("up") > 0.7), F.lit(False)).alias("is_sequential"))


def id_fields(cells: DataFrame) -> DataFrame:
    """Every field with its confidence of being an identifier (0: it is none)."""
    stats = field_stats(cells)
    sample = cells.filter((F.col("idx") < 20) & F.col("str").isNotNull()).groupBy(*ARRAY_FIELD).agg(F.avg(F.when(F.col("str").rlike(UUID), 1.0).otherwise(0.0)).alias("uuids"), F.avg(entropy(F.col("str"))).alias("bits"))
    j = stats.join(sample, ARRAY_FIELD, "left").join(sequential_fields(cells), ARRAY_FIELD, "left")
    ratio = F.col("unique_ratio")
    confidence = (
        F.when(ratio < 0.9, 0.0)
        .when((F.col("kind") == "string") & (F.col("uuids") > 0.8), 0.95)
        .when((F.col("kind") == "string") & (F.col("bits") > 0.7) & (ratio > 0.95), 0.8)
        .when((F.col("kind") == "numeric") & F.col("is_sequential") & (ratio > 0.95), 0.9)
        .when((F.col("kind") == "numeric") & (F.col("max_val") > F.col("min_val")) & (ratio > 0.95), 0.85)
        .when(ratio > 0.98, 0.7)
        .otherwise(0.0)
    )
    return j.select(*ARRAY_FIELD, confidence.alias("confidence"), "unique_ratio", "kind")


def score_fields(cells: DataFrame) -> DataFrame:
    """Numeric fields that look like scores, with their confidence."""
    d = cells.filter("kind = 'numeric' AND num IS NOT NULL")
    order = W.partitionBy(*ARRAY_FIELD).orderBy("idx")
    p = d.select(*ARRAY_FIELD, "num", (F.row_number().over(order) - 1).alias("position"), F.lag("num").over(order).alias("before"))
    g = p.groupBy(*ARRAY_FIELD).agg(
        F.min("num").alias("low"),
        F.max("num").alias("high"),
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("before") >= F.col("num"), 1.0).when(F.col("before").isNotNull(), 0.0)).alias("down"),
        F.avg(F.when(F.col("position") < 20, F.when(F.col("num") != F.col("num").cast("long"), 1.0).otherwise(0.0))).alias("fractions"),
    )
    j = g.join(sequential_fields(cells, 50), ARRAY_FIELD, "left")
    low, high = F.col("low"), F.col("high")
    bounded = F.when((low >= 0) & (high <= 1), 0.4).when((low >= 0) & (high <= 10), 0.3).when((low >= 0) & (high <= 100), 0.25).when((low >= -1) & (high <= 1), 0.35)
    confidence = bounded + F.when((F.col("n") >= 5) & (F.col("down") > 0.7), 0.3).otherwise(0.0) + F.when(F.col("fractions") > 0.3, 0.1).otherwise(0.0)
    return j.filter(~F.coalesce("is_sequential", F.lit(False)) & bounded.isNotNull()).select(*ARRAY_FIELD, F.round(F.least(confidence, F.lit(0.95)), 6).alias("confidence")).filter("confidence >= 0.4")


def rare_values(cells: DataFrame) -> DataFrame:
    """Items whose value is outside the few values that cover 80 % of a field of 2 to 50 values."""
    d = cells.filter("kind = 'string' OR num = floor(num)").withColumn("v", value_key())
    counts = d.groupBy(*ARRAY_FIELD, "v").agg(F.count(F.lit(1)).alias("c"))
    whole, order = W.partitionBy(*ARRAY_FIELD), W.partitionBy(*ARRAY_FIELD).orderBy(F.desc("c"), "v")
    ranked = counts.select(*ARRAY_FIELD, "v", F.count(F.lit(1)).over(whole).alias("values"), F.sum("c").over(whole).alias("total"), F.coalesce(F.sum("c").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = ranked.withColumn("top", F.col("before") < F.ceil(F.col("total") * 0.8))
    tops = ranked.withColumn("tops", F.sum(F.col("top").cast("int")).over(whole)).filter(F.col("values").between(2, 50) & (F.col("tops") <= 5) & ~F.col("top") & (F.col("total") >= 5))
    return d.join(tops.select(*ARRAY_FIELD, "v"), [*ARRAY_FIELD, "v"]).select("array_id", "idx").distinct()


def anomalies(cells: DataFrame, sigmas: float = SIGMAS) -> DataFrame:
    """Items with a number more than sigmas deviations from its field's mean."""
    whole = W.partitionBy(*ARRAY_FIELD)
    d = cells.filter("kind = 'numeric'").withColumns({"m": F.avg("num").over(whole), "v": F.var_samp("num").over(whole)})
    return d.filter((F.col("v") > 0) & (F.abs(F.col("num") - F.col("m")) > sigmas * F.sqrt("v"))).select("array_id", "idx").distinct()


def error_items(items: DataFrame, text: Column) -> DataFrame:
    """Items whose text holds an error word, anywhere, in any case."""
    return items.filter(F.lower(text).rlike("|".join(ERROR_WORDS))).select("array_id", "idx")


def patterns(cells: DataFrame) -> DataFrame:
    """array_id, pattern: time_series, logs, search_results or generic."""
    s = field_stats(cells)
    flags = s.groupBy("array_id").agg(
        F.bool_or((F.col("kind") == "numeric") & (F.col("variance") > 0)).alias("varies"),
        F.bool_or((F.col("kind") == "string") & (F.col("unique_ratio") > 0.5) & (F.col("avg_length") > 20)).alias("message"),
        F.bool_or((F.col("kind") == "string") & (F.col("unique_ratio") < 0.1) & F.col("unique_count").between(2, 10)).alias("level"),
    )
    times = temporal_fields(cells).select("array_id").distinct().withColumn("time", F.lit(True))
    scores = score_fields(cells).filter("confidence >= 0.5").select("array_id").distinct().withColumn("score", F.lit(True))
    j = flags.join(times, "array_id", "left").join(scores, "array_id", "left")
    return j.select("array_id", F.when(F.col("time") & F.col("varies"), "time_series").when(F.col("message") & F.col("level"), "logs").when(F.col("score"), "search_results").otherwise("generic").alias("pattern"))


def crushability(cells: DataFrame, items: DataFrame, text: Column) -> DataFrame:
    """array_id, n_items, crushable, confidence, reason."""
    s = field_stats(cells)
    ids = id_fields(cells).filter("confidence > 0").withColumn("place", F.row_number().over(W.partitionBy("array_id").orderBy(F.desc("confidence"), "field"))).filter("place = 1").select("array_id", F.col("field").alias("id_field"), F.col("confidence").alias("id_confidence"), F.col("unique_ratio").alias("id_ratio"))
    j = s.join(ids, "array_id", "left")
    other = ~F.col("field").eqNullSafe(F.col("id_field"))
    per = j.groupBy("array_id").agg(
        F.max("n").alias("n_items"),
        F.first("id_confidence").alias("id_confidence"),
        F.coalesce(F.first("id_ratio"), F.lit(0.0)).alias("id_ratio"),
        F.coalesce(F.avg(F.when((F.col("kind") == "string") & other, F.col("unique_ratio"))), F.lit(0.0)).alias("strings"),
        F.coalesce(F.avg(F.when((F.col("kind") == "numeric") & other, F.col("unique_ratio"))), F.lit(0.0)).alias("numbers"),
    )
    signals = None
    for part in (score_fields(cells).select("array_id"), rare_values(cells).select("array_id"), error_items(items, text).select("array_id"), anomalies(cells).select("array_id"), change_candidates(cells).select("array_id")):
        signals = part if signals is None else signals.unionByName(part)
    d = per.join(signals.distinct().withColumn("signal", F.lit(True)), "array_id", "left").withColumn("signal", F.coalesce("signal", F.lit(False)))
    has_id = F.coalesce(F.col("id_confidence") >= 0.7, F.lit(False))
    most, content = F.greatest("strings", "id_ratio"), F.greatest("strings", "numbers")

    def case(*values):
        return (
            F.when((content < 0.1) & has_id, values[0])
            .when(most < 0.3, values[1])
            .when(has_id & (most > 0.8) & ~F.col("signal"), values[2])
            .when((most > 0.8) & F.col("signal"), values[3])
            .when(~F.col("signal"), values[4])
            .otherwise(values[5])
        )

    return d.select(
        "array_id",
        "n_items",
        case(True, True, False, True, False, True).alias("crushable"),
        case(0.85, 0.9, 0.85, 0.7, 0.6, 0.5).alias("confidence"),
        case("repetitive_content_with_ids", "low_uniqueness_safe_to_sample", "unique_entities_no_signal", "unique_entities_with_signal", "medium_uniqueness_no_signal", "medium_uniqueness_with_signal").alias("reason"),
    )


def strategies(cells: DataFrame, items: DataFrame, text: Column, least: int = 5) -> DataFrame:
    """array_id, strategy and the estimated reduction."""
    c = crushability(cells, items, text).join(patterns(cells), "array_id")
    changes = change_candidates(cells).select("array_id").distinct().withColumn("changes", F.lit(True))
    stats = field_stats(cells)
    message = stats.filter(F.lower("field").contains("message")).withColumn("place", F.row_number().over(W.partitionBy("array_id").orderBy("field"))).filter("place = 1").select("array_id", F.col("unique_ratio").alias("message_ratio"))
    constants = stats.groupBy("array_id").agg(F.avg(F.col("is_constant").cast("double")).alias("constants"))
    j = c.join(changes, "array_id", "left").join(message, "array_id", "left").join(constants, "array_id")
    strategy = (
        F.when(F.col("n_items") < least, "none")
        .when(~F.col("crushable"), "skip")
        .when((F.col("pattern") == "time_series") & F.col("changes"), "time_series")
        .when((F.col("pattern") == "logs") & (F.col("message_ratio") < 0.5), "cluster")
        .when(F.col("pattern") == "search_results", "top_n")
        .otherwise("smart_sample")
    )
    base = F.when(F.col("strategy") == "none", 0.0)
    for name, b in BASE_REDUCTION.items():
        base = base.when(F.col("strategy") == name, F.least(F.lit(0.95), F.lit(b) + F.col("constants") * 0.2))
    return j.withColumn("strategy", strategy).select("array_id", "pattern", "strategy", base.otherwise(F.least(F.lit(0.95), 0.3 + F.col("constants") * 0.2)).alias("reduction"))


def top_n(items: DataFrame, score: str, n: int) -> DataFrame:
    """The n items of the highest score in each array; of equal scores the earlier."""
    return items.withColumn("place", F.row_number().over(W.partitionBy("array_id").orderBy(F.desc(score), "idx"))).filter(F.col("place") <= n)


def cluster_sample(items: DataFrame, text: str, per_cluster: int = 2, width: int = 50) -> DataFrame:
    """The first items of each cluster of texts that begin alike."""
    cluster = F.substring(F.md5(F.left(F.col(text), F.lit(width)).cast("binary")), 1, 8)
    d = items.withColumn("cluster", cluster)
    return d.withColumn("place", F.row_number().over(W.partitionBy("array_id", "cluster").orderBy("idx"))).filter(F.col("place") <= per_cluster)


def around(flagged: DataFrame, flag: str, reach: int, partition: str = "array_id", order: str = "idx") -> DataFrame:
    """Rows within `reach` rows of a flagged one."""
    near = F.max(F.col(flag).cast("int")).over(W.partitionBy(partition).orderBy(order).rowsBetween(-reach, reach))
    return flagged.withColumn("near", near).filter("near = 1").drop("near")


def first_of_each(items: DataFrame, content: Column) -> DataFrame:
    """Of items of one content in an array the first."""
    d = items.withColumn("content_hash", F.substring(F.md5(content.cast("binary")), 1, 16))
    return d.withColumn("place", F.row_number().over(W.partitionBy("array_id", "content_hash").orderBy("idx"))).filter("place = 1").drop("place")


def strided_fill(items: DataFrame, kept: Column, most: int, content: Column) -> DataFrame:
    """Kept items, filled up to `most` with others at an even stride; contents already there are passed over."""
    whole = W.partitionBy("array_id")
    d = items.withColumns({"kept": kept, "content_hash": F.md5(content.cast("binary"))})
    d = d.withColumns(
        {
            "room": F.greatest(F.lit(0), most - F.sum(F.col("kept").cast("int")).over(whole)),
            "others": F.sum((~F.col("kept")).cast("int")).over(whole),
            "pos": F.sum((~F.col("kept")).cast("int")).over(whole.orderBy("idx")) - 1,
            "known": F.max(F.col("kept").cast("int")).over(W.partitionBy("array_id", "content_hash")),
        }
    )
    d = d.withColumn("step", F.greatest(F.lit(1), F.floor(F.col("others") / (F.col("room") + 1))).cast("int"))
    visit = [F.col("pos") % F.col("step"), F.col("pos")]
    d = d.withColumn("fresh", ~F.col("kept") & (F.col("known") == 0) & (F.row_number().over(W.partitionBy("array_id", "content_hash", "kept").orderBy(*visit)) == 1))
    d = d.withColumn("turn", F.row_number().over(W.partitionBy("array_id", "fresh").orderBy(*visit)))
    return d.filter(F.col("kept") | (F.col("fresh") & (F.col("turn") <= F.col("room")))).select(*items.columns)


def prioritized(items: DataFrame, must: Column, most: int, head: int = 3, tail: int = 2) -> DataFrame:
    """At most `most` items, but all that must stay: then the first `head`, the last `tail`, then by place."""
    whole = W.partitionBy("array_id")
    d = items.withColumns({"must": must, "n": F.count(F.lit(1)).over(whole)})
    rank = F.when(F.col("must"), 0).when(F.col("idx") < head, 1).when(F.col("idx") >= F.col("n") - tail, 2).otherwise(3)
    d = d.withColumn("turn", F.row_number().over(whole.orderBy(rank, "idx")))
    return d.filter(F.col("must") | (F.col("turn") <= most)).drop("n", "turn")


def within_budget(items: DataFrame, text: Column, tokens: int, bytes_per_token: int = 4) -> DataFrame:
    """array_id, k: how many leading items fit the budget, one at least."""
    running = F.sum(F.octet_length(text) + 1).over(W.partitionBy("array_id").orderBy("idx"))
    return items.withColumn("used", running).groupBy("array_id").agg(F.greatest(F.lit(1), F.count(F.when(F.col("used") <= tokens * bytes_per_token, 1))).alias("k"))


def number_summary(cells: DataFrame) -> DataFrame:
    """Per numeric field: mean, median, quartiles (linear) and the outliers beyond two deviations."""
    return cells.filter("kind = 'numeric'").groupBy(*ARRAY_FIELD).agg(
        F.avg("num").alias("mean"), F.expr("percentile(num, 0.5)").alias("median"), F.expr("percentile(num, 0.25)").alias("p25"), F.expr("percentile(num, 0.75)").alias("p75"), F.stddev_samp("num").alias("sd")
    )


def k_split(k: Column, first: float = 0.3, last: float = 0.15) -> tuple[Column, Column, Column]:
    """How many of k items are taken from the front, the back and between; halves round to even."""
    front = F.least(F.greatest(F.lit(1), F.bround(k * first, 0).cast("int")), k)
    back = F.least(F.greatest(F.lit(1), F.bround(k * last, 0).cast("int")), k - front)
    return front, back, k - front - back
