"""Quality rules: a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Words and word pairs of a text fall into BUCKETS hashed buckets. Two multinomials are counted
over them: of the trusted target (all documents labelled as good) and of the raw corpus (all
words of all documents). The good ids are broadcast only while their bytes, which are summed
first, stay within BROADCAST_BYTES; beyond, a sort-merge join finds the same rows. The score of
a text is the mean of log(target / raw) over its n-grams, so it does not grow with length,
and a fixed threshold decides on every document. The two counts are BUCKETS rows; they reach
the scoring pass as one array, a scalar subquery.

Base counts (characters, symbols, repeated lines and windows of words) come beside it, and a
text that is too short or repeats too much fails whatever its score.

Defined cases: a null or empty text has no words and fails; without any trusted document the
score is 0 and the base decides; rows that repeat an id are judged each by itself; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, text_of, words_of

BUCKETS = 1 << 14
BROADCAST_BYTES = 16 << 20  # of the good ids as text; each counts 16 bytes more
SMOOTHING = 20.0  # added to each bucket's count
THRESHOLD = -0.07
SYMBOLS = "#*$%&|<>"


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


def with_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __mr_words, and their hashes and those of word pairs.

    Each step is a projection of its own: its result is used more than once."""
    size = F.size("__mr_hash")
    return (
        docs.withColumn("__mr_words", words_of(text))
        .withColumn("__mr_hash", F.transform("__mr_words", lambda w: F.xxhash64(w)))
        .withColumn("__mr_pairs", F.zip_with(F.slice("__mr_hash", 1, F.greatest(size - 1, F.lit(0))), F.slice("__mr_hash", 2, F.greatest(size - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b)))
    )


def _trusted(good: DataFrame, id_column: str, most_bytes: int) -> DataFrame:
    """The distinct good ids, hinted as a broadcast if their bytes allow it, else for a sort-merge join."""
    ids = good.select(F.col(id_column).alias("__mr_good")).filter(F.col("__mr_good").isNotNull()).distinct()
    n_bytes = ids.agg(F.coalesce(F.sum(F.octet_length(F.col("__mr_good").cast("string")) + 16), F.lit(0))).first()[0]
    return ids.hint("broadcast" if n_bytes <= most_bytes else "merge")


def log_ratios(docs: DataFrame, good: DataFrame, id_column: str = "doc_id", text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """One row, one column: array<double> of log(target / raw), by bucket. good: trusted ids."""
    spark = docs.sparkSession
    trusted = _trusted(good, id_column, broadcast_bytes)
    thin = docs.select(F.col(id_column).alias("__mr_id"), F.col(text)).join(trusted, F.col("__mr_id") == F.col("__mr_good"), "left").select(text, F.col("__mr_good").isNotNull().cast("long").alias("__mr_trusted"))
    grams = with_words(thin, text).select("__mr_trusted", F.explode(F.concat("__mr_hash", "__mr_pairs")).alias("h"))
    counts = grams.groupBy(_bucket(F.col("h")).alias("b")).agg(F.count(F.lit(1)).alias("raw"), F.sum("__mr_trusted").alias("target"))
    every = spark.range(BUCKETS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").select("b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("target", F.lit(0)).alias("target"))
    lists = every.agg(F.sort_array(F.collect_list(F.struct("b", "raw", "target"))).alias("l"), F.sum("raw").alias("n"), F.sum("target").alias("m"))
    # Raw counts at the target's size, and the same smoothing for both: what few trusted documents
    # do not show by chance counts for little.
    expected = lambda x: x["raw"] * (F.col("m") / F.col("n"))
    ratio = F.transform("l", lambda x: F.when(F.col("m") > 0, F.log((x["target"] + SMOOTHING) / (expected(x) + SMOOTHING))).otherwise(0.0))
    return lists.select(ratio.alias("ratios"))


def judged(docs: DataFrame, good: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, __mr_score and kept."""
    body = text_of(text)
    lines = F.filter(F.split(body, "\n"), lambda line: F.length(F.translate(line, SPACES + " ", "")) > 0)
    five = F.when(F.size("__mr_hash") >= 5, F.transform(F.sequence(F.lit(0), F.size("__mr_hash") - 5), lambda i: F.xxhash64(*[F.get("__mr_hash", i + k) for k in range(5)]))).otherwise(F.array().cast("array<bigint>"))
    ratios = log_ratios(docs, good, id_column, text).scalar()
    add = lambda a, h: a + F.get(F.col("__mr_ratios"), _bucket(h))
    n_grams = F.size("__mr_hash") + F.size("__mr_pairs")
    return (
        with_words(docs, text)
        .withColumn("__mr_ratios", ratios)
        .withColumns({"__mr_five": five, "__mr_lines": lines})
        .withColumn("__mr_placed", F.when(F.size(F.array_distinct("__mr_five")) < F.size("__mr_five"), F.sort_array(F.transform("__mr_five", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
        .withColumn("__mr_twice", _twice(F.col("__mr_placed")))
        .withColumns(
            {
                "n_words": F.size("__mr_words").cast("long"),
                "word_chars": F.length(F.translate(body, SPACES + " ", "")).cast("long"),
                "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
                "n_dup_lines": (F.size("__mr_lines") - F.size(F.array_distinct("__mr_lines"))).cast("long"),
                "n_repeat_words": F.coalesce(_covered(F.col("__mr_twice")), F.lit(0)).cast("long"),
                "__mr_score": F.when(n_grams > 0, (F.aggregate("__mr_hash", F.lit(0.0), add) + F.aggregate("__mr_pairs", F.lit(0.0), add)) / n_grams).otherwise(0.0),
            }
        )
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("__mr_score") >= THRESHOLD))
    )


def _twice(placed: Column) -> Column:
    """The places, in order, of the hashes that occur twice or more; placed: sorted (hash, place)."""
    marked = F.transform(placed, lambda x, k: F.when((F.coalesce(F.get(placed, k - 1)["h"] == x["h"], F.lit(False))) | F.coalesce(F.get(placed, k + 1)["h"] == x["h"], F.lit(False)), x["i"]))
    return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))


def _covered(places: Column) -> Column:
    """How many words the windows of five at these places cover together."""
    steps = F.transform(places, lambda p, k: F.least(F.lit(5), F.coalesce(F.get(places, k + 1) - p, F.lit(5))))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The verdict on every document; the trusted target is what labels call good."""
    good = labels.filter(F.col("quality") == 1).select(id_column)
    return judged(docs.select(id_column, text), good, id_column, text).select(id_column, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("__mr_score").alias("score"))
