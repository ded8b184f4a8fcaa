"""Mixing sources to target weights.

Each source's words are summed, its target is a weighted share of the whole (stopped at
`cap` times its own size), and rate = target / size. A document is emitted floor(rate)
times, plus one more copy with probability rate - floor(rate): one Bernoulli draw, seeded by
a hash of its id and its text. No draw looks at another, so a source's total deviates from its
target by chance alone, less the more documents it has. Reruns over the same files agree.

Rows that repeat an id and a text would share a draw, and a source of many such rows would
miss its target; their draws are seeded by their place in the input as well. The keys that
repeat are found by a count of thin keys (combined in tasks, so a hot key stays one row a
task); texts are not shuffled for it while those keys are few.

Defined cases: a null text has size 0; a source of size 0 has rate 0, so its documents are
not emitted (they hold no word); null sources are one source, ordered last; null ids are an
id like others; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from .shared import materialize, text_of, words_of

#: Up to so many sources, the table of sources (about 60 bytes each) is broadcast.
BROADCAST_SOURCES = 50_000
#: Beyond, the join is salted: each source's row is repeated so often, its documents are dealt over them.
SALTS = 64
#: Up to so many repeated keys (about 60 bytes each) are broadcast; more meet their rows in a join.
BROADCAST_KEYS = 50_000
DIGITS = 13  # of the digest: 52 bits, exact as a double


def _key(id_column: str, text: str) -> Column:
    """What seeds a row's draw: its id and a digest of its text."""
    return F.concat(F.coalesce(F.col(id_column).cast("string"), F.lit("null")), F.lit(":"), F.md5(text_of(text).cast("binary")))


def _draw(key: Column) -> Column:
    """A number in [0, 1) from a key."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def _by_source(docs: DataFrame, sources: DataFrame, source: str, n: int) -> DataFrame:
    """docs with the columns of its source's row; null sources meet."""
    keep = [c for c in sources.columns if c != "__mr_source"]
    if n <= BROADCAST_SOURCES:
        return docs.join(F.broadcast(sources), docs[source].eqNullSafe(sources["__mr_source"])).drop("__mr_source")
    salted = sources.withColumn("__mr_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # Null sources are given a flag, so that the join is on plain keys.
    left = docs.withColumns({"__mr_null": F.col(source).isNull(), "__mr_source_key": F.coalesce(source, F.lit("")), "__mr_salt": F.pmod(F.xxhash64(*docs.columns), F.lit(SALTS)).cast("int")})
    right = salted.select(F.col("__mr_source").isNull().alias("__mr_null"), F.coalesce("__mr_source", F.lit("")).alias("__mr_source_key"), "__mr_salt", *keep)
    return left.join(right, ["__mr_null", "__mr_source_key", "__mr_salt"]).drop("__mr_null", "__mr_source_key", "__mr_salt")


def source_rates(sized: DataFrame, source: str, share: float, weights: tuple[int, ...], cap: float) -> DataFrame:
    """One row per source: its size, weight and target. sized: source, __mr_size.

    The targets fill up like water: with lam = (total - stopped) / (weights still open), a
    source takes lam * weight or stops at its cap; lam only rises, and the loop ends when
    no further source stops. Each round collects three sums.
    """
    order = W.orderBy(F.col("__mr_source").asc_nulls_last())
    sources = materialize(
        sized.groupBy(F.col(source).alias("__mr_source"))
        .agg(F.sum("__mr_size").alias("__mr_source_size"))
        .withColumn("__mr_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))),
        "sources",
    )
    most = F.lit(cap) * F.col("__mr_source_size")
    total = (sources.agg(F.sum("__mr_source_size")).first()[0] or 0) * share
    lam, stopped = 0.0, -1
    while True:
        full = most <= F.lit(lam) * F.col("__mr_weight")
        n, held, open_weight = sources.agg(F.count(F.when(full, 1)), F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("__mr_weight")))).first()
        if n == stopped or not open_weight:
            break
        stopped, lam = n, (total - (held or 0.0)) / open_weight
    full = most <= F.lit(lam) * F.col("__mr_weight")
    if not open_weight:
        full = F.lit(True)
    return sources.withColumn("__mr_target", F.when(full, most).otherwise(F.lit(lam) * F.col("__mr_weight")))


def mix_plan(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", share: float = 1.5, weights: tuple[int, ...] = (5, 2, 1), cap: float = 2.0) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """(thin documents: id, source, __mr_size, __mr_seed; rates of sources; number of sources; keys that repeat)."""
    sized = materialize(docs.select(F.col(id_column), F.col(source).cast(T.StringType()).alias(source), F.size(words_of(text)).cast("long").alias("__mr_size"), _key(id_column, text).alias("__mr_seed"), F.monotonically_increasing_id().alias("__mr_place")), "sizes")
    rates = source_rates(sized, source, share, weights, cap)
    rate = F.when(F.col("__mr_source_size") > 0, F.col("__mr_target") / F.col("__mr_source_size")).otherwise(0.0)
    rates = rates.withColumns({"__mr_whole": F.floor(rate), "__mr_fraction": rate - F.floor(rate)})
    again = materialize(sized.groupBy(F.col("__mr_seed").alias("__mr_again")).agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("__mr_again"), "repeated")
    return sized, rates, rates.count(), again


def with_copies(docs: DataFrame, rates: DataFrame, n: int, again: DataFrame, source: str = "source") -> DataFrame:
    """docs (with __mr_seed) with __mr_copies: how often the mix emits each row."""
    placed = docs
    repeated = again.count()
    if repeated:
        placed = docs if "__mr_place" in docs.columns else docs.withColumn("__mr_place", F.monotonically_increasing_id())
        keys = F.broadcast(again) if repeated <= BROADCAST_KEYS else again.hint("merge")
        placed = placed.join(keys, F.col("__mr_seed") == F.col("__mr_again"), "left")
        placed = placed.withColumn("__mr_seed", F.when(F.col("__mr_again").isNotNull(), F.concat("__mr_seed", F.lit(":"), F.col("__mr_place").cast("string"))).otherwise(F.col("__mr_seed"))).drop("__mr_again", "__mr_place")
    found = _by_source(placed, rates, source, n)
    return found.withColumn("__mr_copies", (F.col("__mr_whole") + (_draw(F.col("__mr_seed")) < F.col("__mr_fraction")).cast("long")).cast("int"))


def mix(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed corpus: the rows of docs, repeated as their source's rate asks."""
    _, rates, n, again = mix_plan(docs, id_column, source, text, **options)
    copies = with_copies(docs.withColumn("__mr_seed", _key(id_column, text)), rates, n, again, source).filter(F.col("__mr_copies") > 0)
    return copies.withColumn("__mr_copy", F.explode(F.sequence(F.lit(1), F.col("__mr_copies")))).select(*docs.columns)


def mixed_sizes(docs: DataFrame, id_column: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The digest of a mix: what each document and its source have, and how much the mix takes."""
    sized, rates, n, again = mix_plan(docs, id_column, source, text)
    return with_copies(sized, rates, n, again, source).select(
        id_column,
        F.col("__mr_size").alias("size"),
        F.col("__mr_source_size").alias("source_size"),
        F.col("__mr_target").alias("target"),
        (F.col("__mr_size") * F.col("__mr_copies")).alias("taken"),
    )


#: The same rows in DuckDB, where ids do not repeat. The targets are found in closed form: sources in the order of cap / weight stop first.
SQL = r"""
WITH d AS (
  SELECT doc_id, source, doc_id::VARCHAR || ':' || md5(coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 2.0::DOUBLE * source_size AS most, sum(source_size) OVER () * 1.5::DOUBLE AS total,
         coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS held,
         row_number() OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST) AS place,
         sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_weight
  FROM s
), l AS (
  SELECT arg_min((total - held) / open_weight, place) FILTER (WHERE most > (total - held) / open_weight * weight) AS lam FROM r
), t AS (
  SELECT r.source, r.source_size, CASE WHEN r.most <= l.lam * r.weight THEN r.most ELSE l.lam * r.weight END AS target FROM r, l
), q AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM t
)
SELECT d.doc_id, d.size, q.source_size, q.target::DOUBLE AS target,
       (d.size * (floor(q.rate)::BIGINT + CASE WHEN ('0x' || substr(md5(d.key), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < q.rate - floor(q.rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""
