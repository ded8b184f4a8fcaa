"""Queries over arrays of dicts: events by user and orders by customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.operators import json_rows as j
from millrace.sources import derived as s


def events(spark, sf_dir):
    return s.long_form(s.event_items(spark, sf_dir), s.EVENT_FIELDS)


def orders(spark, sf_dir):
    return s.long_form(s.order_items(spark, sf_dir), s.ORDER_FIELDS)


def order_text():
    return F.concat_ws("|", "o_orderstatus", "o_orderpriority")


E = f"{s.EVENT_ITEMS_SQL}, {s.long_form_sql('cells', 'event_items', s.EVENT_FIELDS)}"
O = f"{s.ORDER_ITEMS_SQL}, {s.long_form_sql('cells', 'order_items', s.ORDER_FIELDS)}"  # noqa: E741
KEY = "coalesce(CASE WHEN kind = 'numeric' THEN num::VARCHAR ELSE str END, chr(1))"
STATS = f"""stats AS (
  SELECT array_id, field, kind, count(*)::BIGINT AS n, count(DISTINCT {KEY})::BIGINT AS unique_count, min(num) AS min_val, max(num) AS max_val, avg(num) AS mean_val,
         CASE WHEN count(num) > 1 THEN var_samp(num) WHEN count(num) = 1 THEN 0.0::DOUBLE END AS variance, avg(length(str)::DOUBLE) AS avg_length,
         count(DISTINCT {KEY})::DOUBLE / count(*) AS unique_ratio, count(DISTINCT {KEY}) = 1 AS is_constant
  FROM cells GROUP BY array_id, field, kind)"""


def _rounded(df, *columns, digits=4):
    # A variance is compared by its root: rounded sums of squares differ in their last digits.
    return df.withColumns({c: F.round(F.sqrt(c), 4) if c == "variance" else F.round(c, digits) for c in columns})


NUMBERS = ("min_val", "max_val", "mean_val", "variance", "avg_length", "unique_ratio")
_STAT_COLUMNS = "array_id, field, kind, n, unique_count, is_constant, " + ", ".join(f"round({'sqrt(variance)' if c == 'variance' else c}, {4 if c == 'variance' else 6}) AS {c}" for c in NUMBERS)
register("array_field_stats", lambda sp, d: _rounded(j.field_stats(events(sp, d)), *NUMBERS, digits=6), f"WITH {E}, {STATS} SELECT {_STAT_COLUMNS} FROM stats")
register("array_field_stats_orders", lambda sp, d: _rounded(j.field_stats(orders(sp, d)), *NUMBERS, digits=6), f"WITH {O}, {STATS} SELECT {_STAT_COLUMNS} FROM stats")
register("constant_fields", lambda sp, d: j.field_stats(orders(sp, d)).filter("is_constant").select("array_id", "field"), f"WITH {O}, {STATS} SELECT array_id, field FROM stats WHERE is_constant")
register(
    "field_top_values",
    lambda sp, d: j.top_values(events(sp, d)),
    f"""WITH {E}, c AS (SELECT array_id, field, str, count(*)::BIGINT AS c, min(idx) AS first FROM cells WHERE kind = 'string' AND str IS NOT NULL GROUP BY ALL)
SELECT array_id, field, str, c, place FROM (SELECT *, row_number() OVER (PARTITION BY array_id, field ORDER BY c DESC, first) AS place FROM c) WHERE place <= 5""",
)
CAND = """cand AS (
  SELECT array_id, field, position FROM (
    SELECT array_id, field, row_number() OVER w - 1 AS position, count(*) OVER p AS n, stddev_samp(num) OVER p AS sd,
           avg(num) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before, avg(num) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS after
    FROM cells WHERE kind = 'numeric' AND num IS NOT NULL WINDOW w AS (PARTITION BY array_id, field ORDER BY idx), p AS (PARTITION BY array_id, field))
  WHERE n >= 10 AND sd > 0 AND position >= 5 AND position < n - 5 AND abs(after - before) > 2.0 * sd)"""
register("change_candidates", lambda sp, d: j.change_candidates(events(sp, d)).filter("field = 'value'"), f"WITH {E}, {CAND} SELECT * FROM cand WHERE field = 'value'")
register(
    "change_points",
    lambda sp, d: j.change_points(events(sp, d)),
    f"""WITH RECURSIVE {E}, {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY array_id, field ORDER BY position) AS k FROM cand),
f AS (SELECT array_id, field, k, position, position AS last, TRUE AS keep FROM r WHERE k = 1
  UNION ALL SELECT r.array_id, r.field, r.k, r.position, CASE WHEN r.position - f.last > 5 THEN r.position ELSE f.last END, r.position - f.last > 5 FROM r JOIN f ON r.array_id = f.array_id AND r.field = f.field AND r.k = f.k + 1)
SELECT array_id, field, position::INT AS position FROM f WHERE keep""",
)
TEMPORAL = r"""temporal AS (
  SELECT array_id, field FROM (SELECT array_id, field, kind, count(*) FILTER (WHERE idx < 10 AND str IS NOT NULL) AS sampled,
    count(*) FILTER (WHERE idx < 10 AND regexp_matches(str, '^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}.*)?$')) AS iso, min(num) AS low FROM cells GROUP BY ALL)
  WHERE (kind = 'string' AND sampled > 0 AND iso::DOUBLE / sampled > 0.5) OR (kind = 'numeric' AND (low BETWEEN 1e9 AND 2e9 OR low BETWEEN 1e12 AND 2e12)))"""
register("temporal_fields", lambda sp, d: j.temporal_fields(events(sp, d)), f"WITH {E}, {TEMPORAL} SELECT * FROM temporal")


def _sequential(name, condition="TRUE"):
    return f"""{name} AS (
  SELECT array_id, field, coalesce(n >= 5 AND mean_step BETWEEN 0.5 AND 2.0 AND even > 0.8 AND up > 0.7, FALSE) AS is_sequential FROM (
    SELECT array_id, field, count(*) AS n, avg(step) AS mean_step, avg(CASE WHEN step BETWEEN 0.5 AND 2.0 THEN 1.0 WHEN step IS NOT NULL THEN 0.0 END) AS even,
           avg(CASE WHEN move >= 0 THEN 1.0 WHEN move IS NOT NULL THEN 0.0 END) AS up FROM (
      SELECT array_id, field, num - lag(num) OVER (PARTITION BY array_id, field ORDER BY num, idx) AS step, num - lag(num) OVER (PARTITION BY array_id, field ORDER BY idx) AS move
      FROM cells WHERE kind = 'numeric' AND num IS NOT NULL AND {condition}) GROUP BY ALL))"""


register("sequential_fields", lambda sp, d: j.sequential_fields(orders(sp, d)), f"WITH {O}, {_sequential('seq')} SELECT * FROM seq")
_CH = "list_filter(string_split(str, ''), lambda c: c <> '')"
ENTROPY = f"CASE WHEN len(list_distinct({_CH})) < 2 THEN 0.0::DOUBLE ELSE list_entropy_bits / log2(least(len(list_distinct({_CH})), len({_CH}))::DOUBLE) END"
BITS = """bits AS (
  SELECT array_id, field, avg(u) AS uuids, avg(CASE WHEN k < 2 THEN 0.0 ELSE h / log2(least(k, n)::DOUBLE) END) AS bits FROM (
    SELECT array_id, field, idx, max(u) AS u, count(*) AS k, sum(m) AS n, -sum(m / t * log2(m / t)) AS h FROM (
      SELECT array_id, field, idx, c, count(*)::DOUBLE AS m, sum(count(*)) OVER (PARTITION BY array_id, field, idx)::DOUBLE AS t,
             max(CASE WHEN regexp_matches(str, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN 1.0 ELSE 0.0 END) AS u
      FROM (SELECT array_id, field, idx, str, unnest(string_split(str, '')) AS c FROM cells WHERE idx < 20 AND str IS NOT NULL) GROUP BY array_id, field, idx, c) GROUP BY array_id, field, idx) GROUP BY array_id, field)"""
register(
    "string_entropy",
    lambda sp, d: orders(sp, d).filter("idx < 20 AND str IS NOT NULL").groupBy("array_id", "field").agg(F.round(F.avg(j.entropy(F.col("str"))), 6).alias("bits")),
    f"WITH {O}, {BITS} SELECT array_id, field, round(bits, 6) AS bits FROM bits",
)
IDS = f"""ids AS (
  SELECT s.array_id, s.field, CASE WHEN unique_ratio < 0.9 THEN 0.0 WHEN kind = 'string' AND uuids > 0.8 THEN 0.95 WHEN kind = 'string' AND bits > 0.7 AND unique_ratio > 0.95 THEN 0.8
    WHEN kind = 'numeric' AND is_sequential AND unique_ratio > 0.95 THEN 0.9 WHEN kind = 'numeric' AND max_val > min_val AND unique_ratio > 0.95 THEN 0.85 WHEN unique_ratio > 0.98 THEN 0.7 ELSE 0.0 END::DOUBLE AS confidence, unique_ratio, kind
  FROM stats s LEFT JOIN bits b USING (array_id, field) LEFT JOIN seq q USING (array_id, field))"""
register("id_fields", lambda sp, d: _rounded(j.id_fields(orders(sp, d)), "unique_ratio", digits=6), f"WITH {O}, {STATS}, {BITS}, {_sequential('seq')}, {IDS} SELECT array_id, field, confidence, round(unique_ratio, 6) AS unique_ratio, kind FROM ids")
SCORES = """scores AS (
  SELECT array_id, field, round(least(0.95, b + CASE WHEN n >= 5 AND down > 0.7 THEN 0.3 ELSE 0 END + CASE WHEN fractions > 0.3 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS confidence FROM (
    SELECT array_id, field, count(*) AS n, CASE WHEN min(num) >= 0 AND max(num) <= 1 THEN 0.4 WHEN min(num) >= 0 AND max(num) <= 10 THEN 0.3 WHEN min(num) >= 0 AND max(num) <= 100 THEN 0.25 WHEN min(num) >= -1 AND max(num) <= 1 THEN 0.35 END AS b,
      avg(CASE WHEN before >= num THEN 1.0 WHEN before IS NOT NULL THEN 0.0 END) AS down, avg(CASE WHEN position < 20 THEN CASE WHEN num <> trunc(num) THEN 1.0 ELSE 0.0 END END) AS fractions
    FROM (SELECT array_id, field, num, row_number() OVER w - 1 AS position, lag(num) OVER w AS before FROM cells WHERE kind = 'numeric' AND num IS NOT NULL WINDOW w AS (PARTITION BY array_id, field ORDER BY idx)) GROUP BY ALL)
  LEFT JOIN seq50 USING (array_id, field) WHERE NOT coalesce(is_sequential, FALSE) AND b IS NOT NULL)"""
SCORED = f"{_sequential('seq50', 'idx < 50')}, {SCORES}"
register("score_fields", lambda sp, d: j.score_fields(events(sp, d)), f"WITH {E}, {SCORED} SELECT * FROM scores WHERE confidence >= 0.4")
RARE = f"""vals AS (SELECT array_id, field, idx, {KEY} AS v FROM cells WHERE kind = 'string' OR num = floor(num)),
ranked AS (SELECT array_id, field, v, count(*) OVER (PARTITION BY array_id, field) AS values_, sum(c) OVER (PARTITION BY array_id, field) AS total,
  coalesce(sum(c) OVER (PARTITION BY array_id, field ORDER BY c DESC, v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM (SELECT array_id, field, v, count(*) AS c FROM vals GROUP BY ALL)),
tops AS (SELECT *, before < ceil(total * 0.8) AS top, sum((before < ceil(total * 0.8))::INT) OVER (PARTITION BY array_id, field) AS tops FROM ranked),
rare AS (SELECT DISTINCT vals.array_id, vals.idx FROM vals JOIN tops USING (array_id, field, v) WHERE values_ BETWEEN 2 AND 50 AND tops <= 5 AND NOT top AND total >= 5)"""
register("rare_status_items", lambda sp, d: j.rare_values(events(sp, d)), f"WITH {E}, {RARE} SELECT * FROM rare")
register("structural_outliers", lambda sp, d: j.rare_values(orders(sp, d)), f"WITH {O}, {RARE} SELECT * FROM rare")
ANOM = """anom AS (SELECT DISTINCT array_id, idx FROM (SELECT *, avg(num) OVER (PARTITION BY array_id, field) AS m, var_samp(num) OVER (PARTITION BY array_id, field) AS v FROM cells WHERE kind = 'numeric') WHERE v > 0 AND abs(num - m) > 2.0 * sqrt(v))"""
register("numeric_anomalies", lambda sp, d: j.anomalies(events(sp, d)), f"WITH {E}, {ANOM} SELECT * FROM anom")


def event_text():
    return F.concat_ws("|", "ts", "event_type")


ERRS = "errs AS (SELECT array_id, idx FROM event_items WHERE regexp_matches(lower(ts || '|' || event_type), '" + "|".join(j.ERROR_WORDS) + "'))"
register("error_items", lambda sp, d: j.error_items(s.event_items(sp, d), event_text()), f"WITH {E}, {ERRS} SELECT * FROM errs")
PATTERN = """flags AS (SELECT array_id, bool_or(kind = 'numeric' AND coalesce(variance > 0, FALSE)) AS varies, bool_or(kind = 'string' AND unique_ratio > 0.5 AND coalesce(avg_length > 20, FALSE)) AS message,
  bool_or(kind = 'string' AND unique_ratio < 0.1 AND unique_count BETWEEN 2 AND 10) AS level FROM stats GROUP BY array_id),
pattern AS (SELECT array_id, CASE WHEN array_id IN (SELECT array_id FROM temporal) AND varies THEN 'time_series' WHEN message AND level THEN 'logs'
  WHEN array_id IN (SELECT array_id FROM scores WHERE confidence >= 0.5) THEN 'search_results' ELSE 'generic' END AS pattern FROM flags)"""
register("array_patterns", lambda sp, d: j.patterns(events(sp, d)), f"WITH {E}, {STATS}, {TEMPORAL}, {SCORED}, {PATTERN} SELECT * FROM pattern")
register("array_patterns_orders", lambda sp, d: j.patterns(orders(sp, d)), f"WITH {O}, {STATS}, {TEMPORAL}, {SCORED}, {PATTERN} SELECT * FROM pattern")


def _crush(items):
    text = "lower(ts || '|' || event_type)" if items == "event_items" else "lower(o_orderstatus || '|' || o_orderpriority)"
    words = "|".join(j.ERROR_WORDS)
    return f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY confidence DESC, field) AS place FROM ids WHERE confidence > 0) WHERE place = 1),
per AS (SELECT s.array_id, max(n) AS n_items, any_value(b.confidence) AS id_confidence, coalesce(any_value(b.unique_ratio), 0.0) AS id_ratio,
  coalesce(avg(s.unique_ratio) FILTER (WHERE s.kind = 'string' AND s.field IS DISTINCT FROM b.field), 0.0) AS strings, coalesce(avg(s.unique_ratio) FILTER (WHERE s.kind = 'numeric' AND s.field IS DISTINCT FROM b.field), 0.0) AS numbers
  FROM stats s LEFT JOIN best b ON s.array_id = b.array_id GROUP BY s.array_id),
sig AS (SELECT array_id FROM scores WHERE confidence >= 0.4 UNION SELECT array_id FROM rare UNION SELECT array_id FROM anom UNION SELECT array_id FROM cand UNION SELECT array_id FROM {items} WHERE regexp_matches({text}, '{words}')),
dec AS (SELECT array_id, n_items, CASE WHEN greatest(strings, numbers) < 0.1 AND coalesce(id_confidence >= 0.7, FALSE) THEN 0 WHEN greatest(strings, id_ratio) < 0.3 THEN 1
  WHEN coalesce(id_confidence >= 0.7, FALSE) AND greatest(strings, id_ratio) > 0.8 AND array_id NOT IN (SELECT array_id FROM sig) THEN 2 WHEN greatest(strings, id_ratio) > 0.8 AND array_id IN (SELECT array_id FROM sig) THEN 3
  WHEN array_id NOT IN (SELECT array_id FROM sig) THEN 4 ELSE 5 END AS c FROM per),
crush AS (SELECT array_id, n_items, c IN (0, 1, 3, 5) AS crushable, [0.85, 0.9, 0.85, 0.7, 0.6, 0.5][c + 1]::DOUBLE AS confidence,
  ['repetitive_content_with_ids', 'low_uniqueness_safe_to_sample', 'unique_entities_no_signal', 'unique_entities_with_signal', 'medium_uniqueness_no_signal', 'medium_uniqueness_with_signal'][c + 1] AS reason FROM dec)"""


def _all(items):
    return ", ".join([E if items == "event_items" else O, STATS, BITS, _sequential("seq"), IDS, SCORED, RARE, ANOM, CAND, TEMPORAL, PATTERN, _crush(items)])


STRATEGY = """strat AS (SELECT c.array_id, pattern, CASE WHEN n_items < 5 THEN 'none' WHEN NOT crushable THEN 'skip' WHEN pattern = 'time_series' AND c.array_id IN (SELECT array_id FROM cand) THEN 'time_series'
  WHEN pattern = 'search_results' THEN 'top_n' ELSE 'smart_sample' END AS strategy, k.constants FROM crush c JOIN pattern p ON c.array_id = p.array_id
  JOIN (SELECT array_id, avg(is_constant::INT) AS constants FROM stats GROUP BY array_id) k ON k.array_id = c.array_id)"""
_STRAT_OUT = "SELECT array_id, pattern, strategy, round(CASE strategy WHEN 'none' THEN 0.0 ELSE least(0.95, CASE strategy WHEN 'time_series' THEN 0.7 WHEN 'cluster' THEN 0.8 WHEN 'top_n' THEN 0.6 WHEN 'smart_sample' THEN 0.5 ELSE 0.3 END + constants * 0.2) END::DOUBLE, 6) AS reduction FROM strat"
register("crushability_events", lambda sp, d: j.crushability(events(sp, d), s.event_items(sp, d), event_text()), f"WITH {_all('event_items')} SELECT * FROM crush")
register("crushability_orders", lambda sp, d: j.crushability(orders(sp, d), s.order_items(sp, d), order_text()), f"WITH {_all('order_items')} SELECT * FROM crush")
register("strategies_events", lambda sp, d: _rounded(j.strategies(events(sp, d), s.event_items(sp, d), event_text()), "reduction", digits=6), f"WITH {_all('event_items')}, {STRATEGY} {_STRAT_OUT}")
register("strategies_orders", lambda sp, d: _rounded(j.strategies(orders(sp, d), s.order_items(sp, d), order_text()), "reduction", digits=6), f"WITH {_all('order_items')}, {STRATEGY} {_STRAT_OUT}")
register("top_n_rows", lambda sp, d: j.top_n(s.order_items(sp, d), "o_totalprice", 12).select("array_id", "idx", "o_orderkey", "place"), f"WITH {O} SELECT array_id, idx, o_orderkey, place FROM (SELECT *, row_number() OVER (PARTITION BY array_id ORDER BY o_totalprice DESC, idx) AS place FROM order_items) WHERE place <= 12")
_PARTS = "parts AS (SELECT p_brand AS array_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, p_partkey, p_name FROM part)"


def parts(sp, d):
    return s._indexed(s.table(sp, d, "part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_partkey")


register("cluster_sample", lambda sp, d: j.cluster_sample(parts(sp, d), "p_name").select("array_id", "idx", "cluster", "place"), f"WITH {_PARTS} SELECT * FROM (SELECT array_id, idx, substr(md5(left(p_name, 50)), 1, 8) AS cluster, row_number() OVER (PARTITION BY array_id, substr(md5(left(p_name, 50)), 1, 8) ORDER BY idx) AS place FROM parts) WHERE place <= 2")


def _time_series(sp, d):
    items = s.event_items(sp, d)
    points = j.change_points(events(sp, d)).filter("field = 'value'").select("array_id", F.col("position").alias("idx"), F.lit(True).alias("hit"))
    return j.around(items.join(points, ["array_id", "idx"], "left").withColumn("hit", F.coalesce("hit", F.lit(False))), "hit", 2).select("array_id", "idx")


register(
    "time_series_rows",
    _time_series,
    f"""WITH RECURSIVE {E}, {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY array_id, field ORDER BY position) AS k FROM cand WHERE field = 'value'),
f AS (SELECT array_id, field, k, position, position AS last, TRUE AS keep FROM r WHERE k = 1 UNION ALL SELECT r.array_id, r.field, r.k, r.position, CASE WHEN r.position - f.last > 5 THEN r.position ELSE f.last END, r.position - f.last > 5 FROM r JOIN f ON r.array_id = f.array_id AND r.field = f.field AND r.k = f.k + 1)
SELECT DISTINCT e.array_id, e.idx FROM event_items e JOIN f ON e.array_id = f.array_id AND keep AND e.idx BETWEEN f.position - 2 AND f.position + 2""",
)
_CONTENT = "o_orderstatus || '|' || o_orderpriority"
register("dedupe_items", lambda sp, d: j.first_of_each(s.order_items(sp, d), order_text()).select("array_id", "idx", "content_hash"), f"WITH {O} SELECT array_id, idx, content_hash FROM (SELECT *, substr(md5({_CONTENT}), 1, 16) AS content_hash, row_number() OVER (PARTITION BY array_id, md5({_CONTENT}) ORDER BY idx) AS place FROM order_items) WHERE place = 1")
register(
    "strided_fill",
    lambda sp, d: j.strided_fill(s.order_items(sp, d), F.col("idx") % 10 == 4, 8, order_text()).select("array_id", "idx"),
    f"""WITH {O}, a AS (SELECT array_id, idx, idx % 10 = 4 AS kept, md5({_CONTENT}) AS h FROM order_items),
b AS (SELECT *, greatest(0, 8 - sum(kept::INT) OVER (PARTITION BY array_id)) AS room, sum((NOT kept)::INT) OVER (PARTITION BY array_id) AS others, sum((NOT kept)::INT) OVER (PARTITION BY array_id ORDER BY idx) - 1 AS pos, max(kept::INT) OVER (PARTITION BY array_id, h) AS known FROM a),
c AS (SELECT *, greatest(1, others // (room + 1)) AS step FROM b),
e AS (SELECT *, NOT kept AND known = 0 AND row_number() OVER (PARTITION BY array_id, h, kept ORDER BY pos % step, pos) = 1 AS fresh FROM c)
SELECT array_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY array_id, fresh ORDER BY pos % step, pos) AS turn FROM e) WHERE kept OR (fresh AND turn <= room)""",
)
register(
    "prioritize_rows",
    lambda sp, d: j.prioritized(s.event_items(sp, d), F.col("event_type") == "error", 15).select("array_id", "idx", "must"),
    f"""WITH {E} SELECT array_id, idx, must FROM (SELECT array_id, idx, event_type = 'error' AS must, row_number() OVER (PARTITION BY array_id ORDER BY CASE WHEN event_type = 'error' THEN 0 WHEN idx < 3 THEN 1 WHEN idx >= n - 2 THEN 2 ELSE 3 END, idx) AS turn
FROM (SELECT *, count(*) OVER (PARTITION BY array_id) AS n FROM event_items)) WHERE must OR turn <= 15""",
)
register("budget_rows", lambda sp, d: j.within_budget(s.event_items(sp, d), F.concat_ws("|", "ts", "event_type"), 60), f"WITH {E} SELECT array_id, greatest(1, count(*) FILTER (WHERE used <= 240)) AS k FROM (SELECT array_id, sum(strlen(ts || '|' || event_type) + 1) OVER (PARTITION BY array_id ORDER BY idx) AS used FROM event_items) GROUP BY array_id")
register("number_summary", lambda sp, d: _rounded(j.number_summary(events(sp, d)), "mean", "median", "p25", "p75", "sd"), f"WITH {E} SELECT array_id, field, round(avg(num), 4) AS mean, round(quantile_cont(num, 0.5), 4) AS median, round(quantile_cont(num, 0.25), 4) AS p25, round(quantile_cont(num, 0.75), 4) AS p75, round(stddev_samp(num), 4) AS sd FROM cells WHERE kind = 'numeric' GROUP BY ALL")


def _splits(sp, d):
    k = F.least(F.lit(15), F.count(F.lit(1))).cast("int")
    front, back, middle = j.k_split(F.col("k"))
    return s.order_items(sp, d).groupBy("array_id").agg(k.alias("k")).select("array_id", "k", front.alias("front"), back.alias("back"), middle.alias("middle"))


register(
    "k_split",
    _splits,
    f"WITH {O}, n AS (SELECT array_id, least(15, count(*))::INT AS k FROM order_items GROUP BY array_id), f AS (SELECT *, least(greatest(1, round_even(k * 0.3, 0)::INT), k) AS front FROM n), b AS (SELECT *, least(greatest(1, round_even(k * 0.15, 0)::INT), k - front) AS back FROM f) SELECT *, k - front - back AS middle FROM b",
)
