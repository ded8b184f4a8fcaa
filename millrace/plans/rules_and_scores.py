"""Queries over rules, scores and typed arrays."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.functions import detection
from millrace.operators import rules, scores
from millrace.sources import derived as s

from .json_rows import KEY, O, orders, parts
from .texts import TEXTS_SQL, texts

COMMANDS = ["git status -s", "git log --oneline", "cargo test --all", "cargo build", "npm install left-pad", "npm run build", "npm run dev", "docker ps -a", "docker logs web", "kubectl get pods", "make all", "gmake -j8", "ls -la src", "rg pattern", "terraform plan", "go test ./...", "pytest -q", "tsc --noEmit", "aws s3 ls", "mvn package", "uv sync", "ruff check", "gh pr list", "brew install jq", "dotnet build", "systemctl status x", "echo hi", "git show HEAD"]
_LIST = "[" + ", ".join(f"'{c}'" for c in COMMANDS) + "]"


def commands(sp, d):
    n = len(COMMANDS)
    c = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % n + 1).cast("int"))
    return s.table(sp, d, "events").select("event_id", c.alias("command"))


_CASE = "CASE " + " ".join(f"WHEN regexp_matches(command, '{p}') THEN '{n}'" for p, n in [(r["match_command"], "toml:" + r["name"]) for r in rules.RULES] + rules.ROUTES) + " ELSE 'generic' END"
_CMD = f"c AS (SELECT event_id, {_LIST}[(event_id % {len(COMMANDS)} + 1)::INT] AS command FROM events)"
register("rule_match_first", lambda sp, d: commands(sp, d).select("event_id", rules.filter_of(F.col("command")).alias("filter")), f"WITH {_CMD} SELECT event_id, {_CASE} AS filter FROM c")
register("rule_usage", lambda sp, d: commands(sp, d).groupBy(rules.filter_of(F.col("command")).alias("filter")).agg(F.count(F.lit(1)).alias("n")), f"WITH {_CMD} SELECT {_CASE} AS filter, count(*) AS n FROM c GROUP BY 1")


def _trust(sp, d):
    files = s.table(sp, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    known = s.table(sp, d, "documents").filter("doc_id % 3 < 2").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat("text", F.lit("x"))).cast("binary"), 256).alias("hash"))
    return rules.trust(files, known)


register("rule_trust_audit", _trust, "SELECT doc_id::VARCHAR AS path, CASE doc_id % 3 WHEN 0 THEN 'trusted-current' WHEN 1 THEN 'trusted-stale' ELSE 'untrusted' END AS status FROM documents")
_LEN = "length(o_orderstatus || '|' || o_orderpriority)"
register(
    "information_score",
    lambda sp, d: scores.information(orders(sp, d), s.order_items(sp, d), F.char_length(F.concat_ws("|", "o_orderstatus", "o_orderpriority"))).withColumn("score", F.round("score", 6)),
    f"""WITH {O}, n AS (SELECT array_id, count(*) AS n FROM order_items GROUP BY array_id), c AS (SELECT array_id, idx, 1 - count(*) OVER (PARTITION BY array_id, field, {KEY})::DOUBLE / (SELECT n FROM n WHERE n.array_id = cells.array_id) AS r FROM cells),
r AS (SELECT array_id, idx, avg(r) AS rareness FROM c GROUP BY array_id, idx), z AS (SELECT array_id, idx, {_LEN} AS len, min({_LEN}) OVER (PARTITION BY array_id) AS lo, max({_LEN}) OVER (PARTITION BY array_id) AS hi, count(*) OVER (PARTITION BY array_id) AS n FROM order_items)
SELECT z.array_id, z.idx, round((CASE WHEN n < 2 THEN 0.5 ELSE rareness END * 0.4 + CASE WHEN n < 2 OR lo = hi THEN 0.5 ELSE (len - lo)::DOUBLE / (hi - lo) END * 0.3 + CASE WHEN n < 2 THEN 0.5 ELSE 0 END * 0.3)::DOUBLE, 6) AS score FROM z JOIN r ON z.array_id = r.array_id AND z.idx = r.idx""",
)
PART = "parts AS (SELECT p_brand AS array_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS idx, p_name || CASE WHEN p_partkey % 37 = 0 THEN ' failed' ELSE '' END AS item, p_retailprice AS num FROM part)"


def part_items(sp, d):
    return parts(sp, d).withColumn("item", F.concat("p_name", F.when(F.col("p_partkey") % 37 == 0, " failed").otherwise(""))).select("array_id", "idx", "item")


register(
    "crush_strings",
    lambda sp, d: scores.crushed_texts(part_items(sp, d)),
    f"""WITH {PART}, a AS (SELECT *, count(*) OVER (PARTITION BY array_id) AS n, avg(length(item)) OVER (PARTITION BY array_id) AS mean, stddev_samp(length(item)) OVER (PARTITION BY array_id) AS sd FROM parts),
b AS (SELECT *, regexp_matches(lower(item), '{"|".join(scores.ERROR_WORDS)}') AS error, coalesce(sd > 0 AND abs(length(item) - mean) > 2.0 * sd, FALSE) AS odd FROM a),
c AS (SELECT *, n <= 8 OR error OR odd OR idx < 4 OR idx >= n - 2 AS must, sum(error::INT) OVER (PARTITION BY array_id) + sum(odd::INT) OVER (PARTITION BY array_id) AS extra FROM b),
e AS (SELECT *, sum(must::INT) OVER (PARTITION BY array_id) AS kept, max(must::INT) OVER (PARTITION BY array_id, item) AS known FROM c),
f AS (SELECT *, NOT must AND kept < 15 AND idx % greatest(1, (n - 1) // (greatest(0, 15 - kept) + 1)) = 0 AS step FROM e),
g AS (SELECT *, step AND known = 0 AND row_number() OVER (PARTITION BY array_id, step, item ORDER BY idx) = 1 AS fresh FROM f)
SELECT array_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY array_id, fresh ORDER BY idx) AS place FROM g) WHERE must OR (fresh AND place <= 15 + extra - kept)""",
)


def number_items(sp, d):
    return s.event_items(sp, d).select("array_id", "idx", F.col("value").alias("num"))


register(
    "crush_numbers",
    lambda sp, d: scores.crushed_numbers(number_items(sp, d)),
    f"""WITH {s.EVENT_ITEMS_SQL}, a AS (SELECT array_id, idx, value AS num, count(*) OVER p AS n, avg(value) OVER p AS mean, stddev_samp(value) OVER p AS sd, avg(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before, avg(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS after
  FROM event_items WINDOW p AS (PARTITION BY array_id), w AS (PARTITION BY array_id ORDER BY idx)),
b AS (SELECT *, coalesce(sd > 0 AND abs(num - mean) > 2.0 * sd, FALSE) AS odd, coalesce(n > 10 AND idx >= 5 AND idx < n - 5 AND sd > 0 AND abs(after - before) > 2.0 * sd, FALSE) AS change FROM a),
c AS (SELECT *, n <= 8 OR odd OR change OR idx < 4 OR idx >= n - 2 AS must, sum(odd::INT) OVER (PARTITION BY array_id) AS extra FROM b), e AS (SELECT *, sum(must::INT) OVER (PARTITION BY array_id) AS kept FROM c),
f AS (SELECT *, NOT must AND kept < 15 AND idx % greatest(1, (n - 1) // (greatest(0, 15 - kept) + 1)) = 0 AS step FROM e)
SELECT array_id, idx FROM (SELECT *, row_number() OVER (PARTITION BY array_id, step ORDER BY idx) AS place FROM f) WHERE must OR (step AND place <= 15 + extra - kept)""",
)
_LABELS = "CASE " + " ".join(f"WHEN list_contains({labels}, label) THEN '{name}'" for name, labels in detection.LABELS.items()) + " ELSE 'text' END"


def _labels(sp, d):
    label = F.element_at(F.array(*map(F.lit, ["json", "diff", "xml", "rust", "yaml", "markdown", "other"])), (F.col("doc_id") % 7 + 1).cast("int"))
    return s.table(sp, d, "documents").select("doc_id", detection.type_of_label(label).alias("content_type"))


register("label_map", _labels, f"WITH l AS (SELECT doc_id, ['json', 'diff', 'xml', 'rust', 'yaml', 'markdown', 'other'][(doc_id % 7 + 1)::INT] AS label FROM documents) SELECT doc_id, {_LABELS} AS content_type FROM l")
_L50 = "list_filter(string_split(text, chr(10))[1:50], lambda x: trim(x) <> '' AND NOT starts_with(trim(x), '#'))"
_LISTED, _KEYED = f"len(list_filter({_L50}, lambda x: regexp_matches(x, '^ +- ')))", f"len(list_filter({_L50}, lambda x: NOT regexp_matches(x, '^ +- ') AND regexp_matches(trim(x), '^[A-Za-z0-9_-]+:')))"
register(
    "yaml_source_heuristic",
    lambda sp, d: texts(sp, d).select("origin", "doc_id", detection.looks_like_yaml(F.col("text")).alias("yaml"), detection.looks_like_source(F.col("text")).alias("source")),
    f"""WITH {TEXTS_SQL}, y AS (SELECT origin, doc_id, text, {_KEYED} >= 2 OR ({_KEYED} >= 1 AND {_LISTED} >= 1) AS yaml FROM texts)
SELECT origin, doc_id, yaml, yaml OR starts_with(ltrim(text), '#!') OR regexp_matches(lower(text), 'const |let |async |=>|def |class ') OR (contains(lower(text), 'select ') AND contains(lower(text), ' from ')) OR (contains(lower(text), ' where ') AND contains(lower(text), ' join ')) AS source FROM y""",
)
