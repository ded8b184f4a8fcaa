"""Queries over log lines and document lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.operators import lines as o
from millrace.sources import derived as s

from .texts import SAMPLES_SQL, samples


def logs(sp, d):
    return s.log_lines(sp, d).withColumnRenamed("line_no", "pos")


def doc_lines(sp, d):
    return s.table(sp, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))


LOGS = s.LOG_LINES_SQL + ", l AS (SELECT doc_id, line_no AS pos, content FROM log_lines)"
DOCS = "l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS content FROM documents)"


def sql_list(words):
    return "[" + ", ".join("'" + w + "'" for w in words) + "]"


def first_word(column, words, fold=False):
    c = f"lower({column})" if fold else column
    return f"list_filter(regexp_extract_all({c}, '{o.RUN}'), lambda w: list_contains({sql_list(words)}, w))[1]"


LEVEL = "CASE WHEN {f} IS NULL THEN 'unknown' " + " ".join(f"WHEN list_contains({sql_list(w)}, {{f}}) THEN '{k}'" for k, w in o.LEVELS.items()) + " END"
LEVEL = LEVEL.replace("{f}", first_word("content", sum(o.LEVELS.values(), [])))
SCORE = "CASE level " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in o.LEVEL_SCORES.items()) + " END"
SUMMARY = o.SUMMARY
KEY = r"regexp_extract(content, '^[^:=]*') || regexp_replace(regexp_replace(regexp_replace(substr(content, length(regexp_extract(content, '^[^:=]*')) + 1), '\d+', 'N', 'g'), '0x[0-9a-fA-F]+', 'ADDR', 'g'), '/[\w/]+/', '/PATH/', 'g')"
LEVELED = f"v AS (SELECT *, {LEVEL} AS level FROM l), sc AS (SELECT *, round(least(1.0, {SCORE} + CASE WHEN regexp_matches(content, '{SUMMARY}') THEN 0.4 ELSE 0 END)::DOUBLE, 6) AS score, regexp_matches(content, '{SUMMARY}') AS summary FROM v)"

register("log_levels", lambda sp, d: logs(sp, d).select("doc_id", "pos", o.level(F.col("content")).alias("level")), f"WITH {LOGS} SELECT doc_id, pos, {LEVEL} AS level FROM l")
register("log_scores", lambda sp, d: logs(sp, d).select("doc_id", "pos", F.round(o.line_score(F.col("content")), 6).alias("score")), f"WITH {LOGS}, {LEVELED} SELECT doc_id, pos, score FROM sc")


def _importance(context):
    def run(sp, d):
        c = o.importance(F.col("content"), context)
        return logs(sp, d).select("doc_id", "pos", c.alias("category"), o.priority(c).alias("priority"))

    both = first_word("content", o.KEYWORDS["error"] + o.KEYWORDS["importance"], True)
    other = "security" if context == "diff" else "warning"
    md = " OR ".join(f"starts_with(content, '{p}')" for p in o.MARKDOWN)
    sql = f"WITH {LOGS}, c AS (SELECT doc_id, pos, CASE WHEN list_contains({sql_list(o.KEYWORDS['error'])}, {both}) THEN 'error' WHEN {both} IS NOT NULL THEN 'importance' WHEN {first_word('content', o.KEYWORDS[other], True)} IS NOT NULL THEN '{other}'" + (f" WHEN {md} THEN 'markdown'" if context == "text" else "") + " END AS category FROM l) SELECT *, CASE WHEN category IS NULL THEN 0.0 " + " ".join(f"WHEN category = '{k}' THEN {v}" for k, v in o.PRIORITIES.items()) + " END::DOUBLE AS priority FROM c"
    return run, sql


for _context in ("text", "search", "log", "diff"):
    register(f"line_importance_{_context}", *_importance(_context))
register("error_indicators", lambda sp, d: s.table(sp, d, "documents").select("doc_id", o.has_error_indicator(F.col("text")).alias("hit")), f"SELECT doc_id, regexp_matches(lower(text), '{'|'.join(o.INDICATORS)}') AS hit FROM documents")
_HITS = ", ".join("count(*) FILTER (WHERE " + " OR ".join(f"contains(content, '{m}')" for m in marks) + f") AS {n}" for n, marks in o.FORMATS.items())
register(
    "log_formats",
    lambda sp, d: o.log_formats(logs(sp, d)),
    f"WITH {LOGS}, h AS (SELECT doc_id, {_HITS} FROM l WHERE pos < 100 GROUP BY doc_id) SELECT doc_id, CASE WHEN greatest({', '.join(o.FORMATS)}) = 0 THEN 'generic' " + " ".join(f"WHEN {n} = greatest({', '.join(o.FORMATS)}) THEN '{n}'" for n in o.FORMATS) + " END AS format FROM h",
)
register(
    "log_summary_lines",
    lambda sp, d: samples(sp, d).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content")).filter(F.col("content").rlike(o.SUMMARY)).select("doc_id", "pos"),
    f"WITH {SAMPLES_SQL}, l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS content FROM samples) SELECT doc_id, pos FROM l WHERE regexp_matches(content, '{SUMMARY}')",
)
register(
    "log_context_lines",
    lambda sp, d: o.with_context(logs(sp, d).withColumn("hit", o.level(F.col("content")) == "error"), "hit", 3, 3).filter("near").select("doc_id", "pos", "hit"),
    f"WITH {LOGS}, {LEVELED} SELECT doc_id, pos, hit FROM (SELECT *, level = 'error' AS hit, max((level = 'error')::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM sc) WHERE near = 1",
)
register(
    "warning_dedupe",
    lambda sp, d: logs(sp, d).filter(o.level(F.col("content")) == "warn").groupBy("doc_id", o.dedupe_key(F.col("content")).alias("key")).agg(F.min("pos").alias("pos"), F.count(F.lit(1)).alias("times")),
    f"WITH {LOGS}, {LEVELED} SELECT doc_id, {KEY} AS key, min(pos) AS pos, count(*) AS times FROM sc WHERE level = 'warn' GROUP BY ALL",
)
register(
    "log_top_errors",
    lambda sp, d: o.first_last_top(logs(sp, d).withColumns({"level": o.level(F.col("content")), "score": o.line_score(F.col("content"))}).filter("level IN ('error', 'fail')"), ["doc_id", "level"], "score", 10).select("doc_id", "pos", "level"),
    f"""WITH {LOGS}, {LEVELED}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY pos) AS f, row_number() OVER (PARTITION BY doc_id, level ORDER BY pos DESC) AS z FROM sc WHERE level IN ('error', 'fail'))
SELECT doc_id, pos, level FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY CASE WHEN f = 1 THEN 0 WHEN z = 1 THEN 1 ELSE 2 END, score DESC, pos) AS k FROM r) WHERE k <= 10""",
)
SELECTED = f"""r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY pos) AS f, row_number() OVER (PARTITION BY doc_id, level ORDER BY pos DESC) AS z, row_number() OVER (PARTITION BY doc_id, level, {KEY} ORDER BY pos) AS same FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, level ORDER BY CASE WHEN f = 1 THEN 0 WHEN z = 1 THEN 1 ELSE 2 END, score DESC, pos) AS rank, sum((level = 'warn' AND same = 1)::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS warns FROM r),
ch AS (SELECT *, (level IN ('error', 'fail') AND rank <= 10) OR (level = 'warn' AND same = 1 AND warns <= 5) OR summary AS chosen FROM k),
nr AS (SELECT *, max(chosen::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM ch),
selected AS (SELECT doc_id, pos, content, level, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pos) AS place FROM nr WHERE near = 1) WHERE place <= 12)"""
register("log_selection", lambda sp, d: o.log_selection(logs(sp, d), cap=12).withColumn("score", F.round("score", 6)), f"WITH {LOGS}, {LEVELED}, {SELECTED} SELECT * FROM selected")
register(
    "log_compress",
    lambda sp, d: o.log_text(logs(sp, d), cap=12).withColumn("ratio", F.round("ratio", 6)),
    f"""WITH {LOGS}, {LEVELED}, {SELECTED},
b AS (SELECT doc_id, count(*) AS n_kept, string_agg(content, chr(10) ORDER BY pos) AS body FROM selected GROUP BY doc_id),
a AS (SELECT doc_id, count(*) AS n_lines, string_agg(content, chr(10) ORDER BY pos) AS original, count(*) FILTER (WHERE level = 'error') AS e, count(*) FILTER (WHERE level = 'fail') AS f, count(*) FILTER (WHERE level = 'warn') AS w, count(*) FILTER (WHERE level = 'info') AS i FROM sc GROUP BY doc_id),
p AS (SELECT *, concat_ws(', ', CASE WHEN e > 0 THEN e || ' ERROR' END, CASE WHEN f > 0 THEN f || ' FAIL' END, CASE WHEN w > 0 THEN w || ' WARN' END, CASE WHEN i > 0 THEN i || ' INFO' END) AS parts FROM a JOIN b USING (doc_id)),
c AS (SELECT *, CASE WHEN n_lines < 50 THEN original ELSE body || CASE WHEN n_lines > n_kept AND parts <> '' THEN chr(10) || '[' || (n_lines - n_kept) || ' lines omitted: ' || parts || ']' ELSE '' END END AS compressed FROM p)
SELECT doc_id, compressed, n_lines, n_kept, strlen(original)::INT AS original_bytes, round(strlen(compressed)::DOUBLE / strlen(original), 6) AS ratio, CASE WHEN n_lines >= 50 AND strlen(compressed)::DOUBLE / strlen(original) < 0.5 THEN substr(md5(original), 1, 24) END AS hash FROM c""",
)


def short(sp, d):
    """Log lines without what varies, so that neighbours repeat."""
    return logs(sp, d).withColumn("content", F.regexp_extract("content", "[A-Z]+ [a-z]+", 0))


SHORT = LOGS.replace("line_no AS pos, content", "line_no AS pos, regexp_extract(content, '[A-Z]+ [a-z]+') AS content")
register(
    "filter_generic",
    lambda sp, d: o.repeats_collapsed(short(sp, d)),
    f"WITH {SHORT}, n AS (SELECT *, coalesce(content <> lag(content) OVER (PARTITION BY doc_id ORDER BY pos), TRUE)::INT AS new FROM l), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n) SELECT doc_id, run::BIGINT AS run, any_value(content) AS content, count(*) AS times FROM r GROUP BY doc_id, run HAVING run <= 240",
)
_NEAR = "max(hit::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN {n} PRECEDING AND CURRENT ROW)"
register(
    "filter_diagnostics",
    lambda sp, d: o.diagnostics(logs(sp, d)),
    f"WITH {LOGS}, h AS (SELECT *, regexp_matches(lower(content), '{'|'.join(o.DIAGNOSTIC)}') AS hit FROM l) SELECT doc_id, pos, content, hit FROM (SELECT *, {_NEAR.format(n=3)} AS near FROM h) WHERE near = 1",
)
register(
    "filter_pytest",
    lambda sp, d: o.pytest_lines(logs(sp, d)),
    f"WITH {LOGS}, h AS (SELECT *, regexp_matches(trim(content), '^(FAILED |ERROR |====)') OR regexp_matches(trim(content), ' (failed|passed|error|warnings)') OR regexp_matches(content, '^(E   |File )') AS hit FROM l) SELECT doc_id, pos, content, hit FROM (SELECT *, {_NEAR.format(n=2)} AS near FROM h) WHERE near = 1",
)
register("filter_git_status", lambda sp, d: o.git_status_lines(doc_lines(sp, d)).select("doc_id", "pos"), rf"WITH {DOCS} SELECT doc_id, pos FROM l WHERE NOT (trim(content) = '' OR regexp_matches(trim(content), '^(\(use |use |no changes added)'))")
register("filter_listing", lambda sp, d: o.listing_lines(doc_lines(sp, d), 10).select("doc_id", "pos"), f"WITH {DOCS} SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l WHERE trim(content) <> '' AND lower(trim(content)) <> 'total 0') WHERE k <= 10")


def commits(sp, d):
    c = F.when(F.col("pos") % 4 == 0, F.concat(F.lit("commit "), F.md5(F.col("content").cast("binary")))).when(F.col("pos") % 4 == 1, F.concat(F.lit("Author: "), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("    "), F.col("content")))
    return logs(sp, d).withColumn("content", c)


COMMITS = LOGS.replace("content FROM log_lines)", "CASE line_no % 4 WHEN 0 THEN 'commit ' || md5(content) WHEN 1 THEN 'Author: ' || doc_id ELSE '    ' || content END AS content FROM log_lines)")
register("filter_git_log", lambda sp, d: o.git_log_lines(commits(sp, d)), f"WITH {COMMITS}, f AS (SELECT doc_id, pos, CASE WHEN starts_with(trim(content), 'commit ') THEN 'commit ' || substr(trim(content), 8, 12) ELSE trim(content) END AS content FROM l WHERE NOT regexp_matches(trim(content), '^(Author:|Date:|Merge:)') AND trim(content) <> '') SELECT doc_id, pos, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM f) WHERE k <= 80")


def cargo(sp, d):
    e = F.col("pos") % 12
    c = F.when(e == 0, "failures:").when(e == 5, F.concat(F.lit("---- "), F.col("content"))).when(e == 9, "test result: FAILED").when(e == 10, "   Compiling thing").otherwise(F.col("content"))
    return logs(sp, d).withColumn("content", c)


CARGO = LOGS.replace("content FROM log_lines)", "CASE line_no % 12 WHEN 0 THEN 'failures:' WHEN 5 THEN '---- ' || content WHEN 9 THEN 'test result: FAILED' WHEN 10 THEN '   Compiling thing' ELSE content END AS content FROM log_lines)")
register(
    "filter_cargo_test",
    lambda sp, d: o.cargo_test_lines(cargo(sp, d), 3),
    f"""WITH {CARGO}, f AS (SELECT *, CASE WHEN content = 'failures:' OR starts_with(content, '---- ') THEN 1 WHEN starts_with(content, 'test result:') THEN 0 END AS mark FROM l WHERE NOT (regexp_matches(ltrim(content), '^(Compiling|Checking|Finished|running )') OR (starts_with(content, 'test ') AND ends_with(content, '... ok')))),
g AS (SELECT *, count(mark) OVER (PARTITION BY doc_id ORDER BY pos) AS section, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS inside FROM f),
h AS (SELECT *, count(*) FILTER (WHERE mark IS NULL) OVER (PARTITION BY doc_id, section ORDER BY pos) AS k FROM g)
SELECT doc_id, pos, content FROM h WHERE mark IS NOT NULL OR (inside = 1 AND k <= 3) OR (inside = 0 AND regexp_matches(lower(content), 'error|failed|panic|could not compile'))""",
)


def searches(sp, d):
    return s.search_lines(sp, d)


register(
    "filter_search_groups",
    lambda sp, d: o.grouped_matches(searches(sp, d), 2, 40),
    f"""WITH {s.SEARCH_LINES_SQL}, g AS (SELECT doc_id, regexp_extract(content, '^([^:]*):', 1) AS file, count(*) AS n FROM search_lines WHERE contains(content, ':') GROUP BY ALL)
SELECT doc_id, file, n, greatest(0, least(n, 2, 40 - before - 1))::BIGINT AS shown FROM (SELECT *, coalesce(sum(least(n, 2) + 1) OVER (PARTITION BY doc_id ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)""",
)


def tsc(sp, d):
    c = F.concat(F.lit("src/m"), (F.col("pos") % 5).cast("string"), F.lit(".ts("), F.col("pos").cast("string"), F.lit(",1): error TS2304: "), F.col("content"))
    return logs(sp, d).withColumn("content", F.when(F.col("pos") % 3 == 0, F.col("content")).otherwise(c))


TSC = LOGS.replace("content FROM log_lines)", "CASE WHEN line_no % 3 = 0 THEN content ELSE 'src/m' || (line_no % 5) || '.ts(' || line_no || ',1): error TS2304: ' || content END AS content FROM log_lines)")
register(
    "filter_tsc_groups",
    lambda sp, d: o.tsc_groups(tsc(sp, d), 5, 60),
    rf"WITH {TSC}, f AS (SELECT doc_id, pos, regexp_extract(content, '^([^(]*)\(', 1) AS file, content FROM l WHERE regexp_matches(content, '^[^(]*\(.*\): (error|warning) TS')) SELECT doc_id, file, place, CASE WHEN length(content) <= 60 THEN content ELSE left(content, 57) || '...' END AS content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, file ORDER BY pos) AS place FROM f) WHERE place <= 5",
)


def sources(sp, d):
    e = F.col("pos") % 9
    c = F.when(e == 0, F.concat(F.lit("# "), F.col("content"))).when(e.isin(3, 4), "").when(e == 5, F.concat(F.lit("  // "), F.col("content"))).when(e == 6, "#!/bin/sh").otherwise(F.concat(F.lit("x = "), F.col("content")))
    return logs(sp, d).withColumn("content", c)


SOURCES = LOGS.replace("content FROM log_lines)", "CASE line_no % 9 WHEN 0 THEN '# ' || content WHEN 3 THEN '' WHEN 4 THEN '' WHEN 5 THEN '  // ' || content WHEN 6 THEN '#!/bin/sh' ELSE 'x = ' || content END AS content FROM log_lines)")
register(
    "source_strip_comments",
    lambda sp, d: o.without_comments(sources(sp, d)),
    rf"""WITH {SOURCES}, f AS (SELECT *, trim(content) = '' AS blank FROM l WHERE NOT (regexp_matches(content, '^\s*(//|#([^!]|$)|--|/\*|\*/|\*|;|%|<!--|\"\"\"|'''''')')))
SELECT doc_id, pos, content FROM (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY pos), FALSE) AS before FROM f) WHERE NOT (blank AND before)""",
)
RULE = {"strip_ansi": True, "replace": [{"pattern": r"\d{4}-\d{2}-\d{2} ", "replacement": ""}], "strip_lines_matching": ["DEBUG"], "keep_lines_matching": ["ERROR", "WARN"], "truncate_lines_at": 40, "head_lines": 30, "tail_lines": 20, "max_lines": 15}
register(
    "rule_apply",
    lambda sp, d: o.apply_rule(logs(sp, d), RULE),
    rf"""WITH {LOGS}, a AS (SELECT doc_id, pos, regexp_replace(regexp_replace(content, '\x1b\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '\d{{4}}-\d{{2}}-\d{{2}} ', '', 'g') AS content FROM l),
b AS (SELECT doc_id, pos, CASE WHEN length(content) <= 40 THEN content ELSE left(content, 37) || '...' END AS content FROM a WHERE NOT contains(content, 'DEBUG') AND (contains(content, 'ERROR') OR contains(content, 'WARN'))),
h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM b) WHERE k <= 30), t AS (SELECT doc_id, pos, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos DESC) AS j FROM h) WHERE j <= 20)
SELECT doc_id, pos, content FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS m FROM t) WHERE m <= 15""",
)
