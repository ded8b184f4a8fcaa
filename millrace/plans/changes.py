"""Queries over search results and diffs, and bloat estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.operators import diffs as d
from millrace.operators import lines as o
from millrace.operators import matches as m
from millrace.sources import derived as s

from .lines import LOGS, first_word, logs

WORDS = ["the", "and", "of"]
PARSED = rf"""{s.SEARCH_LINES_SQL}, p AS (SELECT doc_id, pos, regexp_extract(content, '{m.MATCH}', 1) AS file, regexp_extract(content, '{m.MATCH}', 2) AS n, regexp_extract(content, '{m.MATCH}', 3) AS text FROM search_lines),
matches AS (SELECT doc_id, pos, file, n::BIGINT AS line_number, text FROM p WHERE file <> '')"""
_BOTH = first_word("text", o.KEYWORDS["error"] + o.KEYWORDS["importance"], True)
SCORED = f"""{PARSED}, scored AS (SELECT *, least(1.0, {' + '.join(f"CASE WHEN contains(lower(text), '{w}') THEN 0.3 ELSE 0 END" for w in WORDS if len(w) > 2)}
  + CASE WHEN list_contains({[str(x) for x in o.KEYWORDS['error']]}, {_BOTH}) THEN 0.5 WHEN {_BOTH} IS NOT NULL THEN 0.3 WHEN {first_word('text', o.KEYWORDS['warning'], True)} IS NOT NULL THEN 0.4 ELSE 0 END)::DOUBLE AS score FROM matches),
ranks AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY total DESC, file) AS place FROM (SELECT doc_id, file, count(*) AS n, round(sum(score), 6) AS total FROM scored GROUP BY ALL))"""


def matches(sp, sf):
    return m.parsed(s.search_lines(sp, sf))


def scored(sp, sf):
    return matches(sp, sf).withColumn("score", m.match_score(F.col("text"), WORDS))


register("search_parse", matches, f"WITH {PARSED} SELECT * FROM matches")
register("search_score", lambda sp, sf: scored(sp, sf).select("doc_id", "pos", F.round("score", 6).alias("score")), f"WITH {SCORED} SELECT doc_id, pos, round(score, 6) AS score FROM scored")
register("search_file_ranks", lambda sp, sf: m.file_ranks(scored(sp, sf)), f"WITH {SCORED} SELECT * FROM ranks")
register(
    "search_select",
    lambda sp, sf: m.selected(scored(sp, sf), 2, 20).select("doc_id", "file", "line_number", "place"),
    f"""WITH {SCORED}, a AS (SELECT s.*, r.place, row_number() OVER (PARTITION BY s.doc_id, s.file, line_number, text ORDER BY pos) AS copy, row_number() OVER (PARTITION BY s.doc_id, s.file ORDER BY pos) AS f, row_number() OVER (PARTITION BY s.doc_id, s.file ORDER BY pos DESC) AS z
  FROM scored s JOIN ranks r ON s.doc_id = r.doc_id AND s.file = r.file AND r.place <= 15),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, file ORDER BY CASE WHEN f = 1 THEN 0 WHEN z = 1 THEN 1 ELSE 2 END, score DESC, line_number, pos) AS k FROM a WHERE copy = 1)
SELECT doc_id, file, line_number, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, k) AS turn FROM b WHERE k <= 2) WHERE turn <= 20""",
)
register("bloat_search", lambda sp, sf: m.search_bloat(matches(sp, sf)).withColumn("bloat", F.round("bloat", 6)), f"WITH {PARSED} SELECT doc_id, round(CASE WHEN count(*) < 10 THEN 0.0 ELSE least(1.0, (count(*)::DOUBLE / count(DISTINCT file) - 1) / 10.0) END::DOUBLE, 6) AS bloat FROM matches GROUP BY doc_id")

DIFF = rf"""{s.DIFF_LINES_SQL}, f1 AS (SELECT *, sum(starts_with(content, 'diff --git')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS file_no, regexp_matches(content, '{d.HUNK}') AS is_hunk FROM diff_lines),
f2 AS (SELECT *, sum(is_hunk::INT) OVER (PARTITION BY doc_id, file_no ORDER BY pos) AS hunk_no, max(CASE WHEN starts_with(content, 'diff --git') THEN regexp_extract(content, ' b/(.*)$', 1) END) OVER (PARTITION BY doc_id, file_no) AS new_path FROM f1),
parts AS (SELECT doc_id, pos, content, file_no, hunk_no, new_path, CASE WHEN hunk_no = 0 OR is_hunk THEN 'header' WHEN starts_with(content, '+') THEN 'add' WHEN starts_with(content, '-') THEN 'delete' WHEN starts_with(content, ' ') OR content = '' THEN 'context' ELSE 'other' END AS kind FROM f2),
h0 AS (SELECT doc_id, file_no, hunk_no, max(CASE WHEN regexp_matches(content, '{d.HUNK}') THEN content END) AS header, count(*) FILTER (WHERE kind = 'add') AS additions, count(*) FILTER (WHERE kind = 'delete') AS deletions, count(*) FILTER (WHERE kind = 'context') AS context_lines, lower(string_agg(CASE WHEN kind <> 'header' THEN content END, chr(10) ORDER BY pos)) AS body FROM parts WHERE hunk_no > 0 GROUP BY ALL),
hunks AS (SELECT doc_id, file_no, hunk_no, regexp_extract(header, '{d.HUNK}', 2)::BIGINT AS new_line, additions, deletions, context_lines, round(least(1.0, least(0.3, (additions + deletions) * 0.03) + CASE WHEN contains(body, 'part 1') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(body, '{"|".join(d.PRIORITY)}') THEN 0.3 ELSE 0 END)::DOUBLE, 6) AS score FROM h0)"""


def parts(sp, sf):
    return d.parsed(s.diff_lines(sp, sf))


def hunks(sp, sf):
    return d.hunks(parts(sp, sf), ["part 1"])


register("diff_lines_parsed", lambda sp, sf: parts(sp, sf).select("doc_id", "pos", "file_no", "hunk_no", "new_path", "kind"), f"WITH {DIFF} SELECT doc_id, pos, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, new_path, kind FROM parts")
register("diff_hunk_scores", hunks, f"WITH {DIFF} SELECT doc_id, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, new_line, additions, deletions, context_lines, score FROM hunks")
register("diff_file_topk", lambda sp, sf: d.top_files(hunks(sp, sf)), f"WITH {DIFF} SELECT doc_id, file_no::BIGINT AS file_no, changes::BIGINT AS changes, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY changes DESC, file_no) AS place FROM (SELECT doc_id, file_no, sum(additions + deletions) AS changes FROM hunks GROUP BY ALL)) WHERE place <= 20")
register(
    "diff_hunk_topk",
    lambda sp, sf: d.top_hunks(hunks(sp, sf), 3).select("doc_id", "file_no", "hunk_no", "place"),
    f"""WITH {DIFF}, a AS (SELECT *, count(*) OVER (PARTITION BY doc_id, file_no) AS n, row_number() OVER (PARTITION BY doc_id, file_no ORDER BY hunk_no) AS k FROM hunks),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, file_no ORDER BY CASE WHEN k = 1 THEN 0 WHEN k = n THEN 1 ELSE 2 END, score DESC, hunk_no) AS r FROM a)
SELECT doc_id, file_no::BIGINT AS file_no, hunk_no::BIGINT AS hunk_no, row_number() OVER (PARTITION BY doc_id, file_no ORDER BY new_line, hunk_no) AS place FROM b WHERE r <= 3""",
)
register(
    "diff_context_trim",
    lambda sp, sf: d.trimmed_context(parts(sp, sf), 1).select("doc_id", "pos", "kind"),
    f"""WITH {DIFF}, a AS (SELECT *, max((kind IN ('add', 'delete'))::INT) OVER (PARTITION BY doc_id, file_no, hunk_no ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near, max((kind IN ('add', 'delete'))::INT) OVER (PARTITION BY doc_id, file_no, hunk_no) AS any_, row_number() OVER (PARTITION BY doc_id, file_no, hunk_no ORDER BY pos) AS k FROM parts WHERE hunk_no > 0 AND kind <> 'header')
SELECT doc_id, pos, kind FROM a WHERE near = 1 OR (any_ = 0 AND k <= 1) OR starts_with(content, '\\')""",
)
register(
    "diff_noise",
    lambda sp, sf: d.noise(parts(sp, sf)),
    rf"""WITH {DIFF} SELECT doc_id, file_no::BIGINT AS file_no, any_value(new_path) AS new_path, count(*) AS lines, sum(strlen(content) + 1)::BIGINT AS bytes, regexp_matches(any_value(new_path), '{d.LOCKFILE}') AS lockfile,
  coalesce(list(regexp_replace(substr(content, 2), '\s', '', 'g') ORDER BY pos) FILTER (WHERE kind = 'add') = list(regexp_replace(substr(content, 2), '\s', '', 'g') ORDER BY pos) FILTER (WHERE kind = 'delete'), FALSE) AS whitespace_only FROM parts WHERE file_no > 0 GROUP BY doc_id, file_no""",
)
register("bloat_diff", lambda sp, sf: d.diff_bloat(parts(sp, sf)), f"WITH {DIFF}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE kind = 'context') AS c, count(*) FILTER (WHERE kind IN ('add', 'delete')) AS h FROM parts GROUP BY doc_id) SELECT doc_id, round(CASE WHEN n < 50 OR c + h = 0 OR c::DOUBLE / (c + h) <= 0.6 THEN 0.0 ELSE least(1.0, (c::DOUBLE / (c + h) - 0.6) / 0.4) END::DOUBLE, 6) AS bloat FROM g")


def log_bloat(sp, sf):
    """Half repetition, half lines of low priority, in the first hundred lines; 0 for short logs."""
    c = o.priority(o.importance(F.col("content"), "log"))
    g = logs(sp, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("pos") < 100, 1)).alias("k"), F.count_distinct(F.when(F.col("pos") < 100, F.col("content"))).alias("u"), F.count(F.when((F.col("pos") < 100) & (c <= 0.4), 1)).alias("low"))
    return g.select("doc_id", F.round(F.when(F.col("n") < 50, 0.0).otherwise(0.5 * (1 - F.col("u") / F.col("k")) + 0.5 * F.col("low") / F.col("k")), 6).alias("bloat"))


_ANY = first_word("content", o.KEYWORDS["error"] + o.KEYWORDS["importance"] + o.KEYWORDS["warning"], True)
register("bloat_log", log_bloat, f"WITH {LOGS}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE pos < 100) AS k, count(DISTINCT content) FILTER (WHERE pos < 100) AS u, count(*) FILTER (WHERE pos < 100 AND {_ANY} IS NULL) AS low FROM l GROUP BY doc_id) SELECT doc_id, round(CASE WHEN n < 50 THEN 0.0 ELSE 0.5 * (1 - u::DOUBLE / k) + 0.5 * low::DOUBLE / k END::DOUBLE, 6) AS bloat FROM g")


def broken(sp, sf):
    """Diffs of which every third lacks the last line of each hunk."""
    return s.diff_lines(sp, sf).filter("NOT (doc_id % 3 = 0 AND pos % 10 = 9)")


register(
    "unified_diff",
    lambda sp, sf: d.unified(broken(sp, sf)),
    f"WITH {s.DIFF_LINES_SQL} SELECT doc_id, bool_and(doc_id % 3 <> 0) AS is_diff FROM diff_lines GROUP BY doc_id",
)
