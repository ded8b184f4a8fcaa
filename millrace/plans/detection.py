"""Detection queries over the table of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog import register
from millrace.functions import detection as d

from .texts import TEXTS_SQL, texts


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _lines(most: int) -> str:
    return f"string_split(text, chr(10))[1:{most}]"


def _count(most: int, pattern: str) -> str:
    return f"len(list_filter({_lines(most)}, lambda x: regexp_matches(x, {_q(pattern)})))"


def _filled(most: int) -> str:
    return f"len(list_filter({_lines(most)}, lambda x: regexp_matches(x, {_q(d.FILLED)})))"


_BODY = f"regexp_replace(regexp_replace(text, '^{d.SPACE}+', ''), '{d.SPACE}+$', '')"


_JSON = f"CASE WHEN {_BODY} LIKE '[%' AND json_valid({_BODY}) THEN CASE WHEN json_array_length({_BODY}) > 0 AND len(list_filter(json_extract(CASE WHEN {_BODY} LIKE '[%' AND json_valid({_BODY}) THEN {_BODY} ELSE '[]' END, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END END"
_DIFF = f"CASE WHEN {_count(500, d.DIFF_HEADER)} > 0 THEN least(1.0::DOUBLE, 0.5::DOUBLE + {_count(500, d.DIFF_HEADER)} * 0.2::DOUBLE + {_count(500, d.DIFF_CHANGE)} * 0.05::DOUBLE) END"
_S = f"left(text, {d.HTML_SAMPLE})"
_TAGS = f"len(regexp_extract_all({_S}, {_q(d.STRUCTURE)}))"
_HTML_SCORE = f"least(1.0::DOUBLE, (CASE WHEN regexp_matches({_S}, {_q(d.DOCTYPE)}) THEN 0.5::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches({_S}, {_q(d.HTML)}) THEN 0.3::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches({_S}, {_q(d.HEAD)}) THEN 0.1::DOUBLE ELSE 0 END) + (CASE WHEN regexp_matches({_S}, {_q(d.BODY)}) THEN 0.1::DOUBLE ELSE 0 END) + least(0.3::DOUBLE, {_TAGS} * 0.03::DOUBLE))"
_HTML = f"CASE WHEN (regexp_matches({_S}, {_q(d.DOCTYPE)}) OR regexp_matches({_S}, {_q(d.HTML)}) OR {_TAGS} >= 3) AND {_HTML_SCORE} >= 0.5 THEN {_HTML_SCORE} END"
_SHITS = f"len(list_filter({_lines(100)}, lambda x: regexp_matches(x, {_q(d.SEARCH)})))"
_SEARCH = f"CASE WHEN {_SHITS} > 0 AND {_SHITS}::DOUBLE / {_filled(100)} >= 0.3 THEN least(1.0::DOUBLE, 0.4::DOUBLE + {_SHITS}::DOUBLE / {_filled(100)} * 0.6::DOUBLE) END"
_LHITS, _LERR = _count(200, d.any_of(d.LOG)), _count(200, d.any_of(d.LOG[:2]))
_LOG = f"CASE WHEN {_LHITS} > 0 AND {_LHITS}::DOUBLE / {_filled(200)} >= 0.1 THEN least(1.0::DOUBLE, 0.3::DOUBLE + {_LHITS}::DOUBLE / {_filled(200)} * 0.5::DOUBLE + {_LERR} * 0.05::DOUBLE) END"
_CODES = "greatest(" + ", ".join(_count(100, d.any_of(p)) for p in d.CODE.values()) + ")"
_CODE = f"CASE WHEN {_CODES} >= 3 THEN least(1.0::DOUBLE, 0.4::DOUBLE + {_CODES}::DOUBLE / greatest({_filled(100)}, 1) * 0.4::DOUBLE + {_CODES} * 0.02::DOUBLE) END"

_PROBES = {
    "detect_json": (d.json_confidence, _JSON),
    "detect_diff": (d.diff_confidence, _DIFF),
    "detect_html": (d.html_confidence, _HTML),
    "detect_search": (d.search_confidence, _SEARCH),
    "detect_log": (d.log_confidence, _LOG),
    "detect_code": (d.code_confidence, _CODE),
}


def _probe(column):
    def run(spark, sf_dir):
        return texts(spark, sf_dir).select("origin", "doc_id", column(F.col("text")).alias("confidence")).filter("confidence IS NOT NULL")

    return run


for _name, (_column, _sql) in _PROBES.items():
    register(_name, _probe(_column), f"WITH {TEXTS_SQL} SELECT * FROM (SELECT origin, doc_id, ({_sql})::DOUBLE AS confidence FROM texts) WHERE confidence IS NOT NULL")

register(
    "detect_content_type",
    lambda spark, sf_dir: d.with_content_type(texts(spark, sf_dir)).select("origin", "doc_id", "content_type"),
    f"""WITH {TEXTS_SQL}, c AS (SELECT origin, doc_id, text, {_JSON} AS j, {_DIFF} AS d, {_HTML} AS h, {_SEARCH} AS s, {_LOG} AS l, {_CODE} AS c FROM texts)
SELECT origin, doc_id, CASE WHEN NOT regexp_matches(coalesce(text, ''), '{d.FILLED}') THEN 'text' WHEN j IS NOT NULL THEN 'json_array' WHEN d >= 0.7 THEN 'diff' WHEN h >= 0.7 THEN 'html'
  WHEN s >= 0.6 THEN 'search' WHEN l >= 0.5 THEN 'build' WHEN c >= 0.5 THEN 'source_code' ELSE 'text' END AS content_type FROM c""",
)
