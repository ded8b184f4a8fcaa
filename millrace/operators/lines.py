"""Operators on lines: doc_id, pos, content. Levels, importance, context, repeats and filters.

A document's lines are ordered by pos. Everything is a window over (doc_id order by pos) or an
aggregate over doc_id, so a chain of these operators shares one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from millrace.functions.detection import stripped

# Word lists and patterns of the line classifiers.
LEVELS = {
    "error": ["ERROR", "error", "Error", "FATAL", "fatal", "Fatal", "CRITICAL", "critical"],
    "fail": ["FAIL", "FAILED", "fail", "failed", "Fail", "Failed"],
    "warn": ["WARN", "WARNING", "warn", "warning", "Warn", "Warning"],
    "info": ["INFO", "info", "Info"],
    "debug": ["DEBUG", "debug", "Debug"],
    "trace": ["TRACE", "trace", "Trace"],
}
LEVEL_SCORES = {"error": 1.0, "fail": 1.0, "warn": 0.5, "info": 0.1, "unknown": 0.1, "debug": 0.05, "trace": 0.02}
KEYWORDS = {
    "error": ["error", "exception", "fail", "failed", "failure", "fatal", "critical", "crash", "panic", "abort", "timeout", "denied", "rejected"],
    "warning": ["warn", "warning"],
    "importance": ["important", "note", "todo", "fixme", "hack", "xxx", "bug", "fix"],
    "security": ["security", "auth", "password", "secret"],
}
MARKDOWN = ["# ", "## ", "### ", "#### ", "**", "> "]
INDICATORS = ["error", "fail", "exception", "traceback", "fatal", "panic", "crash"]
PRIORITIES = {"error": 0.95, "warning": 0.75, "security": 0.85, "importance": 0.6, "markdown": 0.45}
FORMATS = {
    "pytest": ["=== FAILURES", "=== ERRORS", "=== test session", "=== short test summary", "PASSED [", "FAILED [", "ERROR [", "SKIPPED [", "collected "],
    "npm": ["npm ERR!", "npm WARN", "npm info", "npm http"],
    "cargo": ["Compiling ", "Finished ", "Running ", "warning: ", "error[E"],
    "jest": ["PASS ", "FAIL ", "Test Suites:"],
    "make": ["make[", "make:", "gcc ", "g++ ", "clang "],
}
SUMMARY = r"^(===|---|\d+ (passed|failed|skipped|error|warning)|(Tests?|Suites?)[ :]\s*\d|TOTAL|Total|Summary|(Build|Compile|Test).*(succeeded|failed|complete))"
DIAGNOSTIC = ["error", "failed", "failures:", "panic", "warning:", "test result", "could not compile", "compilation failed"]
COMMENT = r"^\s*(//|#(?!!)|--|/\*|\*/|\*|;|%|<!--|\"\"\"|''')"
RUN = "[A-Za-z0-9_]+"
LEAST_LINES = 50  # of a log that is compressed


def ordered(*partition: str) -> W:
    return W.partitionBy(*(partition or ("doc_id",))).orderBy("pos")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is evaluated once, however often use names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_word_in(content: Column, words: list[str], fold: bool = False) -> Column:
    """The first maximal word run that is one of the words, or null."""
    run = f"(?<!{RUN[:-1]})(?:{'|'.join(sorted(words, key=len, reverse=True))})(?!{RUN[:-1]})"
    return once(F.regexp_extract(F.lower(content) if fold else content, run, 0), lambda w: F.nullif(w, F.lit("")))


def level(content: Column) -> Column:
    def named(found: Column) -> Column:
        out = F.when(found.isNull(), "unknown")
        for name, words in LEVELS.items():
            out = out.when(found.isin(words), name)
        return out

    return once(first_word_in(content, sum(LEVELS.values(), [])), named)


def level_score(of: Column) -> Column:
    def scored(of: Column) -> Column:
        out = F.when(F.lit(False), 0.0)
        for name, score in LEVEL_SCORES.items():
            out = out.when(of == name, score)
        return out

    return once(of, scored)


def line_score(content: Column, is_stack: Column | None = None) -> Column:
    stack = F.when(is_stack, 0.3).otherwise(0.0) if is_stack is not None else F.lit(0.0)
    return F.least(F.lit(1.0), level_score(level(content)) + stack + F.when(content.rlike(SUMMARY), 0.4).otherwise(0.0))


def importance(content: Column, context: str) -> Column:
    """Category of a line: error or importance anywhere; security in diffs; warnings in text, search and log; Markdown in text."""
    def category(both: Column) -> Column:
        out = F.when(both.isin(KEYWORDS["error"]), "error").when(both.isNotNull(), "importance")
        if context == "diff":
            out = out.when(first_word_in(content, KEYWORDS["security"], fold=True).isNotNull(), "security")
        else:
            out = out.when(first_word_in(content, KEYWORDS["warning"], fold=True).isNotNull(), "warning")
        if context == "text":
            prefix = F.lit(False)
            for p in MARKDOWN:
                prefix = prefix | content.startswith(p)
            out = out.when(prefix, "markdown")
        return out

    return once(first_word_in(content, KEYWORDS["error"] + KEYWORDS["importance"], fold=True), category)


def priority(category: Column) -> Column:
    out = F.when(category.isNull(), 0.0)
    for name, p in PRIORITIES.items():
        out = out.when(category == name, p)
    return out


def has_error_indicator(text: Column) -> Column:
    return F.lower(text).rlike("|".join(INDICATORS))


def log_formats(lines: DataFrame, sample: int = 100) -> DataFrame:
    """doc_id, format: the tool whose markers most of the first lines hold."""
    def hits(marks):
        found = F.lit(False)
        for m in marks:
            found = found | F.col("content").contains(m)
        return F.count(F.when(found, 1))

    counts = lines.filter(F.col("pos") < sample).groupBy("doc_id").agg(*[hits(m).alias(n) for n, m in FORMATS.items()])
    most = F.greatest(*FORMATS)
    out = F.when(most == 0, "generic")
    for name in FORMATS:
        out = out.when(F.col(name) == most, name)
    return counts.select("doc_id", out.alias("format"))


def with_context(lines: DataFrame, selected: str, before: int, after: int) -> DataFrame:
    """Adds near: whether a selected line is at most `before` lines ahead of or `after` lines behind a line."""
    return lines.withColumn("near", F.max(F.col(selected).cast("int")).over(ordered().rowsBetween(-after, before)) == 1)


def dedupe_key(content: Column) -> Column:
    """The part before the first ':' or '=', and the rest with numbers, addresses and paths replaced."""
    prefix = F.regexp_extract(content, r"^[^:=]*", 0)
    rest = F.substring(content, F.char_length(prefix) + 1, 1 << 30)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\d+", "N"), "0x[0-9a-fA-F]+", "ADDR"), r"/[\w/]+/", "/PATH/")
    return F.concat(prefix, rest)


def first_last_top(lines: DataFrame, group: list[str], score: str, most: int) -> DataFrame:
    """Of each group the first and the last line and then the best scored, `most` in all."""
    w = W.partitionBy(*group)
    d = lines.withColumns({"_first": F.row_number().over(w.orderBy("pos")), "_last": F.row_number().over(w.orderBy(F.desc("pos")))})
    rank = F.row_number().over(w.orderBy(F.when(F.col("_first") == 1, 0).when(F.col("_last") == 1, 1).otherwise(2), F.desc(score), "pos"))
    return d.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_first", "_last", "_rank")


def log_caps(lines: DataFrame) -> DataFrame:
    """doc_id, cap: how many lines carry a log's information, 10 to 100."""
    from .sizing import sizes

    return sizes(lines.select(F.col("doc_id").alias("array_id"), F.col("pos").alias("idx"), F.col("content").alias("item")), 1.0, 10, 100).select(F.col("array_id").alias("doc_id"), F.col("k").alias("cap"))


def log_selection(lines: DataFrame, most: int = 10, warnings: int = 5, context: int = 3, cap: int | None = None, stacks: int = 3, frames: int = 20) -> DataFrame:
    """The lines that a log keeps: errors and failures, distinct warnings, the first stack traces, summaries and their
    context. By score as many of them as the log's lines carry information; `cap` takes the place of that number."""
    from .sequential import OPENING, stack_traces

    with_traces = lines.filter(F.col("content").rlike(OPENING)).select("doc_id").distinct()
    traces = stack_traces(lines.join(with_traces, "doc_id", "left_semi")).withColumn("_frame", F.row_number().over(W.partitionBy("doc_id", "trace_no").orderBy("pos")))
    d = lines.join(traces, ["doc_id", "pos"], "left")
    in_trace = F.col("trace_no").isNotNull()
    d = d.withColumns({"level": level(F.col("content")), "score": line_score(F.col("content"), in_trace), "summary": F.col("content").rlike(SUMMARY)})
    w = W.partitionBy("doc_id", "level")
    d = d.withColumns({"_first": F.row_number().over(w.orderBy("pos")), "_last": F.row_number().over(w.orderBy(F.desc("pos"))), "_same": F.row_number().over(W.partitionBy("doc_id", "level", dedupe_key(F.col("content"))).orderBy("pos"))})
    d = d.withColumn("_rank", F.row_number().over(w.orderBy(F.when(F.col("_first") == 1, 0).when(F.col("_last") == 1, 1).otherwise(2), F.desc("score"), "pos")))
    d = d.withColumn("_warn", F.sum(F.when((F.col("level") == "warn") & (F.col("_same") == 1), 1).otherwise(0)).over(ordered().rowsBetween(W.unboundedPreceding, 0)))
    chosen = (F.col("level").isin("error", "fail") & (F.col("_rank") <= most)) | ((F.col("level") == "warn") & (F.col("_same") == 1) & (F.col("_warn") <= warnings)) | F.col("summary")
    chosen = chosen | F.coalesce((F.col("trace_no") <= stacks) & (F.col("_frame") <= frames), F.lit(False))
    d = with_context(d.withColumn("chosen", chosen), "chosen", context, context).filter("near")
    d = d.withColumn("_place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("score"), "pos")))
    d = d.join(log_caps(lines), "doc_id") if cap is None else d.withColumn("cap", F.lit(cap))
    return d.filter(F.col("_place") <= F.col("cap")).select("doc_id", "pos", "content", "level", "score")


def log_text(lines: DataFrame, **options) -> DataFrame:
    """doc_id, compressed, n_lines, n_kept, original_bytes, ratio, hash (of the original, if the log is worth storing)."""
    kept = log_selection(lines, **options).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_kept"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("body"))
    levels = [F.count(F.when(level(F.col("content")) == k, 1)).alias(k) for k in ("error", "fail", "warn", "info")]
    all_lines = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n").alias("original"), *levels)
    parts = F.concat_ws(", ", *[F.when(F.col(k) > 0, F.concat_ws(" ", F.col(k).cast("string"), F.lit(k.upper()))) for k in ("error", "fail", "warn", "info")])
    d = all_lines.join(kept, "doc_id").withColumn("omitted", F.col("n_lines") - F.col("n_kept"))
    note = F.when((F.col("omitted") > 0) & (parts != ""), F.concat(F.lit("\n["), F.col("omitted").cast("string"), F.lit(" lines omitted: "), parts, F.lit("]"))).otherwise("")
    d = d.withColumn("compressed", F.when(F.col("n_lines") < LEAST_LINES, F.col("original")).otherwise(F.concat("body", note)))
    ratio = F.octet_length("compressed") / F.greatest(F.octet_length("original"), F.lit(1))
    stored = (F.col("n_lines") >= LEAST_LINES) & (ratio < 0.5)
    return d.select("doc_id", "compressed", "n_lines", "n_kept", F.octet_length("original").alias("original_bytes"), ratio.alias("ratio"), F.when(stored, F.substring(F.md5(F.col("original").cast("binary")), 1, 24)).alias("hash"))


def repeats_collapsed(lines: DataFrame, most: int = 240) -> DataFrame:
    """Runs of equal consecutive lines as one row: doc_id, run, content, times; the first `most` runs."""
    d = lines.withColumn("_new", F.coalesce((F.col("content") != F.lag("content").over(ordered())), F.lit(True)).cast("int"))
    d = d.withColumn("run", F.sum("_new").over(ordered().rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy("doc_id", "run").agg(F.first("content").alias("content"), F.count(F.lit(1)).alias("times")).filter(F.col("run") <= most)


def diagnostics(lines: DataFrame, following: int = 3) -> DataFrame:
    """Lines that report a problem, and the lines that follow each."""
    hit = F.lower("content").rlike("|".join(DIAGNOSTIC))
    return with_context(lines.withColumn("hit", hit), "hit", 0, following).filter("near").select("doc_id", "pos", "content", "hit")


def pytest_lines(lines: DataFrame, following: int = 2) -> DataFrame:
    t = stripped(F.col("content"))
    hit = t.rlike(r"^(FAILED |ERROR |====)") | t.rlike(" (failed|passed|error|warnings)") | F.col("content").rlike("^(E   |File )")
    return with_context(lines.withColumn("hit", hit), "hit", 0, following).filter("near").select("doc_id", "pos", "content", "hit")


def git_status_lines(lines: DataFrame) -> DataFrame:
    t = stripped(F.col("content"))
    return lines.filter(~((t == "") | t.rlike(r"^(\(use |use |no changes added)")))


def listing_lines(lines: DataFrame, most: int = 120) -> DataFrame:
    d = lines.filter((stripped(F.col("content")) != "") & (F.lower(stripped(F.col("content"))) != "total 0"))
    return d.withColumn("place", F.row_number().over(ordered())).filter(F.col("place") <= most).drop("place")


def git_log_lines(lines: DataFrame, most: int = 80) -> DataFrame:
    t = stripped(F.col("content"))
    out = F.when(t.startswith("commit "), F.concat(F.lit("commit "), F.substring(t, 8, 12))).otherwise(t)
    d = lines.filter(~t.rlike("^(Author:|Date:|Merge:)") & (t != "")).withColumn("content", out)
    return d.withColumn("place", F.row_number().over(ordered())).filter(F.col("place") <= most).drop("place")


def cargo_test_lines(lines: DataFrame, most: int = 20) -> DataFrame:
    """Failure sections of at most `most` lines, results, and other lines that report a problem."""
    t, c = stripped(F.col("content")), F.col("content")
    noise = t.rlike("^(Compiling|Checking|Finished|running )") | (c.startswith("test ") & c.endswith("... ok"))
    d = lines.filter(~noise).withColumn("mark", F.when((c == "failures:") | c.startswith("---- "), 1).when(c.startswith("test result:"), 0))
    d = d.withColumn("section", F.count("mark").over(ordered().rowsBetween(W.unboundedPreceding, 0))).withColumn("inside", F.coalesce(F.last("mark", True).over(ordered().rowsBetween(W.unboundedPreceding, 0)), F.lit(0)))
    d = d.withColumn("at", F.count(F.when(F.col("mark").isNull(), 1)).over(W.partitionBy("doc_id", "section").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)))
    problem = F.lower(c).rlike("error|failed|panic|could not compile")
    return d.filter(F.col("mark").isNotNull() | ((F.col("inside") == 1) & (F.col("at") <= most)) | ((F.col("inside") == 0) & problem)).select("doc_id", "pos", "content")


def grouped_matches(lines: DataFrame, per_file: int = 6, total: int = 80) -> DataFrame:
    """doc_id, file, n, and how many of its lines are shown: a header per file, files in order, `total` lines in all."""
    d = lines.filter(F.col("content").contains(":")).withColumn("file", F.regexp_extract("content", "^([^:]*):", 1))
    g = d.groupBy("doc_id", "file").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum(F.least("n", F.lit(per_file)) + 1).over(W.partitionBy("doc_id").orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("before", before).select("doc_id", "file", "n", F.greatest(F.lit(0), F.least(F.col("n"), F.lit(per_file), total - F.col("before") - 1)).cast("long").alias("shown"))


def tsc_groups(lines: DataFrame, per_file: int = 5, width: int = 180) -> DataFrame:
    """doc_id, file, place, content: the first diagnostics of each file."""
    d = lines.withColumn("file", F.regexp_extract("content", r"^([^(]*)\(", 1)).filter(F.col("content").rlike(r"^[^(]*\(.*\): (error|warning) TS"))
    d = d.withColumn("place", F.row_number().over(W.partitionBy("doc_id", "file").orderBy("pos"))).filter(F.col("place") <= per_file)
    return d.select("doc_id", "file", "place", truncated(F.col("content"), width).alias("content"))


def truncated(text: Column, most: int) -> Column:
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(0, most - 3))), F.lit("...")))


def without_comments(lines: DataFrame) -> DataFrame:
    """Source lines without whole-line comments, and blank runs as one blank line."""
    d = lines.filter(~F.col("content").rlike(COMMENT))
    blank = stripped(F.col("content")) == ""
    return d.withColumn("_blank", blank).withColumn("_before", F.coalesce(F.lag("_blank").over(ordered()), F.lit(False))).filter(~(F.col("_blank") & F.col("_before"))).select("doc_id", "pos", "content")


def source_text(text: Column) -> Column:
    """without_comments of a whole text: its lines joined again, in one projection."""
    code = F.filter(F.split(text, "\n", -1), lambda x: ~x.rlike(COMMENT))
    blank = F.transform(code, lambda x: stripped(x) == "")
    return F.transform(F.array(F.struct(code.alias("x"), blank.alias("b"))), lambda s: F.array_join(F.filter(s["x"], lambda x, i: ~(F.get(s["b"], i) & F.coalesce(F.get(s["b"], i - 1), F.lit(False)))), "\n"))[0]


def apply_rule(lines: DataFrame, rule: dict) -> DataFrame:
    """One filter rule on lines: ANSI codes, replacements, strip and keep patterns, truncation, head, tail, maximum."""
    c = F.col("content")
    if rule.get("strip_ansi"):
        c = F.regexp_replace(c, r"\x1b\[[0-9;?]*[ -/]*[@-~]", "")
    for r in rule.get("replace", []):
        c = F.regexp_replace(c, r["pattern"], r["replacement"])
    d = lines.withColumn("content", c)
    if rule.get("strip_lines_matching"):
        d = d.filter(~F.col("content").rlike("|".join(f"(?:{p})" for p in rule["strip_lines_matching"])))
    if rule.get("keep_lines_matching"):
        d = d.filter(F.col("content").rlike("|".join(f"(?:{p})" for p in rule["keep_lines_matching"])))
    if rule.get("truncate_lines_at"):
        d = d.withColumn("content", truncated(F.col("content"), rule["truncate_lines_at"]))
    for key in ("head_lines", "tail_lines", "max_lines"):
        if rule.get(key) is not None:
            order = W.partitionBy("doc_id").orderBy(F.desc("pos") if key == "tail_lines" else F.col("pos"))
            d = d.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= rule[key]).drop("_place")
    return d
