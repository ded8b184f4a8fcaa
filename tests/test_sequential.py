"""The ordered scans and small functions, on lines made by hand."""

import hashlib
import random

from pyspark.sql import functions as F

from millrace.functions import detection, text
from millrace.operators import diffs, lines, rendering, sequential, sizing


def test_stack_traces_end_with_their_kind():
    log = ["start", "Traceback (most recent call last)", '  File "a.py", line 3', "    x = 1", "ValueError: bad", "done", "    at com.acme.Main(Main.java)", "next"]
    assert sequential.trace_flags(log) == [False, True, True, True, True, False, True, False]
    assert sum(sequential.trace_flags(["Traceback (most recent call last)"] + [" x"] * 50)) == 20


def test_templates_fold_runs_and_keep_the_rest():
    log = "\n".join(f"worker {i} finished the long job number {i * 7} in the night" for i in range(30))
    out = sequential.templated(log)
    assert out.startswith("[Template T1: worker <*> finished the long job number <*> in the night] (30 occurrences)")
    assert "3 21" in out and len(out) < len(log)
    assert sequential.templated("short\nlog") == "short\nlog"


def test_simhash_is_near_for_near_texts():
    a, b = sizing.simhash("the quick brown fox jumps over the lazy dog"), sizing.simhash("the quick brown fox jumps over the lazy dog")
    assert a == b and 0 <= a < 1 << 64
    assert sizing.checked_size("abc" * 200, "abc", 3, 10) in (3,)


def test_detection_of_each_type(spark):
    texts = {
        '[{"a": 1}, {"a": 2}]': "json_array",
        "diff --git a/x b/x\n@@ -1,2 +1,2 @@\n-old\n+new": "diff",
        "<!DOCTYPE html><html><head></head><body><div></div></body></html>": "html",
        "a/b.c:10:x\na/b.c:12:y": "search",
        "2024-01-01 ERROR broken\n2024-01-01 INFO fine": "build",
        "import os\nimport sys\n\ndef f(a):\n    return a": "source_code",
        "  ": "text",
        "just words": "text",
    }
    df = spark.createDataFrame(list(texts.items()), "text string, expected string")
    assert df.filter(detection.content_type(F.col("text")) != F.col("expected")).collect() == []


def test_minified_json_keeps_strings_and_numbers(spark):
    row = spark.createDataFrame([('{"a b" :  1.50, "c": " x \\" y "}',)], "t string").select(text.minified_json(F.col("t")).alias("m")).first()
    assert row.m == '{"a b":1.50,"c":" x \\" y "}'


def test_rule_applies_in_order(spark):
    df = spark.createDataFrame([(1, i, c) for i, c in enumerate(["keep \x1b[31mred\x1b[0m", "drop", "keep a long long line", "keep z"])], "doc_id long, pos long, content string")
    out = lines.apply_rule(df, {"strip_ansi": True, "keep_lines_matching": ["keep"], "truncate_lines_at": 10, "tail_lines": 2})
    assert [r.content for r in out.orderBy("pos").collect()] == ["keep a ...", "keep z"]


def test_line_operators_take_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, pos long, content string")
    for made in (lines.log_selection(empty), lines.repeats_collapsed(empty), lines.diagnostics(empty), sequential.stack_traces(empty)):
        assert made.collect() == []


def test_observed_counts(spark):
    from millrace.operators.rendering import observed

    df, seen = observed(spark.range(5), "five", rows=F.count(F.lit(1)))
    assert len(df.collect()) == 5 and seen.get["rows"] == 5


def test_sizes_in_one_pass_equal_curve_and_clusters(spark):
    texts = ["", "a", "Ab c", "x\x0by z é漢字", "😀 wide 😀 text", "the quick brown fox", "The quick  brown fox", "a b c d e f g"]
    rows = [(k, i, " ".join(texts[(i * (k + 3) + j) % len(texts)] for j in range(k % 3 + 1))) for k in range(12) for i in range(k * 2 + 1)] + [(99, i, f"line {i} of many, {i * 7919 % 1000}") for i in range(60)] + [(98, i, "same") for i in range(9)]
    items = spark.createDataFrame(rows, "array_id long, idx long, item string")
    apart = sizing.knees(sizing.bigram_curve(items)).join(sizing.near_equal_clusters(items).select("array_id", "clusters"), "array_id")
    one = sizing.knees_and_clusters(items)
    assert sorted(map(tuple, one.select(*apart.columns).collect())) == sorted(map(tuple, apart.collect()))
    # No row of a bigram is moved.
    assert "Generate" not in sizing.sizes(items)._jdf.queryExecution().executedPlan().toString()


def test_simhash_of_all_letters():
    def plain(text):
        text, votes = text.lower(), [0] * 64
        for i in range(max(1, len(text) - 3)):
            h = int.from_bytes(hashlib.md5(text[i : i + 4].encode()).digest()[:8], "big")
            votes = [v + (1 if h >> b & 1 else -1) for b, v in enumerate(votes)]
        return sum(1 << b for b, v in enumerate(votes) if v > 0)

    letters = random.Random(3)
    texts = ["", "a", "abc", "abcd", "😀bcd"] + ["".join(letters.choice("abé漢 \nX😀" if i % 3 else "abc d") for _ in range(i)) for i in range(80)]
    assert sizing.simhashes(texts) == [plain(t) for t in texts] == [sizing.simhash(t) for t in texts]


def test_whole_texts_equal_operators_on_lines(spark):
    """Diffs and sources as one row each give what the operators on lines give."""
    r = random.Random(5)
    some = ["diff --git a/x b/y", "diff --git a/x b/y\r", "diff --git a/\rx b/y", "diff --cc z", "diff --git", "@@ -1,2 +3,4 @@ f", "@@@ -1 -2 +3 @@@", "@@ -١ +1 @@", "@ no", "--- a/x", "+++ b/x", "+1", "-2", " c", " d", " e", "", "\\ No newline", "other", "# note", "  // c", "x = 1", " \t", "d"]
    texts = [(k, "\n".join(r.choice(some) for _ in range(r.randint(0, 40)))) for k in range(300)]
    df = spark.createDataFrame([*texts, (300, "a"), (301, "diff --git a/x b/y\n@@ -1 +1 @@\n c\n d\n e\n f")], "doc_id long, text string").repartition(4)
    split = df.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    parts = diffs.parsed(split)
    apart = {x.doc_id: x.text for x in rendering.diff_texts(parts, diffs.trimmed_context(parts, 2)).collect()}
    whole = {x.doc_id: x.out for x in diffs.compressed_texts(df).collect()}
    assert {k: whole[k] for k in apart} == apart and len(apart) > 250
    apart = {x.doc_id: x.out for x in rendering.joined(lines.without_comments(split), ["doc_id"], ["pos"], "content", "out").collect()}
    whole = {x.doc_id: x.out for x in df.select("doc_id", lines.source_text(F.col("text")).alias("out")).collect()}
    assert {k: whole[k] for k in apart} == apart and len(apart) > 250
