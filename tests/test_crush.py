"""Arrays crushed end to end, adaptive caps, traces in logs, diff validation, scorers and gates of the store, against plain Python."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import detection
from millrace.operators import crush, diffs, lines, matches, relevance, rendering, sequential, sizing


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


def kept_by_hand(rows, strategy, most=15, reach=2):
    """rows: (idx, must, cluster, score, change), in order."""
    n = len(rows)
    if n < 5 or strategy in ("none", "skip", None):
        return [r[0] for r in rows]
    top = sorted(rows, key=lambda r: (-r[3], r[0]))[:most]
    seen, first = {}, set()
    for i, r in enumerate(rows):
        seen[r[2]] = seen.get(r[2], 0) + 1
        edge = r[0] < 3 or r[0] >= n - 2
        if strategy == "time_series":
            hit = edge or any(x[4] for x in rows[max(0, i - reach) : i + reach + 1])
        elif strategy == "cluster":
            hit = seen[r[2]] <= 2
        elif strategy == "top_n":
            hit = r in top
        else:
            hit = edge
        if hit:
            first.add(r[0])
    must = [r[0] for r in rows if r[1]]
    rest = [r[0] for r in rows if not r[1] and r[0] in first]
    if strategy == "smart_sample":
        rest += [r[0] for r in rows if not r[1] and r[0] not in first]
    return sorted(must + rest[: max(0, most - len(must))])


def test_plans_and_crushed_arrays(spark):
    rng = random.Random(1)
    arrays, how = {}, {}
    for k, strategy in enumerate(["none", "skip", "time_series", "cluster", "top_n", "smart_sample", None, "smart_sample"]):
        n = 3 if k == 7 else 60
        arrays[k] = [(i, rng.random() < 0.1, f"c{rng.randint(0, 9)}", rng.randint(0, 30), rng.random() < 0.05) for i in range(n)]
        how[k] = strategy
    items = frame(spark, [(k, *r, json.dumps({"id": r[0]})) for k, rows in arrays.items() for r in rows], "array_id long, idx long, must boolean, cluster string, score int, change boolean, raw string")
    plans = frame(spark, [(k, v) for k, v in how.items() if v], "array_id long, strategy string")
    found = crush.planned(items.select("array_id", "idx", "must", "cluster", "score", "change", "raw"), plans, F.col("must"), F.col("cluster"), F.col("score"), F.col("change"))
    want = {k: kept_by_hand(rows, how[k]) for k, rows in arrays.items()}
    assert {k: sorted(r.idx for r in found.collect() if r.array_id == k and r.keep) for k in arrays} == want
    for r in crush.crushed(found).collect():
        body, n = json.loads(r.text), len(arrays[r.array_id])
        assert (r.n_items, r.n_kept) == (n, len(want[r.array_id]))
        assert [x["id"] for x in body if "id" in x] == want[r.array_id]
        if r.n_kept < n:
            assert body[-1] == {"_ccr_dropped": f"<<ccr:{r.hash} {n - r.n_kept}_rows_offloaded>>"}
            assert sorted([x["id"] for x in json.loads(r.dropped)] + want[r.array_id]) == list(range(n))
            assert r.hash == hashlib.sha256(r.dropped.encode()).hexdigest()[:12]
        else:
            assert r.hash is None and r.dropped is None


def test_logs_keep_traces_and_as_many_lines_as_carry_information(spark):
    rows = [(1, i, f"2024-01-01 INFO step {i} of a long build, file{i}.c") for i in range(60)]
    trace = ["Traceback (most recent call last)", '  File "a.py", line 1', "    raise ValueError", "ValueError: no"]
    for i, line in enumerate(trace):
        rows[20 + i] = (1, 20 + i, line)
    rows += [(2, i, f"INFO same {i % 3}") for i in range(40)] + [(2, 40, "ERROR it failed")]
    df = frame(spark, rows, "doc_id long, pos long, content string")
    found = lines.log_selection(df).collect()
    assert {20, 21, 22} <= {r.pos for r in found if r.doc_id == 1}
    caps = {r.array_id: r.k for r in sizing.sizes(df.select(F.col("doc_id").alias("array_id"), F.col("pos").alias("idx"), F.col("content").alias("item")), 1.0, 10, 100).collect()}
    for k in (1, 2):
        n = sum(r.doc_id == k for r in found)
        assert 0 < n <= caps[k] <= 100
    assert 40 in {r.pos for r in found if r.doc_id == 2}
    assert len(lines.log_selection(df, cap=2).collect()) == 4
    flags = sequential.trace_flags([r[2] for r in rows if r[0] == 1])
    assert [i for i, f in enumerate(flags) if f][:3] == [20, 21, 22]


def test_searches_keep_as_many_matches_as_carry_information(spark):
    rows = [(1, i, f"src/f{i % 4}.py:{i}:unlike text number {i} {i * 7919}") for i in range(80)]
    found = matches.parsed(frame(spark, rows, "doc_id long, pos long, content string")).withColumn("score", F.lit(0.1))
    caps = [r.total for r in matches.totals(found).collect()]
    assert 5 <= caps[0] <= 30 and matches.selected(found, per_file=20).count() == caps[0]


@pytest.mark.parametrize(
    ("text", "good"),
    [
        ("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n one\n-two\n+three", True),
        ("--- a/x\n+++ b/x\n@@ -1 +1 @@\n-two\n+three\n\\ No newline at end of file", True),
        ("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n one\n-two", False),
        ("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n one\nnot a line\n+three\n-two", False),
        ("@@ -1,1 +1,1 @@\n-a\n+b", False),
        ("--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n one\n--- two\n+++ three\n@@ -9 +9 @@\n-a\n+b", True),
        ("prose\nand more", False),
        ("", False),
    ],
)
def test_unified_diffs(spark, text, good):
    df = frame(spark, [(1, text)], "doc_id long, text string").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "content"))
    assert [r.is_diff for r in diffs.unified(df).collect()] == [good]


def test_scorers_by_name(spark):
    docs = frame(spark, [(1, "alpha beta gamma"), (2, "delta epsilon"), (3, "alpha alpha zeta")], "doc_id long, text string")
    queries = frame(spark, [(1, "alpha beta"), (2, "nothing here")], "query_id long, text string")
    for name in ("BM25", "embedding", "Hybrid"):
        best = {r.query_id: r.doc_id for r in sorted(relevance.scorer(name)(docs, queries).collect(), key=lambda r: r.score)}
        assert best[1] == 1 or name == "BM25"
    with pytest.raises(ValueError):
        relevance.scorer("magic")


def test_nearest_in_blocks(spark):
    rng = random.Random(2)
    rows = [(i, [rng.random() - 0.3 for _ in range(4)]) for i in range(90)] + [(90, [0.0] * 4)]
    v = frame(spark, rows, "vec_id long, v array<double>")
    q = v.filter("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    for block in (2_048, 3):
        found = {(r.query_id, r.place): r.vec_id for r in relevance.nearest(v, q, 3, block).collect()}
        for k, x in rows[::9]:
            def cosine(y):
                norm = sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5
                return round(min(1.0, max(0.0, sum(a * b for a, b in zip(x, y, strict=True)) / norm)), 5) if norm else 0.0

            want = sorted(rows, key=lambda r: (-cosine(r[1]), r[0]))[:3]
            assert [found[k, p] for p in (1, 2, 3)] == [r[0] for r in want]
    assert relevance.nearest(v.filter("false"), q, 3).collect() == []


def test_gates_notes_and_statistics(spark):
    one = spark.createDataFrame([("x" * 100, "y" * 70, 50), ("x" * 100, "y" * 90, 50), ("x" * 100, "y", 9)], "o string, c string, n long")
    keys = [r[0] for r in one.select(rendering.stored_key(F.col("o"), F.col("c"), F.col("n"), 10)).collect()]
    assert keys == [hashlib.md5(b"x" * 100).hexdigest()[:24], None, None]
    assert [r[0] for r in one.select(rendering.with_omitted(F.col("c"), F.lit(3))).collect()][2] == "y\n[... 3 lines omitted]"
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,2 +1,2 @@\n one\n-two\n+three"
    parts = diffs.parsed(frame(spark, [(1, i, x) for i, x in enumerate(text.split("\n"))], "doc_id long, pos long, content string"))
    r = rendering.diff_stats(parts, parts.filter("kind = 'add'")).collect()[0]
    assert (r.files, r.hunks, r.additions, r.deletions, r.lines, r.kept_lines, r.kept_hunks) == (1, 1, 1, 1, 7, 1, 1)


def test_detection_of_white_space_and_scripts(spark):
    rows = [(1, "\n[{}]"), (2, "\t[{\"a\": 1}]\r\n"), (3, "\u00a0 \r\n"), (4, "def größe(x):\nclass Élan:\n    def été(): pass\n@décor"), (5, None), (6, "[1, 2"), (7, "plain words")]
    df = frame(spark, rows, "doc_id long, text string")
    got = {r.doc_id: (r.content_type, r.whole) for r in detection.with_content_type(df).withColumn("whole", detection.content_type(F.col("text"))).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "json_array", 2: "json_array", 3: "text", 4: "source_code", 5: "text", 6: "text", 7: "text"}
    assert all(a == b for a, b in got.values())
