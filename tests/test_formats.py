"""Merge diffs, image sizes, JSON tables and sanitised documents."""

import json

from pyspark.sql import functions as F

from millrace.functions.text import image_size
from millrace.operators import compaction, diffs, payloads


def test_merge_diffs_have_files_and_hunks(spark):
    text = "commit 1\ndiff --cc src/a.py\n@@@ -1,2 -1,2 +7,3 @@@ def f\n  one\n++two\n- old\ndiff --combined b c.txt\n@@@@ -1 -1 -1 +9 @@@@\n+++x\ndiff --git a/x y b/z y\n@@ -3 +4 @@\n-a\n+b"
    lines = spark.createDataFrame([(1, i, c) for i, c in enumerate(text.split("\n"))], "doc_id long, pos long, content string")
    parts = diffs.parsed(lines)
    assert {r.file_no: r.new_path for r in parts.filter("file_no > 0").collect()} == {1: "src/a.py", 2: "b c.txt", 3: "z y"}
    found = {r.file_no: (r.new_line, r.additions, r.deletions, r.context_lines) for r in diffs.hunks(parts).collect()}
    assert found == {1: (7, 1, 1, 1), 2: (9, 1, 0, 0), 3: (4, 1, 1, 0)}


def test_image_sizes(spark):
    def frame(kind, height, width):
        return b"\xff" + bytes([kind]) + b"\x00\x11\x08" + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes(10)

    thumb = b"\xff\xe1" + (2 + 30).to_bytes(2, "big") + frame(0xC0, 9, 9).ljust(30, b"\x00")  # a frame inside a segment is no frame
    rows = [
        (0, b"\xff\xd8" + thumb + b"\xff\xff\xff" + frame(0xC2, 300, 70_00 // 10)[1:], ("jpeg", 700, 300)),
        (1, b"\xff\xd8\xff\xe0\x00\x00" + bytes(20), ("jpeg", None, None)),
        (2, b"\xff\xd8\xff\xc4\x00\x04ab" + frame(0xC0, 2, 1)[:8], ("jpeg", None, None)),
        (3, b"\xff\xd8\xff\xd9", ("jpeg", None, None)),
        (4, b"GIF89a" + bytes([5, 0, 6, 0]) + bytes(4), ("gif", 5, 6)),
        (5, b"", ("unknown", None, None)),
        (6, None, ("unknown", None, None)),
    ]
    df = spark.createDataFrame([(i, x) for i, x, _ in rows], "id long, data binary")
    assert {r.id: tuple(r.i) for r in df.select("id", image_size(F.col("data")).alias("i")).collect()} == {i: want for i, _, want in rows}


def test_json_tables(spark):
    long = "x y " * 100
    items = [{"a": 'q"\\é\n', "b": 1.0}, {"a": long, "b": 2.5}, {"a": None}]
    cells = [(1, i, k, "string" if isinstance(v, str) else "number", v if isinstance(v, str) else None, v if isinstance(v, float) else None) for i, x in enumerate(items) for k, v in x.items()]
    df = spark.createDataFrame(cells, "array_id long, idx long, field string, kind string, str string, num double")
    found = json.loads(compaction.json_tables(df).first().text)
    assert list(found) == ["_compaction", "_schema", "_kept", "_total", "_rows"] and found["_kept"] == found["_total"] == 3
    assert found["_schema"] == [{"name": "a", "type": "string", "nullable": True}, {"name": "b", "type": "float", "nullable": True}]
    assert found["_rows"][0] == ['q"\\é\n', 1] and found["_rows"][2] == [None, None]
    assert found["_rows"][1][1] == 2.5 and found["_rows"][1][0]["_size"] == len(long) and found["_rows"][1][0]["_kind"] == "string"
    assert compaction.json_tables(df.limit(0)).collect() == []


def test_sanitized_documents(spark):
    text = '{"n": 2.50, "A-P-I Key": {"x": 1}, "l": [{"password": null, "t": "' + "é" * 10 + '"}, "  [1, 2, 3, 4, 5, 6, 7]", {}, []], "s": "short"}'
    rows = [(1, text), (2, "no json"), (3, None), (4, "[]")]
    found = {r.doc_id: r for r in payloads.sanitized_documents(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect()}
    assert json.loads(found[1].text) == {"n": 2.5, "A-P-I Key": "__REDACTED__", "l": [{"password": "__REDACTED__", "t": "__LONG_STRING__"}, "__LARGE_JSON_ARRAY__", {}, []], "s": "short"}
    assert '\n  "n": 2.50,\n' in found[1].text and (found[1].redacted_fields, found[1].placeholder_strings) == (2, 2)
    assert tuple(found[2])[1:] == tuple(found[3])[1:] == (None, None, None)
    assert (found[4].text, found[4].redacted_fields) == ("[]\n", 0)
