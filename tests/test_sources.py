"""Readers, sinks, the store and streams, on files made in a temporary folder."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import rules
from millrace.sources import readers, sinks
from millrace.sources.store import Store
from millrace.streaming import flows


def test_whole_texts_by_suffix(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a.TXT").write_text("one\ntwo")
    (tmp_path / "b.bin").write_text("no")
    (tmp_path / "in" / "c.txt").write_text("three")
    flat = readers.whole_texts(spark, [str(tmp_path)], suffixes=["txt"])
    deep = readers.whole_texts(spark, [str(tmp_path)], recursive=True, suffixes=["txt"])
    assert [r.text for r in flat.collect()] == ["one\ntwo"]
    assert sorted(r.text for r in deep.collect()) == ["one\ntwo", "three"]
    assert [(r.pos, r.content) for r in readers.lines(spark, [str(tmp_path / "a.TXT")]).collect()] == [(0, "one"), (1, "two")]
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        readers.whole_texts(spark, [str(tmp_path / "gone")]).collect()


def test_event_log_drops_bad_lines(spark, tmp_path):
    path = tmp_path / "h.jsonl"
    path.write_text(json.dumps({"command": "ls", "bytes_saved": 4}) + "\nnot json\n")
    assert [(r.command, r.bytes_saved) for r in readers.event_log(spark, str(path)).collect()] == [("ls", 4)]


def test_session_events(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text('{"tool": "x", "input": {"cmd": "git status"}}\n{"stdout": "clean"}\n$ make all\n')
    found = [(r.command, r.output) for r in readers.session_events(spark, [str(path)]).orderBy("pos").collect()]
    assert found == [("git status", None), (None, "clean"), ("make all", None), (None, None)]


def test_settings_and_recommendations(spark):
    assert readers.settings("[bloat]\nlines = 7\n", {"bloat": {"lines": 50, "share": 0.5}})["bloat"] == {"lines": 7, "share": 0.5}
    with pytest.raises(ValueError, match="unknown"):
        readers.settings("[bloat]\nrows = 7\n", {"bloat": {"lines": 50}})
    assert readers.recommendations(spark, "[[recommendation]]\nauth_mode = 'payg'\nconfidence = 0.5").count() == 1
    assert readers.recommendations(spark, "broken [").count() == 0


def test_store_keeps_the_newest_and_forgets_in_time(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    df = spark.createDataFrame([("x",), ("y",), ("x",)], "text string")
    store.put(df, F.lit(100))
    store.put(df.filter("text = 'x'"), F.lit(500))
    assert store.rows().count() == 2
    assert [r.original for r in store.live(2000).collect()] == ["x"]
    hashes = store.rows().select("hash")
    assert sorted(r.original for r in store.get(hashes, 200).collect()) == ["x", "y"]
    assert [r.original for r in store.newest(1).collect()] == ["x"]
    assert store.compact(str(tmp_path / "new"), 2000).rows().count() == 1


def test_rules_run_their_inline_tests(spark):
    content = "[[filters]]\nname = 'a'\nmatch_command = '^a'\nkeep_lines_matching = ['x']\non_empty = 'none'\n[[tests]]\nfilter = 'a'\nname = 't1'\ninput = 'x1\\ny'\nexpected = '''x1\n'''\n[[tests]]\nfilter = 'a'\nname = 't2'\ninput = 'y'\nexpected = 'none'\n[[tests]]\nfilter = 'b'\nname = 't3'\ninput = ''\nexpected = ''\n"
    content = content.replace("input = 'x1\\ny'", 'input = "x1\\ny"')
    assert [(r.name, r.passed) for r in rules.verify(spark, content).orderBy("name").collect()] == [("t1", True), ("t2", True), ("t3", False)]
    with pytest.raises(ValueError, match="unknown keys"):
        rules.load("[[filters]]\nname = 'a'\nmatch_command = 'x'\ncolour = 1")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny"), ("b", "z")], "name string, text string")
    sinks.texts(df, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t" / "name=b")).first().value == "z"
    report = spark.createDataFrame([("ok", 10, 4), ("error", 5, None)], "status string, original_bytes long, compressed_bytes long")
    assert tuple(sinks.totals(report).first()) == (2, 1, 15, 4)
    assert sinks.markdown(report.limit(1)).splitlines()[0] == "| status | original_bytes | compressed_bytes |"
    sinks.append_log(report, str(tmp_path / "log"))
    sinks.append_log(report, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_streams_equal_batches(spark, tmp_path):
    df = spark.createDataFrame([("a", i, f"2024-01-01 0{i % 3}:00:00") for i in range(9)], "filter string, bytes_saved long, t string").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "h.parquet"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "h.parquet"))
    assert [tuple(r) for r in flows.drained(flows.history_totals(stream), str(tmp_path / "h1"), "complete").collect()] == [("a", 9, 36)]
    assert {r.n for r in flows.drained(flows.windowed_totals(stream, "t"), str(tmp_path / "h2"), "append").collect()} <= {3}
    seen = []
    texts = stream.select(F.col("filter").alias("hash"))
    flows.put_stream(texts, lambda d, n: seen.append(d.count()), str(tmp_path / "ck")).awaitTermination()
    assert sum(seen) >= 1


@pytest.mark.parametrize("files", [0, 3])
def test_stream_of_a_table_in_one_file_or_many(spark, tmp_path, files):
    df = spark.createDataFrame([(i, "ab" * i) for i in range(9)], "k long, text string")
    df.repartition(files or 1).write.parquet(str(tmp_path / "made"))
    df.write.parquet(str(tmp_path / "in" / "others.parquet"))
    if files:
        (tmp_path / "made").rename(tmp_path / "in" / "t.parquet")
    else:
        next((tmp_path / "made").glob("part-*.parquet")).rename(tmp_path / "in" / "t.parquet")
    stream = flows.table_stream(spark, str(tmp_path / "in"), "t", df.schema)
    assert sorted(r.bytes for r in flows.drained(flows.sized(stream), str(tmp_path / "out"), "append").collect()) == list(range(0, 18, 2))
