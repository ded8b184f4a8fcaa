"""Diffs: files and hunks as islands of lines, scores, caps, context and noise."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

# Line shapes, weights and names of lock files.
# A plain hunk has two @ on each side and one old range, that of a merge one more for each further parent.
HUNK = r"^(@@+)(?: -\d+(?:,\d+)?)+ \+(\d+)(?:,\d+)? @@"
FILE = r"^diff --(?:git a/.+ b/(.+)|(?:combined|cc) (.+))$"
PRIORITY = [
    r"\b(error|exception|fail(?:ed|ure)?|fatal|critical|crash|panic)\b",
    r"\b(important|note|todo|fixme|hack|xxx|bug|fix)\b",
    r"\b(security|auth|password|secret|token)\b",
]
LOCKFILES = ["Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", "Gemfile.lock", "go.sum", "composer.lock"]
LOCKFILE = r"(^|[/\\])(" + "|".join(x.replace(".", r"\.") for x in LOCKFILES) + ")$"


def _so_far(flag: Column, *partition: str) -> Column:
    return F.sum(flag.cast("int")).over(W.partitionBy("doc_id", *partition).orderBy("pos").rowsBetween(W.unboundedPreceding, 0))


def parsed(lines: DataFrame) -> DataFrame:
    """lines with file_no, hunk_no (0 outside), new_path and kind: add, delete, context, other, header."""
    c = F.col("content")
    d = lines.withColumn("file_no", _so_far(c.rlike(FILE)))
    d = d.withColumn("hunk_no", _so_far(c.rlike(HUNK), "file_no"))
    path = F.concat(F.regexp_extract(c, FILE, 1), F.regexp_extract(c, FILE, 2))
    d = d.withColumn("new_path", F.first(F.when(c.rlike(FILE), path), True).over(W.partitionBy("doc_id", "file_no")))
    outside = (F.col("hunk_no") == 0) | c.rlike(HUNK)
    kind = F.when(outside, "header").when(c.startswith("+"), "add").when(c.startswith("-"), "delete").when(c.startswith(" ") | (c == ""), "context").otherwise("other")
    return d.withColumn("kind", kind)


RANGES = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def unified(lines: DataFrame) -> DataFrame:
    """doc_id, is_diff: whether a text is a unified diff with a hunk: each hunk stands under a pair of file
    lines and has exactly the lines that its header announces. lines: doc_id, pos, content."""
    c, order = F.col("content"), W.partitionBy("doc_id").orderBy("pos")
    d = lines.withColumn("_hunk", _so_far(c.rlike(RANGES)))
    number = lambda k: F.coalesce(F.nullif(F.regexp_extract(c, RANGES, k), F.lit("")).cast("long"), F.lit(1))
    at_hunk = W.partitionBy("doc_id", "_hunk")
    d = d.withColumns({"_is": c.rlike(RANGES), "_a": F.max(F.when(c.rlike(RANGES), number(2))).over(at_hunk), "_b": F.max(F.when(c.rlike(RANGES), number(4))).over(at_hunk)})
    # "+++ b" is a file line behind "--- a", inside a hunk it may be a changed line.
    d = d.withColumn("_file", (c.startswith("+++ ") & F.lag("content").over(order).startswith("--- ")).cast("int"))
    before = at_hunk.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    takes = lambda marks: (~F.col("_is") & (c.rlike(f"^[{marks}]") | (c == ""))).cast("long")
    d = d.withColumns({"_old": takes(" -"), "_new": takes(" +")})
    d = d.withColumns({"_had_old": F.coalesce(F.sum("_old").over(before), F.lit(0)), "_had_new": F.coalesce(F.sum("_new").over(before), F.lit(0)), "_files": F.sum("_file").over(order)})
    inside = (F.col("_hunk") > 0) & ~F.col("_is") & ((F.col("_had_old") < F.col("_a")) | (F.col("_had_new") < F.col("_b")))
    d = d.withColumn("_in", inside).withColumn("_bad", F.col("_in") & ~(c.rlike(r"^[ +\-\\]") | (c == "")))
    counted = lambda name: F.sum(F.when(F.col("_in"), F.col(name)).otherwise(0))
    per = d.filter("_hunk > 0").groupBy("doc_id", "_hunk").agg(F.max("_a").alias("a"), F.max("_b").alias("b"), counted("_old").alias("old"), counted("_new").alias("new"), F.max("_bad").alias("bad"), F.max(F.when(F.col("_is"), F.col("_files"))).alias("files"))
    sound = (F.col("a") == F.col("old")) & (F.col("b") == F.col("new")) & ~F.col("bad") & (F.col("files") > 0)
    good = per.groupBy("doc_id").agg(F.min(sound).alias("sound"))
    return lines.select("doc_id").distinct().join(good, "doc_id", "left").select("doc_id", F.coalesce("sound", F.lit(False)).alias("is_diff"))


def hunks(parts: DataFrame, words: list[str] = ()) -> DataFrame:
    """One row per hunk: header, new_line, additions, deletions, context_lines, score."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") != "header", F.struct("pos", "content")))), lambda x: x["content"]), "\n")
    n = {k: F.count(F.when(F.col("kind") == v, 1)).alias(k) for k, v in (("additions", "add"), ("deletions", "delete"), ("context_lines", "context"))}
    g = parts.filter("hunk_no > 0").groupBy("doc_id", "file_no", "hunk_no").agg(F.first(F.when(F.col("content").rlike(HUNK), F.col("content")), True).alias("header"), *n.values(), F.lower(body).alias("body"))
    score = F.least(F.lit(0.3), (F.col("additions") + F.col("deletions")) * 0.03)
    for w in words:
        if len(w.encode()) > 2:
            score = score + F.when(F.col("body").contains(w.lower()), 0.2).otherwise(0.0)
    score = score + F.when(F.col("body").rlike("|".join(PRIORITY)), 0.3).otherwise(0.0)
    return g.select("doc_id", "file_no", "hunk_no", F.regexp_extract("header", HUNK, 2).cast("long").alias("new_line"), "additions", "deletions", "context_lines", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


def top_files(of: DataFrame, most: int = 20) -> DataFrame:
    """doc_id, file_no, changes, place: the files of most changes, earlier files first among equals."""
    g = of.groupBy("doc_id", "file_no").agg(F.sum(F.col("additions") + F.col("deletions")).alias("changes"))
    return g.withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("changes"), "file_no"))).filter(F.col("place") <= most)


def top_hunks(of: DataFrame, most: int = 10) -> DataFrame:
    """Of each file the first and the last hunk, and the best scored between; in order of the new line."""
    w = W.partitionBy("doc_id", "file_no")
    d = of.withColumns({"_n": F.count(F.lit(1)).over(w), "_at": F.row_number().over(w.orderBy("hunk_no"))})
    rank = F.row_number().over(w.orderBy(F.when(F.col("_at") == 1, 0).when(F.col("_at") == F.col("_n"), 1).otherwise(2), F.desc("score"), "hunk_no"))
    d = d.withColumn("_rank", rank).filter(F.col("_rank") <= most)
    return d.withColumn("place", F.row_number().over(w.orderBy("new_line", "hunk_no"))).drop("_n", "_at", "_rank")


def trimmed_context(parts: DataFrame, reach: int = 2) -> DataFrame:
    """Hunk lines within `reach` lines of a change; a hunk without changes keeps its first lines."""
    d = parts.filter("hunk_no > 0 AND kind <> 'header'")
    w = W.partitionBy("doc_id", "file_no", "hunk_no")
    change = F.col("kind").isin("add", "delete").cast("int")
    d = d.withColumns({"_near": F.max(change).over(w.orderBy("pos").rowsBetween(-reach, reach)), "_any": F.max(change).over(w), "_at": F.row_number().over(w.orderBy("pos"))})
    return d.filter((F.col("_near") == 1) | ((F.col("_any") == 0) & (F.col("_at") <= reach)) | F.col("content").startswith("\\")).select("doc_id", "pos", "content", "kind")


#: HUNK and FILE for re: a dot is no line terminator, and the end may have one behind it.
_DOT, _END = "[^\\n\\r\x85\u2028\u2029]", "(?:\\r\\n|[\\n\\r\x85\u2028\u2029])?\\Z"
_HUNK = re.compile(HUNK.replace(r"\d", "[0-9]"))
_FILE = re.compile(FILE.replace("$", _END).replace(".", _DOT))


def compressed(text: str, reach: int = 2) -> str:
    """A diff's headers, the lines of its hunks that trimmed_context keeps, and a note, as rendering.diff_texts has them."""
    lines = text.split("\n")
    out, adds, deletes, files, n = [], 0, 0, 0, len(lines)
    i, inside = 0, False
    while i < n:
        x = lines[i]
        if (first := x[:1]) == "d" and _FILE.match(x):
            files, inside = files + 1, False
        elif first == "@" and _HUNK.match(x):
            inside = True
        out.append(x)
        i += 1
        if not inside:
            continue
        begin, changes = i, []
        while i < n:
            first = lines[i][:1]
            if first == "+":
                adds += 1
                changes.append(i)
            elif first == "-":
                deletes += 1
                changes.append(i)
            elif (first == "@" and _HUNK.match(lines[i])) or (first == "d" and _FILE.match(lines[i])):
                break
            i += 1
        if not changes:
            out += lines[begin : min(begin + reach, i)]
            begin = min(begin + reach, i)
        for k in changes:
            if k - reach > begin:
                out += [x for x in lines[begin : k - reach] if x[:1] == "\\"]
                begin = k - reach
            end = min(k + reach + 1, i)
            out += lines[begin:end]
            begin = end
        out += [x for x in lines[begin:i] if x[:1] == "\\"]
    return "\n".join(out) + f"\n[{files} files changed, +{adds} -{deletes} lines, {n - len(out)} lines omitted]"


def compressed_texts(texts: DataFrame, text: str = "text", out: str = "out", reach: int = 2) -> DataFrame:
    """texts with the compressed diff of each: a text stays one row, and no line of it is moved."""
    at = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                some = batch.slice(k, 100)
                made = [None if t is None else compressed(t, reach) for t in some.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(made, pa.string())], names=[*some.schema.names, out])

    return texts.mapInArrow(run, texts.withColumn(out, F.lit("")).schema)


def noise(parts: DataFrame) -> DataFrame:
    """One row per file: new_path, lines, bytes, lockfile, whitespace_only (additions equal deletions without white space, in order)."""
    squeezed = F.regexp_replace(F.substring(F.col("content"), 2, 1 << 30), r"\s", "")
    def side(kind):
        return F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", squeezed.alias("s"))))), lambda x: x["s"])

    g = parts.filter("file_no > 0").groupBy("doc_id", "file_no").agg(F.first("new_path").alias("new_path"), F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("content") + 1).alias("bytes"), side("add").alias("adds"), side("delete").alias("subs"))
    return g.select("doc_id", "file_no", "new_path", "lines", "bytes", F.col("new_path").rlike(LOCKFILE).alias("lockfile"), ((F.size("adds") + F.size("subs") > 0) & (F.col("adds") == F.col("subs"))).alias("whitespace_only"))


def diff_bloat(parts: DataFrame, least: int = 50, normal: float = 0.6) -> DataFrame:
    """doc_id, bloat: the share of context lines above the normal one."""
    g = parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") == "context", 1)).alias("context"), F.count(F.when(F.col("kind").isin("add", "delete"), 1)).alias("change"))
    ratio = F.col("context") / F.nullif(F.col("context") + F.col("change"), F.lit(0))
    return g.select("doc_id", F.round(F.when((F.col("n") < least) | ratio.isNull() | (ratio <= normal), 0.0).otherwise(F.least(F.lit(1.0), (ratio - normal) / (1 - normal))), 6).alias("bloat"))
