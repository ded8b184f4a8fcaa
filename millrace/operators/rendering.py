"""Selected matches and hunks as text again, signals in tiers, marked blocks in files, and observed counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.text import key

SURE = 0.7


def joined(df: DataFrame, group: list[str], order: list[str], text: str, name: str, *more: Column) -> DataFrame:
    """The texts of each group, in order, one per line; and other aggregates."""
    return df.groupBy(*group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text))), lambda x: x[text]), "\n").alias(name), *more)


def search_texts(selected: DataFrame, matches: DataFrame) -> DataFrame:
    """doc_id, text: `file:line:text` of the kept matches, files by name, and behind each file how many more it has."""
    kept = selected.withColumn("line", F.concat_ws(":", "file", F.col("line_number").cast("string"), "text"))
    files = joined(kept, ["doc_id", "file"], ["line_number"], "line", "body", F.count(F.lit(1)).alias("shown"))
    every = matches.groupBy("doc_id", "file").agg(F.count(F.lit(1)).alias("n"))
    d = files.join(every, ["doc_id", "file"]).withColumn("more", F.col("n") - F.col("shown"))
    d = d.withColumn("part", F.concat("body", F.when(F.col("more") > 0, F.concat(F.lit("\n[... and "), F.col("more").cast("string"), F.lit(" more matches in "), "file", F.lit("]"))).otherwise("")))
    return joined(d, ["doc_id"], ["file"], "part", "text")


def diff_texts(parts: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, text: headers and the kept lines of hunks, and a last line with files, additions, deletions and lines left out."""
    lines = parts.filter("kind = 'header'").select("doc_id", "pos", "content").unionByName(kept.select("doc_id", "pos", "content"))
    body = joined(lines, ["doc_id"], ["pos"], "content", "body")
    n = parts.groupBy("doc_id").agg(F.max("file_no").alias("files"), F.count(F.when(F.col("kind") == "add", 1)).alias("a"), F.count(F.when(F.col("kind") == "delete", 1)).alias("d"), F.count(F.lit(1)).alias("all"))
    shown = lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("shown"))
    j = body.join(n, "doc_id").join(shown, "doc_id")
    note = F.format_string("\n[%d files changed, +%d -%d lines, %d lines omitted]", F.col("files").cast("long"), "a", "d", F.col("all") - F.col("shown"))
    return j.select("doc_id", F.concat("body", note).alias("text"))


def stored_key(original: Column, compressed: Column, size: Column, least: int, ratio: float = 0.8) -> Column:
    """The store's key of an original that has `least` entries and compresses below the ratio, else null."""
    pays = F.octet_length(compressed) / F.greatest(F.octet_length(original), F.lit(1)) < ratio
    return F.when((size >= least) & pays, key(original, "payload"))


def with_omitted(text: Column, omitted: Column, what: str = "lines") -> Column:
    """A text and a last line that says how much of it is left out."""
    return F.when(omitted > 0, F.concat(text, F.lit("\n[... "), omitted.cast("string"), F.lit(f" {what} omitted]"))).otherwise(text)


def diff_stats(parts: DataFrame, kept: DataFrame) -> DataFrame:
    """doc_id, files, hunks, additions, deletions, lines, kept_lines, kept_hunks: what a compressed diff has of the whole."""
    whole = parts.groupBy("doc_id").agg(
        F.max("file_no").alias("files"),
        F.count_distinct(F.when(F.col("hunk_no") > 0, F.struct("file_no", "hunk_no"))).alias("hunks"),
        F.count(F.when(F.col("kind") == "add", 1)).alias("additions"),
        F.count(F.when(F.col("kind") == "delete", 1)).alias("deletions"),
        F.count(F.lit(1)).alias("lines"),
    )
    some = kept.groupBy("doc_id").agg(F.count(F.lit(1)).alias("kept_lines"), F.count_distinct("file_no", "hunk_no").alias("kept_hunks"))
    return whole.join(some, "doc_id", "left").na.fill(0, ["kept_lines", "kept_hunks"])


def tiered(signals: list[tuple[Column, Column]]) -> Column:
    """Of (value, confidence) pairs the first that is sure, else the most confident one."""
    sure, best = None, None
    for value, confidence in signals:
        sure = F.when(confidence >= SURE, value) if sure is None else sure.when(confidence >= SURE, value)
    for k, (value, confidence) in enumerate(signals):
        pair = F.struct(confidence.alias("c"), F.lit(-k).alias("k"), value.alias("v"))
        best = pair if best is None else F.greatest(best, pair)
    return sure.otherwise(best["v"])


def with_block(text: Column, begin: str, end: str, block: str | None) -> Column:
    """A text in which the lines from begin to end are the block, added at the end if they are not there; None removes them."""
    at, stop = F.instr(text, begin), F.locate(end, text)
    found = (at > 0) & (stop > at)
    before, after = F.substring(text, F.lit(1), at - 1), F.substring(text, stop + len(end), F.char_length(text))
    if block is None:
        return F.when(found, F.concat(F.rtrim(before), after)).otherwise(text)
    made = f"{begin}\n{block}\n{end}"
    return F.when(found, F.concat(before, F.lit(made), after)).otherwise(F.concat(text, F.lit("\n" + made + "\n")))


def observed(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, Observation]:
    """df with counts that are taken while it runs, and where to read them."""
    seen = Observation(name)
    return df.observe(seen, *[c.alias(k) for k, c in counts.items()]), seen
