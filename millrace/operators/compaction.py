"""Lossless tables of arrays of dicts: a schema line, then a CSV row or a key-value block per item.

Input: the long form (array_id, idx, field, kind, str, num); an absent field is a missing row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import key, opaque_kind

CORE, HETEROGENEOUS, BUCKETS, MOST_DISTINCT = 0.8, 0.6, (2, 8), 0.7


def schemas(cells: DataFrame) -> DataFrame:
    """One row per array and field: freq, nullable, type_tag, place (by frequency, then name)."""
    n = cells.groupBy("array_id").agg(F.count_distinct("idx").alias("n_items"))
    whole = F.col("num") == F.floor("num")
    tag = F.when(F.count("str") > 0, "string").when(F.count("num") == 0, "string").when(F.min(F.when(F.col("num").isNotNull(), whole)), "int").otherwise("float")
    g = cells.groupBy("array_id", "field").agg(F.count(F.lit(1)).alias("freq"), F.count(F.when(F.col("str").isNull() & F.col("num").isNull(), 1)).alias("nulls"), tag.alias("type_tag"))
    d = g.join(n, "array_id")
    from pyspark.sql.window import Window as W

    place = F.row_number().over(W.partitionBy("array_id").orderBy(F.desc("freq"), "field"))
    return d.select("array_id", "field", "freq", ((F.col("freq") < F.col("n_items")) | (F.col("nulls") > 0)).alias("nullable"), "type_tag", place.alias("place"), "n_items")


def discriminators(cells: DataFrame) -> DataFrame:
    """array_id, field, buckets: the text field of every item with the most of 2 to 8 values; first name among equals."""
    from pyspark.sql.window import Window as W

    n = cells.groupBy("array_id").agg(F.count_distinct("idx").alias("n_items"))
    g = cells.groupBy("array_id", "field").agg(F.count("str").alias("texts"), F.count_distinct("str").alias("buckets")).join(n, "array_id")
    d = g.filter((F.col("texts") == F.col("n_items")) & F.col("buckets").between(*BUCKETS) & (F.col("buckets") / F.col("n_items") <= MOST_DISTINCT))
    return d.withColumn("_k", F.row_number().over(W.partitionBy("array_id").orderBy(F.desc("buckets"), "field"))).filter("_k = 1").select("array_id", "field", "buckets")


def number_text(num: Column) -> Column:
    return F.when(num == F.floor(num), num.cast("long").cast("string")).otherwise(num.cast("decimal(18,2)").cast("string"))


def csv_cell(cell: Column) -> Column:
    """Quoted only where a comma, a quote or a line break asks for it; null is empty."""
    return F.when(cell.isNull(), "").when(cell.rlike("[,\"\\n\\r]"), F.concat(F.lit('"'), F.replace(cell, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(cell)


def _header(schema: DataFrame) -> DataFrame:
    spec = F.concat("field", F.lit(":"), "type_tag", F.when(F.col("nullable"), "?").otherwise(""))
    return schema.groupBy("array_id").agg(F.first("n_items").alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", spec.alias("s")))), lambda x: x["s"]), ",").alias("spec")).select("array_id", F.concat(F.lit("["), F.col("n_items").cast("string"), F.lit("]{"), "spec", F.lit("}\n")).alias("header"))


def _rendered(cells: DataFrame, schema: DataFrame, cell: Column, glue: str, end: str) -> DataFrame:
    d = cells.withColumn("cell", cell).join(schema.select("array_id", "field", "place"), ["array_id", "field"])
    rows = d.groupBy("array_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "cell"))), lambda x: x["cell"]), glue).alias("line"))
    body = rows.groupBy("array_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: F.concat(x["line"], F.lit(end))), "").alias("body"))
    return _header(schema).join(body, "array_id").select("array_id", F.concat("header", "body").alias("text"))


def csv_tables(cells: DataFrame) -> DataFrame:
    """array_id, text: `[N]{name:type,...}` and one CSV row per item. Items have all fields here."""
    return _rendered(cells, schemas(cells), csv_cell(F.coalesce("str", number_text(F.col("num")))), ",", "\n")


def kv_tables(cells: DataFrame) -> DataFrame:
    """array_id, text: `[N]{name:type,...}` and a `- name: value` block per item."""
    value = F.coalesce("str", number_text(F.col("num")), F.lit("null"))
    schema = schemas(cells)
    shown = F.concat("field", F.lit(": "), value)
    d = _rendered(cells, schema, shown, "\n  ", "\n")
    return d.select("array_id", F.concat(F.substring_index("text", "\n", 1), F.lit("\n"), F.regexp_replace(F.expr("substring(text, instr(text, '\n') + 1)"), r"(?m)^(?=[^ \n])", "- ")).alias("text"))


def json_tables(cells: DataFrame) -> DataFrame:
    """array_id, text: one JSON object per array, with its schema and its rows as arrays in the order
    of the schema. An absent field and a null are null; an opaque text is an object that names its hash."""
    inside = lambda c: F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1)
    kind = opaque_kind(F.col("str"))
    opaque = F.concat(F.lit('{"_ccr":"'), key(F.col("str"), "row"), F.lit('","_size":'), F.octet_length("str").cast("string"), F.lit(',"_kind":"'), kind, F.lit('"}'))
    value = F.when(kind.isNotNull(), opaque).when(F.col("str").isNotNull(), inside(F.col("str"))).when(F.col("num").isNotNull(), number_text(F.col("num"))).otherwise("null")
    spec = F.concat(F.lit('{"name":'), inside(F.col("field")), F.lit(',"type":"'), "type_tag", F.when(F.col("nullable"), '","nullable":true}').otherwise('"}'))
    ordered = lambda *names: F.array_sort(F.collect_list(F.struct(*names)))
    head = schemas(cells).groupBy("array_id").agg(F.first("n_items").cast("string").alias("n"), ordered("place", "field", spec.alias("spec")).alias("fields"))
    items = cells.groupBy("array_id", "idx").agg(F.map_from_entries(F.collect_list(F.struct("field", value.alias("value")))).alias("found"))
    row = F.concat(F.lit("["), F.array_join(F.transform("fields", lambda f: F.coalesce(F.try_element_at("found", f["field"]), F.lit("null"))), ","), F.lit("]"))
    body = items.join(head, "array_id").groupBy("array_id").agg(F.first("n").alias("n"), F.first("fields").alias("fields"), ordered("idx", row.alias("row")).alias("rows"))
    listed = lambda c, name: F.array_join(F.transform(c, lambda x: x[name]), ",")
    return body.select("array_id", F.concat(F.lit('{"_compaction":"table","_schema":['), listed("fields", "spec"), F.lit('],"_kept":'), "n", F.lit(',"_total":'), "n", F.lit(',"_rows":['), listed("rows", "row"), F.lit("]}")).alias("text"))


def savings(cells: DataFrame, original: DataFrame) -> DataFrame:
    """array_id, saved: the share of bytes a table saves over the original (array_id, text)."""
    t = csv_tables(cells).withColumnRenamed("text", "table_text")
    j = original.join(t, "array_id")
    return j.select("array_id", F.greatest(F.lit(0.0), 1 - F.octet_length("table_text") / F.octet_length("text")).alias("saved"))
