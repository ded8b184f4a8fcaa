"""Document fingerprints: a canonical exact digest.

A text is canonical after NFKC, full case folding and the folding of every run of white space
to one blank; its fingerprint is the 128-bit xxhash of those UTF-8 bytes. Equal buckets are
compared byte by byte, so two documents are one group only if their canonical bytes agree.

`edit_probe` gives the fingerprint of every text and, by `with_groups`, its group. Digests are
counted first (thin rows, combined in tasks); only texts of buckets of two or more are read
again, and per bucket the least and the greatest canonical bytes are kept (map-side combined:
one row per digest and task leaves the scan, however hot a group is). Where both agree, all
members agree. A bucket whose bytes differ, which takes a 128-bit collision, is parted by a
second digest.

Defined cases: a null text is the empty text; the empty text has the fingerprint of no bytes;
rows that repeat an id are rows like others, ordered by a hash of their text; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .shared import materialize, partitions, text_of


def canonical(text: str) -> bytes:
    """The bytes that a fingerprint digests."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(text.split()).encode()
    return " ".join(text.lower().split()).encode()


def digest(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def second(data: bytes) -> int:
    """A digest that has nothing to do with the first."""
    return xxhash.xxh64_intdigest(data, 7) - (1 << 63)


def likeness(a: bytes, b: bytes, of_a: str, of_b: str) -> float:
    """1 for equal digests whose bytes agree, else 0: an exact digest knows no degrees."""
    return 1.0 if of_a == of_b and a == b else 0.0


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, fingerprint, __mr_second, and the canonical bytes in __mr_bytes."""
    thin = docs.select(F.col(id_column), text_of(text).alias("__mr_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                data = [canonical(t) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([digest(x) for x in data]), pa.array([second(x) for x in data], pa.int64()), pa.array(data, pa.binary())], names=[id_column, "fingerprint", "__mr_second", "__mr_bytes"])

    return thin.mapInArrow(run, f"`{id_column}` {thin.schema[id_column].dataType.simpleString()}, fingerprint string, __mr_second long, __mr_bytes binary")


def with_groups(marked: DataFrame, docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """marked (fingerprint, __mr_second, ...) with group_id, equal only for equal canonical bytes, and group_size."""
    buckets = materialize(marked.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("group_size"), F.min("__mr_second").alias("lo"), F.max("__mr_second").alias("hi")).filter("group_size > 1"), "buckets")
    few = buckets.count() <= BROADCAST_BUCKETS
    known = F.broadcast(buckets) if few else buckets.hint("merge")
    found = fingerprints(docs, id_column, text).join(known.select("fingerprint"), "fingerprint")
    compared = found.groupBy("fingerprint", "__mr_second").agg(F.min("__mr_bytes").alias("lo"), F.max("__mr_bytes").alias("hi"))
    differ = materialize(compared.filter("lo <> hi").select("fingerprint"), "differ")
    if not differ.isEmpty():
        raise ValueError("texts that differ share two digests of 192 bits together")
    parted = buckets.filter("lo <> hi").select("fingerprint")
    out = marked.join(known.select("fingerprint", "group_size", (F.col("lo") != F.col("hi")).alias("__mr_parted")), "fingerprint", "left")
    out = out.withColumns({"group_id": F.when(F.col("__mr_parted"), F.concat_ws("-", "fingerprint", F.hex("__mr_second"))).otherwise(F.col("fingerprint")), "group_size": F.coalesce("group_size", F.lit(1))}).drop("__mr_parted")
    if parted.isEmpty():
        return out
    sizes = out.join(parted, "fingerprint").groupBy("group_id").agg(F.count(F.lit(1)).alias("__mr_size"))
    return out.join(sizes, "group_id", "left").withColumn("group_size", F.coalesce("__mr_size", "group_size")).drop("__mr_size")


def groups(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, fingerprint, group_id, group_size."""
    marked = materialize(fingerprints(docs, id_column, text).drop("__mr_bytes"), "marks")
    return with_groups(marked, docs, id_column, text).select(id_column, "fingerprint", "group_id", "group_size")


def edited(own: str, following: str) -> str:
    """own with its last floor(n/2) code points replaced by the first as many of the following text."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, __mr_second long"
_KINDS = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
#: Up to so many digests of two or more texts (about 60 bytes each) are broadcast.
BROADCAST_BUCKETS = 200_000


def _rows(ids: list, texts: list[str], following: list[str]) -> list[tuple]:
    """Result columns for texts and the texts that follow them."""
    data = [canonical(t) for t in texts]
    marks = [digest(x) for x in data]
    out = []
    for i, (own, nxt) in enumerate(zip(texts, following, strict=True)):
        changed = edited(own, nxt)
        c = canonical(changed)
        f = digest(c)
        other, of_other = (data[i + 1], marks[i + 1]) if i + 1 < len(data) and nxt is texts[i + 1] else ((x := canonical(nxt)), digest(x))
        out.append((ids[i], len(own), hashlib.sha256(changed.encode()).hexdigest(), marks[i], f, likeness(data[i], c, marks[i], f), likeness(data[i], other, marks[i], of_other), second(data[i])))
    return out


def _batch(rows: list, names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def edit_probe(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The fingerprint of each text, its group, the fingerprint of its edited text, and their likeness.

    The next document of a row follows it in descending id (nulls last, equal ids by a hash of
    the text). Texts move once, dealt by ranges of id and hash; a task holds two rows at a time. The last row
    of a range needs the first row of the next range: both are set aside, and the pairs (one
    per range) are completed afterwards.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_column].dataType.simpleString()
    order = [F.col(id_column).desc_nulls_last(), F.xxhash64("__mr_text")]
    dealt = docs.select(F.col(id_column), text_of(text).alias("__mr_text")).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    names = [id_column, *(x.split()[0] for x in _RESULT.split(", ")), "__mr_part", "__mr_head", "__mr_tail"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, head, last, kinds = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            kinds = kinds or [batch.schema.types[0], *_KINDS, pa.int32(), pa.string(), pa.string()]
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                ids, texts = some.column(0).to_pylist(), some.column(1).to_pylist()
                head = texts[0] if head is None else head
                if last is not None:
                    ids, texts = [last[0], *ids], [last[1], *texts]
                last = (ids[-1], texts[-1])
                if len(ids) > 1:
                    yield _batch([(*r, part, None, None) for r in _rows(ids[:-1], texts[:-1], texts[1:])], names, kinds)
        if last is not None:
            yield _batch([(last[0], *[None] * len(_KINDS), part, head, last[1])], names, kinds)

    table = materialize(dealt.mapInArrow(run, f"`{id_column}` {kind}, {_RESULT}, __mr_part int, __mr_head string, __mr_tail string"), "edits")
    done = table.filter(F.col("__mr_tail").isNull()).select(names[:8])
    ends = table.filter(F.col("__mr_tail").isNotNull())
    # One number per range decides which range follows; the last one is followed by the first.
    ring = ends.select("__mr_part").withColumns({"n": F.lead("__mr_part").over(W.orderBy("__mr_part")), "first": F.min("__mr_part").over(W.partitionBy())}).select("__mr_part", F.coalesce("n", "first").alias("__mr_next"))
    heads = ends.select(F.col("__mr_part").alias("__mr_next"), F.col("__mr_head").alias("__mr_follows"))
    pairs = ends.select(id_column, "__mr_part", "__mr_tail").join(ring, "__mr_part").join(heads, "__mr_next").select(id_column, "__mr_tail", "__mr_follows")

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, following = (c.to_pylist() for c in batch.columns)
            rows = [_rows([i], [t], [f])[0] for i, t, f in zip(ids, texts, following, strict=True)]
            yield _batch(rows, names[:8], [batch.schema.types[0], *_KINDS])

    ended = materialize(pairs.mapInArrow(complete, f"`{id_column}` {kind}, {_RESULT}"), "ends")
    return with_groups(done.unionByName(ended), docs, id_column, text).select(*names[:7], "group_id", "group_size")
