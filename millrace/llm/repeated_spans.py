"""Suffix-array dedup: bytes that lie in a string of LENGTH bytes which starts twice are removed.

A suffix array over all positions is not needed for strings of one length. Every window of
LENGTH bytes has an anchor, the leftmost least hash of its GRAM-byte strings; it depends on
the window's bytes alone, so equal windows have their anchors at equal places and only the
suffixes at anchors (about one in (LENGTH - GRAM) / 2 positions) have to be sorted.

1. Equal texts become one row with their number, in a table bucketed by the text's hash: later
   joins of texts move no text. A text of LENGTH bytes or more that occurs twice goes wholly.
2. A task yields one row per anchor run (the windows that share an anchor): the hash of the
   anchor's string, of the whole context, and the place. Contexts a task has met twice are
   settled in it and send on one row, so a hot passage leaves a task once.
3. Rows are dealt by anchor hash and streamed in order. A context that occurs twice is
   repeated as a whole. Distinct contexts of one anchor go on as candidates. Rows of an anchor
   that many texts share are dealt by anchor and context, and all of them go on; a sample of
   SAMPLE texts tells which anchors those are, which only decides where rows meet.
4. Candidates fetch their bytes. The suffixes at an anchor are sorted deep-shallow to the
   right, the reversed prefixes to the left, and every window is compared with its best
   partner (suffixes.repeats). A task holds GROUP contexts of an anchor at most. Where more
   share one, they are split by their letters: windows that begin between l and l + STEP bytes
   before the anchor can only be equal if the contexts agree in the l bytes before it and in
   the length - l - STEP bytes from it on, so contexts that agree there are groups of their
   own, sorted like others. Groups that are too many even then (texts that share a string of
   180 to 199 bytes and no more) have their windows of that range counted by 128-bit hash,
   an exact way on plain aggregates.
5. The covered ranges meet their texts again and are cut out.

Strings are judged on the input: both copies of a repeated string go. Matches never cross
documents; in one document a string may repeat, overlapping itself too.

Defined cases: a null text is the empty text, which stays; a text below LENGTH bytes stays;
rows that repeat an id are rows like others (two rows of one text are two occurrences); an
empty table gives an empty result. `remove_repeats` decodes what is left and drops a character
whose bytes were cut apart; a removed null text stays null; other columns pass through.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WRITTEN, materialize, partitions, text_of, work_dir
from .suffixes import repeats

LENGTH, GRAM = 200, 40
#: Distinct contexts of one anchor that are sorted together (about 300 bytes each), and the
#: bytes by which the windows of more are told apart.
GROUP, STEP = 2_000, 20
#: Texts in which anchors that many texts share are looked for, and the share that makes many.
SAMPLE, SHARED = 5_000, 0.004
#: Positions that are hashed at once, and anchors that a task gathers before it sends them on.
CHUNK, GATHERED = 1 << 19, 500_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the gram bytes (a multiple of 8) from each position on."""
    n = len(data) - gram + 1
    words = np.ndarray(len(data) - 7, "<u8", data.tobytes(), 0, (1,)).copy()
    words *= _C[0]
    words ^= words >> np.uint64(29)
    out = np.zeros(n, np.uint64)
    for k in range(gram // 8):
        out += words[8 * k : 8 * k + n] * _C[1 + k % 5]
        out ^= out >> np.uint64(31)
        out *= _C[3]
    return out ^ (out >> np.uint64(32))


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first start, last start, anchor, hash) of each run of windows that share an anchor."""
    found = [_runs(part, length, gram) for part in _parts(texts, length)]
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _parts(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Pieces (text, offset, bytes), about CHUNK bytes at a time; long texts are cut so that
    every window lies in one piece."""
    part, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(0, len(t) - length + 1), CHUNK):
            piece = t[at : at + CHUNK + length - 1]
            part.append((i, at, piece))
            size += len(piece)
            if size >= CHUNK:
                yield part
                part, size = [], 0
    if part:
        yield part


def _runs(part: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, ...]:
    h = _gram_hashes(np.frombuffer(b"".join(p[2] for p in part), np.uint8), gram)
    width = length - gram + 1
    bits = np.uint64(24)
    low = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = width - span
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    sizes = np.array([len(p[2]) for p in part], np.int64)
    begin = np.cumsum(sizes) - sizes
    windows = sizes - length + 1
    of = np.repeat(np.arange(len(part)), windows)
    start = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows) + begin[of]
    place = (low[start] & np.uint64((1 << 24) - 1)).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])]))
    last = np.concatenate([new[1:], [len(of)]]) - 1
    piece = of[new]
    shift = np.array([p[1] for p in part], np.int64)[piece] - begin[piece]
    return np.array([p[0] for p in part], np.int64)[piece], start[new] + shift, start[last] + shift, place[new] + shift, h[place[new]]


def _text_table(docs: DataFrame, text: str) -> DataFrame:
    """(a, b, copies, n_bytes, text) of the distinct texts, bucketed by (a, b)."""
    spark = docs.sparkSession
    name = f"millrace_texts_{uuid.uuid4().hex}"
    distinct = docs.select(*_key(text), text_of(text).alias("text")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("copies"), F.first("text").alias("text"))
    table = distinct.select("a", "b", "copies", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    path = f"{work_dir(spark)}/{name}"
    WRITTEN[path] = spark
    table.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), "a", "b").saveAsTable(name)
    return spark.table(name)


def drop_tables(spark) -> None:
    """Forget the bucketed tables whose files shared.sweep has deleted."""
    stand = {path.rpartition("/")[2] for path in WRITTEN}
    for t in spark.catalog.listTables():
        if t.name.startswith("millrace_texts_") and t.name not in stand:
            spark.sql(f"DROP TABLE {t.name}")


def _key(text: str):
    return F.xxhash64(text_of(text)).alias("a"), F.xxhash64(F.lit("millrace"), text_of(text)).alias("b")


_ROW = "g long, c long, n long, a long, b long, place long"
_PLACE = 9  # bits each for the first and the last start, counted from the anchor


def _packed(first: np.ndarray, last: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    return anchor << 2 * _PLACE | (anchor - first) << _PLACE | (last - first)


def _unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor)"""
    anchor, mask = place >> 2 * _PLACE, (1 << _PLACE) - 1
    first = anchor - (place >> _PLACE & mask)
    return first, first + (place & mask), anchor


def _anchor_rows(length: int, gram: int, shared: np.ndarray):
    """Anchor rows of a task. n = 0 marks a range that is settled: `place` is then the start
    and c the end of the range. n < 0 marks -n rows of an anchor that many texts share."""

    def sent(columns: list[list[np.ndarray]]) -> pa.RecordBatch:
        g, c, n, a, b, place = (np.concatenate(x) for x in columns)
        order = np.lexsort((c, g))
        g, c, n, a, b, place = (x[order] for x in (g, c, n, a, b, place))
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (c[1:] != c[:-1])])
        group = np.cumsum(new) - 1
        total = np.bincount(group, n, group[-1] + 1).astype(np.int64)
        heads = np.flatnonzero(new)
        first, last, _ = _unpacked(place)
        settled = np.flatnonzero(total[group] > 1)
        # Settled ranges are spread by their text; they only pass through.
        cols = [
            np.concatenate([g[heads], a[settled] ^ np.arange(len(settled))]),
            np.concatenate([c[heads], last[settled] + length]),
            np.concatenate([np.where(np.isin(g[heads], shared), -total, total), np.zeros(len(settled), np.int64)]),
            np.concatenate([a[heads], a[settled]]),
            np.concatenate([b[heads], b[settled]]),
            np.concatenate([place[heads], first[settled]]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["g", "c", "n", "a", "b", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns, held = [[] for _ in range(6)], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                a, b, copies = (some.column(i).to_numpy() for i in range(3))
                texts = [t.encode() for t in some.column(3).to_pylist()]
                of, first, last, anchor, h = anchors(texts, length, gram)
                whole = xxhash.xxh3_64_intdigest
                seed = (anchor - first).tolist()
                c = np.fromiter((whole(texts[i][x : y + length], s) for i, x, y, s in zip(of.tolist(), first.tolist(), last.tolist(), seed, strict=True)), np.uint64, len(of))
                for column, x in zip(columns, (h.astype(np.int64), c.astype(np.int64), copies[of], a[of], b[of], _packed(first, last, anchor)), strict=True):
                    column.append(x)
                held += len(of)
                if held > GATHERED:
                    yield sent(columns)
                    columns, held = [[] for _ in range(6)], 0
        if held:
            yield sent(columns)

    return run


def _settle(length: int):
    """Streams anchor rows in the order (g, c); a row is decided by the rows on either side.
    Out: ranges (kind 0: x = start, y = end) and candidates (kind 1: x = place, y = 1 if the
    context is settled as a whole). Of a run of equal contexts its ends are candidates."""

    def decided(rows: np.ndarray, begin: int, end: int) -> pa.RecordBatch:
        """Rows begin..end-1 of rows."""
        g, c, n, a, b, place = rows
        near = np.concatenate([[False], (g[1:] == g[:-1]) & (n[1:] != 0) & (n[:-1] != 0), [False]])
        equal = near & np.concatenate([[False], c[1:] == c[:-1], [False]])
        twice = equal[:-1] | equal[1:] | (abs(n) > 1)
        # Contexts of a shared anchor may be anywhere: all of them go on, of equal ones the first.
        other = np.where(n < 0, ~equal[:-1], (near & ~equal)[:-1] | (near & ~equal)[1:])
        at = np.zeros(len(g), bool)
        at[begin:end] = True
        passed = np.flatnonzero(at & (n == 0))
        ranges = np.flatnonzero(at & twice & (abs(n) == 1))  # with more the task has sent the range
        goes = np.flatnonzero(at & other & (n != 0))
        first, last, _ = _unpacked(place[ranges])
        cols = [
            np.repeat([0, 1], [len(passed) + len(ranges), len(goes)]),
            np.concatenate([g[passed], g[ranges], g[goes]]),
            np.concatenate([a[passed], a[ranges], a[goes]]),
            np.concatenate([b[passed], b[ranges], b[goes]]),
            np.concatenate([place[passed], first, place[goes]]),
            np.concatenate([c[passed], last + length, twice[goes].astype(np.int64)]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["kind", "g", "a", "b", "x", "y"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, begin = np.zeros((6, 0), np.int64), 0
        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(i).to_numpy() for i in range(6)])], axis=1)
            if rows.shape[1] > begin + 1:
                yield decided(rows, begin, rows.shape[1] - 1)
                rows, begin = rows[:, -2:], 1
            held = rows
        if held.shape[1] > begin:
            yield decided(held, begin, held.shape[1])

    return run


_FOUND = "a long, b long, x long, y long"


def _rows_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in cols], names=names)


def _compare(length: int):
    """Streams contexts in the order of g. Out: ranges (x = start, y = end)."""

    def solved(group: list[tuple]) -> list[tuple]:
        lefts = [data[:left][::-1] for *_, left, data in group]
        rights = [data[left:] for *_, left, data in group]
        out = []
        for (a, b, start, settled, left, _), ranges in zip(group, repeats(lefts, rights, length), strict=True):
            if not settled:
                anchor = start + left
                out.extend((a, b, anchor - high, anchor - low + length) for low, high in ranges)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in batches:
            for g, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != key:
                    if len(group) > 1:
                        out.extend(solved(group))
                    key, group = g, []
                    if len(out) > 50_000:
                        yield _rows_of(out, ["a", "b", "x", "y"])
                        out = []
                group.append(tuple(rest))
        if len(group) > 1:
            out.extend(solved(group))
        if out:
            yield _rows_of(out, ["a", "b", "x", "y"])

    return run


def _windows(length: int):
    """The windows of contexts that begin low to high bytes before the anchor: x = start, settled, w1 and w2 = hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                out = []
                for low, high, a, b, start, settled, left, data in zip(*(c.to_pylist() for c in batch.slice(at, 1_000).columns), strict=True):
                    for i in range(max(0, left - high), min(left - low, len(data) - length) + 1):
                        w = xxhash.xxh3_128_digest(data[i : i + length])
                        out.append((a, b, start + i, settled, int.from_bytes(w[:8], "little", signed=True), int.from_bytes(w[8:], "little", signed=True)))
                yield _rows_of(out, ["a", "b", "x", "settled", "w1", "w2"])

    return run


def _shared_anchors(texts: DataFrame, length: int, gram: int) -> np.ndarray:
    """The anchors that many of SAMPLE texts have: at most the anchors of so many texts times 1 / SHARED, over their number."""
    n = texts.count()
    if not n:
        return np.zeros(0, np.int64)
    some = texts.filter(F.pmod("a", F.lit(1 << 20)) < min(1.0, SAMPLE / n) * (1 << 20))
    rows = some.select("a", "b", "copies", "text").mapInArrow(_anchor_rows(length, gram, np.zeros(0, np.int64)), _ROW)
    counts = rows.filter("n > 0").groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= max(16, SHARED * min(n, SAMPLE)))
    return np.sort(np.array([r.g for r in counts.select("g").collect()], np.int64))


def _split(contexts: DataFrame, many: DataFrame, length: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """(groups that a task can sort, ranges found by counting windows) for the contexts of anchors with more than GROUP."""
    size = F.length("context")
    more = size - length
    pieces = []
    for low in range(0, length - gram + 1, STEP):
        high = min(low + STEP - 1, length - gram)
        inside = (F.lit(low) <= F.col("left")) & (F.lit(high) >= F.col("left") - more)
        string = F.substring("context", F.col("left") - low + 1, F.lit(low + length - high))
        pieces.append(F.when(inside, F.struct(F.xxhash64("g", F.lit(low), string).alias("key"), F.lit(low).alias("low"), F.lit(high).alias("high"))))
    parts = materialize(contexts.join(F.broadcast(many), "g").withColumn("p", F.explode(F.array_compact(F.array(*pieces)))).select("p.*", "a", "b", "start", "settled", "left", "context"), "pieces")
    sizes = materialize(parts.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"), "piece_sizes")
    met = parts.join(sizes.hint("merge"), "key")
    fine = met.filter(F.col("c") <= GROUP).select(F.col("key").alias("g"), "a", "b", "start", "settled", "left", "context")
    windows = met.filter(F.col("c") > GROUP).select("low", "high", "a", "b", "start", "settled", "left", "context").mapInArrow(_windows(length), "a long, b long, x long, settled long, w1 long, w2 long")
    counted = materialize(windows, "windows")
    twice = materialize(counted.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("w1", "w2"), "twice")
    return fine, counted.filter("settled = 0").join(twice.hint("merge"), ["w1", "w2"]).select("a", "b", "x", (F.col("x") + length).alias("y"))


def covered(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(distinct texts: a, b, copies, n_bytes, text; covered ranges: a, b, spans (array of start, end), not merged)."""
    if gram % 8 or not 8 <= gram <= length < 1 << _PLACE:
        raise ValueError("gram has to be a multiple of 8 and at most length, length below 512")
    spark = docs.sparkSession
    parts = partitions(spark)
    texts = _text_table(docs, text)
    long = texts.filter(F.col("n_bytes") >= length)
    rows = long.select("a", "b", "copies", "text").mapInArrow(_anchor_rows(length, gram, _shared_anchors(long, length, gram)), _ROW)
    spread = F.when(F.col("n") < 0, F.xxhash64("g", "c")).otherwise(F.col("g"))
    settled = materialize(rows.repartition(parts, spread).sortWithinPartitions("g", "c").mapInArrow(_settle(length), "kind long, g long, a long, b long, x long, y long"), "settled")
    # A text's candidates are fewer than its anchors, so they fit beside the text.
    wanted = settled.filter("kind = 1").groupBy("a", "b").agg(F.collect_list(F.struct("g", "x", "y")).alias("wanted"))
    cut = texts.select("a", "b", F.col("text").cast("binary").alias("data")).join(wanted.hint("shuffle_hash"), ["a", "b"])
    mask = (1 << _PLACE) - 1
    anchor, left, more = (lambda x: F.shiftright(x, 2 * _PLACE)), (lambda x: F.shiftright(x, _PLACE).bitwiseAND(mask)), (lambda x: x.bitwiseAND(mask))
    contexts = cut.select(
        "a",
        "b",
        F.explode(
            F.transform(
                "wanted",
                lambda w: F.struct(w["g"].alias("g"), (anchor(w["x"]) - left(w["x"])).alias("start"), w["y"].alias("settled"), left(w["x"]).alias("left"), F.substring("data", (anchor(w["x"]) - left(w["x"]) + 1).cast("int"), (more(w["x"]) + length).cast("int")).alias("context")),
            )
        ).alias("w"),
    ).select("w.g", "a", "b", "w.start", "w.settled", "w.left", "w.context")
    # Anchors with more contexts than a task sorts; so few of all candidates that they can be broadcast.
    sizes = settled.filter("kind = 1").groupBy("g").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > GROUP)
    many = materialize(sizes.select("g"), "many")
    ranges = settled.filter("kind = 0").select("a", "b", "x", "y")
    if not many.isEmpty():
        fine, counted = _split(contexts, many, length, gram)
        contexts = contexts.join(F.broadcast(many), "g", "left_anti").unionByName(fine)
        ranges = ranges.unionByName(counted)
    found = materialize(contexts.repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_compare(length), _FOUND), "found")
    ranges = ranges.unionByName(found)
    return texts, ranges.groupBy("a", "b").agg(F.collect_list(F.struct("x", "y")).alias("spans"))


def merged(spans: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of (start, end) rows that touch or overlap."""
    out: list[list[int]] = []
    for start, end in sorted(map(tuple, spans.tolist())):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


def _joined(docs: DataFrame, text: str, length: int, gram: int) -> DataFrame:
    """docs without its text, with __mr_bytes, __mr_whole (all of it goes), __mr_spans and __mr_text (null where whole)."""
    texts, spans = covered(docs, text, length, gram)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    held = texts.join(spans.hint("shuffle_hash"), ["a", "b"], "left").select(
        F.col("a").alias("__mr_ha"), F.col("b").alias("__mr_hb"), F.col("n_bytes").alias("__mr_bytes"), whole.alias("__mr_whole"), F.when(~whole, F.col("spans")).alias("__mr_spans"), F.when(~whole, F.col("text")).alias("__mr_text")
    )
    a, b = _key(text)
    thin = docs.withColumns({"__mr_a": a, "__mr_b": b, "__mr_null": F.col(text).isNull()}).drop(text)
    return thin.join(held, (thin["__mr_a"] == held["__mr_ha"]) & (thin["__mr_b"] == held["__mr_hb"]))


def _cut(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for start, end in spans:
        kept.append(data[at:start])
        at = end
    return b"".join([*kept, data[at:]])


def _spans_of(spans) -> list[tuple[int, int]]:
    return merged(np.array([(s["x"], s["y"]) for s in spans], np.int64).reshape(-1, 2)) if spans is not None and len(spans) else []


def repeat_digest(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of every row."""
    found = _joined(docs.select(id_column, text), text, length, gram)

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans, strict=True):
            cut = _spans_of(s)
            kept = _cut((t or "").encode(), cut)
            rows.append((sum(y - x for x, y in cut), len(cut), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept_sha256"])

    nothing = F.struct(F.col("__mr_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256().hexdigest()).alias("kept_sha256"))
    made = found.withColumn("__mr_digest", digest("__mr_text", "__mr_spans"))
    made = made.withColumn("__mr_digest", F.when(F.col("__mr_whole"), nothing).otherwise(F.col("__mr_digest")))
    return made.select(id_column, F.col("__mr_bytes").alias("n_bytes"), *[F.col(f"__mr_digest.{c}").alias(c) for c in ("n_removed", "n_spans", "kept_sha256")])


def remove_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, chars: str | None = "n_chars") -> DataFrame:
    """docs with the repeated bytes cut out of the text; the column `chars`, if docs has it, is counted anew."""
    found = _joined(docs, text, length, gram)

    @F.pandas_udf("string")
    def keep(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not (cut := _spans_of(s)) else _cut(t.encode(), cut).decode("utf-8", "ignore") for t, s in zip(texts, spans, strict=True)], dtype=object)

    made = found.withColumn("__mr_kept", keep("__mr_text", "__mr_spans"))
    made = made.withColumn(text, F.when(F.col("__mr_null"), F.lit(None)).when(F.col("__mr_whole"), F.lit("")).otherwise(F.col("__mr_kept")))
    if chars in docs.columns:
        made = made.withColumn(chars, F.when(F.col("__mr_null"), F.col(chars)).otherwise(F.length(text).cast(docs.schema[chars].dataType)))
    return made.select(*docs.columns)


#: The same rows in DuckDB: every window of 200 bytes by its digest. Fit for small tables only.
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
s AS (SELECT doc_id, i FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)),
m AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200, TRUE)::INT AS new FROM s),
k AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
sp AS (SELECT doc_id, k, min(i) AS b, max(i) + 200 AS e FROM k GROUP BY doc_id, k),
p AS (SELECT sp.doc_id, k, b, e, substr(h, 2 * coalesce(lag(e) OVER q, 0) + 1, 2 * (b - coalesce(lag(e) OVER q, 0))) AS piece, h FROM sp JOIN d ON sp.doc_id = d.doc_id WINDOW q AS (PARTITION BY sp.doc_id ORDER BY k)),
g AS (SELECT doc_id, sum(e - b)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY k) || substr(any_value(h), 2 * max(e) + 1) AS kept FROM p GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id
"""
