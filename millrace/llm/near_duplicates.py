"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

The join is between different texts; rows with one text are one node. A node's set holds the
hashes of its windows of `size` words (a shorter text is one window). Bands and rows are
chosen for the target recall at the threshold. Band hashes are shuffled; nodes that meet in a
band hang on the least node of that bucket, which is a pair per member and not per pair, and
the components of those pairs are the candidate groups.

Small groups are verified as a whole on the full sets, one task each, which finds every pair
that a band found and more. A group beyond a chunk may be a chain of weak pairs, so it is
verified bucket by bucket wherever that ships fewer texts: buckets of the same members are one
unit, and a pair that meets in several units counts in the one of its first band. A unit
beyond a chunk is dealt by hash into chunks of bounded size, and each pair of chunks is a task
of its own. Tasks count links and return the roots of a spanning forest; pairs leave no task.
Classes are components of verified links.

Defined cases: a null text is the empty text; texts without words have an empty set and no
links, but equal texts still share a class; rows that repeat an id and text stay one node;
class_id is the least id of the class (null only if it has none); an empty table gives an
empty result; other columns pass through `deduplicate` and are not read otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, joined_apart
from .shared import discard, materialize, partitions, remembered, text_of

SIZE, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.99999, 4
#: A chunk of a candidate group holds about so many nodes and windows at most.
CHUNK_NODES, CHUNK_WINDOWS = 3_000, 1_500_000
REMEMBERED = 250_000
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def bands_for(threshold: float, recall: float, rows: int = ROWS) -> int:
    """The bands of `rows` rows that find a pair at the threshold with at least this recall."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def window_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct window hashes of each text."""
    known = remembered("near_duplicates", REMEMBERED)
    words = [t.encode().split() for t in texts]
    known.update((w, xxhash.xxh3_64_intdigest(w)) for w in set().union(*words).difference(known))
    ends = np.cumsum([len(w) for w in words])
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(ends[-1]) if len(ends) else 0)
    n = max(0, len(h) - size + 1)
    windows = np.full(n, size, np.uint64)
    for k in range(size):
        windows = _mix(windows * _M1 + h[k : k + n])
    out, start = [], 0
    for end in ends.tolist():
        if end - start >= size:
            out.append(np.unique(windows[start : end - size + 1]))
        elif end > start:
            short = np.array([end - start], np.uint64)
            for x in h[start:end]:
                short = _mix(short * _M1 + x)
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        start = end
    return out


def band_hashes(found: np.ndarray, multipliers: np.ndarray, rows: int) -> np.ndarray:
    """One hash per band of a non-empty set."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), 4096):
        np.minimum(least, (multipliers[:, None] * found[None, start : start + 4096]).min(axis=1), out=least)
    least = least.reshape(-1, rows)
    out = np.arange(1, len(least) + 1, dtype=np.uint64)
    for k in range(rows):
        out = _mix(out * _M1 + least[:, k])
    return out


def signatures(docs: DataFrame, id_column: str, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """id, a and b (the text's 128-bit hash), n (windows), bands (array of hashes), one row per row of docs."""
    thin = docs.select(F.col(id_column).alias("id"), *_key(text), text_of(text).alias("__mr_text"))
    multipliers = np.random.default_rng(7).integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                sets = window_sets(some.column(3).to_pylist(), size)
                hashes = [band_hashes(x, multipliers, rows).astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(list(map(len, sets)), pa.int64()), pa.array(hashes, pa.list_(pa.int64()))], names=["id", "a", "b", "n", "bands"])

    return thin.mapInArrow(run, f"id {thin.schema['id'].dataType.simpleString()}, a long, b long, n long, bands array<long>")


def _key(text: str):
    return F.xxhash64(text_of(text)).alias("a"), F.xxhash64(F.lit("millrace"), text_of(text)).alias("b")


def _node(a: str = "a", b: str = "b"):
    return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))


def links_within(sets: list[np.ndarray], threshold: float, split: int | None = None, earlier: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(links of each set, root index of each set). With split, only pairs across that index count;
    with earlier (sets by bands, 0 for none), only pairs that agree in none of its columns."""
    m = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    member = np.repeat(np.arange(m), sizes)
    values, place, df = np.unique(np.concatenate(sets) if m else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    keep = df[place] > 1  # a window of one set alone is in no intersection
    member, place = member[keep], place[keep]
    _, place = np.unique(place, return_inverse=True)
    width = int(place.max()) + 1 if len(place) else 0
    order = np.argsort(place, kind="stable")
    member, place = member[order], place[order]
    links, parent = np.zeros(m, np.int64), list(range(m))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(i: int, js: np.ndarray) -> None:
        for j in js.tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[max(x, y)] = min(x, y)

    counts = np.bincount(place, minlength=width)
    starts = np.concatenate([[0], np.cumsum(counts)])
    dense = 2.0 * m * m * width / 2e10 < float((counts.astype(float) ** 2).sum()) / 1e8
    by_member = np.argsort(member, kind="stable")
    bounds = np.searchsorted(member[by_member], np.arange(m + 1))
    for begin in range(0, m, 512):
        end = min(m, begin + 512)
        common = np.zeros((end - begin, m), np.float32)
        if dense:
            for left in range(0, width, 4096):
                some = slice(starts[left], starts[min(width, left + 4096)])
                block = np.zeros((m, min(4096, width - left)), np.float32)
                block[member[some], place[some] - left] = 1
                common += block[begin:end] @ block.T
        else:
            for i in range(begin, end):
                mine = place[by_member[bounds[i] : bounds[i + 1]]]
                if len(mine):
                    others = np.concatenate([member[starts[p] : starts[p + 1]] for p in mine])
                    common[i - begin] = np.bincount(others, minlength=m)
        union = sizes[begin:end, None] + sizes[None, :] - common
        hit = (common > 0) & (common / np.maximum(union, 1) >= threshold)
        hit[np.arange(end - begin), np.arange(begin, end)] = False
        if split is not None:
            rows = np.arange(begin, end)
            hit &= (rows[:, None] < split) != (np.arange(m)[None, :] < split)
        for column in () if earlier is None else earlier.T:
            hit &= (column[begin:end, None] != column[None, :]) | (column[begin:end, None] == 0)
        links[begin:end] = hit.sum(axis=1)
        for i in np.flatnonzero(hit.any(axis=1)).tolist():
            js = np.flatnonzero(hit[i])
            join(begin + i, js[js > begin + i])
    return links, np.array([root(i) for i in range(m)], np.int64)


_UNIT = ["ca", "cb", "i", "j"]


def _verify(threshold: float, size: int):
    """Streams units, sorted by key and side; a unit's rows are held until it is complete."""

    def finish(key: tuple, nodes: list, texts: list[str], met: list, first: int) -> pa.RecordBatch:
        sets = [x for k in range(0, len(texts), 500) for x in window_sets(texts[k : k + 500], size)]
        earlier = None
        if met[0] is not None:
            earlier = np.array(met, np.int64)
            earlier = earlier[:, : met[0].index(key[0])]
        links, roots = links_within(sets, threshold, None if key[2] == key[3] else first, earlier)
        cols = list(zip(*nodes, strict=True))
        at = [nodes[r] for r in roots.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(links), pa.array([x[0] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.int64())], names=["a", "b", "links", "ra", "rb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, texts, met, first = None, [], [], [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                some = batch.slice(start, 1000)
                for *unit, side, a, b, units, text in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if tuple(unit) != key:
                        if nodes:
                            yield finish(key, nodes, texts, met, first)
                        key, nodes, texts, met, first = tuple(unit), [], [], [], 0
                    if nodes and nodes[-1] == (a, b):
                        continue  # a repeated row
                    nodes.append((a, b))
                    texts.append(text)
                    met.append(units)
                    first += side == 0
        if nodes:
            yield finish(key, nodes, texts, met, first)

    return run


def _chunks(windows: str):
    """Into how many chunks rows with so many windows go."""
    return F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_NODES), F.ceil(F.sum(windows) / CHUNK_WINDOWS)).cast("int")


def _members(grouped: DataFrame) -> DataFrame:
    """One row per node and unit: id, a, b, the unit's key (ca, cb), its chunks k, the node's chunk
    and units (null in a unit that is a whole group; else the node's unit by band, 0 for none)."""
    chunk = F.pmod(F.col("b"), F.col("k")).cast("int").alias("chunk")
    nobody = F.lit(None).cast("array<bigint>").alias("units")
    whole = [F.col("root.a").alias("ca"), F.col("root.b").alias("cb")]
    small = grouped.filter("k = 1").select("id", "a", "b", *whole, "k", chunk, nobody)
    large = grouped.filter("k > 1")
    if large.isEmpty():
        return small
    bands = large.select("a", "b", "n", "root", F.posexplode("bands").alias("at", "band"))
    mark = [F.sum(F.xxhash64(F.lit(salt), "a", "b").cast("decimal(38,0)")).alias(f"s{salt}") for salt in (1, 2)]
    buckets = materialize(bands.groupBy("band").agg(F.first("root").alias("root"), F.count(F.lit(1)).alias("c"), *mark, _chunks("n").alias("ku")).filter("c > 1"), "buckets")
    # Buckets of the same members: their count and two sums of hashes agree.
    same = ["root", "c", "s1", "s2"]
    named = buckets.groupBy(*same).agg(F.min("band").alias("unit"))
    found = materialize(buckets.join(named, same).select("band", "unit", "root", "ku", (F.col("c") * F.col("ku")).alias("sent")), "units")
    cost = found.filter("band = unit").groupBy("root").agg(F.sum("sent").alias("sent"))
    apart = materialize(large.groupBy("root").agg(F.first("whole").alias("whole")).join(cost, "root").filter("sent < whole").select("root"), "apart")
    rest = large.join(apart, "root", "left_anti").select("id", "a", "b", *whole, "k", chunk, nobody)
    of = bands.join(apart, "root", "left_semi").select("a", "b", "at", "band").join(found.select("band", "unit", "ku"), "band", "left")
    each = of.groupBy("a", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", F.coalesce("unit", F.lit(0)).alias("unit")))), lambda x: x["unit"]).alias("units"), F.collect_set(F.struct("unit", "ku")).alias("in"))
    met = each.select("a", "b", "units", F.explode("in").alias("u")).filter("u.unit IS NOT NULL").join(large.select("a", "b", "id"), ["a", "b"])
    return small.unionByName(rest).unionByName(met.select("id", "a", "b", F.col("u.unit").alias("ca"), F.lit(0).cast("long").alias("cb"), F.col("u.ku").alias("k"), "units").select("id", "a", "b", "ca", "cb", "k", chunk, "units"))


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: id, a, b (its text's hash), class_id, n_links.

    A class is a connected group of links; n_links counts the different texts that a text is
    linked to directly."""
    spark = docs.sparkSession
    parts = partitions(spark)
    rows_of = materialize(signatures(docs, id_column, text, size, bands_for(threshold, recall, rows), rows), "signatures")
    nodes = materialize(rows_of.groupBy("a", "b").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    bands = nodes.select("a", "b", F.posexplode("bands").alias("at", "band"))
    hubs = bands.groupBy("band").agg(F.min(_node()).alias("v"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    met = components(joined_apart(bands, hubs, "band").select(_node().alias("u"), "v"))
    sized = met.join(nodes.select(_node().alias("node"), "id", "n", "bands"), "node")
    # Tables of groups are written, so that joins with them are plain shuffles that Spark can split.
    groups = materialize(sized.groupBy("root").agg(F.count(F.lit(1)).alias("m"), _chunks("n").alias("k")), "groups")
    grouped = materialize(sized.join(groups, "root").select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), "id", "n", "bands", "root", "k", (F.col("m") * F.col("k")).alias("whole")), "grouped")
    members = materialize(_members(grouped), "members")
    # One document of each node brings its text.
    texts = docs.select(F.col(id_column).alias("id"), *_key(text), text_of(text).alias("__mr_text"))
    # Always a sort-merge join: members grow with the corpus, so no size makes a broadcast safe.
    held = members.hint("merge")
    brought = texts.join(held, (texts["a"] == held["a"]) & (texts["b"] == held["b"]) & texts["id"].eqNullSafe(held["id"])).select("ca", "cb", "k", "chunk", texts["a"], texts["b"], "units", "__mr_text")
    units = brought.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("ca", "cb", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "a", "b", "units", "__mr_text")
    done = materialize(units.repartition(parts, *_UNIT).sortWithinPartitions(*_UNIT, "side", "a", "b").mapInArrow(_verify(threshold, size), "a long, b long, links long, ra long, rb long"), "links")
    # Groups of several units have a root per task; one more round of components joins them.
    many = grouped.filter("k > 1").select("a", "b")
    roots = done.groupBy("a", "b").agg(F.sum("links").alias("links"), F.min(_node("ra", "rb")).alias("root"))
    if not many.isEmpty():
        joined = components(done.join(many, ["a", "b"], "left_semi").select(_node().alias("u"), _node("ra", "rb").alias("v")))
        roots = roots.join(joined.select(F.col("node.a").alias("a"), F.col("node.b").alias("b"), F.col("root").alias("joined")), ["a", "b"], "left").select("a", "b", "links", F.coalesce("joined", "root").alias("root"))
    roots = materialize(roots, "roots")
    # Roots are nodes; a class is named by its least id.
    named = materialize(roots.join(nodes.select("a", "b", "id"), ["a", "b"]).groupBy("root").agg(F.min("id").alias("class")), "names")
    classes = roots.filter("links > 0").join(named, "root").select("a", "b", "links", "class")
    # Written first, so that the last join has two plain shuffles and Spark can split a text of many rows.
    every = materialize(nodes.select("a", "b", F.col("id").alias("own")).join(classes, ["a", "b"], "left").select("a", "b", F.when(F.col("links").isNotNull(), F.col("class")).otherwise(F.col("own")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links")), "named")
    discard(nodes, groups, grouped, members, done, roots, named)
    return rows_of.select("id", "a", "b").join(every, ["a", "b"]).select(F.col("id").alias(id_column), "a", "b", "class_id", "n_links")


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of docs without near copies: of each class the row of the least id stays (of
    equal ids the one of the least text hash)."""
    found = materialize(near_duplicates(docs, id_column, text, **options), "classes")
    same = F.col(id_column).eqNullSafe(F.col("class_id"))
    stay = found.filter(same).groupBy("class_id").agg(F.min(_node()).alias("n")).filter("class_id IS NOT NULL").select(F.col("class_id").alias("__mr_class"), F.col("n.a").alias("__mr_a"), F.col("n.b").alias("__mr_b"))
    # Rows without an id: one of each text.
    lost = found.filter("class_id IS NULL").select(F.col("class_id").alias("__mr_class"), F.col("a").alias("__mr_a"), F.col("b").alias("__mr_b")).distinct()
    stay = stay.unionByName(lost)
    a, b = _key(text)
    keyed = docs.withColumns({"__mr_ka": a, "__mr_kb": b})
    kept = keyed.join(stay, (keyed["__mr_ka"] == stay["__mr_a"]) & (keyed["__mr_kb"] == stay["__mr_b"]) & keyed[id_column].eqNullSafe(stay["__mr_class"]))
    return kept.dropDuplicates(["__mr_ka", "__mr_kb"]).select(*docs.columns)


#: The same rows in DuckDB: shared windows by a join, exact Jaccard, and classes by recursion.
SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS id FROM documents GROUP BY 1),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM t),
s AS (SELECT DISTINCT id, array_to_string(w[k : k + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE m::DOUBLE / (x.n + y.n - m) >= 0.8),
r AS (SELECT id AS a, id AS root FROM t UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.a),
c AS (SELECT a AS id, min(root) AS class_id FROM r GROUP BY a),
k AS (SELECT a AS id, count(*) AS n_links FROM l GROUP BY a)
SELECT d.doc_id, c.class_id, coalesce(k.n_links, 0)::BIGINT AS n_links
FROM documents d JOIN t ON coalesce(d.text, '') = t.text JOIN c ON c.id = t.id LEFT JOIN k ON k.id = t.id
"""
