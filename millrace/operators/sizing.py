"""How many items of a list carry its information: bigram coverage, its knee, near-equal items, a compression check.

Input: array_id, idx, item (text). The coverage curve and the knee are aggregates and windows;
near-equal items need an ordered greedy pass and run per array in Arrow batches. Sizes need both,
and take the curve in that pass too, so that no row of a bigram is moved.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

LEAST_DIFFERENCE, NEAR_BITS, ZLIB_LEVEL = 0.05, 3, 1


def bigram_curve(items: DataFrame) -> DataFrame:
    """array_id, idx, covered: distinct word bigrams up to each item."""
    words = F.filter(F.split(F.lower("item"), r"\s+"), lambda w: w != "")
    pairs = F.when(F.size("w") < 2, F.array(F.struct(F.coalesce(F.get("w", F.lit(0)), F.lit("")).alias("a"), F.lit("").alias("b")))).otherwise(F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    first = items.withColumn("w", words).select("array_id", "idx", F.explode(pairs).alias("p")).groupBy("array_id", "p").agg(F.min("idx").alias("idx"))
    new = first.groupBy("array_id", "idx").agg(F.count(F.lit(1)).alias("new"))
    d = items.select("array_id", "idx").join(new, ["array_id", "idx"], "left")
    return d.select("array_id", "idx", F.sum(F.coalesce("new", F.lit(0))).over(W.partitionBy("array_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)).alias("covered"))


def knees(curve: DataFrame) -> DataFrame:
    """array_id, n, knee: the 1-based place where coverage is farthest above the diagonal; null without one, 1 for a flat curve."""
    w = W.partitionBy("array_id")
    d = curve.withColumns({"n": F.count(F.lit(1)).over(w), "lo": F.min("covered").over(w), "hi": F.max("covered").over(w)})
    gain = (F.col("covered") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0)) - F.col("idx") / F.nullif(F.col("n") - 1, F.lit(0))
    d = d.withColumn("gain", gain)
    g = d.groupBy("array_id").agg(F.first("n").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.max("gain").alias("most"), F.max(F.struct("gain", (-F.col("idx")).alias("i"))).alias("best"))
    return g.select("array_id", "n", F.when(F.col("n") < 3, None).when(F.col("lo") == F.col("hi"), 1).when(F.col("most") < LEAST_DIFFERENCE, None).otherwise(1 - F.col("best.i")).cast("long").alias("knee"))


def _bits(gram: str) -> bytes:
    return hashlib.md5(gram.encode()).digest()[:8][::-1]


class _Signs:
    """+1 or -1 for each of the first 64 bits of a gram's MD5, one row per gram; bounded."""

    most = 1 << 18

    def __init__(self):
        self.rows: dict[int, int] = {}
        self.signs = np.zeros((1 << 12, 64), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        """The signs of four letters each, packed to 16 bits a letter."""
        known = self.rows
        found = list(map(known.get, keys := grams.tolist()))
        if None in found:
            if len(known) + len(keys) > self.most:
                known.clear()
            new = [g for g in keys if g not in known]
            need = len(known) + len(new)
            if need > len(self.signs):
                self.signs = np.concatenate([self.signs, np.zeros((max(need, 2 * len(self.signs)) - len(self.signs), 64), np.int8)])
            made = np.frombuffer(b"".join(_bits("".join(chr(g >> k & 0xFFFF) for k in (0, 16, 32, 48))) for g in new), np.uint8)
            self.signs[len(known) : need] = 2 * np.unpackbits(made.reshape(-1, 8), axis=1, bitorder="little").view(np.int8) - 1
            known.update(zip(new, range(len(known), need), strict=True))
            found = list(map(known.__getitem__, keys))
        return self.signs[found].astype(np.float32)


_SIGNS = _Signs()
#: Letters of texts whose grams are counted together.
LETTERS = 1 << 17


def simhash(text: str) -> int:
    """64-bit simhash of the MD5 of four-letter grams."""
    return simhashes([text])[0]


def simhashes(texts: list[str]) -> list[int]:
    """The simhash of each text; a gram is looked up once for many texts, however often it occurs."""
    out, some, letters = [], [], 0
    for text in texts:
        some.append(text.lower())
        letters += len(some[-1])
        if letters > LETTERS:
            out += _simhashes(some)
            some, letters = [], 0
    return out + _simhashes(some) if some else out


def _dense(x: np.ndarray) -> tuple[np.ndarray, int]:
    """x with its values renumbered from 0 in order, and how many there are."""
    if (most := int(x.max()) + 1) > max(1 << 21, 4 * len(x)):
        values, at = np.unique(x, return_inverse=True)
        return at, len(values)
    used = np.zeros(most, bool)
    used[x] = True
    number = np.cumsum(used, dtype=np.int32)
    return number[x].astype(np.int64) - 1, int(number[-1])


def _ranks(codes: np.ndarray) -> np.ndarray:
    """A number for the four letters from each letter on, equal for equal letters; tables of pairs take the place of a sort."""
    letters, n = _dense(codes.astype(np.int64))
    pairs, n = _dense(letters[:-1] * n + letters[1:])
    return _dense(pairs[:-2] * n + pairs[2:])[0]


def _simhashes(texts: list[str]) -> list[int]:
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    wide = n < 4  # whole texts, and grams of letters beyond 16 bits, are hashed one by one
    if len(codes) and codes.max() > 0xFFFF:
        wide = wide | np.fromiter((max(t, default="") > "\uffff" for t in texts), bool, len(texts))
    votes = np.zeros((len(texts), 64), np.float32)
    for i in np.flatnonzero(wide).tolist():
        grams = Counter(texts[i][k : k + 4] for k in range(max(1, len(texts[i]) - 3)))
        bits = np.unpackbits(np.frombuffer(b"".join(map(_bits, grams)), np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[i] = np.fromiter(grams.values(), np.int64, len(grams)) @ (2 * bits.astype(np.int64) - 1)
    if not wide.all():
        c = codes.astype(np.uint64)
        packed = c[:-3] | c[1:-2] << np.uint64(16) | c[2:-1] << np.uint64(32) | c[3:] << np.uint64(48)
        of = np.repeat(np.arange(len(texts)), n)[: len(packed)]
        # A gram lies in one text, and that is not a wide one.
        inside = (np.arange(len(packed)) < (np.cumsum(n) - 3)[of]) & ~wide[of]
        at, of = _ranks(codes)[inside], of[inside]
        first = np.zeros(int(at.max()) + 1, np.int64)
        first[at] = np.arange(len(at))  # any place of each gram
        used = np.bincount(at, minlength=len(first)) > 0
        grams, at = packed[inside][first[used]], (np.cumsum(used) - 1)[at]
        signs = _SIGNS.of(grams)
        rows = max(1, (1 << 22) // len(grams))
        starts = np.searchsorted(of, np.arange(0, len(texts) + rows, rows))
        for k, first in enumerate(range(0, len(texts), rows)):
            part, last = slice(starts[k], starts[k + 1]), min(first + rows, len(texts))
            counts = np.bincount((of[part] - first) * len(grams) + at[part], minlength=(last - first) * len(grams))
            votes[first:last] += counts.reshape(last - first, len(grams)).astype(np.float32) @ signs
    return np.packbits(votes > 0, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def _heads(hashes: list[int], bits: int) -> int:
    """How many hashes differ in more than `bits` bits from all heads before them, which makes them heads."""
    heads, n = np.zeros(len(hashes), np.uint64), 0
    for h in hashes:
        if not (np.bitwise_count(heads[:n] ^ np.uint64(h)) <= bits).any():
            heads[n] = h
            n += 1
    return n


def _knee(items: list[str]) -> int | None:
    """As knees(bigram_curve(items)) has it, of items in order."""
    if len(items) < 3:
        return None
    seen, covered = set(), []
    for item in items:
        w = item.lower().encode().split()  # the white space of \s, as bytes have no other
        seen.update(zip(w, w[1:], strict=False) if len(w) > 1 else [(w[0] if w else b"", b"")])
        covered.append(len(seen))
    lo, hi = covered[0], covered[-1]
    if lo == hi:
        return 1
    gain = (np.array(covered, np.float64) - lo) / (hi - lo) - np.arange(len(items), dtype=np.float64) / (len(items) - 1)
    best = int(gain.argmax())
    return None if gain[best] < LEAST_DIFFERENCE else best + 1


def near_equal_clusters(items: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """array_id, n, clusters: how many items differ in more than `bits` bits from all cluster heads before them."""
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"array_id": [key[0]], "n": [len(pdf)], "clusters": [_heads(simhashes(pdf.sort_values("idx")["item"].tolist()), bits)]})

    kind = items.schema["array_id"].dataType.simpleString()
    return items.select("array_id", "idx", "item").groupBy("array_id").applyInPandas(run, f"array_id {kind}, n long, clusters long")


def knees_and_clusters(items: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """array_id, n, knee, clusters: as knees and near_equal_clusters have them, in one pass over the items of each array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, knee, clusters = [], [], []
            for held in batch.column(1):
                texts = [x["item"] for x in held.as_py()]
                n.append(len(texts))
                knee.append(_knee(texts))
                clusters.append(_heads(simhashes(texts), bits))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(knee, pa.int64()), pa.array(clusters, pa.int64())], names=["array_id", "n", "knee", "clusters"])

    kind = items.schema["array_id"].dataType.simpleString()
    held = items.groupBy("array_id").agg(F.array_sort(F.collect_list(F.struct("idx", "item"))).alias("items"))
    return held.mapInArrow(run, f"array_id {kind}, n long, knee long, clusters long")


def sizes(items: DataFrame, bias: float = 1.0, least: int = 3, most: int = 15) -> DataFrame:
    """array_id, k: how many items to keep. A bias of 0 leaves `least`, as the knee is multiplied by it."""
    j = knees_and_clusters(items)
    diversity = F.col("clusters") / F.col("n")
    floor = F.greatest(F.lit(least), F.floor(F.col("n") * (0.3 + 0.7 * diversity)))
    knee = F.when(F.col("knee").isNull(), floor).when(diversity > 0.7, F.greatest("knee", floor)).otherwise(F.col("knee"))
    k = F.least(F.lit(most), F.greatest(F.lit(least), F.floor(knee * bias)))
    return j.select("array_id", F.when(F.col("n") <= 8, F.col("n")).when(F.col("clusters") <= 3, F.least(F.lit(most), F.greatest(F.lit(least), "clusters"))).otherwise(k).cast("long").alias("k"))


def compressed_length(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(zlib.compress(t.encode(), ZLIB_LEVEL)))


def checked_size(full: str, head: str, k: int, most: int, tolerance: float = 0.15) -> int:
    """k, or 1.2 k if the head compresses otherwise than the whole by more than the tolerance."""
    if k >= most or len(full.encode()) < 200:
        return k
    ratio = [len(zlib.compress(t.encode(), ZLIB_LEVEL)) / max(1, len(t.encode())) for t in (full, head)]
    return min(most, int(k * 1.2)) if abs(ratio[0] - ratio[1]) > tolerance else k
