"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the buckets of its words, of its word pairs and triples, and of the
pairs that skip one or two words, each present or absent. Training is FTRL-proximal: a rate
per coordinate and L1 sparsity, so the model that goes to the executors is a few thousand
(bucket, weight) pairs at most.

The model is fitted on a bounded sample of the labelled rows on the learning side: at most
MAX_TOXIC toxic and MAX_CLEAN clean rows, the least by a hash of their id. Scoring covers
every document and its whole text; only the text is an input of the score.

Defined cases: a null or empty text has no features, so its score is the bias alone; label
rows with a null label or id are not learned from; several labels of one id count as toxic if one is; of
several documents with one id the learner takes one; without any labelled row every score is
0.5; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import learned, remembered, text_of

BUCKETS = 1 << 20
MAX_TOXIC, MAX_CLEAN = 2_500, 5_500
EPOCHS = 12
ALPHA, BETA, L2 = 2.0, 1.0, 0.02
L1_LEAST, L1_ROOT = 0.8, 0.04  # of L1, per epoch
MIN_DOCS = 3  # a bucket that fewer sampled documents have is not a feature
THRESHOLD = 0.7
REMEMBERED = 200_000
SLICE = 200  # documents whose features a task holds at once
#: Lower case comes first; then ASCII marks separate words.
_MARKS = bytes(32 if chr(i) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else i for i in range(256))


@dataclass(frozen=True)
class Model:
    bias: float
    buckets: np.ndarray  # int32
    weights: np.ndarray  # float64


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram and skip-gram of the texts, with repetitions."""
    known = remembered("toxicity", REMEMBERED)
    words = [t.lower().encode().translate(_MARKS).split() for t in texts]
    known.update((w, xxhash.xxh32_intdigest(w)) for w in set().union(*words).difference(known))
    n = np.fromiter(map(len, words), np.int64, len(words))
    h = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, int(n.sum()))
    row = np.repeat(np.arange(len(words)), n)
    rows, found = [row], [h * np.uint64(0x9E3779B97F4A7C15)]
    for salt, offsets in enumerate(((0, 1), (0, 1, 2), (0, 2), (0, 3))):
        size = max(0, len(h) - offsets[-1])
        mixed = np.full(size, salt + 1, np.uint64)
        for k in offsets:
            mixed = (mixed ^ h[k : k + size]) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        inside = row[:size] == row[offsets[-1] :][:size]
        rows.append(row[:size][inside])
        found.append((mixed * np.uint64(0x9E3779B97F4A7C15))[inside])
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(44)).astype(np.int32)


def fit(rows: list[np.ndarray], labels: np.ndarray) -> Model:
    """FTRL-proximal over rows of distinct buckets, in the order given, EPOCHS times."""
    if not len(rows):
        return Model(0.0, np.zeros(0, np.int32), np.zeros(0))
    counts = np.zeros(BUCKETS, np.int64)
    for r in rows:
        counts[r] += 1
    ids = np.flatnonzero(counts >= MIN_DOCS)
    place = np.full(BUCKETS, -1, np.int32)
    place[ids] = np.arange(len(ids))
    rows = [(p := place[r])[p >= 0] for r in rows]
    z, n = np.zeros(len(ids)), np.zeros(len(ids))
    # What labels by chance add to z in an epoch grows as the root of the toxic rows; L1 has to exceed it.
    l1 = EPOCHS * (L1_LEAST + L1_ROOT * math.sqrt(labels.sum()))
    bias_z = bias_n = 0.0
    for _ in range(EPOCHS):
        for r, y in zip(rows, labels.astype(float).tolist(), strict=True):
            zr, root = z[r], np.sqrt(n[r])
            w = -np.sign(zr) * np.maximum(np.abs(zr) - l1, 0) / ((BETA + root) / ALPHA + L2)
            bias = -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, bias + float(w.sum()))))) - y
            grown = np.sqrt(n[r] + g * g)
            z[r] = zr + g - (grown - root) / ALPHA * w
            n[r] += g * g
            bias_z += g - (math.sqrt(bias_n + g * g) - math.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    w = -np.sign(z) * np.maximum(np.abs(z) - l1, 0) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return Model(-bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA), ids[w != 0].astype(np.int32), w[w != 0])


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 3, held_out: int = 1) -> Model:
    """Fit on the sample of labelled rows whose id's crc32 is not held_out, modulo modulus."""
    usable = labels.filter(F.col(label).isNotNull() & F.col(id_column).isNotNull() & learned(id_column, modulus, held_out)).groupBy(id_column).agg(F.max(F.col(label).cast("int")).alias("__mr_label"))
    order = [F.xxhash64(id_column), F.col(id_column)]
    parts = [usable.filter(c).orderBy(*order).limit(n) for c, n in (("__mr_label = 1", MAX_TOXIC), ("__mr_label <> 1", MAX_CLEAN))]
    sample = F.broadcast(parts[0].unionByName(parts[1]))  # of MAX_TOXIC + MAX_CLEAN rows at most

    @F.pandas_udf("binary")
    def buckets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(features([t])[1]).tobytes() for t in texts])

    rows = docs.select(id_column, text_of(text).alias("__mr_text")).join(sample, id_column).select(id_column, "__mr_label", buckets("__mr_text").alias("x")).groupBy(id_column).agg(F.max("__mr_label").alias("y"), F.min("x").alias("x"), F.xxhash64(id_column).alias("k"))
    # The sample is bounded, so one task can fit it; the driver sees the model only.
    kinds = rows.coalesce(1).mapInArrow(_fit_task(id_column), "bucket int, weight double").toArrow()
    bucket, weight = kinds.column("bucket").to_numpy(), kinds.column("weight").to_numpy()
    bias = weight[bucket < 0]
    return Model(float(bias[0]) if len(bias) else 0.0, bucket[bucket >= 0], weight[bucket >= 0])


def _fit_task(id_column: str):
    """Fits the rows of a task; the bias is sent as bucket -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        remembered("toxicity", REMEMBERED).clear()
        rows = []
        for batch in batches:
            ids, k, y = (batch.column(c).to_pylist() for c in (id_column, "k", "y"))
            rows.extend(zip(k, ids, y, (np.frombuffer(x.as_buffer(), np.int32).copy() for x in batch.column("x")), strict=True))
        rows.sort(key=lambda r: r[:2])
        model = fit([r[3] for r in rows], np.array([r[2] == 1 for r in rows], bool))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *model.buckets.tolist()], pa.int32()), pa.array([model.bias, *model.weights.tolist()])], names=["bucket", "weight"])

    return run


def scorer(model: Model) -> Callable[[list[str]], np.ndarray]:
    """The probability of label 1 of each text."""
    dense = np.zeros(BUCKETS)
    dense[model.buckets] = model.weights

    def run(texts: list[str]) -> np.ndarray:
        row, bucket = features(texts)
        hit = dense[bucket] != 0
        pairs = np.unique(row[hit].astype(np.int64) << 32 | bucket[hit])
        total = np.bincount(pairs >> 32, dense[pairs & 0xFFFFFFFF], len(texts))
        return 1 / (1 + np.exp(-np.clip(model.bias + total, -35, 35)))

    return run


def toxic_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, score and predicted for every document."""
    model = train(docs, labels, id_column, text)
    thin = docs.select(F.col(id_column), (~learned(id_column, 3, 1)).alias("held_out"), text_of(text).alias("__mr_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                found = score(some.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(found), pa.array((found >= THRESHOLD).astype(np.int32))], names=[id_column, "held_out", "score", "predicted"])

    return thin.mapInArrow(run, f"`{id_column}` {thin.schema[id_column].dataType.simpleString()}, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that score below the threshold."""
    model = train(docs, labels, id_column, text)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(model)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                some = batch.slice(start, SLICE)
                yield some.filter(pa.array(score([t or "" for t in some.column(at).to_pylist()]) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
