"""LM scoring: a log-bilinear neural model trained with noise-contrastive estimation.

Words. Texts are split and numbered some megabytes at a time in Arrow: what depends on a word
alone is looked up once for each distinct word of a piece, not for each occurrence.

Counts. One pass counts every token of the learning side (combined in the task, then by Spark);
the table of counts stays distributed. Words whose count reaches a cut, at most
FREQUENT of them, are broadcast for lookups; all other words meet their counts in a join.

Model. The vocabulary of the model holds the most frequent words, one class per hash of a
word's last three characters for all other words, the end of a text and its begin: WORDS and
CLASSES up to GROWS distinct words, more by the cube root of their number beyond, at most
MOST times as many, as the normaliser takes square tables of the vocabulary.
With embeddings r of the two tokens before, a token scores q . t + b, q = c1 * r1 + c2 * r2.
A word outside the most frequent has its class's probability times its share of the class,
add-one smoothed with one place for unseen words, so that the whole is a distribution.

Training. Every learning text of every partition is used: partitions are joined to SHARD
tokens or more, their contexts are counted and written once, and in each of ROUNDS rounds every
task makes a pass over its own contexts, weighted by their counts, from the last average;
parameters and Adagrad sums are then averaged by weight, in Spark. NCE takes its noise from the
unigram distribution of the model's tokens.

Scoring. The logits are a sum over the two positions, so the normaliser of every context is
one product of two matrices of exponentials; token log-probabilities are exact and normalised.

Defined cases: a null text is the empty text, which is one end token; rows that repeat an id
are scored each by itself; without any learning row N = V = 0; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import learned, materialize, remembered, text_of

WORDS, CLASSES, WIDTH = 1_500, 512, 24
FREQUENT = 200_000  # words; at about 12 bytes, a broadcast of 3 MB
NOISE, BATCH, RATE, START = 64, 512, 0.15, 0.1
ROUNDS, SHARD = 3, 2_000_000  # passes over all contexts; tokens
PASSED, BLOCK = 1 << 21, 1 << 14  # contexts that a pass shuffles together, and those of a written row (128 KB, not too large for the heap)
GROWS, MOST = 1_000_000, 3
END, BEGIN = WORDS + CLASSES, WORDS + CLASSES + 1
SIZE = WORDS + CLASSES + 2
#: Bytes of text whose words are numbered together, and those that are counted together.
PIECE, COUNTED = 4 << 20, 1 << 25


@dataclass(frozen=True)
class Sizes:
    """The vocabulary of the model: words, classes, then the end and the begin of a text."""

    words: int = WORDS
    classes: int = CLASSES

    @classmethod
    def of(cls, distinct: int) -> Sizes:
        scale = min(max((distinct / GROWS) ** (1 / 3), 1), MOST)
        return cls(int(WORDS * scale), int(CLASSES * scale))

    @property
    def end(self) -> int:
        return self.words + self.classes

    @property
    def begin(self) -> int:
        return self.end + 1

    @property
    def size(self) -> int:
        return self.end + 2

    def class_of(self, word: bytes) -> int:
        return self.words + zlib.crc32(word.decode()[-3:].encode()) % self.classes

    def classes_of(self, words: pa.Array) -> np.ndarray:
        """The classes of many words: words with equal last characters are looked up once."""
        ends = pc.utf8_slice_codeunits(words, start=-3).dictionary_encode()
        found = np.fromiter(map(self.class_of, ends.dictionary.cast(pa.binary()).to_pylist()), np.int64, len(ends.dictionary))
        return found[ends.indices.to_numpy()]


@dataclass
class Model:
    tokens: int  # N
    distinct: int  # V
    ends: int  # count of the end token
    frequent: list[bytes]  # the most frequent first: number i < sizes.words is the model's word i
    counts: np.ndarray
    class_tokens: np.ndarray  # by class, of the words beyond the model's own
    class_distinct: np.ndarray
    sizes: Sizes
    parameters: dict[str, np.ndarray] | None = None

    def words(self) -> pa.Array:
        """The frequent words, compact for a broadcast."""
        return pa.array(self.frequent, pa.binary()).cast(pa.string())

    def unigram(self) -> np.ndarray:
        """Add-one probabilities of the model's tokens; BEGIN is never predicted."""
        z = self.sizes
        n = np.ones(z.size)
        top = self.counts[: z.words]
        n[: len(top)] += top
        n[len(top) : z.words] = 0
        n[z.words : z.end] += self.class_tokens
        n[z.end] += self.ends
        n[z.begin] = 0
        return n / n.sum()


def _pieces(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about PIECE bytes of text, or one row."""
    size = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(), dtype=np.int64)
    begin = 0
    while begin < batch.num_rows:
        most = PIECE + (size[begin - 1] if begin else 0)
        end = max(begin + 1, int(np.searchsorted(size, most, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, lower-case, with empty ones where a text begins or ends with white space; how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    return lists.flatten().cast(pa.string()), pc.list_value_length(lists).to_numpy().astype(np.int64)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of some texts, the place of each word among them, the number of words of each text."""
    flat, n = _split(texts)
    words = flat.dictionary_encode()
    at = words.indices.to_numpy()
    full = at != pc.index(words.dictionary, "").as_py()
    before, ends = np.concatenate([[0], np.cumsum(full)]), np.cumsum(n)
    return words.dictionary, at[full], before[ends] - before[ends - n]


def count(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) of all texts, and the word '' for the end tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, ends = [], 0, 0
        for batch in batches:
            for some in _pieces(batch):
                held.append(_split(some.column(0))[0])
                size += held[-1].nbytes
                ends += some.num_rows
                if size > COUNTED:
                    yield _counted(held)
                    held, size = [], 0
        if ends:
            yield _counted(held)
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([ends], pa.int64())], names=["word", "c"])

    return docs.select(text_of(text)).mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(held: list[pa.Array]) -> pa.RecordBatch:
    found = pa.chunked_array(held, pa.string()).value_counts()
    found = found.filter(pc.not_equal(found.field("values"), ""))
    return pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], names=["word", "c"])


def summarize(counts: DataFrame) -> Model:
    """What the driver keeps of a table of counts: bounded lists and sums."""
    spot = F.floor(F.log2("c") * 16)
    steps = sorted(((r[0], r[1], r[2]) for r in counts.filter("word <> ''").groupBy(spot.alias("s")).agg(F.count(F.lit(1)), F.min("c")).collect()), reverse=True)
    total, cut = 0, None
    for _, n, least in steps:
        if total + n > FREQUENT:
            break
        total, cut = total + n, least
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.filter("word = ''").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    words, c = [], np.zeros(0, np.int64)
    if cut is not None:
        t = counts.filter((F.col("word") != "") & (F.col("c") >= cut)).toArrow()
        words, c = t.column("word").cast(pa.binary()).to_pylist(), t.column("c").to_numpy()
        order = sorted(range(len(words)), key=lambda i: (-c[i], words[i]))
        words, c = [words[i] for i in order], c[order]
    sizes = Sizes.of(distinct)
    kind = (F.crc32(F.expr("right(word, 3)").cast("binary")) % sizes.classes).cast("int")
    of_class, in_class = np.zeros(sizes.classes, np.int64), np.zeros(sizes.classes, np.int64)
    for k, n, m in counts.filter("word <> ''").groupBy(kind.alias("k")).agg(F.sum("c"), F.count(F.lit(1))).collect():
        of_class[k], in_class[k] = n, m
    for w, n in zip(words[: sizes.words], c[: sizes.words].tolist(), strict=True):
        of_class[sizes.class_of(w) - sizes.words] -= n
        in_class[sizes.class_of(w) - sizes.words] -= 1
    return Model(tokens, distinct, ends, words, c, of_class, in_class, sizes)


def _start(size: int = SIZE) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    made = {k: (rng.standard_normal((size, WIDTH)) * START).astype(np.float32) for k in ("context", "target")}
    return made | {"c1": np.ones(WIDTH, np.float32), "c2": np.full(WIDTH, 0.5, np.float32), "bias": np.zeros(size, np.float32)}


#: Batches whose indices are ordered together; bits of a place in a batch; times that an index's rows are summed one by one.
TOGETHER, PLACE, SINGLY = 32, 11, 4


class _Places:
    """Where the equal indices, which are below 2^15, of each batch lie, for some batches at once.

    An index that occurs up to SINGLY times gets its rows one by one, the others theirs by a product.
    The distinct indices of a batch lie in the order of their times, those with the most first."""

    def __init__(self, index: np.ndarray, half: int):
        n, self.wide = index.shape
        # Index and place in one number: a sort of numbers is faster than one of places.
        key = np.sort(index.astype(np.int32) << PLACE | np.arange(self.wide, dtype=np.int32), axis=1).ravel()
        order, sorted_index = (key & ((1 << PLACE) - 1)).astype(np.int64), key >> PLACE
        new = np.ones(len(key), bool)
        np.not_equal(sorted_index[1:], sorted_index[:-1], out=new[1:])
        new[:: self.wide] = True
        first = np.flatnonzero(new)
        times = np.diff(first, append=len(key))
        batch, levels = first // self.wide, SINGLY + 1
        level = batch * levels + levels - np.minimum(times, levels)
        by_times = np.argsort(level.astype(np.int16), kind="stable")
        first = first[by_times]
        self.index, self.given = sorted_index[first].astype(np.int64), index.astype(np.int16)
        # The places of the first rows of each; where there are fewer, they are not used.
        self.places = [order.take(first + i, mode="clip") for i in range(SINGLY)]
        self.begins = np.searchsorted(batch, np.arange(n + 1)).tolist()
        # By batch: how many occur more than SINGLY times, SINGLY times or more, and so on.
        self.least = np.cumsum(np.bincount(level, minlength=levels * n).reshape(n, levels), axis=1).tolist()
        self.half = half

    def sums(self, k: int, rows: np.ndarray, split: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct indices of batch k, and the sum of the rows of each; indices below half lie in the first split rows."""
        begin, end = self.begins[k], self.begins[k + 1]
        often, *least = self.least[k]
        index = self.index[begin:end]
        out = rows.take(self.places[0][begin:end], axis=0)
        for i, m in zip(range(SINGLY - 1, 0, -1), least, strict=False):
            if m > often:
                out[often:m] += rows.take(self.places[i][begin + often : begin + m], axis=0)
        below = int(np.searchsorted(index[:often], self.half))
        given = self.given[k]
        for here, some, of in ((slice(0, below), given[:split], rows[:split]), (slice(below, often), given[split:], rows[split:])):
            values = index[here].astype(np.int16)
            np.matmul((some == values[:, None]).astype(np.float32), of, out=out[here])
        return index, out


def nce(p: dict[str, np.ndarray], seen: dict[str, np.ndarray], triples: np.ndarray, weights: np.ndarray, noise: np.ndarray, seed: int) -> None:
    """One pass of noise-contrastive estimation over (token before last, last, next) with weights:
    changes the parameters p and seen, their Adagrad sums.

    A batch shares its noise tokens; Adagrad sets the rate of each parameter. The bias is kept
    as a difference to the log unigram probability, which is the noise distribution itself.
    What does not depend on the parameters is made for many batches at once. While the pass runs,
    a target's bias is its last column, which meets a column of ones in the contexts."""
    size, n = len(noise), len(triples)
    rng = np.random.default_rng((n, seed))
    order = rng.permutation(n)
    scale = np.float32(1 / (weights.mean() * BATCH))
    cumulated = np.cumsum(noise)
    log_k, rate = np.float32(math.log(NOISE)), np.float32(RATE)
    # The contexts' rows, then the targets': one table, so that a batch reads and writes it once.
    table, table_seen = (np.vstack([np.column_stack([x["context"], np.ones(size, np.float32)]), np.column_stack([x["target"], x["bias"]])]) for x in (p, seen))
    # A row as one value: it is stored by one copy.
    row = np.dtype((np.void, 4 * (WIDTH + 1)))
    table_rows, seen_rows = table.view(row).ravel(), table_seen.view(row).ravel()
    c, c_seen = np.array([np.append(p["c1"], 1), np.append(p["c2"], 0)], np.float32), np.array([seen["c1"], seen["c2"]])

    def pass_over(target: np.ndarray, last: np.ndarray, before: np.ndarray, weight: np.ndarray, drawn: np.ndarray) -> None:
        """Some batches of equal size, one per row."""
        wide = target.shape[1]
        every = np.concatenate([last, before, target + size, drawn + size], axis=1)
        places = _Places(every, size)
        g, bad = np.empty((every.shape[1], WIDTH + 1), np.float32), np.empty((wide, NOISE), np.float32)
        rows, by_context, other = np.empty_like(g), np.empty((2, WIDTH + 1), np.float32), np.empty((wide, WIDTH + 1), np.float32)
        r1, r2, t, tn = rows[:wide], rows[wide : 2 * wide], rows[2 * wide : 3 * wide], rows[3 * wide :]
        # Products with c take several rows as one: short rows cost more than their numbers.
        joined = math.gcd(wide, 16)
        flat = (-1, joined * (WIDTH + 1))
        both, g1, g2 = (x.reshape(flat) for x in (other, g[:wide], g[wide : 2 * wide]))
        flat1, flat2, scales = r1.reshape(flat), r2.reshape(flat), np.empty((2, joined, WIDTH + 1), np.float32)
        of_last, of_before = scales.reshape(2, -1)
        for k in range(len(target)):
            table.take(every[k], axis=0, out=rows, mode="clip")
            # log(model / noise) is q . t + bias, as the bias counts from the log of the noise.
            scales[:] = c[:, None]
            q = flat1 * of_last
            q += np.multiply(flat2, of_before, out=both)
            q = q.reshape(wide, WIDTH + 1)
            good = np.einsum("ij,ij->i", q, t)
            good -= log_k
            np.exp(good, out=good)
            good += 1
            good = (weight[k] / good)[:, None]
            np.matmul(q, tn.T, out=bad)
            np.subtract(log_k, bad, out=bad)
            np.exp(bad, out=bad)
            bad += 1
            np.divide(weight[k][:, None], bad, out=bad)
            dq = good * t
            dq -= np.matmul(bad, tn, out=other)
            dq[:, -1] = 0
            np.multiply(dq.reshape(flat), of_last, out=g1)
            np.multiply(dq.reshape(flat), of_before, out=g2)
            np.multiply(good, q, out=g[2 * wide : 3 * wide])
            np.matmul(bad.T, q, out=g[3 * wide :])
            np.negative(g[3 * wide :], out=g[3 * wide :])
            at, sums = places.sums(k, g, 2 * wide)
            square = table_seen.take(at, axis=0)
            square += sums * sums
            seen_rows[at] = square.view(row).ravel()
            np.sqrt(square, out=square)
            np.divide(sums, square, out=sums)
            sums *= rate
            sums += table.take(at, axis=0)
            table_rows[at] = sums.view(row).ravel()
            np.einsum("ij,ij->j", dq, r1, out=by_context[0])
            np.einsum("ij,ij->j", dq, r2, out=by_context[1])
            step = by_context[:, :-1]
            c_seen[:] += step * step
            c[:, :-1] += rate * step / np.sqrt(c_seen)

    for begin in range(0, n, BATCH * TOGETHER):
        some = order[begin : begin + BATCH * TOGETHER]
        packed, w = triples[some], weights[some].astype(np.float32) * scale
        rest = packed // size
        before = rest // size
        found = (packed - rest * size, rest - before * size, before, w)
        full, batches = len(some) // BATCH, -(-len(some) // BATCH)
        drawn = np.minimum(np.searchsorted(cumulated, rng.random((batches, NOISE)) * cumulated[-1], side="right"), size - 2)
        if full:
            pass_over(*(x[: full * BATCH].reshape(full, BATCH) for x in found), drawn[:full])
        if full < batches:
            pass_over(*(x[full * BATCH :][None, :] for x in found), drawn[full:])
    for x, rows in ((p, table), (seen, table_seen)):
        x["context"][:], x["target"][:], x["bias"][:] = rows[:size, :-1], rows[size:, :-1], rows[size:, -1]
    p["c1"][:], p["c2"][:] = c[:, :-1]
    seen["c1"][:], seen["c2"][:] = c_seen


class _Numbers:
    """Words to numbers: i for the frequent word i, -1 - class for any other."""

    def __init__(self, frequent: pa.Array, sizes: Sizes):
        self.frequent, self.sizes = frequent, sizes
        self.classes = sizes.classes_of(frequent)

    def of(self, words: pa.Array) -> np.ndarray:
        number = pc.fill_null(pc.index_in(words, value_set=self.frequent), -1).to_numpy().astype(np.int64)
        others = np.flatnonzero(number < 0)
        number[others] = -1 - self.sizes.classes_of(words.take(pa.array(others)))
        return number

    def classed(self, number: np.ndarray) -> np.ndarray:
        """Frequent words beyond the model's own get their class."""
        beyond = number >= self.sizes.words
        out = number.copy()
        out[beyond] = -1 - self.classes[number[beyond]]
        return out


def _sequence(number: np.ndarray, n: np.ndarray, sizes: Sizes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, last, target) of each token; n: words of each text, which an end token follows."""
    ends = np.cumsum(n + 1) - 1
    target = np.full(int((n + 1).sum()), sizes.end, np.int64)
    inner = np.ones(len(target), bool)
    inner[ends] = False
    model = np.where(number >= sizes.words, 0, number)
    target[inner] = np.where(number < 0, -1 - number, model)
    last = np.concatenate([[sizes.begin], target[:-1]])
    before = np.concatenate([[sizes.begin, sizes.begin], target[:-2]])[: len(target)]
    begins = ends - n
    last[begins] = sizes.begin
    before[begins] = sizes.begin
    before[np.minimum(begins + 1, len(target) - 1)[n > 0]] = sizes.begin
    return before, last, target


def contexts(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """(triples, counts): int64 arrays of distinct contexts of a partition, BLOCK at most in a row, and
    their counts as the shortest unsigned integers that hold them all."""
    held = docs.sparkSession.sparkContext.broadcast(model.words())
    sizes = model.sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(held.value, sizes)
        packed, kept, counts, open_size = [], np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(packed), return_counts=True)
            both = np.concatenate([kept, new])
            order = np.argsort(both, kind="stable")  # two sorted runs: this merges them
            both = both[order]
            first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
            ids, total = both[first], np.add.reduceat(np.concatenate([counts, n])[order], first)
            return ids, total

        for batch in batches:
            for some in _pieces(batch):
                words, at, n = _words(some.column(0))
                before, last, target = _sequence(numbers.classed(numbers.of(words))[at], n, sizes)
                packed.append((before * sizes.size + last) * sizes.size + target)
                open_size += len(target)
                if open_size > 2_000_000:
                    (kept, counts), packed, open_size = fold(), [], 0
        if packed:
            kept, counts = fold()
        # Dealt in a mixed order: a row is no range of contexts.
        order = np.random.default_rng(len(kept)).permutation(len(kept))
        for start in range(0, len(order), BLOCK):
            some = order[start : start + BLOCK]
            n = counts[some]
            n = n.astype(np.min_scalar_type(n.max()))
            yield pa.RecordBatch.from_arrays([pa.array([kept[some].tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["triples", "counts"])

    # A table of many small partitions is joined to the same shards as one of few.
    shards = max(1, math.ceil(model.tokens / SHARD))
    made = materialize(docs.select(text_of(text)).coalesce(shards).mapInArrow(run, "triples binary, counts binary"), "contexts")
    held.unpersist()
    return made.coalesce(shards)


def train(docs: DataFrame, model: Model, text: str = "text") -> Model:
    """Fit the parameters on all texts of docs."""
    table, noise = contexts(docs, model, text), model.unigram()
    p = _start(model.sizes.size)
    state = p | {f"{k}^2": np.full(x.shape, 1e-3, np.float32) for k, x in p.items()}
    for k in range(ROUNDS):
        state = _round(table, state, noise, k)
    model.parameters = {name: state[name] for name in p}
    return model


def _round(table: DataFrame, state: dict[str, np.ndarray], noise: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """The average, by weight, of what every task makes of the state in one pass over its contexts."""
    held = table.sparkSession.sparkContext.broadcast((state, noise))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, noise = held.value
        made = {k: x.copy() for k, x in begun.items()}
        p, seen = {k: x for k, x in made.items() if not k.endswith("^2")}, {k[:-2]: x for k, x in made.items() if k.endswith("^2")}
        some, open_size, weight = [], 0, 0

        def learn() -> None:
            nce(p, seen, np.concatenate([t for t, _ in some]), np.concatenate([c for _, c in some]), noise, seed)

        for batch in batches:
            for t, c in zip(batch.column(0), batch.column(1), strict=True):
                triples = np.frombuffer(t.as_buffer(), np.int64)
                some.append((triples, np.frombuffer(c.as_buffer(), f"u{len(c.as_buffer()) // len(triples)}")))
                open_size += len(triples)
                weight += int(some[-1][1].sum())
                if open_size >= PASSED:
                    learn()
                    some, open_size = [], 0
        if some:
            learn()
        if weight:
            yield pa.RecordBatch.from_arrays([pa.array(list(made)), pa.array([float(weight)] * len(made)), pa.array([x.tobytes() for x in made.values()], pa.binary())], names=["name", "weight", "x"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, list] = {}
        for batch in batches:
            for name, weight, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                one = total.setdefault(name, [0.0, 0.0])
                one[0] += weight
                one[1] = one[1] + weight * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array([w for w, _ in total.values()]), pa.array([(x / w).astype(np.float32).tobytes() for w, x in total.values()], pa.binary())], names=["name", "weight", "x"])

    schema = "name string, weight double, x binary"
    # A few arrays of SIZE * WIDTH numbers, whatever the input.
    found = table.mapInArrow(run, schema).repartition(len(state), "name").mapInArrow(mean, schema).collect()
    held.unpersist()
    return state | {r.name: np.frombuffer(bytes(r.x), np.float32).reshape(state[r.name].shape) for r in found}


class _Tables:
    """The vectors of the logits, and the log normaliser of each context in a square table."""

    def __init__(self, p: dict[str, np.ndarray], unigram: np.ndarray):
        with np.errstate(divide="ignore"):
            self.b = (p["bias"] + np.log(unigram)).astype(np.float32)
        self.last, self.before, self.target = p["context"] * p["c1"], p["context"] * p["c2"], p["target"]
        # By context (before, last): one product gives every sum over the vocabulary. Only this
        # table stays, and its parts are made by rows: others are as large as it is.
        of_last = self.last @ self.target.T
        of_last += self.b
        top_last = of_last.max(axis=1)
        of_last -= top_last[:, None]
        np.exp(of_last, out=of_last)
        self.z = np.empty_like(of_last)
        for i in range(0, len(self.z), 256):
            of_before = self.before[i : i + 256] @ self.target.T
            top_before = of_before.max(axis=1)[:, None]
            z = np.exp(of_before - top_before) @ of_last.T
            self.z[i : i + 256] = np.log(np.maximum(z, 1e-37)) + top_before + top_last[None, :]

    def log10(self, before: np.ndarray, last: np.ndarray, target: np.ndarray) -> np.ndarray:
        out = np.empty(len(target))
        for i in range(0, len(target), 1 << 15):
            x, y, t = before[i : i + (1 << 15)], last[i : i + (1 << 15)], target[i : i + (1 << 15)]
            logit = np.einsum("ij,ij->i", self.before[x] + self.last[y], self.target[t])
            out[i : i + (1 << 15)] = logit.astype(np.float64) + self.b[t] - self.z[x, y]
        return out / math.log(10)


def score(docs: DataFrame, model: Model, counts: DataFrame, learning, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    held, key = docs.sparkSession.sparkContext.broadcast((replace(model, frequent=[]), model.words())), uuid.uuid4().hex
    thin = docs.select(F.col(id_column), (~learning).alias("held_out"), text_of(text).alias("__mr_text"))
    names = [id_column, "held_out", "__mr_row", "n_tokens", "n_known", "base", "model", "rare"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        m, frequent = held.value
        numbers = _Numbers(frequent, m.sizes)
        known = remembered("tables", 1)
        if key not in known:
            known.clear()
            known[key] = _Tables(m.parameters, m.unigram())
        tables = known[key]
        log_count = np.log10(m.counts + 1.0)
        log_all = math.log10(m.tokens + m.distinct + 1)
        log_class = np.log10(m.class_tokens + m.class_distinct + 1.0)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for some in _pieces(batch, 2):
                words, at, n = _words(some.column(2))
                number = numbers.of(words)
                common, classed = number >= 0, numbers.classed(number)
                logs = np.where(common, log_count[np.maximum(number, 0)] if len(log_count) else 0.0, 0.0)
                share = logs.copy()  # a word's share of its class
                share[classed >= 0] = 0
                share[classed < 0] -= log_class[-1 - classed[classed < 0] - m.sizes.words]
                of = np.repeat(np.arange(len(n)), n)
                base = np.bincount(of, logs[at], len(n)) + math.log10(m.ends + 1) - (n + 1) * log_all
                before, last, target = _sequence(classed[at], n, m.sizes)
                whole = np.repeat(np.arange(len(n)), n + 1)
                found = np.bincount(whole, tables.log10(before, last, target), len(n)) + np.bincount(of, share[at], len(n))
                met = common[at]
                known = np.bincount(of, met, len(n)).astype(np.int64)
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n - known)]).astype(np.int32)), words.take(pa.array(at[~met])))
                known += m.ends > 0
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(np.arange(row, row + len(n))), pa.array(n + 1), pa.array(known), pa.array(base), pa.array(found), rare], names=names)
                row += len(n)

    kind = thin.schema[id_column].dataType.simpleString()
    half = materialize(thin.mapInArrow(run, f"`{id_column}` {kind}, held_out boolean, __mr_row long, n_tokens long, n_known long, base double, model double, rare array<string>"), "scores")
    # Words that the broadcast does not hold: their counts come from the table.
    cut = int(model.counts[-1]) if len(model.counts) else None
    others = counts.filter("word <> ''") if cut is None else counts.filter((F.col("word") != "") & (F.col("c") < cut))
    met = half.select("__mr_row", F.explode("rare").alias("word")).join(others, "word").groupBy("__mr_row").agg(F.count(F.lit(1)).alias("more"), F.sum(F.log10(F.col("c") + 1.0)).alias("logs"))
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return half.drop("rare").join(met, "__mr_row", "left").select(id_column, "held_out", "n_tokens", (F.col("n_known") + more).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs).alias("base_score"), (F.col("model") + logs).alias("score"))


def lm_scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text", modulus: int = 7, held_out: int = 2) -> DataFrame:
    """Learn from the rows whose id's crc32 is not held_out, modulo modulus, and score all."""
    learning = learned(id_column, modulus, held_out)
    chosen = docs.filter(learning)
    counts = materialize(count(chosen, text), "counts")
    model = train(chosen, summarize(counts), text)
    return score(docs, model, counts, learning, id_column, text)
