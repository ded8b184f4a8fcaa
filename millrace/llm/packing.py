"""Packing token sequences: concatenate and cut.

Pass 1 tokenises each document once, writes its ids with the running total inside its
partition, and so gives one total per partition. A prefix sum over those totals (one row per
partition) turns running totals into global offsets. Pass 2 cuts at the multiples of the
window: a document that crosses a boundary gives one record on either side of it.

Only the last sequence is not full: the padding of a whole corpus is below one window.

The stream follows the partitions of the written table and the rows in them. Tokenising
splits a text at ASCII white space and remembers the ids of the pieces, which is exact for
this tokenizer: its patterns never match across white space.

Defined cases: a null text is the empty text, that is one closing id; rows that repeat an id
are packed each by itself; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, remembered, text_of

#: Remembered pieces of text, per Python worker; above it the memory is emptied.
REMEMBERED = 1_000_000
#: Marks that close a word are pieces of their own: here the tokenizer's pattern splits as well.
_CLOSING = re.compile(rb"(?<=[a-z])([-,.!?;:*&%$#()]+)(?=\s|$)")
_TOKENIZERS: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _tokenizer(path: str | None):
    """(tokenizer, whether an id ends a word), one per worker."""
    path = path or default_tokenizer()
    if path not in _TOKENIZERS:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        vocabulary = tokenizer.get_vocab()
        ends = np.zeros(max(vocabulary.values()) + 1, bool)
        ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        _TOKENIZERS[path] = (tokenizer, ends)
    return _TOKENIZERS[path]


def _learn(pieces: list[bytes], tokenizer, ends: np.ndarray, known: dict[bytes, bytes]) -> None:
    """Remember the ids of new pieces. Words of letters are encoded as one text and told
    apart by the ids that end a word, if there is one such id for each."""
    texts = [p.decode() for p in pieces]
    plain = [i for i, t in enumerate(texts) if t.isalpha()]
    ids = np.array(tokenizer.encode(" ".join(texts[i] for i in plain), add_special_tokens=False).ids, "<u4")
    cut = (np.flatnonzero(ends[ids]) + 1) * 4
    if len(cut) == len(plain):
        raw, at = ids.tobytes(), 0
        for i, end in zip(plain, cut.tolist(), strict=True):
            known[pieces[i]] = raw[at:end]
            at = end
        rest = [i for i, t in enumerate(texts) if not t.isalpha()]
    else:
        rest = range(len(texts))
    found = tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)
    known.update((pieces[i], np.array(x.ids, "<u4").tobytes()) for i, x in zip(rest, found, strict=True))


def _pieces(text: str) -> list[bytes]:
    """Parts of a text that the tokenizer never joins; ASCII letters are lower case to it.
    A text that may hold a special token keeps its case and is split at white space only."""
    raw = text.encode()
    return raw.split() if b"<|" in raw else _CLOSING.sub(rb" \1", raw.lower()).split()


def encode(texts: list[str], path: str | None = None) -> list[bytes]:
    """The ids of each text, as unsigned 32-bit little-endian bytes."""
    tokenizer, ends = _tokenizer(path)
    known = remembered("packing", REMEMBERED)
    pieces = [_pieces(t) for t in texts]
    if new := list(set().union(*pieces).difference(known)):
        _learn(new, tokenizer, ends, known)
    return [b"".join(map(known.__getitem__, p)) for p in pieces]


def tokenized(docs: DataFrame, id_column: str = "doc_id", text: str = "text", end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """Pass 1: id, __mr_part, __mr_before (ids before it in its partition), __mr_n, __mr_ids."""
    thin = docs.select(F.col(id_column), text_of(text).alias("__mr_text"))
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                ids = [x + end for x in encode(some.column(1).to_pylist(), tokenizer)]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(before + np.cumsum(n) - n), pa.array(n), pa.array(ids, pa.binary())],
                    names=[id_column, "__mr_part", "__mr_before", "__mr_n", "__mr_ids"],
                )
                before += int(n.sum())

    kind = thin.schema[id_column].dataType.simpleString()
    return materialize(thin.mapInArrow(run, f"`{id_column}` {kind}, __mr_part int, __mr_before long, __mr_n long, __mr_ids binary"), "ids")


def pack(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, sequence_id, offset, ids (array of int)."""
    raw = pieces(tokenized(docs, id_column, text, end_id, tokenizer), id_column, window)

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.frombuffer(x, "<u4").astype(np.int32) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(pa.int32()))], names=[*batch.schema.names[:-1], "ids"])

    kind = raw.schema[id_column].dataType.simpleString()
    return raw.mapInArrow(ids, f"`{id_column}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids array<int>")


def pieces(table: DataFrame, id_column: str, window: int, digest: bool = False) -> DataFrame:
    """Pass 2. The last column is the piece's ids as bytes, or with digest their crc32."""
    totals = table.groupBy("__mr_part").agg(F.sum("__mr_n").alias("n"))
    # One row per partition of the written table: about 16 bytes for each 100 MB of text.
    at, bases = 0, []
    for part, n in sorted(map(tuple, totals.collect())):
        bases.append((part, at))
        at += n
    bases = table.sparkSession.createDataFrame(bases, "__mr_part int, __mr_base long")
    placed = table.join(F.broadcast(bases), "__mr_part").select(id_column, (F.col("__mr_base") + F.col("__mr_before")).alias("__mr_at"), "__mr_n", "__mr_ids")
    last = "ids_crc32" if digest else "__mr_piece"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 500):
                rows = batch.slice(some, 500)
                at, n = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                count = (at + n - 1) // window - at // window + 1
                row = np.repeat(np.arange(len(n)), count)
                k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                sequence = at[row] // window + k
                start = np.maximum(sequence * window, at[row]) - at[row]
                end = np.minimum((sequence + 1) * window, at[row] + n[row]) - at[row]
                ids = rows.column(3)
                views = [memoryview(ids[i].as_buffer()) for i in range(len(n))]
                cut = (views[i][4 * a : 4 * b] for i, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True))
                got = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if digest else pa.array([bytes(x) for x in cut], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0).take(pa.array(row)), pa.array(start), pa.array(end - start), pa.array(n[row]), pa.array(sequence), pa.array(at[row] + start - sequence * window), got],
                    names=[id_column, "start", "length", "doc_tokens", "sequence_id", "offset", last],
                )

    kind = table.schema[id_column].dataType.simpleString()
    return placed.mapInArrow(run, f"`{id_column}` {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, {last} {'long' if digest else 'binary'}")


def packed_digest(docs: DataFrame, id_column: str = "doc_id", text: str = "text", window: int = 2048, end_id: int = 1, tokenizer: str | None = None) -> DataFrame:
    """The pieces, with the crc32 of their ids in place of the ids."""
    found = pieces(tokenized(docs, id_column, text, end_id, tokenizer), id_column, window, digest=True)
    return found.select(id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
