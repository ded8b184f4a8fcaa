"""Token counts: trie-shared dynamic programming over a unigram vocabulary.

A text splits into words; the pre-token of a word is the word behind the vocabulary's word
mark. A pre-token's segmentation is the one with the highest sum of piece scores. The
distinct pre-tokens of a task are inserted in a trie. A node holds the forward state of its
prefix (best score, pieces, open walks through the vocabulary), computed when the node is
made, so once per shared prefix; the node that ends a pre-token stores its count. A task's
slices share the trie; above NODES nodes it begins anew.

The scores of pieces are a parameter. The vocabulary file holds merge ranks and no unigram
scores, and tokenizers are not trained here, so by default the score of a piece is that of
its rank under Zipf's law, -ln(rank + ZIPF). A character without a piece falls back to one
piece for each of its UTF-8 bytes, each at the score FALLBACK below the least piece. Of equal
scores the segmentation of fewer pieces counts.

Nothing is shuffled: a task needs only its own texts and the vocabulary (a file on every
machine).

Defined cases: a null or empty text has no words and no tokens; rows that repeat an id are
counted each by itself; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import gc
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remembered, text_of

ZIPF = 10.0
FALLBACK = -5.0
MARK = "▁"
#: Counts that a worker remembers, and nodes of its trie (about 500 bytes each).
REMEMBERED, NODES = 800_000, 300_000
_VOCABULARIES: dict[str, PieceTrie] = {}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def scores(path: str) -> dict[str, float]:
    """The score of every ordinary piece of a vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return {model.id_to_piece(i): -math.log(rank + ZIPF) for rank, i in enumerate(usual)}


class PieceTrie:
    """The vocabulary as nested dicts, letter by letter; a piece's score stands at the key ''."""

    def __init__(self, of: dict[str, float]):
        self.root: dict = {}
        self.unknown = min(of.values(), default=0.0) + FALLBACK
        for piece, score in of.items():
            node = self.root
            for letter in piece:
                node = node.setdefault(letter, {})
            node[""] = score


class Forward:
    """A trie of pre-tokens. A node: best score, fewest pieces, open walks (vocabulary node,
    score and pieces where the walk began), children by letter or None, stored count or None."""

    def __init__(self, vocabulary: PieceTrie):
        self.vocabulary, self.unknown = vocabulary.root, vocabulary.unknown
        self.root: list = [0.0, 0, (), {}, None]
        self.size = 1

    def insert(self, token: str) -> tuple[int, float]:
        """(pieces, score) of the best segmentation of a pre-token."""
        node = self.root
        for i, letter in enumerate(token):
            children = node[3]
            if children is None or letter not in children:
                node = self._grown(node, token[i:])
                break
            node = children[letter]
        if node[4] is None:
            node[4] = (node[1], node[0])
        return node[4]

    def _grown(self, node: list, letters: str) -> list:
        """The last of new nodes for these letters, each with the forward state one letter on."""
        start, unknown = self.vocabulary, self.unknown
        for letter in letters:
            score, pieces, open_walks, children, _ = node
            # The fallback ends at this letter; any piece that ends here may be better.
            n = 1 if letter < "\x80" else len(letter.encode())
            best, fewest = score + n * unknown, pieces + n
            walks = []
            for place, at, k in open_walks:
                place = place.get(letter)
                if place is not None:
                    walks.append((place, at, k))
                    if "" in place:
                        total = at + place[""]
                        if total > best or total == best and k + 1 < fewest:
                            best, fewest = total, k + 1
            place = start.get(letter)
            if place is not None:
                walks.append((place, score, pieces))
                if "" in place:
                    total = score + place[""]
                    if total > best or total == best and pieces + 1 < fewest:
                        best, fewest = total, pieces + 1
            made = [best, fewest, walks, None, None]
            if children is None:
                node[3] = {letter: made}
            else:
                children[letter] = made
            node = made
        self.size += len(letters)
        return node


def _vocabulary(path: str | None, of: dict[str, float] | None) -> PieceTrie:
    if of is not None:
        return PieceTrie(of)
    path = path or default_vocabulary()
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = PieceTrie(scores(path))
    return _VOCABULARIES[path]


def token_counts(docs: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str | None = None, piece_scores: dict[str, float] | None = None) -> DataFrame:
    """id, n_words, n_tokens, score (of the best segmentation, rounded to 1e-6) of every document.

    piece_scores: the unigram score of each piece, in place of a vocabulary file."""
    thin = docs.select(F.col(id_column), text_of(text).alias("__mr_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _vocabulary(vocabulary, piece_scores)
        trie, known = Forward(pieces), {}
        gc.disable()  # tries hold no cycles, and a worker's collector would visit their nodes again and again
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                some = batch.slice(start, 500)
                words = [t.encode().split() for t in some.column(1).to_pylist()]
                if piece_scores is None:
                    known = remembered("token_counts", REMEMBERED)
                elif len(known) > REMEMBERED:
                    known.clear()
                if trie.size > NODES:
                    trie = Forward(pieces)
                known.update((w, trie.insert(MARK + w.decode())) for w in sorted(set().union(*words).difference(known)))
                n = np.fromiter(map(len, words), np.int64, len(words))
                found = np.array([known[w] for ws in words for w in ws], np.float64).reshape(-1, 2)
                row = np.repeat(np.arange(len(n)), n)
                tokens, total = (np.bincount(row, found[:, k], len(n)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n), pa.array(tokens.astype(np.int64)), pa.array(np.round(total, 6))], names=[id_column, "n_words", "n_tokens", "score"])

    return thin.mapInArrow(run, f"`{id_column}` {thin.schema[id_column].dataType.simpleString()}, n_words long, n_tokens long, score double")
