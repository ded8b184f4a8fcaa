"""Token counts by a byte-pair vocabulary file (base64 token and rank per line)."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_LOADED: dict[str, object] = {}


def encoding(path: str, pattern: str):
    """The encoding of a vocabulary file, loaded once per worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        _LOADED[path] = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def counter(path: str | None = None, pattern: str | None = None) -> Callable[[Column], Column]:
    """A column function that counts tokens; strings of special tokens are ordinary text.

    The file has to be on every machine; without a path it is that of the public tokenizers."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        import public_tokenizers

        e = encoding(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
        return texts.map(lambda t: 0 if t is None else len(e.encode_ordinary(t)))

    return run
