"""Token counters: exact by a byte-level vocabulary where one can be loaded, else an upper estimate.

A counter is a function from a column to a column, so plans take either.
"""

from __future__ import annotations

import base64
import logging
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplefold.functions.text import estimated_tokens

#: Fixed value: the splitting pattern of vocabularies whose file does not name one.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LOADED: dict[tuple[str, str], object] = {}


def _encoding(path: str, pieces: str):
    """The encoding of a rank file, loaded once per process."""
    if (path, pieces) not in _LOADED:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _LOADED[path, pieces] = tiktoken.Encoding(path, pat_str=pieces, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pieces]


def exact_tokens(path: str, pieces: str = PIECES) -> Callable[[Column], Column]:
    """A counter by the rank file at ``path``, which every executor must be able to read; null texts count as null."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoding(path, pieces).encode_ordinary
        return pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return lambda text: count(text.cast("string"))


def token_counter(path: str | None, pieces: str = PIECES) -> Callable[[Column], Column]:
    """The exact counter, or ``estimated_tokens`` where the vocabulary cannot be loaded; which one is logged."""
    log = logging.getLogger(__name__)
    if path:
        try:
            _encoding(path, pieces)
            return exact_tokens(path, pieces)
        except (OSError, ValueError, ImportError) as reason:
            log.warning("no exact token counts, as %s cannot be loaded: %s", path, reason)
    else:
        log.info("no vocabulary named; tokens are estimated")
    return estimated_tokens
