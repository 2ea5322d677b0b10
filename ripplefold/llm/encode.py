"""Encoding of texts by a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's splitting pattern. Each piece starts as single bytes; a segment
tree over adjacent pairs holds, for each pair, its merge rank and position in one integer, so the root is the
leftmost pair of lowest rank. A merge is three point updates of logarithmic cost; the piece is done when the
root holds no mergeable pair. Pieces recur, so each Python worker keeps the ids of pieces it has met and the
tree runs once per distinct piece and worker.

Null and empty texts have no ids. Texts are encoded whole, however long; a piece of n bytes costs
O(n log n).
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The splitting pattern of the byte-level vocabulary, and its form for texts of ASCII only,
#: where letters, digits and white space are known ranges and the standard engine is twice as fast.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PIECES = (
    r" ?[A-Za-z]+| ?[0-9]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^A-Za-z0-9 \t\n\x0b\x0c\r]+"
    r"|[ \t\n\x0b\x0c\r]+(?![^ \t\n\x0b\x0c\r])|[ \t\n\x0b\x0c\r]+"
)

#: Pieces kept by a worker before it forgets them all; it bounds memory, not results.
REMEMBERED = 400_000


def default_vocabulary() -> str:
    """Path of the installed byte_bpe_50k ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id; the id is also the rank of the merge that makes the token."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class PairTree:
    """Segment tree of minima over keys ``rank * width + position``; ``NONE`` marks no mergeable pair."""

    NONE = 1 << 62

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, (len(keys) - 1).bit_length())
        self.tree = [self.NONE] * self.size + keys + [self.NONE] * (self.size - len(keys))
        tree = self.tree
        for node in range(self.size - 1, 0, -1):
            left, right = tree[2 * node], tree[2 * node + 1]
            tree[node] = left if left < right else right

    def root(self) -> int:
        return self.tree[1]

    def put(self, position: int, key: int) -> None:
        tree, node = self.tree, position + self.size
        tree[node] = key
        node >>= 1
        while node:
            left, right = tree[2 * node], tree[2 * node + 1]
            low = left if left < right else right
            if tree[node] == low:
                return
            tree[node] = low
            node >>= 1


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    width = len(piece)
    if width < 2:
        return [ranks[piece]] if piece else []
    none, rank_of = PairTree.NONE, ranks.get
    ends = list(range(1, width + 1))  # end of the part that starts at each position
    before = list(range(-1, width - 1))  # start of the part before

    def key(start: int) -> int:
        middle = ends[start]
        if middle >= width:
            return none
        rank = rank_of(piece[start : ends[middle]])
        return none if rank is None else rank * width + start

    tree = PairTree([key(start) for start in range(width - 1)])
    while (low := tree.root()) != none:
        start = low % width
        gone = ends[start]
        end = ends[start] = ends[gone]
        if end < width:
            before[end] = start
        if gone < width - 1:
            tree.put(gone, none)
        tree.put(start, key(start))
        if before[start] >= 0:
            tree.put(before[start], key(before[start]))
    ids, start = [], 0
    while start < width:
        ids.append(ranks[piece[start : ends[start]]])
        start = ends[start]
    return ids


class Encoder:
    """Texts to packed 32-bit ids, remembering pieces."""

    def __init__(self, path: str):
        import regex

        ranks = read_ranks(path)

        class Remembered(dict):
            def __missing__(self, piece: str) -> bytes:
                packed = array("i", merge_piece(piece.encode("utf-8", "surrogatepass"), ranks)).tobytes()
                if len(piece) <= 64:
                    if len(self) >= REMEMBERED:
                        self.clear()
                    self[piece] = packed
                return packed

        self.packed = Remembered()
        self.ascii_pieces = re.compile(ASCII_PIECES).findall
        self.pieces = regex.compile(PIECES).findall

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces = self.ascii_pieces(text) if text.isascii() else self.pieces(text)
        return b"".join(map(self.packed.__getitem__, pieces))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary, made once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _mapper(path: str, text: str, keep: list[str], lengths_only: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch in batches:
            packed = list(map(encode, batch.column(text).to_pylist()))
            lengths = array("i", [len(ids) >> 2 for ids in packed])
            if lengths_only:
                last = pa.array(lengths, pa.int32())
            else:
                offsets = array("i", [0])
                total = 0
                for n in lengths:
                    total += n
                    offsets.append(total)
                values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(packed))])
                last = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(name) for name in keep), last], [*keep, "out"])

    return run


def token_ids(df: DataFrame, key: str, text: str = "text", vocabulary: str | None = None, ids: str = "ids") -> DataFrame:
    """One row (key, ids) for each row of ``df``; ids is a list of 32-bit integers without special tokens.

    Null and empty texts give an empty list; repeated rows give repeated results; other columns are ignored,
    so their names cannot clash. No shuffle: it is one Arrow pass over the scan.
    """
    path = vocabulary or default_vocabulary()
    rows = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([rows.schema["k"], T.StructField("out", T.ArrayType(T.IntegerType(), False), False)])
    return rows.mapInArrow(_mapper(path, "t", ["k"], False), schema).select(F.col("k").alias(key), F.col("out").alias(ids))


def token_counts(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None, count: str = "n_tokens") -> DataFrame:
    """The ``keep`` columns of each row with the number of its ids; 0 for null and empty texts."""
    path = vocabulary or default_vocabulary()
    names = [f"k{i}" for i in range(len(keep))]
    rows = df.select(*(F.col(name).alias(short) for name, short in zip(keep, names)), F.col(text).cast("string").alias("t"))
    schema = T.StructType([*(rows.schema[short] for short in names), T.StructField("out", T.IntegerType(), False)])
    counted = rows.mapInArrow(_mapper(path, "t", names, True), schema)
    return counted.select(*(F.col(short).alias(name) for name, short in zip(keep, names)), F.col("out").cast("long").alias(count))
