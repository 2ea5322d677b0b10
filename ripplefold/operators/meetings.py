"""Pairs of token sequences that may be alike, found in Arrow batches: shingles, their order, prefixes and where they meet.

Every function here works on whole batches with numpy; text is touched once per distinct token and shingle of a slice.
A hash stands for a shingle's text. Shingles that share a hash only let more units meet, and each pair is judged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Slots in which shingles are counted, and slots to a block of them; tokens worked on at once; pairs judged at once, and
#: kept before repeated ones leave.
SLOT_BITS = 23
BLOCK = 8192
SLICE = 400_000
CHUNK = 65_536
MOST_WAITING = 4_000_000

Batches = Iterator[pa.RecordBatch]
_BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-spread bits of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column("tokens")), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SLICE, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def _windows(tokens: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """(row, hash of the text, first token) of each window of k tokens, and the tokens' texts.

    The hash is a polynomial over bytes, put together from those of the tokens, so it depends on the joined text alone.
    """
    lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode(null_encoding="encode")
    texts, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
    value, power = np.zeros(len(texts), np.uint64), np.ones(len(texts), np.uint64)
    for i, text in enumerate(texts):
        h, p = 0, 1
        for byte in (text or "").encode():
            h, p = (h * _BASE + byte + 1) & 0xFFFFFFFFFFFFFFFF, (p * _BASE) & 0xFFFFFFFFFFFFFFFF
        value[i], power[i] = h, p
    told = np.array([t is not None for t in texts], dtype=bool)
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
    at = np.flatnonzero(np.arange(len(row)) + k <= np.repeat(np.cumsum(lengths), lengths))
    joined, begun = np.zeros(len(at), np.uint64), np.zeros(len(at), bool)
    for j in range(k):
        c = code[at + j]
        more = joined * (power[c] * np.uint64(_BASE)) + np.uint64(33) * power[c] + value[c]
        joined = np.where(told[c], np.where(begun, more, value[c]), joined)
        begun |= told[c]
    return row[at], mixed(joined), at, [texts, code]


def _slot(gram: np.ndarray) -> np.ndarray:
    return (gram >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def counter(k: int) -> Callable[[Batches], Batches]:
    """(block, counts) of the shingles of a task's units, by slot."""

    def run(batches: Batches) -> Batches:
        held = np.zeros(1 << SLOT_BITS, np.uint32)
        for batch in batches:
            for part in _slices(batch):
                slots, n = np.unique(_slot(_windows(part.column("tokens"), k)[1]), return_counts=True)
                held[slots] += n.astype(np.uint32)
        blocks = held.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(1))
        for start in range(0, len(some), 64):
            these = some[start : start + 64]
            yield pa.RecordBatch.from_arrays([pa.array(these, pa.int32()), pa.array([blocks[i].tobytes() for i in these], pa.binary())], ["block", "counts"])

    return run


def summed(batches: Batches) -> Batches:
    """(block, codes): counts of each block summed over tasks, as codes of a byte that rise with the count."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts")):
            held[block] = held.get(block, np.zeros(BLOCK, np.int64)) + np.frombuffer(counts.as_buffer(), np.uint32)
    for block, n in held.items():
        coded = np.where(n < 128, n, np.minimum(255, 127 + np.ceil(np.log(np.maximum(n, 128) / 127.0) / np.log(1.1)))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([coded.tobytes()], pa.binary())], ["block", "codes"])


def decoded(codes: np.ndarray) -> np.ndarray:
    """A count that is as large as that of each code, or a little larger."""
    return np.where(codes < 128, codes, np.ceil(127 * 1.1 ** np.maximum(codes.astype(np.float64) - 127, 0))).astype(np.int64)


def preparer(codes: Callable[[], np.ndarray], k: int, width: int, least_shared: float, crowd: int) -> Callable[[Batches], Batches]:
    """(unit, cells, sides, w) of rows (unit, u, tokens): the cells of a unit's prefix and its fingerprint as 32-bit numbers.

    A cell is that of a shingle, or of two blocks of a shingle's holders where they may be more than ``crowd``.
    """

    def run(batches: Batches) -> Batches:
        table = codes()
        for batch in batches:
            for part in _slices(batch):
                row, gram, at, (texts, code) = _windows(part.column("tokens"), k)
                w = np.zeros((part.num_rows, width), np.int32)
                once, first, which = np.unique(gram, return_index=True, return_inverse=True)
                said = [texts[c] for c in code.tolist()]
                told = (said[i : i + k] for i in at[first].tolist())
                if None in texts:
                    told = ([t for t in x if t is not None] for x in told)
                marks = np.frombuffer(b"".join([hashlib.sha1(" ".join(x).encode()).digest()[:5] for x in told]), np.uint8).reshape(-1, 5).astype(np.int64)
                bucket = (marks[:, 0] << 24 | marks[:, 1] << 16 | marks[:, 2] << 8 | marks[:, 3]) % width
                np.add.at(w, (row, bucket[which]), np.where(marks[:, 4] & 1, 1, -1).astype(np.int32)[which])
                order = np.lexsort((gram, row))
                r, g = row[order], gram[order]
                begin = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (g[1:] != g[:-1])])) if len(r) else np.empty(0, np.int64)
                mass = np.diff(np.append(begin, len(r))) ** 2
                r, g = r[begin], g[begin]
                n = decoded(table[_slot(g)])
                order = np.lexsort((g, -n, r))
                r, g, n, mass = r[order], g[order], n[order], mass[order]
                run_of = np.cumsum(mass)
                rows_mass = np.bincount(r, mass, part.num_rows).astype(np.int64)
                rest = run_of - (np.cumsum(rows_mass) - rows_mass)[r]
                kept = (rest > least_shared**2 * rows_mass[r]) & (n > 1)
                r, g, blocks = r[kept], g[kept], -(-n[kept] // crowd)
                own = (mixed(part.column("u").to_numpy().view(np.uint64))[r] % blocks.astype(np.uint64)).astype(np.int64)
                again = np.repeat(np.arange(len(r)), blocks)
                other = np.arange(len(again)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                low, high = np.minimum(own[again], other), np.maximum(own[again], other)
                side = np.where(low == high, -1, own[again] == high).astype(np.int8)
                cell = mixed(g[again] + low.astype(np.uint64) * np.uint64(_BASE) + high.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(r[again], minlength=part.num_rows))]).astype(np.int32))
                out = [part.column("unit"), pa.ListArray.from_arrays(offsets, pa.array(cell)), pa.ListArray.from_arrays(offsets, pa.array(side)), pa.array([x.tobytes() for x in w], pa.binary())]
                yield pa.RecordBatch.from_arrays(out, ["unit", "cells", "sides", "w"]).filter(pa.array(w.any(1)))

    return run


def _weights(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), width)


def dealer(parts: int, width: int) -> Callable[[Batches], Batches]:
    """(unit, part, cells, sides, signs, ss, nnz): each unit once per part of its cells, with the signs of its fingerprint as bits."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            w = _weights(batch.column("w"), width)
            signs = np.packbits(np.concatenate([w > 0, w < 0], 1), axis=1)
            ss, nnz = (w.astype(np.int64) ** 2).sum(1), (w != 0).sum(1)
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("cells")).to_numpy())
            cell, side = (batch.column(c).flatten().to_numpy() for c in ("cells", "sides"))
            part = (cell.view(np.uint64) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(row * parts + part, kind="stable")
            key = (row * parts + part)[order]
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
            at, to = np.divmod(key[begin], parts)
            offsets = pa.array(np.append(begin, len(key)).astype(np.int32))
            short = (cell[order] >> 32).astype(np.int32)
            out = [batch.column("unit").take(pa.array(at)), pa.array(to, pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(short)), pa.ListArray.from_arrays(offsets, pa.array(side[order]))]
            yield pa.RecordBatch.from_arrays([*out, pa.array([signs[i].tobytes() for i in at], pa.binary()), pa.array(ss[at]), pa.array(nnz[at], pa.int64())], ["unit", "part", "cells", "sides", "signs", "ss", "nnz"])

    return run


def judge(threshold: float) -> Callable[[Batches], Batches]:
    """(a, b), a < b: pairs of one part that share a cell and can reach ``threshold``.

    Buckets of equal sign are all that adds to a product, and every other bucket that is not zero takes 1 at least from
    the square of its side; a bucket of opposite signs takes 1 at least from the product. That bounds the cosine from above.
    """

    def run(batches: Batches) -> Batches:
        taken = [x for x in batches if x.num_rows]
        if not taken:
            return
        table = pa.Table.from_batches(taken).sort_by("unit").combine_chunks()
        cells, sides, names, marks = (table.column(c).combine_chunks() for c in ("cells", "sides", "unit", "signs"))
        unit = np.repeat(np.arange(table.num_rows, dtype=np.int32), np.diff(cells.offsets.to_numpy()))
        cell, side = cells.flatten().to_numpy(), sides.flatten().to_numpy()
        order = np.argsort(cell, kind="stable")
        cell, side, unit = cell[order], side[order], unit[order]
        last = np.append(np.flatnonzero(cell[1:] != cell[:-1]), len(cell) - 1)
        end = np.repeat(last, np.diff(last, prepend=-1))
        signs = np.frombuffer(b"".join(marks.to_pylist()), np.uint64).reshape(table.num_rows, -1)
        plus, minus = np.array_split(signs, 2, axis=1)
        ss, nnz = (table.column(c).to_numpy() for c in ("ss", "nnz"))
        free, length = (ss - nnz).astype(np.float64), np.sqrt(ss.astype(np.float64))
        count = lambda x: np.bitwise_count(x).sum(1, dtype=np.int32)
        known, pending, waiting, step = np.empty(0, np.int64), [], 0, 0
        at = np.arange(len(cell))
        while True:
            step += 1
            at = at[at + step <= end[at]]
            if not len(at):
                break
            for some in np.array_split(at, -(-len(at) // CHUNK)):
                apart = (side[some] < 0) | (side[some] != side[some + step])
                a, b = unit[some[apart]], unit[some[apart] + step]
                same = count(plus[a] & plus[b]) + count(minus[a] & minus[b])
                against = count(plus[a] & minus[b]) + count(minus[a] & plus[b])
                kept = np.sqrt((free[a] + same) * (free[b] + same)) - against >= threshold * (1 - 1e-9) * length[a] * length[b]
                pending.append(a[kept].astype(np.int64) * table.num_rows + b[kept])
                waiting += len(pending[-1])
                if waiting > MOST_WAITING:
                    known, pending, waiting = np.unique(np.concatenate([known, *pending])), [], 0
        known = np.unique(np.concatenate([known, *pending]))
        for start in range(0, len(known), CHUNK):
            a, b = np.divmod(known[start : start + CHUNK], table.num_rows)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b))], ["a", "b"])

    return run


def products(width: int) -> Callable[[Batches], Batches]:
    """(a, b, dot, saa, sbb) of rows (a, b, wa, wb), in whole numbers."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            wa, wb = (_weights(batch.column(c), width).astype(np.int64) for c in ("wa", "wb"))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *(pa.array(x.sum(1)) for x in (wa * wb, wa * wa, wb * wb))], ["a", "b", "dot", "saa", "sbb"])

    return run
