"""The k most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are turned by pseudo-random rotations (three rounds of random signs and a fast Hadamard
transform). A rotated vector is cut in halves; the nearest signed axis of each half is a digit, and two digits
make the bucket of one table; three or four, of two rotations, where the vectors are so many that two would leave
buckets too full, with more tables to keep the recall. Every vector enters its own bucket of each table and the buckets reached by
changing one digit to the next nearest axis, and meets all that enter the same. Each entry carries 128 sign
bits of other rotated coordinates, which drop nearly all chance meetings inside the bucket; cosines of the rest
are computed from the whole vectors, and the k best are kept.

Usable vectors are non-null, non-empty, finite and not all zero; others have no row. Vectors meet only inside
their group columns and with their own number of elements. Equal vectors are one class and meet once; a
crowded bucket is paired block against block. Ties are ordered by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplefold.durable import cut
from ripplefold.llm.hot import STRIDE, hot_keys
from ripplefold.operators.blocks import in_blocks

#: Digits of a bucket and tables up to each number of vectors; a digit of 128 axes has 256 values, so about 64 vectors
#: meet in a bucket at most on average. A table finds a pair of cosine 0.7 with probability 0.34, 0.2 or 0.11.
WIDTHS = ((1 << 22, 2, 7), (1 << 30, 3, 13), (1 << 62, 4, 24))
TABLES = WIDTHS[0][2]
#: Digits changed one at a time per table.
PROBES = 2
#: Differing sign bits of 128 up to which a meeting is looked at: at a cosine of 0.7 a bit differs with
#: probability 0.253, so 42 is two deviations above the mean; unrelated vectors pass once in ten thousand.
MOST_BITS = 42
#: Members above which a bucket is paired in blocks of about that size.
CROWD = 3000
#: Low half of ``place``, which holds a quarter of the sign bits; the high half is the bucket.
LOW = 0xFFFFFFFF


def _hadamard(n: int) -> np.ndarray:
    h = np.ones((1, 1), dtype=np.float32)
    while len(h) < n:
        h = np.block([[h, h], [h, -h]])
    return (h / np.sqrt(n)).astype(np.float32)


def _transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of rows whose length is a power of two, as a product of two smaller ones."""
    n, d = x.shape
    left = 1 << ((d.bit_length() - 1) // 2)
    right = d // left
    y = x.reshape(n * left, right) @ _hadamard(right)
    return np.matmul(_hadamard(left), y.reshape(n, left, right)).reshape(n, d)


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """Rows turned by the pseudo-random rotation ``seed``."""
    signs = np.random.default_rng(seed).integers(0, 2, size=(3, x.shape[1])).astype(np.float32) * 2 - 1
    for row in signs:
        x = _transform(x * row)
    return x


def digits(rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best, second, loss) signed axis of each half of the rows: axis * 2 + (1 if negative)."""
    n, d = rotated.shape
    halves = rotated.reshape(n, 2, d // 2)
    size = np.abs(halves)
    first = size.argmax(2)[..., None]
    top = np.take_along_axis(size, first, 2)
    np.put_along_axis(size, first, -1.0, 2)
    second = size.argmax(2)[..., None]
    near = np.take_along_axis(size, second, 2)

    def digit(axis: np.ndarray) -> np.ndarray:
        return (axis * 2 + (np.take_along_axis(halves, axis, 2) < 0))[..., 0]

    return digit(first), digit(second), (top - near)[..., 0]


def _pack(x: np.ndarray) -> pa.Array:
    """Rows of floats as binary, byte plane by byte plane, which compresses well where low bytes are empty."""
    planes = np.ascontiguousarray(x.astype("<f4")).view(np.uint8).reshape(len(x), x.shape[1], 4).transpose(0, 2, 1)
    data = np.ascontiguousarray(planes).tobytes()
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (4 * x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, floats) of packed rows, one length at a time."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        rows = data[offsets[at][:, None] + np.arange(size)[None, :]].reshape(len(at), 4, size // 4).transpose(0, 2, 1)
        yield at, np.ascontiguousarray(rows).view("<f4")[..., 0]


def _packer(whole: bool):
    """Usable rows of (id, g, vector): with the packed vector, or with two hashes of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(2)
            offsets = column.offsets.to_numpy()
            values = column.values.fill_null(np.float32("nan")).to_numpy(zero_copy_only=False)
            sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, np.diff(offsets))
            for d in np.unique(sizes[sizes > 0]):
                at = np.flatnonzero(sizes == d)
                x = values[offsets[at][:, None] + np.arange(d)[None, :]]
                fine = np.isfinite(x).all(1) & (x != 0).any(1)
                keep = pa.array(at[fine])
                packed = _pack(x[fine])
                head = [batch.column(0).take(keep), batch.column(1).take(keep)]
                if whole:
                    yield pa.RecordBatch.from_arrays([*head, packed], ["id", "g", "v"])
                else:
                    both = [xxhash.xxh3_128_digest(row.as_buffer()) for row in packed]
                    halves = np.frombuffer(b"".join(both), dtype=np.int64).reshape(-1, 2)
                    yield pa.RecordBatch.from_arrays([*head, pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))], ["id", "g", "h1", "h2"])

    return run


def width_for(n: int) -> tuple[int, int]:
    """(digits of a bucket, tables) for a number of vectors."""
    return next((digits_, tables) for most, digits_, tables in WIDTHS if n <= most)


def _hasher(tables: int, probes: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, group = batch.column(0), batch.column(1).to_numpy()
            for at, x in _by_length(batch.column(2)) if batch.num_rows else ():
                d = x.shape[1]
                x = x / np.linalg.norm(x.astype(np.float64), axis=1)[:, None].astype(np.float32)
                wide = 1 << max(2, (d - 1).bit_length())
                x = np.pad(x, ((0, 0), (0, wide - d))).astype(np.float32)
                yield from _rows(ids.take(pa.array(at)), group[at], x, tables, probes)

    def _rows(ids: pa.Array, group: np.ndarray, x: np.ndarray, tables: int, probes: int) -> Iterator[pa.RecordBatch]:
        n = len(x)
        every = np.arange(n)
        wide = min(128, x.shape[1])
        bits = np.concatenate([rotate(x, 1_000_003 + i)[:, :wide] > 0 for i in range(-(-128 // wide))], axis=1)[:, :128]
        packed = np.packbits(bits, axis=1)
        near = pa.array(np.ascontiguousarray(packed[:, :8]).view(np.int64)[:, 0])
        last = pa.array(np.ascontiguousarray(packed[:, 12:]).view(np.int32)[:, 0])
        rest = np.ascontiguousarray(packed[:, 8:12]).view(np.uint32)[:, 0].astype(np.uint64)
        for table in range(tables):
            turned = [digits(rotate(x, table + 10_000 * i)) for i in range(-(-parts // 2))]
            best, second, loss = (np.concatenate(same, axis=1)[:, :parts] for same in zip(*turned))
            weights = np.uint64(x.shape[1]) ** np.arange(parts - 1, -1, -1, dtype=np.uint64)
            order = np.argsort(loss, axis=1)
            found = [best.astype(np.uint64) @ weights]
            for probe in range(min(probes, parts)):
                half = order[:, probe]
                changed = best.copy()
                changed[every, half] = second[every, half]
                found.append(changed.astype(np.uint64) @ weights)
            for cell in found:
                spread = (group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(table)) * np.uint64(0xBF58476D1CE4E5B9) + cell
                spread = (spread ^ (spread >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array((((spread >> np.uint64(32)) << np.uint64(32)) | rest).view(np.int64)), near, last],
                    ["id", "place", "near", "last"],
                )

    return run


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of pairs of the same group; as a join condition the group would move the vectors once more."""
    for batch in batches:
        same = pc.equal(batch.column(4), batch.column(5))
        batch = batch.filter(same)
        if not batch.num_rows:
            continue
        out = np.zeros(batch.num_rows)
        for (at, a), (_, b) in zip(_by_length(batch.column(2)), _by_length(batch.column(3))):
            a, b = a.astype(np.float64), b.astype(np.float64)
            out[at] = (a * b).sum(1) / np.sqrt((a * a).sum(1) * (b * b).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "cosine"])


def usable(df: DataFrame, key: str, vector: str, by: list[str], whole: bool = True) -> DataFrame:
    """Rows with a usable vector: (id, g, v), v packed, or (id, g, h1, h2), two hashes of it.

    g is the hash of the group columns and the length.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(*by, F.size(vector)).alias("g"), F.col(vector).cast("array<float>").alias("v"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_packer(whole), f"id {kind}, g bigint, " + ("v binary" if whole else "h1 bigint, h2 bigint"))


def classes(marked: DataFrame) -> DataFrame:
    """(id, class_id) of (id, g, h1, h2): equal vectors of a group share the smallest of their ids."""
    least = marked.groupBy("g", "h1", "h2").agg(F.min("id").alias("class_id"))
    return marked.join(least, ["g", "h1", "h2"]).select("id", "class_id").distinct()


def _meetings(most_bits: int):
    """Pairs (a, b), a < b, of entries of the same bucket; entries come in order of their bucket.

    Entries are compared at growing distances inside the runs of equal buckets, a block at a time; a run cut
    by the end of a batch waits for the next one. Where entries have a side, as ``in_blocks`` gives it, only those
    of different sides meet, and all of side -1.
    """

    def met(ids: np.ndarray, place: np.ndarray, near: np.ndarray, last: np.ndarray, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        cell, found, step = place >> 32, [], 1
        at = np.arange(len(ids) - 1)
        while len(at := at[at + step < len(ids)]) and len(at := at[cell[at] == cell[at + step]]):
            to = at + step
            apart = np.bitwise_count((near[at] ^ near[to]).view(np.uint64)).astype(np.int64) + np.bitwise_count((place[at] ^ place[to]) & LOW) + np.bitwise_count((last[at] ^ last[to]).view(np.uint32))
            good = (apart <= most_bits) & (ids[at] != ids[to])
            if side is not None:
                good &= (side[at] < 0) | (side[at] != side[to])
            found.append(np.stack([np.minimum(ids[at[good]], ids[to[good]]), np.maximum(ids[at[good]], ids[to[good]])], axis=1))
            step += 1
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), ids.dtype)
        return pairs[:, 0], pairs[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if waiting is not None:
                columns = [np.concatenate(both) for both in zip(waiting, columns)]
            cell = columns[1] >> 32
            end = int(np.searchsorted(cell, cell[-1]))
            waiting = [c[end:] for c in columns]
            if end:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in met(*(c[:end] for c in columns))], ["a", "b"])
        if waiting is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in met(*waiting)], ["a", "b"])

    return run


def candidates(vectors: DataFrame, tables: int = TABLES, probes: int = PROBES, most_bits: int = MOST_BITS, crowd: int = CROWD, parts: int = 2) -> DataFrame:
    """(a, b), a < b: pairs of different vectors that meet in a bucket and agree in enough sign bits.

    Entries are shuffled once, by bucket, and paired in order of it; ids are integers.
    """
    schema = "id bigint, place bigint, near bigint, last int"
    entries = vectors.mapInArrow(_hasher(tables, probes, parts), schema)
    cell = F.shiftright("place", 32)
    some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(STRIDE)) == 0).mapInArrow(_hasher(tables, probes, parts), schema)
    hot = hot_keys(some.select("id", cell.alias("cell")), "cell", "id", crowd)
    if hot.isEmpty():
        return _meet(entries, most_bits).distinct()
    hot = cut(hot).df
    found = _meet(entries.join(hot, cell == F.col("cell"), "left_anti"), most_bits)
    dealt = in_blocks(entries.join(hot, cell == F.col("cell")).drop("cell"), cell, "id", F.col("blocks"))
    place = F.shiftleft("cell", 32).bitwiseOR(F.col("place").bitwiseAND(LOW))
    found = found.unionByName(_meet(dealt.withColumn("place", place), most_bits, "side"))
    return found.distinct()


def _meet(entries: DataFrame, most_bits: int, *side: str) -> DataFrame:
    placed = entries.select("id", "place", "near", "last", *side).repartition(F.shiftright("place", 32)).sortWithinPartitions("place")
    return placed.mapInArrow(_meetings(most_bits), "a bigint, b bigint")


def similar(vectors: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of the given pairs, from the whole vectors; pairs of different groups fall out."""
    kind = vectors.schema["id"].dataType.simpleString()
    left = vectors.select(F.col("id").alias("a"), F.col("g"), F.col("v").alias("va"))
    right = vectors.select(F.col("id").alias("b"), F.col("g").alias("h"), F.col("v").alias("vb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "va", "vb", "g", "h")
    return both.mapInArrow(_cosines, f"a {kind}, b {kind}, cosine double")


def nearest(df: DataFrame, key: str, vector: str, by: list[str], k: int = 3, least: float = -1.0) -> DataFrame:
    """(id, other, cosine, rank): up to k most similar others of every usable vector, cosine ``least`` or more.

    Among equal vectors and equal cosines the smaller id comes first. A class of equal vectors contributes at
    most its k + 1 smallest ids to any list, which is all that a list of k can use.
    """
    written = cut(classes(usable(df, key, vector, by, False)), F.count(F.when(F.col("id") == F.col("class_id"), 1)).alias("n"))
    members = written.df
    parts, tables = width_for(written.metrics["n"])
    heads = members.where("id = class_id").select("id")
    vectors = usable(df, key, vector, by).join(heads, "id", "left_semi").dropDuplicates(["id"])
    near = similar(vectors, candidates(vectors, tables, parts=parts)).where(F.col("cosine") >= least)
    directed = near.select(F.inline(F.array(F.struct("a", "b", "cosine"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))))
    best = W.partitionBy("a").orderBy(F.desc("cosine"), "b")
    directed = directed.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")
    first = W.partitionBy("class_id").orderBy("id")
    some = members.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).select("class_id", F.col("id").alias("other"))
    own = members.join(some, "class_id").where("id <> other").select("id", "other", F.lit(1.0).alias("cosine"))
    across = members.join(directed.withColumnRenamed("a", "class_id"), "class_id").join(some.withColumnRenamed("class_id", "b"), "b").select("id", "other", "cosine")
    ranked = own.unionByName(across).withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("cosine"), "other")))
    return ranked.where(F.col("rank") <= k)


def pairs(df: DataFrame, key: str, vector: str, by: list[str], k: int = 3, least: float = 0.7, names: tuple[str, str] = ("fp_a", "fp_b")) -> DataFrame:
    """Distinct pairs, smaller id first, of which one is among the other's k most similar."""
    found = nearest(df, key, vector, by, k, least)
    return found.select(F.least("id", "other").alias(names[0]), F.greatest("id", "other").alias(names[1])).distinct()
