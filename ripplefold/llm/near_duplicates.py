"""Near-duplicate token sequences by HyperMinHash.

A sequence's set is its distinct runs of ``width`` tokens. Each of ``tables`` hash functions sends a run to one
of 16 buckets, and a bucket keeps the run of smallest hash as a 16-bit register: the count of leading zeros of
that hash (6 bits) and the mantissa bits after its leading one (10 bits). Registers of two sets agree with the
probability of their Jaccard similarity, but for accidental agreement, whose expectation is known and taken
off. Three registers make a 48-bit band; sequences that share a band are candidates, the corrected estimate
drops those far below the threshold, and the runs of the others are compared whole.

Every row is sketched where it is read, so tokens never move. Equal sequences, told by 128 bits of hash, are one class
with one representative (their smallest id), so copies meet once, not in pairs.
A band shared by a crowd of different sequences is paired block against block, so no pair of it is lost.

Sequences shorter than ``least_tokens`` or null take no part, nor do rows without a key. A null token counts as a token of its own.
Repeated rows count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.durable import cut
from ripplefold.llm.hot import hot_keys
from ripplefold.operators.blocks import in_blocks, met

#: Hash functions, each with 16 buckets; three registers a band. At a similarity of 0.5 a pair shares one of
#: the 48 bands with probability 0.998, at 0.6 with 0.99999.
TABLES = 9
BUCKETS = 16
ROWS = 3
#: Members above which a band is paired in blocks of about that size.
CROWD = 2000


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def token_hashes(tokens: pa.Array) -> np.ndarray:
    """A hash of each token; a null one has its own."""
    import xxhash

    coded = tokens.dictionary_encode()
    words = coded.dictionary.to_pylist()
    seeds = np.array([xxhash.xxh64_intdigest("\x00" if w is None else w, 7) for w in words] + [0x9E3779B97F4A7C15], dtype=np.uint64)
    codes = coded.indices.fill_null(len(words)).to_numpy(zero_copy_only=False).astype(np.int64)
    return _mix(seeds[codes])


def run_hashes(one: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of each row of token hashes, ordered by row and hash."""
    sizes = np.diff(offsets)
    runs = np.maximum(sizes - width + 1, 0)
    rows = np.repeat(np.arange(len(sizes)), runs)
    first = np.arange(len(rows)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(offsets[:-1], runs)
    hashed = np.zeros(len(rows), dtype=np.uint64)
    for step in range(width):
        hashed = _mix(hashed * np.uint64(0xD6E8FEB86659FD93) + one[first + step])
    order = np.lexsort((hashed, rows))
    rows, hashed = rows[order], hashed[order]
    if len(rows):
        new = np.concatenate([[True], (rows[1:] != rows[:-1]) | (hashed[1:] != hashed[:-1])])
        rows, hashed = rows[new], hashed[new]
    return rows, hashed


def registers(rows: np.ndarray, hashed: np.ndarray, n: int, tables: int) -> np.ndarray:
    """(n, tables * 16) HyperMinHash registers; an empty bucket holds 65535."""
    out = np.full((n, tables * BUCKETS), 65535, dtype=np.uint16)
    for table in range(tables):
        h = _mix(hashed ^ _mix(np.full(1, table + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)))
        cell = rows * BUCKETS + (h >> np.uint64(60)).astype(np.int64)
        low = np.full(n * BUCKETS, np.uint64(0xFFFFFFFFFFFFFFFF), dtype=np.uint64)
        np.minimum.at(low, cell, h & np.uint64((1 << 60) - 1))
        full = low != np.uint64(0xFFFFFFFFFFFFFFFF)
        value = (low[full] >> np.uint64(8)).astype(np.float64) + 1.0  # 52 bits, exact as a double
        bits = value.view(np.uint64)
        exponent = (bits >> np.uint64(52)).astype(np.int64) - 1023
        mantissa = ((bits >> np.uint64(42)) & np.uint64(1023)).astype(np.int64)
        packed = np.full(n * BUCKETS, 65535, dtype=np.uint16)
        packed[full] = np.minimum((52 - exponent) * 1024 + (1023 - mantissa), 65534)
        out[:, table * BUCKETS : (table + 1) * BUCKETS] = packed.reshape(n, BUCKETS)
    return out


def bands(regs: np.ndarray) -> np.ndarray:
    """(n, bands) 64-bit keys of three registers each, told apart by their place."""
    n, m = regs.shape
    parts = regs.reshape(n, m // ROWS, ROWS).astype(np.uint64)
    joined = parts @ (np.uint64(1) << (np.uint64(16) * np.arange(ROWS, dtype=np.uint64)))
    return _mix(joined ^ _mix(np.arange(1, m // ROWS + 1, dtype=np.uint64))[None, :]).view(np.int64)


def corrected(same: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Jaccard estimates from the number of equal and of filled registers.

    Two unrelated registers agree when the leading zeros and all mantissa bits do: for minima of like sized
    sets that is about 1 / (3 * 1024), summed over the geometric law of the leading zeros.
    """
    chance = 1 / (3 * 1024)
    filled = np.maximum(filled, 1)
    return np.clip((same / filled - chance) / (1 - chance), 0, 1)


def _sketcher(width: int, tables: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            if not batch.num_rows:
                continue
            lists, n = batch.column(1), batch.num_rows
            offsets = lists.offsets.to_numpy().astype(np.int64)
            one = token_hashes(lists.values.slice(offsets[0], offsets[-1] - offsets[0]))
            offsets -= offsets[0]
            whole = b"".join(xxhash.xxh3_128_digest(one[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:]))
            halves = np.frombuffer(whole, dtype=np.int64).reshape(n, 2)
            rows, hashed = run_hashes(one, offsets, width)
            regs = registers(rows, hashed, n, tables)
            runs = np.bincount(rows, minlength=n)
            keys = bands(regs)
            some = (runs > 0).astype(np.int32) * keys.shape[1]  # a sequence without a run is like nothing
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.ascontiguousarray(halves[:, 0])),
                    pa.array(np.ascontiguousarray(halves[:, 1])),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(runs)]).astype(np.int32)), pa.array(hashed.view(np.int64))),
                    pa.array([r.tobytes() for r in regs], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(some)]).astype(np.int32)), pa.array(keys[runs > 0].reshape(-1))),
                ],
                ["id", "h1", "h2", "runs", "regs", "bands"],
            )

    return run


def _estimator(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), dtype=np.uint16).reshape(batch.num_rows, -1) for i in (2, 3))
            both = (a != 65535) | (b != 65535)
            keep = corrected(((a == b) & both).sum(1), both.sum(1)) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return run


def sketches(df: DataFrame, key: str, tokens: str, least_tokens: int, width: int = 5, tables: int = TABLES) -> DataFrame:
    """(id, h1, h2, runs, regs, bands, row) of every usable row, written; ``row`` tells repeated rows apart."""
    rows = df.where((F.size(tokens) >= least_tokens) & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(tokens).cast("array<string>").alias("tokens"))
    kind = rows.schema["id"].dataType.simpleString()
    made = rows.mapInArrow(_sketcher(width, tables), f"id {kind}, h1 bigint, h2 bigint, runs array<bigint>, regs binary, bands array<bigint>")
    return cut(made.withColumn("row", F.monotonically_increasing_id())).df


def classes(sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, heads): (id, class_id) of every row once, and (row, class_id) of the one row that stands for a class.

    class_id is the smallest id of equal sequences; only ids and hashes are grouped, with partial minima.
    """
    least = sketched.groupBy("h1", "h2").agg(F.min(F.struct("id", "row")).alias("head"))
    members = sketched.select("id", "h1", "h2").join(least, ["h1", "h2"]).select("id", F.col("head.id").alias("class_id")).distinct()
    return members, cut(least.select("head.row", F.col("head.id").alias("class_id"))).df


def similar_heads(sketched: DataFrame, heads: DataFrame, least: float, tables: int = TABLES, crowd: int = CROWD) -> DataFrame:
    """(a, b, similarity), a < b by class: pairs of classes whose sets have a Jaccard similarity of ``least`` or more."""
    banded = sketched.select("row", "bands").join(heads.select("row"), "row", "left_semi").select(F.col("row").alias("id"), F.explode("bands").alias("key"))
    hot = hot_keys(banded, "key", "id", crowd)
    pairs = _meet(banded)
    if not hot.isEmpty():
        hot = cut(hot).df
        dealt = in_blocks(banded.join(hot, "key"), F.col("key"), "id", F.col("blocks"))
        pairs = _meet(banded.join(hot, "key", "left_anti")).unionByName(met(dealt, "id"))
    pairs = pairs.distinct()
    deviation = (least * (1 - least) / (tables * BUCKETS)) ** 0.5
    regs = sketched.select("row", "regs")
    rated = pairs.join(regs.toDF("a", "ra"), "a").join(regs.toDF("b", "rb"), "b").select("a", "b", "ra", "rb")
    likely = rated.mapInArrow(_estimator(max(0.0, least - 5 * deviation)), "a bigint, b bigint")
    runs = sketched.select("row", "runs")
    whole = likely.join(runs.toDF("a", "sa"), "a").join(runs.toDF("b", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    compared = whole.select("a", "b", shared.alias("shared"), (F.size("sa") + F.size("sb")).alias("both"))
    found = compared.where(F.col("shared") >= least * (F.col("both") - F.col("shared"))).select("a", "b", (F.col("shared") / (F.col("both") - F.col("shared"))).alias("similarity"))
    named = found.join(heads.toDF("a", "ca"), "a").join(heads.toDF("b", "cb"), "b")
    return named.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), "similarity")


def similar_classes(sequences: DataFrame, least: float, width: int = 5, tables: int = TABLES, crowd: int = CROWD) -> DataFrame:
    """``similar_heads`` of sequences (class_id, tokens) of which no two are equal."""
    sketched = sketches(sequences, "class_id", "tokens", 0, width, tables)
    return similar_heads(sketched, sketched.select("row", F.col("id").alias("class_id")), least, tables, crowd)


def _meet(banded: DataFrame) -> DataFrame:
    left, right = (banded.select(F.col("id").alias(name), "key") for name in ("a", "b"))
    return left.join(right, "key").where("a < b").select("a", "b")


def class_links(df: DataFrame, key: str, tokens: str, least: float, least_tokens: int, width: int = 5) -> DataFrame:
    """(key, class_id, copies, links): one row per usable record with the smallest id of its equal copies, the
    number of those and the number of other classes it is similar to. Copies are not expanded into pairs."""
    sketched = sketches(df, key, tokens, least_tokens, width)
    members, heads = classes(sketched)
    near = similar_heads(sketched, heads, least)
    degree = near.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    copies = members.groupBy("class_id").agg(F.count(F.lit(1)).alias("copies"))
    counted = copies.join(degree, "class_id", "left").select("class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"))
    return members.join(counted, "class_id").select(F.col("id").alias(key), "class_id", "copies", "links")


def pairs(df: DataFrame, key: str, tokens: str, least: float, least_tokens: int, width: int = 5, names: tuple[str, str] = ("unit_a", "unit_b")) -> DataFrame:
    """Every pair of records, smaller id first, that are equal or similar; copies are expanded into pairs.

    The size of this result is that of what it states, so use ``class_links`` where copies are many.
    """
    sketched = sketches(df, key, tokens, least_tokens, width)
    members, heads = classes(sketched)
    members = cut(members).df
    near = similar_heads(sketched, heads, least)
    left, right = members.toDF("x", "a"), members.toDF("y", "b")
    across = near.join(left, "a").join(right, "b").select(F.least("x", "y").alias(names[0]), F.greatest("x", "y").alias(names[1]))
    equal = left.join(right, F.col("a") == F.col("b")).where("x < y").select(F.col("x").alias(names[0]), F.col("y").alias(names[1]))
    return across.unionByName(equal)
