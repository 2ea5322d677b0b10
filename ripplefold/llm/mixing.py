"""A mix of sources by target shares of the total size, with capped repeats.

The total is the size of all named sources, each document once. A source wants target_share * total; it can
give at most max_repeats * size. What it gives is the smaller of both: whole passes over its documents and one
partial pass over a permuted part of them. Shares actually reached are measured on the drawn mix and reported
beside the targets.

A seeded hash of its id puts every document into one of its source's blocks, so the blocks along their numbers are
a permutation of the source cut in parts; their number follows from the source's size. A partial pass takes the
first blocks, as many as come closest. The exact numbers of blocks used of each source are divided among output
shards by a splitting tree: at each node the blocks of its left half are drawn from the node's counts per source by
a multivariate hypergeometric law, down to one shard per leaf, so counts per shard are exact and shares even. A
shard takes its number of blocks from a permutation of each source's blocks and passes, so shards are disjoint, and
its rows carry a hash to order them by, so the shuffle is local to the shard. No list of blocks is ever made: block,
pass and shard of a document follow from a few numbers of its source.

Sources are compared in lower case without outer white space. Targets that name one source twice count as one: their
shares add up, the larger cap holds, and each spelling is reported. Documents of other or null sources take no part;
null and empty texts have size 0 and may be placed without weight. A source without documents has size 0. A null
share or cap counts as 0, as do negative ones and a share that is no number. Empty tables give no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tokens of a block and of a shard, and the least number of both; a partial pass misses its size by half a block at most.
BLOCK_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 27
LEAST_BLOCKS = 256
LEAST_SHARDS = 16
#: Parts of a range of blocks that one pass looks at while it seeks the end of a partial pass.
RADIX = 256
#: The most sources a target table may name, and the most counts (shards by sources) of a splitting tree; beyond them shards grow.
MOST_SOURCES = 10_000
MOST_COUNTS = 1 << 22
SEED = 20240


def plain(source: str) -> Column:
    """A source name in lower case without outer white space of any kind."""
    return F.lower(F.regexp_replace(F.col(source), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def checked_targets(targets: DataFrame) -> list[dict]:
    """The target rows with a name, as dictionaries with ``plain``, or an error for more than ``MOST_SOURCES``."""
    rows = targets.where("source is not null").select("source", plain("source").alias("plain"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
    found = [r.asDict() | {"target_share": r["target_share"] if r["target_share"] > 0 else 0.0, "max_repeats": max(r["max_repeats"], 0)} for r in rows.distinct().limit(MOST_SOURCES + 1).collect()]
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    return sorted(found, key=lambda r: r["source"])


def named(sized: DataFrame, targets: DataFrame, key: str, source: str) -> DataFrame:
    """(key, source, n_tokens): documents of the named sources, with the plain name."""
    names = sorted({r["plain"] for r in checked_targets(targets)})
    some = sized.sparkSession.createDataFrame([(n,) for n in names], "source string")
    rows = sized.select(F.col(key), plain(source).alias("source"), F.col("n_tokens"))
    return rows.join(F.broadcast(some), "source").select(key, "source", "n_tokens")


def split_tree(counts: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): blocks of each source for each shard, by recursive hypergeometric splits.

    A node of s shards and c blocks gives its left half floor(c * left / s) blocks. Rows differ by at most
    the rounding of the splits and columns add up to ``counts`` exactly.
    """
    out = np.zeros((shards, len(counts)), dtype=np.int64)
    waiting = [(0, shards, counts.astype(np.int64), 1)]
    while waiting:
        first, size, have, node = waiting.pop()
        if size == 1:
            out[first] = have
            continue
        left, total = size // 2, int(have.sum())
        draw = np.random.default_rng([seed, node]).multivariate_hypergeometric(have, total * left // size, method="marginals") if total else have * 0
        waiting += [(first, left, draw, 2 * node), (first + left, size - left, have - draw, 2 * node + 1)]
    return out


def multiplier(n: int) -> int:
    """A number near 0.618 n without a common divisor, so that its multiples modulo n are a permutation."""
    a = max(1, int(n * 0.6180339887))
    while math.gcd(a, n) != 1:
        a += 1
    return a


class Mix:
    """The plan of a mix and, lazily, its documents."""

    def __init__(self, spark: SparkSession, docs: DataFrame, targets: DataFrame, key: str, shards: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = SEED):
        """``docs`` is (key, source, n_tokens) as by ``named``; ``targets`` is (source, target_share, max_repeats)."""
        self.spark, self.docs, self.key, self.seed = spark, docs, key, seed
        self.targets = checked_targets(targets)
        sizes = {r["source"]: int(r["n"]) for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per named source
        self.total = sum(sizes.values())
        self.plan: dict[str, dict] = {}
        for t in self.targets:
            own = self.plan.setdefault(t["plain"], {"source": t["plain"], "share": 0.0, "most": 0, "size": sizes.get(t["plain"], 0)})
            own["share"] += t["target_share"]
            own["most"] = max(own["most"], t["max_repeats"])
        for own in self.plan.values():
            size, give = own["size"], min(own["share"] * self.total, own["most"] * own["size"])
            own["blocks"] = max(LEAST_BLOCKS, -(-size // block_tokens))
            own["passes"] = min(int(give // size), own["most"]) if size else 0
            own["left"] = give - own["passes"] * size if own["passes"] < own["most"] else 0.0
            own["first"] = 0
        self._seek_ends()
        names = sorted(self.plan)
        counts = np.array([self.plan[n]["passes"] * self.plan[n]["blocks"] + self.plan[n]["first"] for n in names], dtype=np.int64)
        used = sum(min(p["share"] * self.total, p["most"] * p["size"]) for p in self.plan.values())
        self.shards = shards or min(max(LEAST_SHARDS, math.ceil(used / SHARD_TOKENS)), max(LEAST_SHARDS, MOST_COUNTS // max(1, len(names))))
        self.quota = split_tree(counts, self.shards, seed)
        self.names, self.counts = names, counts

    def _block(self, blocks: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed), F.col(self.key)), blocks)

    def _seek_ends(self) -> None:
        """Set ``first``, the number of first blocks of each partial pass, looking at ``RADIX`` parts of a range at a time."""
        open_ = {n: (0, p["blocks"], p["left"]) for n, p in self.plan.items() if p["left"] > 0 and p["size"]}
        while open_:
            rows = [(n, low, high, self.plan[n]["blocks"], -(-(high - low) // RADIX)) for n, (low, high, _) in open_.items()]
            ranges = self.spark.createDataFrame(rows, "source string, low bigint, high bigint, blocks bigint, step bigint")
            inside = self.docs.join(F.broadcast(ranges), "source").withColumn("b", self._block(F.col("blocks"))).where("b >= low and b < high")
            parts = inside.groupBy("source", F.expr("cast((b - low) div step as int)").alias("part")).agg(F.sum("n_tokens").alias("n")).collect()  # RADIX rows a source
            tokens: dict[str, dict[int, int]] = {}
            for r in parts:
                tokens.setdefault(r["source"], {})[r["part"]] = int(r["n"])
            following = {}
            for n, low, high, _, step in rows:
                left, part = open_[n][2], 0
                while low + part * step < high and tokens.get(n, {}).get(part, 0) <= left:
                    left -= tokens.get(n, {}).get(part, 0)
                    part += 1
                end = min(low + part * step, high)
                if end == high or step == 1:
                    nearer = end < high and tokens[n][part] <= 2 * left
                    self.plan[n]["first"] = end + nearer
                else:
                    following[n] = (end, min(end + step, high), left)
            open_ = following

    def rows(self) -> DataFrame:
        """(shard, key, source, repeat, n_tokens, place): every use of every document; sort a shard by place."""
        ends = np.cumsum(self.quota, axis=0)
        numbers = [(n, i, p["blocks"], p["passes"], p["first"], int(u), multiplier(int(u)) if u else 1) for i, (n, p, u) in enumerate((n, self.plan[n], u) for n, u in zip(self.names, self.counts)) if u]
        table = self.spark.createDataFrame(numbers, "source string, i int, blocks bigint, passes bigint, first bigint, used bigint, a bigint")

        @F.pandas_udf("int")
        def shard_of(i: pd.Series, position: pd.Series) -> pd.Series:
            out = np.zeros(len(i), dtype=np.int32)
            for source in i.unique():
                at = (i == source).to_numpy()
                out[at] = np.searchsorted(ends[:, source], position.to_numpy()[at], side="right")
            return pd.Series(out)

        # The table has one row per named source, MOST_SOURCES at most; the tree's counts are MOST_COUNTS at most.
        placed = self.docs.join(F.broadcast(table), "source").withColumn("b", self._block(F.col("blocks")))
        times = F.col("passes") + (F.col("b") < F.col("first")).cast("bigint")
        drawn = placed.where(times > 0).withColumn("repeat", F.explode(F.sequence(F.lit(0).cast("bigint"), times - 1)))
        position = F.pmod(F.col("a") * (F.col("repeat") * F.col("blocks") + F.col("b")), F.col("used"))
        sharded = drawn.select(shard_of("i", position).alias("shard"), self.key, "source", F.col("repeat").cast("int").alias("repeat"), "n_tokens")
        return sharded.withColumn("place", F.xxhash64(F.lit(self.seed), self.key, "repeat", "shard"))

    def shares(self) -> DataFrame:
        """Target and reached share of each source as written, with its size, wanted and used tokens, measured on the
        drawn rows; ``short`` where the most repeats allowed were drawn of all its documents and do not suffice."""
        drawn = {r["source"]: int(r["n"]) for r in self.rows().groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # one row per named source
        total, rows = sum(drawn.values()), []
        for t in self.targets:
            own = self.plan[t["plain"]]
            got, want = drawn.get(t["plain"], 0), own["share"] * self.total
            short = got >= own["most"] * own["size"] and got < want
            rows.append((t["source"], own["share"], own["most"], own["size"], int(math.floor(want)), got, got / total if total else 0.0, short))
        return self.spark.createDataFrame(rows, "source string, target_share double, max_repeats int, size_tokens bigint, want_tokens bigint, used_tokens bigint, actual_share double, short boolean")

    def short(self) -> DataFrame:
        """(source), as written, of the sources that cannot reach their share."""
        return self.shares().where("short").select("source")

    def audit(self) -> DataFrame:
        """(source, documents, doubled, over_cap, broken): of each source as written, its documents, and how many of them
        are drawn twice in one pass, more often than allowed, or not once in every whole pass."""
        uses = self.rows().groupBy("source", self.key).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("repeat").alias("d"), F.max("repeat").alias("last"))
        caps = self.spark.createDataFrame([(t["source"], t["plain"], self.plan[t["plain"]]["most"], self.plan[t["plain"]]["passes"]) for t in self.targets], "written string, source string, most int, passes bigint")
        one = self.docs.join(uses, ["source", self.key], "left").join(F.broadcast(caps), "source")
        told = (F.coalesce("n", F.lit(0)) != F.coalesce("d", F.lit(0)), F.coalesce("n", F.lit(0)) > F.col("most"), F.coalesce("d", F.lit(0)) < F.col("passes"))
        return one.groupBy(F.col("written").alias("source")).agg(F.count(F.lit(1)).alias("documents"), *(F.sum(c.cast("bigint")).alias(n) for c, n in zip(told, ("doubled", "over_cap", "broken"))))
