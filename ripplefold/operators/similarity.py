"""Fingerprint similarity of token sequences: shingles, signed hashing, cosine, threshold top-k, ranking."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplefold.durable import cut
from ripplefold.functions.text import round_half_up
from ripplefold.operators import meetings
from ripplefold.operators.blocks import in_blocks, met

#: Tokens to a shingle, fingerprint width, similarity, hits per unit, hits in all, least tokens.
SHINGLE = 5
WIDTH = 256
THRESHOLD = 0.85
PER_UNIT = 3
IN_ALL = 10
LEAST_TOKENS = 40
#: Cosine of shingle counts below which a pair cannot reach the threshold, and members of a block of a common shingle.
LEAST_SHARED = 0.5
CROWD = 2000
#: Cells to a part of pairing and parts at least.
PART_CELLS = 2_000_000
LEAST_PARTS = 6


def shingles(tokens: Column, k: int = SHINGLE) -> Column:
    """Space-joined windows of k tokens; none for shorter sequences and null."""
    n = F.size(tokens)
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(tokens, i, k)))
    return F.when(n >= k, windows).otherwise(F.array().cast("array<string>"))


def bucket_and_sign(gram: Column, width: int = WIDTH) -> tuple[Column, Column]:
    """Bucket (first four bytes of SHA-1, modulo width) and sign (lowest bit of the fifth: 1 is plus)."""
    digest = F.sha1(gram)
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % width
    bit = F.conv(F.substring(digest, 9, 2), 16, 10).cast("long") % 2
    return bucket, F.when(bit == 1, 1).otherwise(-1)


def fingerprints(units: DataFrame, key: str = "unit", tokens: str = "tokens", width: int = WIDTH) -> DataFrame:
    """(unit, bucket, w): sparse integer fingerprints; zero weights have no row."""
    grams = units.select(F.col(key).alias("unit"), F.explode(shingles(F.col(tokens))).alias("gram"))
    bucket, sign = bucket_and_sign(F.col("gram"), width)
    return grams.select("unit", bucket.alias("bucket"), sign.alias("sign")).groupBy("unit", "bucket").agg(F.sum("sign").alias("w")).where("w <> 0")


def norms(prints: DataFrame) -> DataFrame:
    """(unit, ss): the squared length of each fingerprint."""
    return prints.groupBy("unit").agg(F.sum(F.col("w") * F.col("w")).alias("ss"))


def _marks(tokens: Column) -> tuple[Column, Column]:
    """128 bits of hash that tell a token list."""
    spelled = F.concat_ws("\x01", F.transform(tokens, lambda t: F.coalesce(t, F.lit("\x00"))))
    return F.xxhash64(tokens).alias("h1"), F.xxhash64(spelled, F.size(tokens)).alias("h2")


def candidate_pairs(units: DataFrame, key: str = "unit", tokens: str = "tokens", crowd: int = CROWD) -> DataFrame:
    """(a, b), a < b: units whose shingle counts can have a cosine above ``LEAST_SHARED``, by prefix filter.

    A unit's shingles are ordered from the rarest to the most common, the same way in all units. Its prefix
    ends where the rest has at most ``LEAST_SHARED`` of its length; a pair above that shares a shingle of both
    prefixes, however common it is. The fingerprint's cosine differs from that of the counts by collisions of
    buckets, with a deviation of at most 0.05 at 0.5, so 0.85 is seven deviations away.
    """
    grams = units.select(F.col(key).alias("unit"), F.explode(shingles(F.col(tokens))).alias("gram")).select("unit", F.xxhash64("gram").alias("g"))
    counted = grams.groupBy("unit", "g").agg((F.count(F.lit(1)) * F.count(F.lit(1))).alias("mass"))
    held = counted.join(counted.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "g")
    whole = W.partitionBy("unit")
    rest = whole.orderBy(F.desc("n"), F.desc("g")).rowsBetween(W.unboundedPreceding, W.currentRow)
    prefix = held.withColumn("rest", F.sum("mass").over(rest)).withColumn("all", F.sum("mass").over(whole)).where((F.col("rest") > LEAST_SHARED**2 * F.col("all")) & (F.col("n") > 1))
    return met(in_blocks(prefix.select("unit", "g", "n"), F.col("g"), "unit", F.ceil(F.col("n") / crowd)), "unit").distinct()


def prepared(units: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(unit, cells, sides, w) of ``units(unit, tokens)``: the cells of each unit's prefix and its fingerprint.

    Prefixes are those of ``candidate_pairs``, but for the order of shingles: by how often a slot of a fixed number of
    them is met, then by hash. Any order that is the same in all units loses no pair. A unit is worked on where it is read.
    """
    kind = units.schema["unit"].dataType.simpleString()
    counts = units.select("tokens").mapInArrow(meetings.counter(SHINGLE), "block int, counts binary")
    table = np.zeros(1 << meetings.SLOT_BITS, np.uint8)
    for row in counts.repartition("block").mapInArrow(meetings.summed, "block int, codes binary").toLocalIterator():
        table[row["block"] * meetings.BLOCK : (row["block"] + 1) * meetings.BLOCK] = np.frombuffer(row["codes"], np.uint8)
    held = units.sparkSession.sparkContext.broadcast(table)
    run = meetings.preparer(lambda: held.value, SHINGLE, WIDTH, LEAST_SHARED, crowd)
    return units.select("unit", F.xxhash64("unit").alias("u"), "tokens").mapInArrow(run, f"unit {kind}, cells array<bigint>, sides array<tinyint>, w binary")


def near_pairs(ready: DataFrame, total: int, threshold: float = THRESHOLD, part_cells: int = PART_CELLS) -> DataFrame:
    """(a, b), a < b: the pairs of ``prepared`` units that meet and whose fingerprints may reach ``threshold``.

    The ``total`` cells are dealt to parts and a unit goes to a part once, with the signs of its fingerprint as bits, so a
    pair is judged where it meets and few of them are ever moved. No pair that reaches ``threshold`` is left out.
    """
    parts = max(LEAST_PARTS, -(-total // part_cells))
    kind = ready.schema["unit"].dataType.simpleString()
    dealt = ready.mapInArrow(meetings.dealer(parts, WIDTH), f"unit {kind}, part int, cells array<int>, sides array<tinyint>, signs binary, ss bigint, nnz bigint")
    return dealt.repartitionById(parts, F.col("part")).drop("part").mapInArrow(meetings.judge(threshold), f"a {kind}, b {kind}").distinct()


def measured(ready: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, similarity) of pairs of ``prepared`` units, as ``cosines`` gives it."""
    kind = ready.schema["unit"].dataType.simpleString()
    left, right = (ready.select(F.col("unit").alias(n), F.col("w").alias(f"w{n}")) for n in ("a", "b"))
    dots = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb").mapInArrow(meetings.products(WIDTH), f"a {kind}, b {kind}, dot bigint, saa bigint, sbb bigint")
    return dots.select("a", "b", (F.col("dot") / F.sqrt((F.col("saa") * F.col("sbb")).cast("double"))).alias("similarity"))


def cosines(prints: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, dot, saa, sbb, similarity) of pairs, from integers up to the last division."""
    dense = prints.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "w"))).alias("m"), F.sum(F.col("w") * F.col("w")).alias("ss"))
    left, right = dense.toDF("a", "ma", "saa"), dense.toDF("b", "mb", "sbb")
    both = pairs.join(left, "a").join(right, "b")
    dot = F.aggregate(F.map_entries("ma"), F.lit(0).cast("long"), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(F.col("mb"), e["key"]), F.lit(0).cast("long")))
    return both.select("a", "b", dot.alias("dot"), "saa", "sbb").withColumn("similarity", F.col("dot") / F.sqrt((F.col("saa") * F.col("sbb")).cast("double")))


def rated(units: DataFrame, threshold: float = THRESHOLD, crowd: int = CROWD) -> DataFrame:
    """(a, b, similarity), a < b: every pair of ``units(unit, tokens)`` of a similarity of ``threshold`` or more.

    Units of equal tokens are compared once, as one class, and expanded afterwards; so are repeated rows of a unit.
    """
    rows = cut(units.select("unit", "tokens").withColumn("_row", F.monotonically_increasing_id())).df
    marked = rows.select("unit", "_row", *_marks(F.col("tokens")))
    least = marked.groupBy("h1", "h2").agg(F.min(F.struct("unit", "_row")).alias("m"))
    placed = cut(marked.join(least, ["h1", "h2"]).select("unit", "_row", F.col("m.unit").alias("head"), (F.col("_row") != F.col("m._row")).alias("spare"))).df
    members = placed.select("unit", "head").distinct()
    heads = rows.join(cut(placed.where("spare").select("_row")).df, "_row", "left_anti").select("unit", "tokens")
    ready = cut(prepared(heads, crowd), F.sum(F.size("cells").cast("long")).alias("cells"))
    near = measured(ready.df, near_pairs(ready.df, ready.metrics["cells"] or 0, threshold)).where(F.col("similarity") >= threshold).select(F.col("a").alias("ha"), F.col("b").alias("hb"), "similarity")
    across = near.join(members.toDF("x", "ha"), "ha").join(members.toDF("y", "hb"), "hb").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
    copies = members.groupBy("head").agg(F.count(F.lit(1)).alias("n")).where("n > 1").join(ready.df.select(F.col("unit").alias("head")), "head", "left_semi")
    equal = met(in_blocks(members.join(copies, "head"), F.col("head"), "unit", F.ceil(F.col("n") / crowd)), "unit")
    return across.unionByName(equal.withColumn("similarity", F.lit(1.0)))


def overlapping(same_file: Column, a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """True where two ranges of one file share a line; a missing end is the start."""
    return same_file & (a1 <= F.coalesce(b2, b1)) & (b1 <= F.coalesce(a2, a1))


def hits_per_unit(rated: DataFrame, threshold: float = THRESHOLD, k: int = PER_UNIT) -> DataFrame:
    """(unit, other, similarity, r): the k best hits of each unit from pairs, both ways, ties by the other's order."""
    near = rated.where(F.col("similarity") >= threshold)
    both = near.select(F.inline(F.array(F.struct(F.col("a").alias("unit"), F.col("b").alias("other"), "similarity"), F.struct(F.col("b").alias("unit"), F.col("a").alias("other"), "similarity"))))
    order = W.partitionBy("unit").orderBy(F.desc("similarity"), "other")
    return both.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)


def first_direction(hits: DataFrame) -> DataFrame:
    """Each unordered pair once: the direction met first in order of unit and rank."""
    pair = W.partitionBy(F.least("unit", "other"), F.greatest("unit", "other")).orderBy("unit", "r")
    return hits.withColumn("k", F.row_number().over(pair)).where("k = 1").drop("k")


def ranked(hits: DataFrame, fan_in: DataFrame, limit: int = IN_ALL) -> DataFrame:
    """The ``limit`` most important hits: larger fan-in of the two sides, then rounded similarity, then order.

    A hit of another repository (``scope`` other than this-repository) counts its own side only.
    """
    own = fan_in.select(F.col("id").alias("unit"), F.col("fan_in").alias("fa"))
    other = fan_in.select(F.col("id").alias("other"), F.col("fan_in").alias("fb"))
    joined = hits.join(own, "unit", "left").join(other, "other", "left").na.fill(0, ["fa", "fb"])
    importance = F.when(F.col("scope") == "this-repository", F.greatest("fa", "fb")).otherwise(F.col("fa"))
    rated = joined.withColumn("importance", importance).withColumn("rounded", round_half_up(F.col("similarity")))
    return rated.orderBy(F.desc("importance"), F.desc("rounded"), "unit", "r").limit(limit)
