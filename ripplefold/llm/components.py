"""Groups of records joined by pairwise matches, by hash-to-min.

Every vertex holds a cluster set, at first itself and its neighbours. In each round it sends the whole set to
the set's smallest member and that smallest member to all others; a vertex's next set is the union of what it
was sent. At the fixed point the smallest vertex of a group holds the group and every other vertex holds just
that smallest one. Sets are rows (vertex, member), never arrays. The smallest members are written before the sets
meet them, so both sides of that join are tables of known size: a small one is broadcast within the planner's
limit, else the rows of a giant group's smallest vertex are one key, which adaptive execution splits over tasks.

A record without links, or linked only to itself, is a group of its own. Null ends, and links whose strength
is null, NaN or below the threshold, join nothing, but a non-null end still names a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.durable import cut


def links(df: DataFrame, left: str, right: str, strength: str, least: float) -> DataFrame:
    """Distinct links (a, b), a < b, of two non-null ends and a strength that is a number of at least ``least``."""
    usable = F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right))
    strong = F.col(strength).isNotNull() & ~F.isnan(strength) & (F.col(strength) >= least)
    return (
        df.where(usable & strong)
        .select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
        .distinct()
    )


def records(df: DataFrame, left: str, right: str, name: str = "v") -> DataFrame:
    """Every non-null end once."""
    return df.select(F.explode(F.array(left, right)).alias(name)).where(F.col(name).isNotNull()).distinct()


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """(v, group_no) for every end of an edge; group_no is the smallest vertex of v's component.

    Each round is one min per vertex, one join and one distinct; both are written to the shared folder, the rows
    with their number and a checksum observed on the way, and the loop ends when both stay the same.
    """
    pairs = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null")
    start = pairs.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")), F.struct("v", F.col("v").alias("u")), F.struct(F.col("u").alias("v"), "u"))).alias("x"))
    sums = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("x"))
    clusters = cut(start.select("x.v", "x.u").distinct(), *sums)
    for _ in range(max_rounds):
        least = cut(clusters.df.groupBy("v").agg(F.min("u").alias("m")))
        sent = clusters.df.join(least.df, "v").select(F.explode(F.array(F.struct(F.col("m").alias("v"), "u"), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("x"))
        after = cut(sent.select("x.v", "x.u").distinct(), *sums)
        stable = after.metrics == clusters.metrics
        clusters.drop()
        least.drop()
        clusters = after
        if stable:
            return clusters.df.groupBy("v").agg(F.min("u").alias("group_no"))
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def groups(df: DataFrame, left: str, right: str, strength: str, least: float, name: str = "unit_no") -> DataFrame:
    """(``name``, group_no): one row for each non-null end of any row of ``df``."""
    joined = hash_to_min(links(df, left, right, strength, least))
    return (
        records(df, left, right)
        .join(joined, "v", "left")
        .select(F.col("v").alias(name), F.coalesce("group_no", "v").alias("group_no"))
    )
