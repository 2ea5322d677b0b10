"""Pairs inside crowded keys, whole: members are dealt into blocks and every block meets every other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_blocks(df: DataFrame, key: Column, member: str, blocks: Column) -> DataFrame:
    """``df`` with ``cell`` and ``side``, each row once per block of its key.

    A cell holds two blocks of a key, or one with itself (side -1). Two members of a key meet in exactly one
    cell under ``apart``, so nothing is lost and a key of n members is spread over about blocks²/2 cells.
    """
    own = F.pmod(F.xxhash64(F.lit(11), F.col(member)), blocks)
    dealt = df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), (blocks - 1).cast("long"))))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    side = F.when(low == high, -1).otherwise((F.col("_own") == high).cast("int"))
    return dealt.withColumn("cell", F.xxhash64(key, low, high)).withColumn("side", side.cast("byte")).drop("_own", "_other")


def apart(a: str, b: str) -> Column:
    """True where two rows of one cell are of different blocks, or the cell is one block."""
    return (F.col(a) < 0) | (F.col(a) != F.col(b))


def met(dealt: DataFrame, member: str) -> DataFrame:
    """(a, b), a < b: members that share a cell of ``in_blocks``."""
    left, right = (dealt.select(F.col(member).alias(n), "cell", F.col("side").alias(f"side_{n}")) for n in ("a", "b"))
    return left.join(right, "cell").where(apart("side_a", "side_b") & (F.col("a") < F.col("b"))).select("a", "b")
