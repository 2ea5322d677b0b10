"""Detection of crowded keys, for plans that must treat them apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One row in this many, chosen by the hash of its id, is counted to find crowded keys.
STRIDE = 64


def hot_keys(df: DataFrame, key: str, member: str, limit: int) -> DataFrame:
    """(key, blocks): keys that hold more than about ``limit`` members, and how many blocks of that size those fill.

    Only the detection counts a share of the rows, and it drops none: a crowded key that escapes it is merely
    joined as it stands. There are at most rows / limit such keys.
    """
    share = df.where(F.pmod(F.xxhash64(member), F.lit(STRIDE)) == 0)
    some = share.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(2, limit // STRIDE))
    return some.select(key, F.ceil(F.col("n") / max(1, limit // STRIDE)).alias("blocks"))
