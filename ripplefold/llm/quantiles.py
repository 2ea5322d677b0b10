"""Percentiles per group with a guaranteed relative error, from mergeable counts.

A value x is counted in the signed logarithmic bucket (sign, ceil(log_g |x|)) with g = (1 + a) / (1 - a); zero
has a bucket of its own. Any value of a bucket is within relative error a of the bucket's representative
2 g^i / (g + 1). Sketches are plain rows (group, sign, bucket, n), so days or files computed apart are put
together by adding counts, in any order, with the same result as one pass.

Null, NaN and infinite values are not counted. Groups may be null; callers drop them if they should not count.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplefold.durable import cut

#: Relative width of a bucket for production queries.
ALPHA = 0.01


def _gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def bucket_of(value: Column, alpha: float = ALPHA) -> tuple[Column, Column]:
    """(sign, bucket) of a value; bucket is 0 for zero."""
    size = F.abs(value.cast("double"))
    sign = F.signum(value.cast("double")).cast("int")
    place = F.when(size > 0, F.ceil(F.ln(F.when(size > 0, size)) / math.log(_gamma(alpha)))).otherwise(0)
    return sign, place.cast("int")


def sketch(df: DataFrame, by: list[str], value: str, alpha: float = ALPHA) -> DataFrame:
    """Counts (by..., sign, bucket, n) of the finite values of each group; counted before the shuffle."""
    x = F.col(value).cast("double")
    finite = df.where(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sign, place = bucket_of(F.col(value), alpha)
    return finite.select(*by, sign.alias("sign"), place.alias("bucket")).groupBy(*by, "sign", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merge(*sketches: DataFrame, by: list[str]) -> DataFrame:
    """One sketch of all the values of several of the same alpha."""
    return reduce(DataFrame.unionByName, sketches).groupBy(*by, "sign", "bucket").agg(F.sum("n").alias("n"))


def _ordered(counts: DataFrame, by: list[str]) -> DataFrame:
    """Buckets of each group in order of value with the number of values before and of the group.

    A group has at most as many rows as there are buckets between its extremes, whatever the number of values.
    """
    order = W.partitionBy(*by).orderBy("sign", F.col("sign") * F.col("bucket"))
    return counts.withColumn("upto", F.sum("n").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(W.partitionBy(*by))).withColumn("before", F.col("upto") - F.col("n"))


def estimate(counts: DataFrame, by: list[str], quantiles: list[float], alpha: float = ALPHA) -> DataFrame:
    """(by..., q, bucket, value, low, high, total): each quantile by nearest lower rank, with the bounds that hold it."""
    g = _gamma(alpha)
    asked = _ordered(counts, by).withColumn("q", F.explode(F.array(*(F.lit(float(q)) for q in quantiles))))
    rank = F.floor(F.col("q") * (F.col("total") - 1))
    hit = asked.where((rank >= F.col("before")) & (rank < F.col("upto")))
    inner, outer = F.pow(F.lit(g), F.col("bucket") - 1), F.pow(F.lit(g), F.col("bucket"))
    middle = F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * 2 * outer / (g + 1))
    low = F.when(F.col("sign") > 0, inner).when(F.col("sign") < 0, -outer).otherwise(0.0)
    high = F.when(F.col("sign") > 0, outer).when(F.col("sign") < 0, -inner).otherwise(0.0)
    return hit.select(*by, "q", "bucket", middle.alias("value"), low.alias("low"), high.alias("high"), "total")


def exact(df: DataFrame, counts: DataFrame, by: list[str], value: str, quantile: Column, alpha: float = ALPHA) -> DataFrame:
    """(by..., exact_q): the linearly interpolated quantile of each group, found through its sketch.

    The sketch names the one or two buckets that hold the wanted ranks, so the second pass over the rows meets that
    table first (written, so that the planner knows its size and broadcasts it within its limit) and counts only the distinct values of those
    buckets: neither a group nor a bucket is ever gathered. ``quantile`` may depend on the group columns, which
    must not be null, as null groups never meet. Groups without a finite value have no row.
    """
    place = quantile * (F.col("total") - 1)
    asked = _ordered(counts, by).withColumn("at", place)
    wanted = cut(asked.where((F.ceil("at") >= F.col("before")) & (F.floor("at") < F.col("upto"))).select(*by, "sign", "bucket", "before", "at")).df
    sign, bucket = bucket_of(F.col(value), alpha)
    rows = df.select(*by, F.col(value).cast("double").alias("x"), sign.alias("sign"), bucket.alias("bucket"))
    held = rows.join(wanted, [*by, "sign", "bucket"]).groupBy(*by, "sign", "bucket", "before", "at", "x").agg(F.count(F.lit(1)).alias("n"))
    within = W.partitionBy(*by, "sign", "bucket").orderBy("x").rowsBetween(W.unboundedPreceding, 0)
    ranked = held.withColumn("end", F.col("before") + F.sum("n").over(within)).withColumn("begin", F.col("end") - F.col("n"))

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("begin")) & (rank < F.col("end")), F.col("x")))

    found = ranked.groupBy(*by).agg(at(F.floor("at")).alias("lower"), at(F.ceil("at")).alias("upper"), F.max("at").alias("at"))
    return found.select(*by, (F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("at") - F.floor("at"))).alias("exact_q"))
