"""Scoring of findings against known defects, and summaries over repeated runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplefold.functions.text import plain_slashes

#: A defect of at least this tolerance is found by a finding about the whole change; defect
#: kinds that need a view across files.
WHOLE_CHANGE = 1000
ACROSS = ("cross-module", "cycle", "architecture", "duplicate")


def matches(findings: DataFrame, defects: DataFrame, by: list[str]) -> DataFrame:
    """(by..., finding_no, defect_no) of findings that identify defects of the same ``by``.

    findings: (by..., finding_no, file, line, category); defects: (by..., defect_no, file, line,
    line_tolerance, accept_categories). Files are compared with forward slashes.
    """
    d = defects.select(*(F.col(k).alias(f"_{k}") for k in by), "defect_no", plain_slashes(F.col("file")).alias("_file"), F.col("line").alias("_line"), F.col("line_tolerance").alias("_tol"), F.col("accept_categories").alias("_ok"))
    f = findings.withColumn("_norm", plain_slashes(F.col("file")))
    same = (F.col("_norm") == F.col("_file")) & F.array_contains("_ok", F.col("category"))
    for k in by:
        same = same & (F.col(k) == F.col(f"_{k}"))
    near = F.when(F.col("line") == 0, F.col("_tol") >= WHOLE_CHANGE).otherwise(F.abs(F.col("line") - F.col("_line")) <= F.col("_tol"))
    return f.join(d, same & near).select(*by, "finding_no", "defect_no")


def credited(matched: DataFrame, by: list[str]) -> DataFrame:
    """(by..., finding_no, defect_no, hit): each finding credited to its first defect; the first finding of a
    defect is the hit and the others are duplicates."""
    one = matched.groupBy(*by, "finding_no").agg(F.min("defect_no").alias("defect_no"))
    return one.withColumn("hit", F.row_number().over(W.partitionBy(*by, "defect_no").orderBy("finding_no")) == 1)


def rates(caught: Column, false_positives: Column, missed: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, f1): 1 where nothing was predicted or nothing was there, f1 0 where both are 0."""
    predicted, actual = caught + false_positives, caught + missed
    precision = F.when(predicted == 0, 1.0).otherwise(caught / F.when(predicted == 0, 1).otherwise(predicted))
    recall = F.when(actual == 0, 1.0).otherwise(caught / F.when(actual == 0, 1).otherwise(actual))
    total = precision + recall
    return precision, recall, F.when(total == 0, 0.0).otherwise(2 * precision * recall / F.when(total == 0, 1.0).otherwise(total))


def spread(x: Column) -> Column:
    """struct(mean, stdev, min, max, n) of the non-null values, population deviation; zeros without any."""
    zero = F.lit(0.0)
    return F.struct(F.coalesce(F.avg(x), zero).alias("mean"), F.coalesce(F.stddev_pop(x), zero).alias("stdev"), F.coalesce(F.min(x).cast("double"), zero).alias("min"), F.coalesce(F.max(x).cast("double"), zero).alias("max"), F.count(x).alias("n"))


def all_or_null_sum(x: Column) -> Column:
    """Sum if every row has a value, 0 for no rows, else null."""
    return F.when(F.count(F.lit(1)) == F.count(x), F.coalesce(F.sum(x), F.lit(0)))


def separated(mean_a: Column, sd_a: Column, mean_b: Column, sd_b: Column) -> Column:
    """True where two means differ by more than both deviations together."""
    return F.abs(mean_a - mean_b) > sd_a + sd_b


def verdict(mean_a: Column, sd_a: Column, mean_b: Column, sd_b: Column, failures: Column) -> Column:
    """One of four words for two arms."""
    return F.when(failures > 0, "incomplete").when(~separated(mean_a, sd_a, mean_b, sd_b), "not separated").when(mean_a > mean_b, "first is better").otherwise("second is better")
