"""Claims held against the evidence they cite, and the gate on their severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefold.functions.text import severity_rank


def grounded(findings: DataFrame, refs: str, known: str) -> DataFrame:
    """Findings with ``unknown`` and ``reason``: cited ids outside the known array, looked at before a missing citation.

    ``reason`` is null for a kept finding. Null refs are no refs; a null known array knows nothing.
    """
    none = F.array().cast("array<string>")
    cited, have = F.coalesce(F.col(refs), none), F.coalesce(F.col(known), none)
    unknown = F.array_except(cited, have)
    reason = F.when(F.size(unknown) > 0, "unknown-evidence").when(F.size(cited) == 0, "no-evidence")
    return findings.withColumn("unknown", unknown).withColumn("reason", reason)


def kept_and_rejected(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A lossless split by ``reason``."""
    return judged.where("reason is null"), judged.where("reason is not null")


def at_least(severity: Column, threshold: str) -> Column:
    """True for severities as grave as ``threshold``; ``never`` passes none, an unknown severity does not pass."""
    if threshold == "never":
        return F.lit(False)
    return F.coalesce(severity_rank(severity) <= severity_rank(F.lit(threshold)), F.lit(False))


def should_fail(findings: DataFrame, by: list[str], threshold: str) -> DataFrame:
    """(by..., fail): whether any finding passes the gate."""
    return findings.groupBy(*by).agg(F.coalesce(F.max(at_least(F.col("severity"), threshold)), F.lit(False)).alias("fail"))
