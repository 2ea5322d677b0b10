"""All queries of the core with their SQL, gathered from the family modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplefold.plans import graphs, inputs_and_units, records, stores

FAMILIES = [graphs, records, inputs_and_units, stores]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["j6_impact_blast_radius"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for family in FAMILIES for name, run in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.SQL.items()}
