"""Access to the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table as stored; ``name`` may be a file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The table with each repeated row once.

    Repeated rows are equal in every column, so distinct rows of a selection that holds the key are the
    distinct rows of the table; ``columns`` narrows the shuffle to what the query needs.
    """
    df = table(spark, sf_dir, name)
    return (df.select(*columns) if columns else df).distinct()
