"""Writers: run records, fingerprint snapshots, tables, text reports."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplefold.functions.text import escaped_cell, severity_rank

#: Rows shown per symbol, per hop, in an evidence table, and the bounds of a vector width.
PER_SYMBOL = 8
PER_HOP = 10
EVIDENCE_ROWS = 25
WIDEST = 16_000


def save_run(tables: dict[str, DataFrame], root: str, run_id: str) -> bool:
    """Write a run's tables under a staging folder and move it into place; False and a warning instead of an error.

    A reader of ``root/<table>/run=<id>`` sees all of a table or none.
    """
    try:
        spark = next(iter(tables.values())).sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path
        files = path(root).getFileSystem(conf)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{root}/_staging/{run_id}/{name}")
        for name in tables:
            files.mkdirs(path(f"{root}/{name}"))
            target = path(f"{root}/{name}/run={run_id}")
            files.delete(target, True)
            files.rename(path(f"{root}/_staging/{run_id}/{name}"), target)
        return True
    except Exception as reason:  # noqa: BLE001 - a lost record must not lose the review
        logging.getLogger(__name__).warning("run %s was not saved: %s", run_id, reason)
        return False


def replace_snapshot(prints: DataFrame, root: str) -> bool:
    """Replace the fingerprints of each (repo, embedder) that the sweep holds; an empty sweep changes nothing."""
    if prints.isEmpty():
        return False
    last = W.partitionBy("repo", "file", "symbol", "start_line", "embedder").orderBy(F.desc_nulls_last("updated_at"), F.desc("fp_id"))
    rows = prints.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo", "embedder").parquet(root)
    return True


def checked_width(width: int) -> int:
    """A vector width that a store accepts."""
    if not isinstance(width, int) or isinstance(width, bool) or not 1 <= width <= WIDEST:
        raise ValueError(f"width must be an integer from 1 to {WIDEST}")
    return width


def create_tables(spark: SparkSession, schemas: dict[str, str], location: str) -> None:
    """Create missing tables; existing ones stay."""
    for name, columns in schemas.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet LOCATION '{location}/{name}'")


def _first_of(sites: DataFrame, by: str, order: list, most: int, more: str) -> DataFrame:
    """The first ``most`` rows of each ``by`` with their place and the number left out; rows beyond are dropped before
    the shuffle, and counts come from an aggregate."""
    first = sites.withColumn("r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("r") <= most)
    counted = sites.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    return first.join(counted, by).withColumn(more, F.greatest(F.col("_n") - most, F.lit(0))).drop("_n")


def shown_sites(sites: DataFrame, most: int = PER_SYMBOL) -> DataFrame:
    """Sites shown per origin, nearest first, with how many more there are."""
    return _first_of(sites, "origin", ["hops", "symbol_id"], most, "more")


def hop_columns(sites: DataFrame, most: int = PER_HOP) -> DataFrame:
    """Sites drawn per hop, largest fan-in first, with the overflow of the hop."""
    return _first_of(sites, "hops", [F.desc("module_fan_in"), "symbol_id"], most, "overflow")


def drawn_edges(sites: DataFrame, drawn: DataFrame) -> DataFrame:
    """(from_id, to_id) of drawn sites whose origin of the step is drawn as well."""
    ends = drawn.select(F.col("symbol_id").alias("via"))
    return drawn.join(ends, "via", "left_semi").select(F.col("via").alias("from_id"), F.col("symbol_id").alias("to_id"))


def split_comments(findings: DataFrame, lines: DataFrame) -> DataFrame:
    """Findings with ``inline``: on a line of ``lines(path, line)`` of the diff, and not about the whole change."""
    marks = lines.select(F.col("path").alias("file"), F.col("line").alias("line")).distinct().withColumn("_on", F.lit(True))
    return findings.join(marks, ["file", "line"], "left").withColumn("inline", F.coalesce(F.col("_on") & (F.col("line") > 0), F.lit(False))).drop("_on")


def by_severity(findings: DataFrame) -> DataFrame:
    """Findings with their place by severity, gravest first, ties by id, per run."""
    return findings.withColumn("place", F.row_number().over(W.partitionBy("run_id").orderBy(severity_rank(F.col("severity")), "id")))


def markdown_rows(df: DataFrame, columns: list[str]) -> Column:
    """One table row per row."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *(escaped_cell(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns)), F.lit(" |"))


def as_json(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(json): one document per row, null fields left out."""
    return df.select(F.to_json(F.struct(*(columns or df.columns))).alias("json"))
