"""Lineage cuts that survive the loss of executors.

A cut writes the rows as a Parquet table into the shared folder named by ``spark.checkpoint.dir`` and
reads them back, so later stages start from files that every executor can reach, with true sizes for the
planner. Only a session without that setting (a test) gets a folder of its own. Tables that were not dropped before are
deleted with ``forget`` or when the driver ends.
"""

from __future__ import annotations

import atexit
import logging
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for cut tables: ``spark.checkpoint.dir`` where set, else one made for a local session."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_FOLDER:
        _OWN_FOLDER.append(tempfile.mkdtemp(prefix="ripplefold-"))
        atexit.register(shutil.rmtree, _OWN_FOLDER[0], True)
    return f"file://{_OWN_FOLDER[0]}"


def application_folder(spark: SparkSession) -> str:
    """The part of the shared folder that holds this application's tables."""
    return f"{shared_folder(spark)}/ripplefold-{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_ENDS: set[str] = set()


def _delete_at_exit(spark: SparkSession) -> None:
    """Have this application's folder deleted when the driver ends; a folder that cannot be is left to its owner."""
    path = application_folder(spark)
    if path in _ENDS:
        return
    _ENDS.add(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def end() -> None:
        try:
            target.getFileSystem(conf).delete(target, True)
        except Exception as reason:  # noqa: BLE001 - the Java side may be gone
            logging.getLogger(__name__).debug("%s was left: %s", path, reason)

    atexit.register(end)


def forget(spark: SparkSession) -> None:
    """Delete every cut table of this application; results that still read one must be written before."""
    _delete(spark, application_folder(spark))


class CutTable:
    """A written table: ``df`` reads it, ``metrics`` holds what was observed while writing, ``drop`` deletes it."""

    def __init__(self, df: DataFrame, path: str, metrics: dict):
        self.df, self.path, self.metrics = df, path, metrics

    def drop(self) -> None:
        _delete(self.df.sparkSession, self.path)


def cut(df: DataFrame, *observed: Column) -> CutTable:
    """Write ``df`` to the shared folder and return the table; ``observed`` aggregates are taken on the way."""
    spark = df.sparkSession
    _delete_at_exit(spark)
    path = f"{application_folder(spark)}/cut-{uuid.uuid4().hex}"
    schema = df.schema
    seen = Observation() if observed else None
    (df.observe(seen, *observed) if seen else df).write.parquet(path)
    return CutTable(spark.read.schema(schema).parquet(path), path, seen.get if seen else {})
