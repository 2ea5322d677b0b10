"""Joins of points and ranges inside a file. The file is the equality key, so a join meets a file's own rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.functions.text import is_source_file


def enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """``points(file, line, ...)`` with ``decl``, the innermost range of ``ranges(file, start, end, decl)`` around it.

    Innermost is the latest start, then the earliest end, then the smallest name. A point in no range gets
    ``<module>``. Points are keyed by all their columns, so equal points are one.
    """
    keys = points.columns
    spans = ranges.select(F.col("file").alias("_f"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("decl").alias("_d"))
    met = points.join(spans, (F.col("file") == F.col("_f")) & F.col("line").between(F.col("_s"), F.col("_e")), "left")
    inner = F.min_by("_d", F.when(F.col("_d").isNotNull(), F.struct(-F.col("_s"), F.col("_e"), F.col("_d"))))
    return met.groupBy(*keys).agg(F.coalesce(inner, F.lit("<module>")).alias("decl"))


def touched(units: DataFrame, lines: DataFrame) -> DataFrame:
    """Units (file, line, end_line) of which some line of ``lines(file, changed)`` lies inside."""
    marks = lines.select(F.col("file").alias("_f"), F.col("changed").alias("_c"))
    return units.join(marks, (F.col("file") == F.col("_f")) & F.col("_c").between(F.col("line"), F.coalesce("end_line", "line")), "left_semi")


def attributed_lines(files: DataFrame) -> DataFrame:
    """(file, line) to attribute of ``files(file, status, n_lines, changed)``: all lines of an added file or one
    without changed lines, else the changed ones. Deleted files have none; a null length counts as 0."""
    whole = (F.col("status") == "added") | (F.size(F.coalesce("changed", F.array().cast("array<int>"))) == 0)
    every = F.when(F.coalesce("n_lines", F.lit(0)) > 0, F.sequence(F.lit(1), F.greatest("n_lines", F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return files.where(F.col("status") != "deleted").select("file", F.explode(F.when(whole, every).otherwise(F.col("changed"))).alias("line"))


def first_symbols(located: DataFrame) -> DataFrame:
    """(symbol_id, file, line, change_kind): each symbol at its first changed line."""
    kind = F.when(F.col("status") == "added", "added").when(F.col("status") == "deleted", "removed").otherwise("modified")
    return located.groupBy("symbol_id").agg(F.min_by(F.struct("file", "line", kind.alias("change_kind")), "line").alias("x")).select("symbol_id", "x.*")


def changed_symbols(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """(symbol_id, file, line, change_kind): symbols that ``files(file, status, changed)`` change, each at its first line.

    ``ranges(file, start, end, decl)`` are the declarations of the parsed project; a line in none belongs to
    ``<file>#<module>``. Deleted files and files that are no source have no symbols. A source file that the project
    does not hold has one row of kind ``unparsed`` without a symbol, so what is missing is told.
    """
    source = files.where((F.col("status") != "deleted") & is_source_file(F.col("file")))
    known = ranges.groupBy("file").agg(F.max("end").alias("n_lines"))
    sized = source.join(known, "file", "left")
    lines = attributed_lines(sized.where("n_lines is not null")).distinct()
    placed = enclosing(lines, ranges).join(source.select("file", "status"), "file")
    named = placed.withColumn("symbol_id", F.when(F.col("decl") == "<module>", F.concat("file", F.lit("#<module>"))).otherwise(F.col("decl")))
    missing = sized.where("n_lines is null").select(F.lit(None).cast("string").alias("symbol_id"), "file", F.lit(None).cast("int").alias("line"), F.lit("unparsed").alias("change_kind"))
    return first_symbols(named).unionByName(missing)
