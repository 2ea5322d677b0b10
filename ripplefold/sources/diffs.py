"""Unified diffs to files, hunks and changed lines.

A diff is exploded to numbered lines; sections and hunks are running counts of their headers and new-side line
numbers are running counts inside a hunk, each over one diff's lines. An added line counts itself; a removed
line marks the new-side line it stands before, 1 at least; context and empty lines count; ``\\`` lines do not;
any other line ends its hunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The line forms of the format.
SECTION = r'^diff --git (?:"a/(.*)"|a/(.*)) (?:"b/(.*)"|b/(.*))$'
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def read_diffs(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, raw): captured diffs, one per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("raw"))


def diff_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, n, line, section, is_header): numbered lines; section 0 is what precedes the first file."""
    lines = diffs.select("diff_id", F.posexplode(F.split(F.regexp_replace("raw", "\r\n", "\n"), "\n")).alias("n", "line"))
    header = F.col("line").rlike(SECTION)
    order = W.partitionBy("diff_id").orderBy("n")
    return lines.withColumn("is_header", header).withColumn("section", F.sum(header.cast("int")).over(order))


def hunk_header(line: str = "line"):
    """struct(old_start, old_lines, new_start, new_lines) of a hunk header; omitted counts are 1; null otherwise."""
    parts = [F.regexp_extract(line, HUNK, g) for g in (1, 2, 3, 4)]
    numbers = [F.when(p == "", 1).otherwise(p.try_cast("int")).alias(n) for p, n in zip(parts, ("old_start", "old_lines", "new_start", "new_lines"))]
    return F.when(F.col(line).rlike(HUNK), F.struct(*numbers))


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(diff_id, section, hunk, header, changed): every hunk with its sorted distinct changed new-side lines."""
    lines = diff_lines(diffs).where("section > 0").withColumn("header", hunk_header())
    inside = W.partitionBy("diff_id", "section").orderBy("n")
    lines = lines.withColumn("hunk", F.sum(F.col("header").isNotNull().cast("int")).over(inside)).where("hunk > 0")
    body = W.partitionBy("diff_id", "section", "hunk").orderBy("n")
    mark = F.substring("line", 1, 1)
    ends = F.col("header").isNull() & ~mark.isin("+", "-", " ", "\\") & (F.col("line") != "")
    lines = lines.withColumn("closed", F.max(ends.cast("int")).over(body))
    lines = lines.where("closed = 0")
    advances = (F.col("header").isNull() & (mark.isin("+", " ") | (F.col("line") == ""))).cast("int")
    start = F.first("header.new_start").over(body)
    before = F.coalesce(F.sum(advances).over(body.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = (start + before).cast("int")
    touched = F.when(F.col("header").isNull() & (mark == "+"), at).when(F.col("header").isNull() & (mark == "-"), F.greatest(F.lit(1), at))
    found = lines.withColumn("touched", touched).groupBy("diff_id", "section", "hunk").agg(F.first("header", True).alias("header"), F.array_sort(F.collect_set("touched")).alias("changed"))
    return found


def changed_files(diffs: DataFrame) -> DataFrame:
    """(diff_id, section, path, previous_path, status, hunks) of every file section, in the diff's order.

    Status is added, deleted, renamed or modified; paths that differ mean a rename. ``hunks`` is an array of
    structs ordered by place, empty for a pure rename. A section's rows are those of one file of one diff.
    """
    lines = diff_lines(diffs).where("section > 0").withColumn("hunk_line", F.col("line").rlike(HUNK))
    before_hunks = W.partitionBy("diff_id", "section").orderBy("n")
    head = lines.withColumn("seen", F.sum(F.col("hunk_line").cast("int")).over(before_hunks)).where("seen = 0")
    old = F.coalesce(F.nullif(F.regexp_extract("line", SECTION, 1), F.lit("")), F.regexp_extract("line", SECTION, 2))
    new = F.coalesce(F.nullif(F.regexp_extract("line", SECTION, 3), F.lit("")), F.regexp_extract("line", SECTION, 4))
    told = head.groupBy("diff_id", "section").agg(
        F.max(F.when(F.col("is_header"), old)).alias("old"),
        F.max(F.when(F.col("is_header"), new)).alias("new"),
        F.max(F.col("line").startswith("new file mode")).alias("added"),
        F.max(F.col("line").startswith("deleted file mode")).alias("deleted"),
        F.max(F.col("line").startswith("rename from ")).alias("renamed"),
    )
    status = F.when(F.col("added"), "added").when(F.col("deleted"), "deleted").when(F.col("renamed") | (F.col("old") != F.col("new")), "renamed").otherwise("modified")
    hunks = changed_lines(diffs).groupBy("diff_id", "section").agg(F.array_sort(F.collect_list(F.struct("hunk", "header.old_start", "header.old_lines", "header.new_start", "header.new_lines", "changed"))).alias("hunks"))
    files = told.withColumn("status", status).join(hunks, ["diff_id", "section"], "left")
    shape = F.transform("hunks", lambda h: F.struct(h["old_start"], h["old_lines"], h["new_start"], h["new_lines"], h["changed"].alias("changed_new_lines")))
    empty = F.array().cast("array<struct<old_start:int,old_lines:int,new_start:int,new_lines:int,changed_new_lines:array<int>>>")
    return files.select("diff_id", "section", F.when(F.col("status") == "deleted", F.col("old")).otherwise(F.col("new")).alias("path"), F.when(F.col("status") == "renamed", F.col("old")).alias("previous_path"), "status", F.coalesce(shape, empty).alias("hunks"))


def split_by_file(diffs: DataFrame) -> DataFrame:
    """(diff_id, section, text): each file's part of a diff, put together again in order."""
    parts = diff_lines(diffs).where("section > 0").groupBy("diff_id", "section").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("x"))
    return parts.select("diff_id", "section", F.array_join(F.col("x.line"), "\n").alias("text"))
