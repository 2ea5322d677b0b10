"""Blast radius: who depends on what changed, within a few hops, each site credited to one origin.

The walk is a first-in-first-out search; its order is carried as a path of edge ordinals, which sorts like the
queue would, so a level is one join, one anti-join and one grouping, without a global numbering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.durable import cut
from ripplefold.functions.text import is_project_node

#: Default bounds of the walk.
MAX_HOPS = 3
MAX_LOOKUPS = 400
MAX_MODULE_DEPENDANTS = 25


def blast_radius(edges: DataFrame, changed: DataFrame, max_hops: int = MAX_HOPS, max_lookups: int | None = MAX_LOOKUPS) -> tuple[DataFrame, bool]:
    """(sites, truncated): sites is (symbol_id, hops, origin, via, path).

    ``edges`` is (src, dst, ord), src depends on dst and ord orders a target's dependants; ``changed`` is
    (id, ord). A vertex is expanded once; when ``max_lookups`` expansions are used the walk stops and tells so.
    Changed vertices are never sites. An empty change has no sites. The edges are read once per hop, so they
    should be a written table.
    """
    reverse = edges.select(F.col("dst").alias("at"), F.col("src").alias("next"), F.col("ord").cast("long").alias("edge_ord"))
    kind = changed.schema["id"].dataType.simpleString()
    start = changed.groupBy("id").agg(F.min("ord").alias("ord")).select("id", F.col("id").alias("origin"), F.array(F.col("ord").cast("long")).alias("path"))
    frontier = cut(start, F.count(F.lit(1)).alias("n"))
    seen = frontier.df.select("id")
    sites = edges.sparkSession.createDataFrame([], f"symbol_id {kind}, hops int, origin {kind}, via {kind}, path array<bigint>")
    looked, truncated = 0, False
    for hop in range(1, max_hops + 1):
        waiting, size = frontier.df, frontier.metrics["n"]
        if not size:
            break
        if max_lookups is not None and looked + size > max_lookups:
            waiting, truncated = waiting.orderBy("path").limit(max_lookups - looked), True
        looked += size
        reached = waiting.join(reverse, F.col("id") == F.col("at")).select(F.col("next"), "origin", F.col("id").alias("via"), F.concat("path", F.array("edge_ord")).alias("path"))
        first = reached.groupBy("next").agg(F.min_by(F.struct("origin", "via", "path"), "path").alias("x")).select(F.col("next").alias("id"), "x.*")
        frontier = cut(first.join(seen, "id", "left_anti"), F.count(F.lit(1)).alias("n"))
        sites = sites.unionByName(frontier.df.select(F.col("id").alias("symbol_id"), F.lit(hop).alias("hops"), "origin", "via", "path"))
        seen = seen.unionByName(frontier.df.select("id"))
        if truncated:
            break
    return sites, truncated


def module_dependants(edges: DataFrame, module, max_hops: int = MAX_HOPS, cap: int = MAX_MODULE_DEPENDANTS) -> DataFrame:
    """(symbol_id, hops, via, path): up to ``cap`` modules that depend on one module, in order of the walk."""
    one = edges.sparkSession.createDataFrame([(module, 1)], f"id {edges.schema['src'].dataType.simpleString()}, ord int")
    sites, _ = blast_radius(edges, one, max_hops, None)
    return sites.orderBy("hops", "path").limit(cap).select("symbol_id", "hops", "via", "path")


def with_fan_in(sites: DataFrame, metrics: DataFrame) -> DataFrame:
    """Sites with the fan-in of their module, 0 where unknown."""
    return sites.join(metrics.select(F.col("id").alias("symbol_id"), F.col("fan_in").cast("int").alias("module_fan_in")), "symbol_id", "left").na.fill(0, ["module_fan_in"])


def with_names(sites: DataFrame, names: DataFrame, column: str = "via") -> DataFrame:
    """Sites with ``<column>_name`` from ``names(id, name)``; an unknown or unnamed id stands for itself."""
    known = names.groupBy(F.col("id").alias("_id")).agg(F.min("name").alias("_name"))
    return sites.join(known, F.col(column) == F.col("_id"), "left").withColumn(f"{column}_name", F.coalesce("_name", column)).drop("_id", "_name")


def usable_references(references: DataFrame) -> DataFrame:
    """References of ``(symbol_id, path, line, declared_path, declared_line, in_import)`` that are uses: not the
    declaration itself, not under an import or export, and inside the project."""
    own = (F.col("path") == F.col("declared_path")) & (F.col("line") == F.col("declared_line"))
    return references.where(~F.coalesce(own, F.lit(False)) & ~F.coalesce("in_import", F.lit(False)) & is_project_node(F.col("path")))
