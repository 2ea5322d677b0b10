"""Evidence: weights, order, packing into a token budget, rendering."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplefold.durable import cut
from ripplefold.functions.text import round_half_up

#: Weights of the kinds of evidence, and the order in which kinds are built.
WEIGHTS = {"introduced-cycle": 1000, "introduced-violation": 950, "type-definition": 400, "violation": 300, "cycle": 250, "instability": 200}
BUILD_ORDER = ("cycle", "layer-violation", "impacted-site", "instability", "duplicate", "type-definition")


def site_weight(hops: Column, fan_in: Column) -> Column:
    """max(1, 800 - 100 hops + min(fan_in, 50))."""
    return F.greatest(F.lit(1), 800 - 100 * hops + F.least(fan_in, F.lit(50)))


def duplicate_weight(similarity: Column) -> Column:
    """600 + the rounded percentage."""
    return 600 + F.floor(similarity * 100 + 0.5)


def cycle_weight(introduced: Column) -> Column:
    return F.when(introduced, WEIGHTS["introduced-cycle"]).otherwise(WEIGHTS["cycle"])


def violation_weight(introduced: Column) -> Column:
    return F.when(introduced, WEIGHTS["introduced-violation"]).otherwise(WEIGHTS["violation"])


def ordinals(items: DataFrame, by: list[str], weight: str = "weight", seq: str = "seq", spread: bool = False) -> DataFrame:
    """Items with ``ordinal`` and ``evidence_id`` (E1, E2, ...) inside each of ``by``: weight down, then build order.

    ``spread`` numbers groups of any size over many tasks; without it a group is sorted in one.
    """
    order = [F.desc(weight), F.asc(seq)]
    placed = numbered(items, by, order, "ordinal") if spread else items.withColumn("ordinal", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return placed.withColumn("evidence_id", F.concat(F.lit("E"), F.col("ordinal")))


def numbered(items: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """Items with their place in each of ``by``, whatever the size of a group.

    Rows are ranged by group and order over the partitions, and each partition counts its groups; a row's place is
    its place in its partition after the rows of the partitions before. What is counted has a row per partition and
    group that meet there.
    """
    ranged = cut(items.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id())).df
    counted = ranged.groupBy("_part", *by).agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counted.select(F.col("_part").alias("_p"), *(F.col(k).alias(f"_{k}") for k in by), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    local = ranged.withColumn("_local", F.row_number().over(W.partitionBy("_part", *by).orderBy(*order)))
    return local.join(offsets, same).withColumn(name, F.col("_local") + F.col("_before")).drop("_part", "_p", "_local", "_before", *(f"_{k}" for k in by))


def packed(items: DataFrame, by: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Items with ``kept``: taken greedily in order while they fit; one that does not fit is skipped and later,
    smaller ones may still be taken.

    The decision depends on all before it, so a group passes one task in order, row by row, with nothing kept but
    the sum so far. Groups are independent and spread over tasks. A null cost counts as 0.
    """
    schema = T.StructType([*items.schema.fields, T.StructField("kept", T.BooleanType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, used = None, 0
        for batch in batches:
            kept = []
            for key, c in zip(zip(*(batch.column(k).to_pylist() for k in by)), batch.column(cost).to_pylist()):
                if key != group:
                    group, used = key, 0
                fits = used + (c or 0) <= budget
                used += (c or 0) * fits
                kept.append(fits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.bool_())], [*batch.schema.names, "kept"])

    return items.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, schema)


def rendered(items: DataFrame, by: list[str]) -> DataFrame:
    """(by..., text): the evidence block of a prompt from (evidence_id, ordinal, kind, file, line, summary, detail)."""
    place = F.concat(F.lit(" "), F.col("file"), F.coalesce(F.concat(F.lit(":"), F.col("line").cast("string")), F.lit("")))
    head = F.concat(F.lit("["), "evidence_id", F.lit("] ("), "kind", F.lit(")"), F.coalesce(place, F.lit("")), F.lit(" "), "summary")
    line = F.concat_ws("\n", head, "detail")
    rows = items.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ordinal", line.alias("t")))).alias("x"))
    return rows.select(*by, F.array_join(F.col("x.t"), "\n").alias("text"))


def instability_summary(module: Column, before: Column, after: Column) -> Column:
    """What moved, with both values to two places."""
    shown = [F.format_string("%.2f", round_half_up(x)) for x in (before, after)]
    return F.when(before.isNull(), F.concat(module, F.lit(" is new with instability "), shown[1])).otherwise(F.concat(module, F.lit(" instability "), shown[0], F.lit(" -> "), shown[1]))
