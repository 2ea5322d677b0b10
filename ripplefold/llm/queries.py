"""Queries of the training-data operators with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplefold.durable import cut
from ripplefold.llm import components, encode, handwritten, mixing, near_duplicates, neighbours, quantiles, repetition
from ripplefold.llm.oracle import SQL
from ripplefold.sources.tables import table, unique

#: Fixed values of the test statement.
SIMILAR = 0.85
LEAST_COSINE = 0.7
NEAREST = 3
LEAST_JACCARD = 0.5
LEAST_TOKENS = 40
LEAST_REPEATED = 0.3


def _files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, d, "source_files").select("repo", "file", "head", "n_lines", "n_bytes")
    return files, handwritten.whole_attribute_files(files)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    files, attributes = _files(spark, d)
    asked = table(spark, d, "function_fingerprints").select("repo", "file").distinct()
    return asked.join(handwritten.not_handwritten(files, attributes).select("repo", "file"), ["repo", "file"], "left_semi")


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    files, attributes = _files(spark, d)
    return handwritten.not_handwritten(files, attributes)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    matches = table(spark, d, "stored_matches").select("unit_no", "match_no", "similarity")
    return components.groups(matches, "unit_no", "match_no", "similarity", SIMILAR)


def _measures(spark: SparkSession, d: str) -> DataFrame:
    """(run_id, day, model, graph_grounded, measure, x) of each positive measure of each run of a known group."""
    runs = unique(spark, d, "runs", "id", "created_at", "model", "graph_grounded", "llm_latency_ms", "prompt_tokens")
    both = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("x")) for m in ("llm_latency_ms", "prompt_tokens")))
    known = runs.where("model is not null and graph_grounded is not null")
    return known.select(F.col("id").alias("run_id"), F.to_date("created_at").alias("day"), "model", "graph_grounded", F.inline(both)).where("x > 0")


GROUP = ["model", "graph_grounded", "measure"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    measured = cut(_measures(spark, d).drop("day")).df
    counts = cut(quantiles.sketch(measured, GROUP, "x")).df
    slow = F.col("measure") == "llm_latency_ms"
    limits = cut(quantiles.exact(measured, counts, GROUP, "x", F.when(slow, 0.95).otherwise(0.05))).df
    joined = measured.join(limits, GROUP)
    return joined.where(F.when(slow, F.col("x") > 2 * F.col("exact_q")).otherwise(4 * F.col("x") < F.col("exact_q"))).select("run_id", "measure")


QUANTILES = [0.05, 0.5, 0.9, 0.95, 0.99]


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each group from one sketch per day, put together, in thousandths; bounds hold the exact value."""
    daily = quantiles.sketch(_measures(spark, d), [*GROUP, "day"], "x")
    told = quantiles.estimate(quantiles.merge(daily, by=GROUP), GROUP, QUANTILES)
    return told.select(*GROUP, "q", "bucket", *(F.floor(F.col(c) * 1000 + 0.5).cast("long").alias(c) for c in ("value", "low", "high")), "total")


def p3_exact_percentiles(spark: SparkSession, d: str) -> DataFrame:
    measured = cut(_measures(spark, d).drop("day", "run_id")).df
    counts = cut(quantiles.sketch(measured, GROUP, "x")).df
    parts = [quantiles.exact(measured, counts, GROUP, "x", F.lit(q)).withColumn("q", F.lit(q)) for q in (0.5, 0.95)]
    return parts[0].unionByName(parts[1]).select(*GROUP, "q", F.floor(F.col("exact_q") * 100 + 0.5).cast("long").alias("hundredths"))


VECTOR_GROUP = ["embedder", "fingerprint_version"]


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "function_fingerprints").select("fp_id", "embedder", "fingerprint_version", "embedding")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.pairs(_vectors(spark, d), "fp_id", "embedding", VECTOR_GROUP, NEAREST, LEAST_COSINE)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "function_units").select("unit_no", "tokens")
    return near_duplicates.pairs(units, "unit_no", "tokens", LEAST_JACCARD, LEAST_TOKENS)


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "function_units").select("unit_no", "tokens")
    return near_duplicates.class_links(units, "unit_no", "tokens", LEAST_JACCARD, LEAST_TOKENS)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.token_ids(table(spark, d, "documents"), "doc_id")


def _mix(spark: SparkSession, d: str) -> mixing.Mix:
    targets = table(spark, d, "source_targets")
    sized = encode.token_counts(table(spark, d, "documents"), ["doc_id", "source"])
    docs = cut(mixing.named(sized, targets, "doc_id", "source")).df
    return mixing.Mix(spark, docs, targets, "doc_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).short()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


def p7_audit(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each target's source, and how many break a rule of the drawn mix: none."""
    return _mix(spark, d).audit()


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).rows()


def p8_measures(spark: SparkSession, d: str) -> DataFrame:
    """The exact counts of words and of repeated words of each document."""
    return repetition.measures(table(spark, d, "documents"), "doc_id").select("doc_id", "n_words", "covered")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return cut(repetition.measures(table(spark, d, "documents"), "doc_id")).df


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(_judged(spark, d), LEAST_REPEATED).select("doc_id")


def p8_posterior(spark: SparkSession, d: str) -> DataFrame:
    return repetition.judged(_judged(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_reasons, p2_found, p3_found, p3_percentiles, p3_exact_percentiles, p4_found, p5_found, p5_classes,
            p6_ids, p7_found, p7_shares, p7_audit, p7_mix, p8_found, p8_measures, p8_posterior,
        )
    }


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
