"""Queries that write and read back, search the vector store, drain the queue stream, and compose the pipeline."""

from __future__ import annotations

import hashlib
import hmac
import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplefold.durable import cut, application_folder
from ripplefold.functions import code, sequential, text
from ripplefold.operators import blast, evidence, jobs, vectors
from ripplefold.plans import graphs, inputs_and_units, records
from ripplefold.sources import inputs, sinks
from ripplefold.sources.tables import table, unique
from ripplefold.streaming import jobs as stream


def h7_store_search(spark, d):
    """The three nearest stored vectors of other repositories, then 0.85 or more, for every query row (id divisible by 20)."""
    rows = unique(spark, d, "function_fingerprints", "fp_id", "repo", "embedder", "fingerprint_version", "embedding")
    found = vectors.search(rows.where("fp_id % 20 = 0"), rows, "fp_id", ["embedder", "fingerprint_version"], "repo", "embedding")
    return found.select(F.col("query").alias("fp_id"), "other", F.col("r").cast("int").alias("r"))


def b2_snapshot(spark, d):
    """Fingerprints written as a snapshot, last version per symbol and embedder, and read back."""
    root = f"{application_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    rows = unique(spark, d, "function_fingerprints").where("embedding is not null and updated_at is not null and symbol is not null")
    sinks.replace_snapshot(rows, root)
    return spark.read.parquet(root).select("fp_id", "repo", "file", "embedder")


def b1_saved_runs(spark, d):
    """Runs and their findings saved as one record and read back by run."""
    root = f"{application_folder(spark)}/record-{uuid.uuid4().hex}"
    runs = unique(spark, d, "runs", "id", "provider", "findings_count")
    found = unique(spark, d, "findings", "id", "run_id", "grounded")
    if not sinks.save_run({"runs": runs, "findings": found}, root, "all"):
        raise RuntimeError("the record was not saved")
    saved = spark.read.parquet(f"{root}/findings").groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return spark.read.parquet(f"{root}/runs").join(saved, "id", "left").select("id", "provider", F.coalesce("n", F.lit(0)).alias("n"))


def k7_drained_queue(spark, d):
    """The final state of each pull request's deliveries after the stream of them, repeated and late ones too, is drained."""
    root = f"{application_folder(spark)}/queue-{uuid.uuid4().hex}"
    rows = table(spark, d, "review_jobs").select("delivery_id", "owner", "repo", "pull_number", F.col("created_at").cast("timestamp").alias("created_at")).where("delivery_id is not null")
    written = cut(rows)
    source = spark.readStream.schema(written.df.schema).parquet(written.path)
    stream.drain(stream.queue_changes(source), stream.by_batch(f"{root}/changes"), f"{root}/state").awaitTermination()
    return stream.final_states(spark.read.schema(stream.CHANGES).parquet(f"{root}/changes"))


def i18_signatures(spark, d):
    """Payloads signed with the right key, another key, in a wrong form, or not at all."""
    j = unique(spark, d, "review_jobs", "id", "clone_url")
    made = j.withColumn("n", (F.col("id") % 4).cast("int"))
    sign = F.udf(lambda body, n: None if n == 3 else ("sha256=" if n < 2 else "md5=") + hmac.new(b"key" if n == 0 else b"other", (body or "").encode(), hashlib.sha256).hexdigest(), "string", useArrow=True)
    signed = made.withColumn("header", sign("clone_url", "n"))
    return signed.select("id", sequential.signature_state(F.col("clone_url"), F.col("header"), "key").alias("state"))


def k8_repaired_answers(spark, d):
    """Answers of a model that is right only after it was told what was wrong: one call for grounded runs, two for others."""
    prompts = unique(spark, d, "runs", "id", "graph_grounded").select("id", F.when(F.coalesce("graph_grounded", F.lit(False)), "short").otherwise("long").alias("prompt"))

    def model(prompt: str) -> str:
        return "[]" if prompt == "short" or "not accepted" in prompt else "I found nothing."

    return inputs.completed(prompts, model, sequential.checked_findings, "id").select("id", "calls", F.col("problem").isNull().alias("accepted"))


def l4_missed_everywhere(spark, d):
    """Defects seen in any arm and caught in none."""
    f, defects = records._cases(spark, d)
    arms = defects.select("case", "defect_no", F.explode(F.array(F.lit(True), F.lit(False))).alias("arm"))
    arm_of = f.select("finding_no", "arm")
    caught = records.d12_matches(spark, d).where("finding_no <> defect_no").join(arm_of, "finding_no").select("case", "defect_no", "arm").distinct()
    return arms.select("case", "defect_no").union(caught.select("case", "defect_no")).distinct().exceptAll(caught.select("case", "defect_no").distinct())


def c8_quotable_types(spark, d):
    """The first twelve interfaces, type aliases and enums of at most 1500 characters of each repository, by path and line."""
    files = inputs_and_units._sources(spark, d).select("repo", "path", F.explode(code.contracts(F.col("content"))).alias("c"))
    once = files.groupBy("repo", "path", F.col("c.name").alias("name")).agg(F.min("c.line").alias("line"))
    ranked = once.withColumn("r", F.row_number().over(W.partitionBy("repo").orderBy("path", "line", "name")))
    return ranked.where("r <= 12").select("repo", "path", "name", F.col("r").cast("int").alias("r"))


def c8_short_heads(spark, d):
    """The first twelve distinct in-repository heads of at most 1500 characters per repository, by path."""
    files = unique(spark, d, "source_files", "repo", "file", "head").where(F.col("head").isNotNull() & (F.length("head") <= 1500))
    once = files.groupBy("repo", "head").agg(F.min("file").alias("file"))
    ranked = once.withColumn("r", F.row_number().over(W.partitionBy("repo").orderBy("file", "head")))
    return ranked.where("r <= 12").select("repo", "file", F.col("r").cast("int").alias("r"))


def i6_relative_paths(spark, d):
    """Checkout roots below the folder that holds all of them."""
    return unique(spark, d, "runs", "id", "repo_root").select("id", text.relative_to(F.col("repo_root"), F.lit("/srv/checkouts")).alias("below"), text.percent(F.length("repo_root") / 100).alias("share"))


def j9_impact_evidence(spark, d):
    """The whole impact of the change as one packed list of evidence per brand: cycles, violations, sites, instability, duplicates.

    Units belong to no brand, so the duplicates, ten at most, are evidence of every brand's list.
    """
    e, n = cut(graphs.edges(spark, d)).df, graphs.nodes(spark, d)
    sites, _ = blast.blast_radius(e, graphs._changed(e), 3, None)
    sites = blast.with_fan_in(sites, e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in")))
    site_items = sites.select(F.substring_index("origin", "/", 1).alias("change"), F.lit("impacted-site").alias("kind"), F.concat_ws(" ", "symbol_id", F.lit("via"), "via").alias("summary"), evidence.site_weight(F.col("hops"), F.col("module_fan_in")).cast("int").alias("weight"))
    other = graphs.evidence_items(n, e, graphs.weighted_cycles(e, n)).select("change", "kind", "summary", F.col("weight").cast("int").alias("weight"))
    of_brands = cut(site_items.unionByName(other)).df
    duplicates = duplicate_items(inputs_and_units.ranked_matches(spark, d)).collect()  # IN_ALL rows at most
    told = F.array(*(F.struct(*(F.lit(row[c]).alias(c) for c in ("kind", "summary", "weight"))) for row in duplicates))
    shared = of_brands.select("change").distinct().select("change", F.inline(told)) if duplicates else of_brands.limit(0)
    return packed_evidence(of_brands.unionByName(shared))


def duplicate_items(hits):
    """(kind, summary, weight) of ranked hits of similar units."""
    said = F.concat_ws(" ", F.col("unit").cast("string"), F.lit("is"), F.format_string("%.2f", text.round_half_up(F.col("similarity"))), F.lit("similar to"), F.col("other").cast("string"), F.lit("in"), "scope")
    return hits.select(F.lit("duplicate").alias("kind"), said.alias("summary"), evidence.duplicate_weight(F.col("similarity")).cast("int").alias("weight"))


def packed_evidence(items):
    """Items (change, kind, summary, weight) numbered per change, by weight and order of building, and packed."""
    built = F.array_position(F.array(*map(F.lit, evidence.BUILD_ORDER)), F.col("kind"))
    costed = items.withColumn("cost", text.estimated_tokens(F.col("summary"))).withColumn("seq", F.struct(built.alias("built"), F.col("summary")))
    ranked = evidence.ordinals(costed, ["change"], spread=True).drop("seq")
    return evidence.packed(ranked, ["change"], ["ordinal"], "cost", 2000).select("change", "kind", "summary", "weight", F.col("ordinal").cast("int").alias("ordinal"), "kept")


def k9_checked_states(spark, d):
    return jobs.checked_states(unique(spark, d, "review_jobs", "id", "state")).select("id", "state")


QUERIES = {f.__name__: f for f in (h7_store_search, b1_saved_runs, b2_snapshot, k7_drained_queue, k8_repaired_answers, k9_checked_states, i6_relative_paths, i18_signatures, l4_missed_everywhere, c8_quotable_types, c8_short_heads, j9_impact_evidence)}

SQL = {
    "h7_store_search": """WITH f AS (SELECT DISTINCT fp_id, repo, embedder, fingerprint_version AS v, embedding::DOUBLE[] AS e FROM function_fingerprints WHERE len(embedding) > 0),
        ok AS (SELECT *, len(e) AS n, sqrt(list_sum([x * x FOR x IN e])) AS l FROM f WHERE len([x FOR x IN e IF isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
        s AS (SELECT a.fp_id, b.fp_id AS other, list_dot_product(a.e, b.e) / (a.l * b.l) AS c FROM ok a JOIN ok b ON a.embedder = b.embedder AND a.v = b.v AND a.n = b.n AND a.repo <> b.repo WHERE a.fp_id % 20 = 0)
        SELECT fp_id, other, r FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fp_id ORDER BY round(c, 12) DESC, other) AS INTEGER) AS r FROM s) WHERE r <= 3 AND c >= 0.85""",
    "b2_snapshot": """SELECT fp_id, repo, file, embedder FROM (SELECT *, row_number() OVER (PARTITION BY repo, file, symbol, start_line, embedder ORDER BY updated_at DESC, fp_id DESC) AS r
        FROM (SELECT DISTINCT fp_id, repo, file, symbol, start_line, embedder, updated_at FROM function_fingerprints WHERE embedding IS NOT NULL AND updated_at IS NOT NULL AND symbol IS NOT NULL)) WHERE r = 1""",
    "b1_saved_runs": "SELECT r.id, any_value(provider) AS provider, count(f.id) AS n FROM (SELECT DISTINCT id, provider, findings_count FROM runs) r LEFT JOIN (SELECT DISTINCT id, run_id, grounded FROM findings) f ON f.run_id = r.id GROUP BY r.id",
    "k7_drained_queue": """WITH j AS (SELECT DISTINCT delivery_id, owner, repo, pull_number, created_at FROM review_jobs WHERE delivery_id IS NOT NULL)
        SELECT delivery_id, CASE WHEN row_number() OVER (PARTITION BY owner, repo, pull_number ORDER BY created_at DESC, delivery_id DESC) = 1 THEN 'pending' ELSE 'superseded' END AS state FROM j""",
    "k8_repaired_answers": "SELECT DISTINCT id, CASE WHEN coalesce(graph_grounded, false) THEN 1 ELSE 2 END AS calls, true AS accepted FROM runs",
    "k9_checked_states": "SELECT DISTINCT id, state FROM review_jobs",
    "i6_relative_paths": "SELECT DISTINCT id, CASE WHEN starts_with(repo_root, '/srv/checkouts/') THEN substr(repo_root, 16) END AS below, printf('%.1f%%', CAST(length(repo_root) AS DOUBLE)) AS share FROM runs",
    "i18_signatures": "SELECT DISTINCT id, CASE id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'malformed' ELSE 'missing' END AS state FROM review_jobs",
    "l4_missed_everywhere": f"WITH {records._F}, {records._CASES} SELECT \"case\", defect_no FROM df WHERE defect_no NOT IN (SELECT defect_no FROM m WHERE finding_no <> defect_no)",
    "c8_short_heads": """SELECT repo, file, CAST(r AS INTEGER) AS r FROM (SELECT repo, file, row_number() OVER (PARTITION BY repo ORDER BY file, head) AS r FROM (SELECT repo, head, min(file) AS file FROM source_files WHERE length(head) <= 1500 GROUP BY 1, 2)) WHERE r <= 12""",
    "j9_impact_evidence": f"""WITH RECURSIVE {graphs.SQL_EDGES}, {graphs.SQL_ITEMS}, {graphs._coupling_sql('coupling', 'edges')}, {graphs.SQL_SITES}, {inputs_and_units.SQL_RANKED}, every AS (
        SELECT split_part(module, '/', 1) AS change, kind, summary, weight FROM items
        UNION ALL SELECT split_part(origin, '/', 1), 'impacted-site', symbol_id || ' via ' || via, greatest(1, 800 - 100 * hops + least(module_fan_in, 50)) FROM sites),
      own AS (SELECT * FROM every UNION ALL SELECT change, 'duplicate', unit || ' is ' || printf('%.2f', floor(s * 100 + 0.5) / 100) || ' similar to ' || other || ' in ' || scope, 600 + CAST(floor(s * 100 + 0.5) AS INTEGER)
        FROM ranked_hits, (SELECT DISTINCT change FROM every)),
      numbered AS (SELECT *, CAST(ceil(length(summary) / 1.25) AS BIGINT) AS cost, row_number() OVER (PARTITION BY change ORDER BY weight DESC, list_position(['cycle', 'layer-violation', 'impacted-site', 'instability', 'duplicate'], kind), summary) AS ordinal FROM own),
      w AS (SELECT change, ordinal, cost <= 2000 AS kept, CASE WHEN cost <= 2000 THEN cost ELSE 0 END AS used FROM numbered WHERE ordinal = 1
        UNION ALL SELECT n.change, n.ordinal, w.used + n.cost <= 2000, w.used + CASE WHEN w.used + n.cost <= 2000 THEN n.cost ELSE 0 END FROM w JOIN numbered n ON n.change = w.change AND n.ordinal = w.ordinal + 1)
      SELECT change, kind, summary, CAST(weight AS INTEGER) AS weight, CAST(ordinal AS INTEGER) AS ordinal, kept FROM numbered JOIN w USING (change, ordinal)""",
}
