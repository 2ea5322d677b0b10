"""Queries over runs, findings and jobs: lookups, text functions, grounding, packing, evaluation, queue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplefold.functions import text
from ripplefold.operators import evaluate, evidence, grounding, jobs
from ripplefold.sources import inputs, sinks
from ripplefold.sources.tables import table, unique

NOW = "2025-06-01 00:00:00"
BUDGET = 400


def _findings(spark, d, *columns):
    return unique(spark, d, "findings", *columns)


def _hundredths(x: Column) -> Column:
    return F.floor(x * 100 + 0.5).cast("long")


# Lookups


def a17_latest_runs(spark, d):
    """The 200 newest runs."""
    runs = unique(spark, d, "runs", "id", "created_at", "model", "findings_count")
    return runs.orderBy(F.desc("created_at"), "id").limit(200)


def a16_run_lookup(spark, d):
    """Each run with its findings split by grounding, in order of id."""
    runs = unique(spark, d, "runs", "id", "repo_root", "model").withColumnRenamed("id", "run_id")
    parts = _findings(spark, d, "id", "run_id", "grounded").groupBy("run_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("grounded"), F.col("id")))).alias("kept"), F.array_sort(F.collect_list(F.when(~F.col("grounded"), F.col("id")))).alias("rejected")
    )
    none = F.array().cast("array<bigint>")
    return runs.join(parts, "run_id", "left").select("run_id", "repo_root", "model", F.coalesce("kept", none).alias("kept"), F.coalesce("rejected", none).alias("rejected"))


def e8_cost_by_model(spark, d):
    """Cost per repository, model and day, null where any run of it is unknown."""
    runs = unique(spark, d, "runs", "id", "repo_root", "model", "created_at", "estimated_cost_usd")
    by = runs.groupBy("repo_root", "model", F.to_date("created_at").alias("day"))
    return by.agg(evaluate.all_or_null_sum(F.col("estimated_cost_usd")).cast("decimal(18,6)").alias("cost"), F.count(F.lit(1)).alias("n"))


def e7_token_usage(spark, d):
    runs = unique(spark, d, "runs", "id", "provider", "model", "prompt_tokens", "completion_tokens")
    return runs.groupBy("provider", "model").agg(F.sum("prompt_tokens").alias("input_tokens"), F.sum("completion_tokens").alias("output_tokens"))


# Scalar functions


def c1_source_files(spark, d):
    return table(spark, d, "function_units").select("file").distinct().select("file", text.is_source_file(F.col("file")).alias("source"), text.is_project_node(F.col("file")).alias("node"))


def i5_plain_paths(spark, d):
    files = table(spark, d, "function_units").select("file").distinct()
    return files.select("file", text.plain_slashes(F.col("file")).alias("plain"), text.parent_folder(text.plain_slashes(F.col("file"))).alias("folder"))


def i3_short_names(spark, d):
    units = unique(spark, d, "function_units", "unit_no", "id", "file", "name")
    return units.select("unit_no", text.short_name(F.col("id")).alias("short"), text.symbol_id(F.col("file"), F.coalesce("name", F.lit("<anonymous>"))).alias("symbol"))


def i13_remote_identity(spark, d):
    return table(spark, d, "review_jobs").select("clone_url").distinct().select("clone_url", text.remote_identity(F.col("clone_url")).alias("identity"))


def i8_estimated_tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", text.utf16_length(F.col("text")).alias("units"), text.estimated_tokens(F.col("text")).alias("tokens"))


def i11_summaries(spark, d):
    """Summaries cut to 60 characters, safe for markup and for a table."""
    f = _findings(spark, d, "id", "summary", "severity", "confidence")
    cut = text.truncated(F.col("summary"), 60)
    return f.select("id", cut.alias("short"), text.escaped_html(cut).alias("html"), text.escaped_cell(F.col("summary")).alias("cell"), text.severity_rank(F.col("severity")).alias("rank"), F.floor(F.col("confidence").cast("double") * 100 + 0.5).cast("long").alias("hundredths"), text.clamped(F.length("summary"), 1, 100).alias("clamped"))


def i23_instants(spark, d):
    """Instants as text, lease limits and scrubbed errors of jobs."""
    j = unique(spark, d, "review_jobs", "id", "created_at", "claimed_at", "last_error", "head_sha")
    return j.select("id", text.iso_instant(F.col("created_at")).alias("iso"), (F.col("claimed_at") - F.make_dt_interval(mins=F.lit(jobs.LEASE_MINUTES))).alias("lease"), F.left("last_error", F.lit(jobs.ERROR_LENGTH)).alias("error"), text.scrubbed(F.concat(F.lit("key "), "head_sha"), F.col("head_sha")).alias("scrubbed"))


def i28_kind_and_rest(spark, d):
    f = _findings(spark, d, "id", "severity", "summary", "line")
    told = text.kind_and_rest(F.concat(F.col("severity"), F.lit(": "), F.col("summary")))
    return f.select("id", told["kind"].alias("kind"), told["rest"].alias("rest"), text.plural(F.col("line"), "line").alias("lines"))


# Grounding and gate


def _judged(spark, d):
    """Findings held against the evidence of their run, which has three items per kept finding of it."""
    runs = unique(spark, d, "runs", "id", "findings_count").withColumnRenamed("id", "run_id")
    known = F.transform(F.sequence(F.lit(1), F.greatest(3 * F.col("findings_count"), F.lit(1))), lambda i: F.concat(F.lit("E"), i.cast("string")))
    f = _findings(spark, d, "id", "run_id", "severity", "category", "evidence_refs").join(runs, "run_id", "left").withColumn("known", F.when(F.col("findings_count").isNotNull(), known))
    return grounding.grounded(f, "evidence_refs", "known")


def d11_grounding(spark, d):
    return _judged(spark, d).select("id", F.array_sort("unknown").alias("unknown"), "reason")


def l7_split(spark, d):
    """Kept and rejected per reason; together they are all findings."""
    kept, rejected = grounding.kept_and_rejected(_judged(spark, d).select("id", "reason"))
    return kept.unionByName(rejected).groupBy(F.coalesce("reason", F.lit("kept")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def c6_gate(spark, d):
    return grounding.should_fail(_findings(spark, d, "id", "run_id", "severity"), ["run_id"], "high")


def c7_structural(spark, d):
    f = _findings(spark, d, "id", "category")
    return f.select("id", F.coalesce(F.col("category").isin(*text.STRUCTURAL), F.lit(False)).alias("structural"))


# Packing and rendering


def _ordered(spark, d):
    f = _findings(spark, d, "id", "run_id", "severity", "category", "file", "line", "summary", "rationale")
    weight = (1000 - 100 * F.coalesce(text.severity_rank(F.col("severity")), F.lit(9)))
    items = f.withColumn("weight", weight).withColumn("seq", F.col("id")).withColumn("cost", F.coalesce(text.estimated_tokens(F.col("rationale")), F.lit(0)) + text.estimated_tokens(F.coalesce("summary", F.lit(""))))
    return evidence.ordinals(items, ["run_id"])


def f1_evidence_order(spark, d):
    return _ordered(spark, d).select("run_id", "id", F.col("ordinal").cast("int").alias("ordinal"), "evidence_id", "cost")


def f9_packed(spark, d):
    """Findings of each run packed greedily into a token budget, heaviest first."""
    items = _ordered(spark, d).select("run_id", "id", "ordinal", "cost")
    return evidence.packed(items, ["run_id"], ["ordinal"], "cost", BUDGET).select("run_id", "id", "kept")


def b13_prompt(spark, d):
    items = _ordered(spark, d).withColumn("kind", F.coalesce("category", F.lit("finding"))).withColumn("detail", F.col("rationale"))
    return evidence.rendered(items, ["run_id"])


def b7_by_severity(spark, d):
    f = _findings(spark, d, "id", "run_id", "severity")
    return sinks.by_severity(f).select("id", "run_id", F.col("place").cast("int").alias("place"))


def b8_inline_comments(spark, d):
    """Findings that stand on a line where a function unit of the same file begins, against the others."""
    lines = table(spark, d, "function_units").select(F.col("file").alias("path"), "line")
    return sinks.split_comments(_findings(spark, d, "id", "file", "line"), lines).select("id", "inline")


def b5_json(spark, d):
    f = _findings(spark, d, "id", "severity", "line")
    return f.select("id", F.to_json(F.struct("id", "severity", "line")).alias("json"))


def a20_echo(spark, d):
    """The deterministic answer to each run's evidence block."""
    prompts = b13_prompt(spark, d).withColumnRenamed("text", "prompt")
    return inputs.echo_answers(prompts, "run_id").select("run_id", "refs", "file", "input_tokens")


# Evaluation: grave, grounded findings are the truth, and each is judged by the other findings of its repository.


def _cases(spark, d):
    runs = unique(spark, d, "runs", "id", "repo_root", "graph_grounded", "model").select(F.col("id").alias("run_id"), F.element_at(F.split("repo_root", "/"), -1).alias("case"), F.coalesce("graph_grounded", F.lit(False)).alias("arm"), F.col("model").alias("model"))
    f = _findings(spark, d, "id", "run_id", "severity", "category", "file", "line", "grounded").join(runs, "run_id")
    truth = f.where("severity in ('critical', 'high') and grounded and category is not null")
    defects = truth.select("case", F.col("id").alias("defect_no"), "file", "line", F.when(F.col("line") == 0, 1000).otherwise(6).alias("line_tolerance"), F.array("category").alias("accept_categories"))
    return f.withColumnRenamed("id", "finding_no"), defects


def d12_matches(spark, d):
    f, defects = _cases(spark, d)
    return evaluate.matches(f.select("case", "finding_no", "file", "line", "category"), defects, ["case"]).select("case", "finding_no", "defect_no")


def f6_credit(spark, d):
    return evaluate.credited(d12_matches(spark, d), ["case"])


def l3_missed(spark, d):
    """Defects that no other finding identifies."""
    f, defects = _cases(spark, d)
    caught = d12_matches(spark, d).where("finding_no <> defect_no").select("defect_no")
    return defects.select("case", "defect_no").join(caught, "defect_no", "left_anti")


def _scored(spark, d):
    """(case, arm, model, caught, false_positives, missed): a run is a model of an arm of a case."""
    f, defects = _cases(spark, d)
    keys = ["case", "arm", "model"]
    hits = evaluate.matches(f.select("case", "finding_no", "file", "line", "category"), defects, ["case"]).where("finding_no <> defect_no")
    own = f.select(*keys, "finding_no")
    caught = own.join(hits.select("finding_no", "defect_no"), "finding_no").groupBy(*keys).agg(F.countDistinct("defect_no").alias("caught"), F.countDistinct("finding_no").alias("right"))
    totals = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    actual = defects.groupBy("case").agg(F.count(F.lit(1)).alias("actual"))
    got = caught.toDF("_case", "_arm", "_model", "caught", "right")
    same = F.col("model").eqNullSafe(F.col("_model")) & (F.col("case") == F.col("_case")) & (F.col("arm") == F.col("_arm"))
    rows = totals.join(got, same, "left").select(*keys, "n", F.coalesce("caught", F.lit(0)).alias("caught"), F.coalesce("right", F.lit(0)).alias("right"))
    return rows.join(actual, "case", "left").select(*keys, "caught", (F.col("n") - F.col("right")).alias("false_positives"), F.greatest(F.coalesce("actual", F.lit(0)) - F.col("caught"), F.lit(0)).alias("missed"))


def e9_confusion(spark, d):
    return _scored(spark, d)


def _rated(spark, d):
    p, r, f1 = evaluate.rates(F.col("caught"), F.col("false_positives"), F.col("missed"))
    return _scored(spark, d).select("case", "arm", "model", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def e10_rates(spark, d):
    return _rated(spark, d).select("case", "arm", "model", *(F.floor(F.col(c) * 1e6 + 0.5).cast("long").alias(c) for c in ("precision", "recall", "f1")))


def e11_structural_recall(spark, d):
    """Share of structural defects that some other finding identifies, null for a case without any."""
    _, defects = _cases(spark, d)
    caught = d12_matches(spark, d).where("finding_no <> defect_no").select("defect_no").distinct().withColumn("hit", F.lit(1))
    rows = defects.join(caught, "defect_no", "left").withColumn("structural", F.col("accept_categories")[0].isin(*text.STRUCTURAL))
    some = F.count(F.when(F.col("structural"), 1))
    return rows.groupBy("case").agg(F.when(some > 0, F.floor(F.count(F.when(F.col("structural") & F.col("hit").isNotNull(), 1)) * 1e6 / some + 0.5)).cast("long").alias("recall_millionths"))


MEASURES = ("precision", "recall", "f1", "structural_recall", "prompt_tokens", "latency_ms")


def _measured(spark, d):
    """(case, arm, model, the six measures): rates of each scored run, the recall of structural defects of its case
    (null without any), and the tokens and time of its model calls."""
    runs = unique(spark, d, "runs", "id", "repo_root", "graph_grounded", "model", "prompt_tokens", "llm_latency_ms").where("prompt_tokens > 0 and llm_latency_ms > 0")
    keys = [F.element_at(F.split("repo_root", "/"), -1).alias("_case"), F.coalesce("graph_grounded", F.lit(False)).alias("_arm"), F.col("model").alias("_model")]
    used = runs.groupBy(*keys).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("llm_latency_ms").alias("latency_ms"))
    same = (F.col("case") == F.col("_case")) & (F.col("arm") == F.col("_arm")) & F.col("model").eqNullSafe(F.col("_model"))
    structural = e11_structural_recall(spark, d).select("case", (F.col("recall_millionths") / 1e6).alias("structural_recall"))
    return _rated(spark, d).join(used, same, "left").join(structural, "case", "left").select("case", "arm", "model", *MEASURES)


def _failures(spark, d):
    """Whether each run failed outright: its tokens were never counted."""
    return unique(spark, d, "runs", "id", "repo_root", "graph_grounded", "prompt_tokens").select(F.element_at(F.split("repo_root", "/"), -1).alias("case"), F.coalesce("graph_grounded", F.lit(False)).alias("arm"), F.coalesce(F.col("prompt_tokens") == -1, F.lit(False)).cast("int").alias("failed"))


def e13_arm_summary(spark, d):
    """The spread of each of six measures per arm of each case and per arm overall, in hundredths, with the runs that failed."""
    sets = [["case", "arm"], ["arm"]]
    both = _measured(spark, d).groupingSets(sets, "case", "arm").agg(*(evaluate.spread(F.col(m)).alias(m) for m in MEASURES))
    failed = _failures(spark, d).groupingSets(sets, "case", "arm").agg(F.sum("failed").alias("failures")).toDF("_case", "_arm", "failures")
    joined = both.join(failed, F.col("case").eqNullSafe(F.col("_case")) & (F.col("arm") == F.col("_arm")), "left")
    long = joined.select("case", "arm", F.coalesce("failures", F.lit(0)).alias("failures"), F.inline(F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("s")) for m in MEASURES))))
    return long.select("case", "arm", "measure", "failures", *(_hundredths(F.col(f"s.{c}")).alias(c) for c in ("mean", "stdev", "min", "max")), F.col("s.n").alias("n"))


def e15_verdict(spark, d):
    """Whether the two arms of each case differ by more than their deviations, and the word for it."""
    f1 = _rated(spark, d).groupBy("case", "arm").agg(evaluate.spread(F.col("f1")).alias("s"))
    pivot = f1.groupBy("case").pivot("arm", [True, False]).agg(F.first("s"))
    failures = _failures(spark, d).groupBy("case").agg(F.sum("failed").alias("failures"))
    args = (F.col("true.mean"), F.col("true.stdev"), F.col("false.mean"), F.col("false.stdev"))
    told = pivot.where(F.col("true").isNotNull() & F.col("false").isNotNull()).join(failures, "case", "left")
    return told.select("case", evaluate.separated(*args).alias("separated"), evaluate.verdict(*args, F.coalesce("failures", F.lit(0))).alias("verdict"))


# Queue


def _jobs(spark, d):
    return unique(spark, d, "review_jobs")


def _now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def k1_enqueued(spark, d):
    key = jobs.delivery_key("delivery_id", "owner", "repo", "pull_number", "head_sha")
    rows = _jobs(spark, d).select("id", key.alias("key"), "created_at")
    return jobs.enqueued(rows, "key", ["created_at", "id"]).select("id", "key")


def k2_superseded(spark, d):
    rows = _jobs(spark, d).select("id", "delivery_id", "owner", "repo", "pull_number", "state", "superseded_by", "created_at")
    return jobs.superseded(rows, ["owner", "repo", "pull_number"], ["created_at", "id"]).select("id", "state", "superseded_by")


def k3_claim(spark, d):
    return jobs.claimed(_jobs(spark, d), _now()).select("id", "state", "attempts")


def k5_finished(spark, d):
    """Running jobs after a round in which those with a known error fail again and the others are done."""
    rows = _jobs(spark, d)
    results = rows.select("id", F.concat(F.lit("run-"), F.col("id").cast("string")).alias("result_run"), F.when(F.col("attempts") > 1, F.lit("timeout")).alias("error"))
    return jobs.finished(rows, results, _now()).select("id", "state", "run_id", "last_error")


def k6_reclaimed(spark, d):
    return jobs.reclaimed(_jobs(spark, d), _now()).select("id", "state", "stale")


def e16_pending(spark, d):
    return jobs.checked_states(_jobs(spark, d)).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        a16_run_lookup, a17_latest_runs, a20_echo, e7_token_usage, e8_cost_by_model, c1_source_files, c6_gate, c7_structural, i3_short_names, i5_plain_paths,
        i8_estimated_tokens, i11_summaries, i13_remote_identity, i23_instants, i28_kind_and_rest, d11_grounding, l7_split, f1_evidence_order, f9_packed, b5_json,
        b7_by_severity, b8_inline_comments, b13_prompt, d12_matches, f6_credit, l3_missed, e9_confusion, e10_rates, e11_structural_recall, e13_arm_summary,
        e15_verdict, e16_pending, k1_enqueued, k2_superseded, k3_claim, k5_finished, k6_reclaimed,
    )
}

_F = "f AS (SELECT DISTINCT * FROM findings), r AS (SELECT DISTINCT * FROM runs), j AS (SELECT DISTINCT * FROM review_jobs)"
_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 END"
_UNITS = "(length({0}) + length(regexp_replace({0}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"
_TOKENS = "CAST(ceil(" + _UNITS + " / 1.25) AS BIGINT)"
_ORDERED = f"""o AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY 1000 - 100 * coalesce({_RANK}, 9) DESC, id) AS ordinal,
    coalesce({_TOKENS.format('rationale')}, 0) + {_TOKENS.format("coalesce(summary, '')")} AS cost FROM f)"""
_PROMPT = """p AS (SELECT run_id, string_agg('[E' || ordinal || '] (' || coalesce(category, 'finding') || ')' || coalesce(' ' || file || coalesce(':' || line, ''), '') || ' ' || summary
    || coalesce(chr(10) || rationale, ''), chr(10) ORDER BY ordinal) AS text FROM o GROUP BY run_id)"""
_JUDGED = """g AS (SELECT f.id, coalesce(evidence_refs, []) AS refs, CASE WHEN findings_count IS NULL THEN [] ELSE [ 'E' || i FOR i IN range(1, greatest(3 * findings_count, 1) + 1) ] END AS known
    FROM f LEFT JOIN r ON r.id = run_id),
  jd AS (SELECT id, list_sort(list_distinct([x FOR x IN refs IF NOT list_contains(known, x)])) AS unknown, len(refs) AS n FROM g),
  judged AS (SELECT id, unknown, CASE WHEN len(unknown) > 0 THEN 'unknown-evidence' WHEN n = 0 THEN 'no-evidence' END AS reason FROM jd)"""
_CASES = """c AS (SELECT f.*, list_last(string_split(repo_root, '/')) AS "case", coalesce(graph_grounded, false) AS arm, model FROM f JOIN r ON r.id = run_id),
  df AS (SELECT "case", id AS defect_no, replace(file, chr(92), '/') AS file, line, CASE WHEN line = 0 THEN 1000 ELSE 6 END AS tol, category FROM c
    WHERE severity IN ('critical', 'high') AND grounded AND category IS NOT NULL),
  m AS (SELECT c."case", c.id AS finding_no, defect_no FROM c JOIN df ON c."case" = df."case" AND regexp_replace(replace(c.file, chr(92), '/'), '^\\./', '') = regexp_replace(df.file, '^\\./', '') AND c.category = df.category
    AND CASE WHEN c.line = 0 THEN tol >= 1000 ELSE abs(c.line - df.line) <= tol END)"""
_SCORED = """k AS (SELECT c."case", c.arm, c.model, count(DISTINCT c.id) AS n, count(DISTINCT m.defect_no) AS caught, count(DISTINCT m.finding_no) AS rt
    FROM c LEFT JOIN m ON m.finding_no = c.id AND m.finding_no <> m.defect_no GROUP BY ALL),
  sc AS (SELECT k."case", arm, model, caught, n - rt AS false_positives, greatest(coalesce(a, 0) - caught, 0) AS missed FROM k LEFT JOIN (SELECT "case", count(*) AS a FROM df GROUP BY 1) USING ("case")),
  rt AS (SELECT *, CASE WHEN caught + false_positives = 0 THEN 1.0 ELSE CAST(caught AS DOUBLE) / (caught + false_positives) END AS precision, CASE WHEN caught + missed = 0 THEN 1.0 ELSE CAST(caught AS DOUBLE) / (caught + missed) END AS recall FROM sc),
  ra AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rt)"""
_STRUCTURAL = """h0 AS (SELECT *, category IN ('cross-module-regression', 'circular-dependency', 'architecture', 'duplicate-logic') AS s, defect_no IN (SELECT defect_no FROM m WHERE finding_no <> defect_no) AS hit FROM df),
  st AS (SELECT "case", CASE WHEN count(*) FILTER (s) > 0 THEN CAST(floor(count(*) FILTER (s AND hit) * 1e6 / count(*) FILTER (s) + 0.5) AS BIGINT) END AS recall_millionths FROM h0 GROUP BY 1)"""
_FAILED = """fl AS (SELECT list_last(string_split(repo_root, '/')) AS "case", coalesce(graph_grounded, false) AS arm, CASE WHEN prompt_tokens = -1 THEN 1 ELSE 0 END AS failed FROM r)"""
_B = "CAST(floor({0} * 1e6 + 0.5) AS BIGINT)"

SQL = {
    "a17_latest_runs": f"WITH {_F} SELECT id, created_at, model, findings_count FROM r ORDER BY created_at DESC, id LIMIT 200",
    "a16_run_lookup": f"""WITH {_F} SELECT r.id AS run_id, any_value(repo_root) AS repo_root, any_value(model) AS model, coalesce(list_sort(list(f.id) FILTER (f.grounded)), []) AS kept,
        coalesce(list_sort(list(f.id) FILTER (NOT f.grounded)), []) AS rejected FROM r LEFT JOIN f ON f.run_id = r.id GROUP BY r.id""",
    "e8_cost_by_model": f"""WITH {_F} SELECT repo_root, model, CAST(created_at AS DATE) AS day, CASE WHEN count(*) = count(estimated_cost_usd) THEN CAST(sum(estimated_cost_usd) AS DECIMAL(18,6)) END AS cost, count(*) AS n FROM r GROUP BY 1, 2, 3""",
    "e7_token_usage": f"WITH {_F} SELECT provider, model, CAST(sum(prompt_tokens) AS BIGINT) AS input_tokens, CAST(sum(completion_tokens) AS BIGINT) AS output_tokens FROM r GROUP BY 1, 2",
    "c1_source_files": """SELECT DISTINCT file, regexp_matches(file, '(\\.ts|\\.tsx|\\.mts|\\.cts|\\.js|\\.jsx|\\.mjs|\\.cjs)$') AND NOT suffix(file, '.d.ts') AS source,
        NOT suffix(file, '.d.ts') AND NOT contains('/' || file, '/node_modules/') AND NOT starts_with(file, '..') AND file <> '' AS node FROM function_units""",
    "i5_plain_paths": """SELECT file, plain, regexp_replace(plain, '/?[^/]*$', '') AS folder FROM (SELECT DISTINCT file, regexp_replace(replace(file, chr(92), '/'), '^\\./', '') AS plain FROM function_units)""",
    "i3_short_names": "SELECT DISTINCT unit_no, CASE WHEN instr(id, '#') > 0 THEN substr(id, instr(id, '#') + 1) ELSE id END AS short, file || '#' || coalesce(name, '<anonymous>') AS symbol FROM function_units",
    "i13_remote_identity": """SELECT DISTINCT clone_url, lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(clone_url), '^[a-zA-Z][a-zA-Z0-9+.]*://', ''), '^[^@/]+@', ''), '^([^:]*):([^0-9])', '\\1/\\2'), '\\.git$', ''), '/+$', '')) AS identity FROM review_jobs""",
    "i8_estimated_tokens": f"SELECT doc_id, CAST({_UNITS.format('text')} AS BIGINT) AS units, {_TOKENS.format('text')} AS tokens FROM documents",
    "i11_summaries": f"""WITH {_F}, s AS (SELECT *, CASE WHEN length(summary) > 60 THEN substr(summary, 1, 59) || '…' ELSE summary END AS short FROM f)
        SELECT id, short, replace(replace(replace(replace(replace(short, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS html,
        replace(replace(summary, '|', chr(92) || '|'), chr(10), ' ') AS cell, {_RANK} AS rank, CAST(floor(CAST(confidence AS DOUBLE) * 100 + 0.5) AS BIGINT) AS hundredths, CAST(greatest(least(length(summary), 100), 1) AS INTEGER) AS clamped FROM s""",
    "i23_instants": f"WITH {_F} SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso, claimed_at - INTERVAL 30 MINUTE AS lease, substr(last_error, 1, 2000) AS error, CASE WHEN head_sha IS NOT NULL THEN 'key ***' END AS scrubbed FROM j",
    "i28_kind_and_rest": f"WITH {_F} SELECT id, split_part(severity || ': ' || summary, ': ', 1) AS kind, substr(severity || ': ' || summary, instr(severity || ': ' || summary, ': ') + 2) AS rest, CASE WHEN line = 1 THEN '1 line' ELSE line || ' lines' END AS lines FROM f",
    "d11_grounding": f"WITH {_F}, {_JUDGED} SELECT * FROM judged",
    "l7_split": f"WITH {_F}, {_JUDGED} SELECT coalesce(reason, 'kept') AS outcome, count(*) AS n FROM judged GROUP BY 1",
    "c6_gate": f"WITH {_F} SELECT run_id, bool_or(severity IN ('critical', 'high')) AS fail FROM f GROUP BY 1",
    "c7_structural": f"WITH {_F} SELECT id, coalesce(category IN ('cross-module-regression', 'circular-dependency', 'architecture', 'duplicate-logic'), false) AS structural FROM f",
    "f1_evidence_order": f"WITH {_F}, {_ORDERED} SELECT run_id, id, CAST(ordinal AS INTEGER) AS ordinal, 'E' || ordinal AS evidence_id, cost FROM o",
    "f9_packed": f"""WITH RECURSIVE {_F}, {_ORDERED}, w AS (SELECT run_id, id, ordinal, cost <= {BUDGET} AS kept, CASE WHEN cost <= {BUDGET} THEN cost ELSE 0 END AS used FROM o WHERE ordinal = 1
        UNION ALL SELECT o.run_id, o.id, o.ordinal, w.used + o.cost <= {BUDGET}, w.used + CASE WHEN w.used + o.cost <= {BUDGET} THEN o.cost ELSE 0 END FROM w JOIN o ON o.run_id = w.run_id AND o.ordinal = w.ordinal + 1)
        SELECT run_id, id, kept FROM w""",
    "b13_prompt": f"WITH {_F}, {_ORDERED}, {_PROMPT} SELECT * FROM p",
    "b7_by_severity": f"WITH {_F} SELECT id, run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY {_RANK} NULLS FIRST, id) AS INTEGER) AS place FROM f",
    "b8_inline_comments": f"WITH {_F} SELECT id, line > 0 AND (file, line) IN (SELECT (file, line) FROM function_units WHERE file IS NOT NULL AND line IS NOT NULL) AS inline FROM f",
    "b5_json": f"""WITH {_F} SELECT id, '{{"id":' || id || coalesce(',"severity":"' || severity || '"', '') || coalesce(',"line":' || line, '') || '}}' AS json FROM f""",
    "a20_echo": f"""WITH {_F}, {_ORDERED}, {_PROMPT}, x AS (SELECT run_id, text, regexp_extract_all(text, '\\[(E\\d+)\\]', 1) AS a FROM p)
        SELECT run_id, [a[i] FOR i IN range(1, len(a) + 1) IF list_position(a, a[i]) = i] AS refs, nullif(regexp_extract(text, '([\\w./-]+\\.(?:tsx?|jsx?|mjs|cjs))\\b', 1), '') AS file, CAST(ceil(length(text) / 4) AS BIGINT) AS input_tokens FROM x""",
    "d12_matches": f"WITH {_F}, {_CASES} SELECT * FROM m",
    "f6_credit": f"WITH {_F}, {_CASES}, o AS (SELECT \"case\", finding_no, min(defect_no) AS defect_no FROM m GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY \"case\", defect_no ORDER BY finding_no) = 1 AS hit FROM o",
    "l3_missed": f"WITH {_F}, {_CASES} SELECT \"case\", defect_no FROM df WHERE defect_no NOT IN (SELECT defect_no FROM m WHERE finding_no <> defect_no)",
    "e9_confusion": f"WITH {_F}, {_CASES}, {_SCORED} SELECT \"case\", arm, model, caught, false_positives, missed FROM sc",
    "e10_rates": f"WITH {_F}, {_CASES}, {_SCORED} SELECT \"case\", arm, model, {_B.format('precision')} AS precision, {_B.format('recall')} AS recall, {_B.format('f1')} AS f1 FROM ra",
    "e11_structural_recall": f"WITH {_F}, {_CASES}, {_STRUCTURAL} SELECT * FROM st",
    "e13_arm_summary": f"""WITH {_F}, {_CASES}, {_SCORED}, {_STRUCTURAL}, {_FAILED}, x AS (
        SELECT ra."case", ra.arm, precision, recall, f1, recall_millionths / 1e6 AS structural_recall, prompt_tokens, latency_ms FROM ra LEFT JOIN st ON st."case" = ra."case"
        LEFT JOIN (SELECT list_last(string_split(repo_root, '/')) AS c, coalesce(graph_grounded, false) AS g, model AS m, sum(prompt_tokens) AS prompt_tokens, sum(llm_latency_ms) AS latency_ms FROM r
          WHERE prompt_tokens > 0 AND llm_latency_ms > 0 GROUP BY 1, 2, 3) u ON c = ra."case" AND g = ra.arm AND m IS NOT DISTINCT FROM ra.model),
        l AS ({" UNION ALL ".join(f'SELECT "case", arm, {chr(39)}{m}{chr(39)} AS measure, CAST({m} AS DOUBLE) AS v FROM x' for m in MEASURES)}),
        g AS (SELECT "case", arm, measure, coalesce(avg(v), 0) AS mean, coalesce(stddev_pop(v), 0) AS stdev, coalesce(min(v), 0) AS min, coalesce(max(v), 0) AS max, count(v) AS n FROM l GROUP BY GROUPING SETS (("case", arm, measure), (arm, measure))),
        h AS (SELECT "case", arm, sum(failed) AS failures FROM fl GROUP BY GROUPING SETS (("case", arm), (arm)))
        SELECT g."case", g.arm, measure, CAST(coalesce(failures, 0) AS BIGINT) AS failures, {", ".join(f"CAST(floor({c} * 100 + 0.5) AS BIGINT) AS {c}" for c in ("mean", "stdev", "min", "max"))}, n
        FROM g LEFT JOIN h ON g."case" IS NOT DISTINCT FROM h."case" AND g.arm = h.arm""",
    "e15_verdict": f"""WITH {_F}, {_CASES}, {_SCORED}, {_FAILED}, s AS (SELECT "case", avg(f1) FILTER (arm) AS a, stddev_pop(f1) FILTER (arm) AS sa, avg(f1) FILTER (NOT arm) AS b, stddev_pop(f1) FILTER (NOT arm) AS sb FROM ra GROUP BY 1),
        t AS (SELECT s.*, coalesce((SELECT sum(failed) FROM fl WHERE fl."case" = s."case"), 0) AS bad FROM s WHERE a IS NOT NULL AND b IS NOT NULL)
        SELECT "case", abs(a - b) > sa + sb AS separated, CASE WHEN bad > 0 THEN 'incomplete' WHEN NOT abs(a - b) > sa + sb THEN 'not separated' WHEN a > b THEN 'first is better' ELSE 'second is better' END AS verdict FROM t""",
    "k1_enqueued": f"""WITH {_F}, q AS (SELECT id, coalesce(nullif(delivery_id, ''), owner || '/' || repo || '#' || pull_number || '@' || head_sha) AS key, created_at FROM j)
        SELECT arg_min(id, (created_at, id)) AS id, key FROM q GROUP BY key""",
    "k2_superseded": f"""WITH {_F}, q AS (SELECT *, lead(delivery_id) OVER (PARTITION BY owner, repo, pull_number ORDER BY created_at, id) AS nx FROM j)
        SELECT id, CASE WHEN state = 'pending' AND nx IS NOT NULL THEN 'superseded' ELSE state END AS state, CASE WHEN state = 'pending' AND nx IS NOT NULL THEN nx ELSE superseded_by END AS superseded_by FROM q""",
    "k3_claim": f"WITH {_F} SELECT id, 'running' AS state, attempts + 1 AS attempts FROM j WHERE state = 'pending' ORDER BY created_at, id LIMIT 1",
    "k5_finished": f"""WITH {_F} SELECT id, CASE WHEN attempts <= 1 THEN 'done' WHEN attempts >= 3 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN attempts <= 1 THEN 'run-' || id ELSE run_id END AS run_id,
        CASE WHEN attempts > 1 THEN 'timeout' ELSE last_error END AS last_error FROM j WHERE state = 'running'""",
    "k6_reclaimed": f"""WITH {_F}, q AS (SELECT *, coalesce(state = 'running' AND claimed_at < TIMESTAMP '{NOW}' - INTERVAL 30 MINUTE, false) AS stale FROM j) SELECT id, CASE WHEN stale THEN 'pending' ELSE state END AS state, stale FROM q""",
    "e16_pending": f"WITH {_F} SELECT state, count(*) AS n FROM j GROUP BY 1",
}
