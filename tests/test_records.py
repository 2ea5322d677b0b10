from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplefold.functions import sequential, text
from ripplefold.operators import evaluate, evidence, grounding, intervals, jobs, similarity
from ripplefold.sources import diffs, inputs, modules, sinks


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_scalars(spark):
    r = one(
        spark,
        a=text.round_half_up(F.lit(0.285)), b=text.round_half_up(F.lit(-2.5), 0), c=text.utf16_length(F.lit("a😀")), d=text.joined_path(F.lit("src/deep"), F.lit("../b")), e=text.joined_path(F.lit("a"), F.lit("../../b/./c")),
        f=text.remote_identity(F.lit("git@Host.org:Team/r.git")), g=text.remote_identity(F.lit("https://u:p@host.org:8443/r.git/")), h=text.short_name(F.lit("f#A#b")), i=text.truncated(F.lit("abcdef"), 4), j=text.escaped_html(F.lit("<a & 'b'>")),
        k=text.scrubbed(F.lit("x tok y"), F.lit("tok")), l=text.scrubbed(F.lit("x"), F.lit("")), m=text.plural(F.lit(1), "cycle"), n=text.plural(F.lit(3), "cycle"), o=text.kind_and_rest(F.lit("a: b: c"))["rest"], p=text.severity_rank(F.lit("odd")),
        q=text.parent_folder(F.lit("x.ts")), r=text.estimated_tokens(F.lit("")), s=text.percent(F.lit(0.125)),
    )
    assert tuple(r) == (0.28, -2.0, 3, "src/b", "../b/c", "host.org/team/r", "host.org:8443/r.git", "A#b", "abc…", "&lt;a &amp; &#39;b&#39;&gt;", "x *** y", "x", "1 cycle", "3 cycles", "b: c", None, "", 0, "12.5%")


def test_globs_of_layers(spark):
    cases = [("src/**", "src/a/b.ts", True), ("**/x.ts", "x.ts", True), ("**/x.ts", "a/b/x.ts", True), ("src/*.ts", "src/a/b.ts", False), ("a?c", "abc", True), ("a?c", "a/c", False), ("a.c", "abc", False), ("src/**/index.ts", "src/index.ts", True)]
    for glob, path, fits in cases:
        assert one(spark, x=F.lit(path).rlike(text.layer_glob(glob))).x is fits, glob


DIFF = """diff --git a/src/a.ts b/src/a.ts
index 1..2 100644
--- a/src/a.ts
+++ b/src/a.ts
@@ -1,4 +1,4 @@
 one
-two
+TWO
+three

\\ No newline at end of file
@@ -10 +20 @@ ctx
-gone
diff --git a/new.ts b/new.ts
new file mode 100644
@@ -0,0 +1,2 @@
+a
+b
diff --git "a/old name.ts" "b/new name.ts"
similarity index 100%
rename from old name.ts
rename to new name.ts
diff --git a/bye.ts b/bye.ts
deleted file mode 100644
@@ -1 +0,0 @@
-x
"""


def test_diffs(spark):
    df = spark.createDataFrame([("d", DIFF), ("none", ""), ("null", None)], "diff_id string, raw string")
    rows = {r.path: r for r in diffs.changed_files(df).collect()}
    assert {p: (r.status, r.previous_path, [tuple(h)[:4] for h in r.hunks], [h.changed_new_lines for h in r.hunks]) for p, r in rows.items()} == {
        "src/a.ts": ("modified", None, [(1, 4, 1, 4), (10, 1, 20, 1)], [[2, 3], [20]]),
        "new.ts": ("added", None, [(0, 0, 1, 2)], [[1, 2]]),
        "new name.ts": ("renamed", "old name.ts", [], []),
        "bye.ts": ("deleted", None, [(1, 1, 0, 0)], [[1]]),
    }
    assert "\n".join(r.text for r in diffs.split_by_file(df).orderBy("section").collect()) == DIFF


def test_imports_and_resolution(spark):
    code = "import { a } from './b';\nimport './side.js';\nexport * from \"../up\";\nimport type { T } from '@pkg/x';\nconst z = import('./lazy');\nexport const y = 1;\nimport(other);\n"
    files = spark.createDataFrame([("r", "src/m/a.ts", code), ("r", "src/m/b.ts", ""), ("r", "src/up/index.ts", None), ("r", "src/m/side.ts", "import './missing'")], "repo string, path string, content string")
    found = modules.imports(files)
    assert [r.specifier for r in found.where("path = 'src/m/a.ts'").orderBy("ord").collect()] == ["./b", "./side.js", "../up", "@pkg/x", "./lazy"]
    done = modules.resolved(found.withColumn("repo", F.lit("r")), files, ["repo"])
    nodes, edges = modules.module_graph(done, files, ["repo"])
    assert {(r.src, r.dst) for r in edges.collect()} == {("src/m/a.ts", "src/m/b.ts"), ("src/m/a.ts", "src/m/side.ts"), ("src/m/a.ts", "src/up/index.ts")}
    assert {r.path: r.external_imports for r in nodes.collect()} == {"src/m/a.ts": ["@pkg/x"], "src/m/b.ts": [], "src/up/index.ts": [], "src/m/side.ts": []}


def test_trees_and_project_files(spark, tmp_path):
    for name, body in (("src/a.ts", "x"), ("node_modules/p/i.ts", "y"), ("src/a.d.ts", "z"), ("README.md", "r")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert [(r.path, r.content) for r in modules.project_files(modules.read_tree(spark, str(tmp_path))).collect()] == [("src/a.ts", "x")]


def test_rules_and_settings(spark, tmp_path):
    assert inputs.parse_rules("# c\n\ndeny a/** -> b/**\n") == [(3, "deny a/** -> b/**", "a/**", "b/**")]
    with pytest.raises(ValueError, match="line 2"):
        inputs.parse_rules("deny a -> b\nallow x")
    with pytest.raises(Exception, match="line 1"):
        inputs.rule_lines(spark.createDataFrame([("nonsense",)], "text string")).collect()
    env = tmp_path / ".env"
    env.write_text("BLAST_RADIUS_MAX_HOPS=5\nLLM_PROVIDER=echo\n")
    assert inputs.Settings.read(str(env), environment={"CONTEXT_TOKEN_BUDGET": "9000"}).blast_radius_max_hops == 5
    assert inputs.Settings.read(environment={"LLM_PROVIDER": "gemini", "GOOGLE_API_KEY": "k"}).llm_provider == "gemini"
    with pytest.raises(ValueError, match="PORT.*OPENAI_API_KEY"):
        inputs.Settings.read(environment={"PORT": "x", "LLM_PROVIDER": "openai"})
    for bad in ({"BLAST_RADIUS_MAX_HOPS": "11"}, {"LLM_PROVIDER": "x"}, {"DATABASE_URL": "mysql://x"}, {"LLM_MODEL": " "}, {"REVIEW_FAIL_ON": "bad"}):
        with pytest.raises(ValueError):
            inputs.Settings.read(environment=bad)


def test_payloads_never_coerce(spark):
    good = '{"action":"opened","number":7,"pull_request":{"head":{"sha":"s"},"base":{"ref":"b"}},"repository":{"name":"r","owner":{"login":"o"},"clone_url":"u"}}'
    rows = [(1, "pull_request", good), (2, "push", good), (3, "pull_request", good.replace("7", '"7"')), (4, "pull_request", good.replace("opened", "closed")), (5, "pull_request", "{"), (6, "pull_request", None), (7, "pull_request", good.replace('"sha":"s"', '"x":1'))]
    got = inputs.pull_requests(spark.createDataFrame(rows, "id int, event string, body string")).collect()
    assert [(r.id, r.pull_number, r.owner) for r in got] == [(1, 7, "o")]


def test_json_in_prose():
    assert sequential.balanced_json('say {bad {"a": "}"} or [1, 2]') == '{"a": "}"}'
    assert sequential.balanced_json('x [0]\n```json\n{"findings": []}\n```') == '{"findings": []}'
    assert sequential.balanced_json("none") is None and sequential.balanced_json(None) is None
    row = {"severity": "high", "category": "correctness", "file": "a", "line": 0, "summary": "s", "rationale": "r"}
    import json

    assert sequential.checked_findings(json.dumps([row]))[0][0]["evidence_refs"] == []
    for change in ({"line": "3"}, {"line": True}, {"severity": "odd"}, {"summary": ""}, {"confidence": 2}, {"evidenceRefs": [1]}):
        assert sequential.checked_findings(json.dumps([{**row, **change}]))[1]


def test_signatures():
    import hashlib
    import hmac

    right = "sha256=" + hmac.new(b"k", b"body", hashlib.sha256).hexdigest()
    assert [sequential.signature_check("body", h, s) for h, s in ((right, "k"), (right, None), (None, "k"), ("sha1=x", "k"), (right, "other"))] == ["ok", "no-secret", "missing", "malformed", "mismatch"]


def test_intervals(spark):
    spans = spark.createDataFrame([("f", 1, 100, "outer"), ("f", 10, 20, "inner"), ("g", 1, 5, "other")], "file string, start int, end int, decl string")
    points = spark.createDataFrame([("f", 15), ("f", 50), ("f", 200), ("h", 1), ("f", 15)], "file string, line int")
    assert {(r.file, r.line): r.decl for r in intervals.enclosing(points, spans).collect()} == {("f", 15): "inner", ("f", 50): "outer", ("f", 200): "<module>", ("h", 1): "<module>"}
    files = spark.createDataFrame([("a", "added", 3, [1]), ("m", "modified", 9, [4, 6]), ("r", "renamed", 2, []), ("d", "deleted", 5, None), ("n", "added", None, None)], "file string, status string, n_lines int, changed array<int>")
    assert sorted((r.file, r.line) for r in intervals.attributed_lines(files).collect()) == [("a", 1), ("a", 2), ("a", 3), ("m", 4), ("m", 6), ("r", 1), ("r", 2)]


def test_packing_skips_and_continues(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, *range(1, 60)])) for g in "ab" for i in range(40)] + [("big", 0, 500), ("big", 1, 7)]
    got = {(r.g, r.i): r.kept for r in evidence.packed(spark.createDataFrame(rows, "g string, i int, cost int"), ["g"], ["i"], "cost", 100).collect()}
    used: dict = {}
    for g, i, c in sorted(rows, key=lambda r: (r[0], r[1])):
        fits = used.get(g, 0) + (c or 0) <= 100
        used[g] = used.get(g, 0) + (c or 0) * fits
        assert got[(g, i)] is fits
    weights = one(spark, a=evidence.site_weight(F.lit(1), F.lit(90)), b=evidence.site_weight(F.lit(9), F.lit(0)), c=evidence.duplicate_weight(F.lit(0.995)))
    assert tuple(weights) == (750, 1, 700)


def test_grounding_is_lossless_and_ordered(spark):
    rows = [(1, ["E1"], ["E1"]), (2, ["E9", "E1"], ["E1"]), (3, [], ["E1"]), (4, None, None), (5, ["E1"], None)]
    judged = grounding.grounded(spark.createDataFrame(rows, "id int, refs array<string>, known array<string>"), "refs", "known")
    kept, out = grounding.kept_and_rejected(judged)
    assert [r.id for r in kept.collect()] == [1] and {r.id: r.reason for r in out.collect()} == {2: "unknown-evidence", 3: "no-evidence", 4: "no-evidence", 5: "unknown-evidence"}
    gate = one(spark, a=grounding.at_least(F.lit("critical"), "high"), b=grounding.at_least(F.lit("low"), "high"), c=grounding.at_least(F.lit("critical"), "never"), d=grounding.at_least(F.lit(None).cast("string"), "high"))
    assert tuple(gate) == (True, False, False, False)


def test_evaluation(spark):
    f = spark.createDataFrame([("c", 1, "./a\\b.ts", 12, "x"), ("c", 2, "a/b.ts", 13, "x"), ("c", 3, "a/b.ts", 0, "x"), ("c", 4, "a/b.ts", 12, "y"), ("c", 5, "z.ts", 0, "cyc")], "case string, finding_no int, file string, line int, category string")
    d = spark.createDataFrame([("c", 1, "a/b.ts", 10, 6, ["x"]), ("c", 2, "z.ts", 1, 1000, ["cyc"])], "case string, defect_no int, file string, line int, line_tolerance int, accept_categories array<string>")
    got = {r.finding_no: (r.defect_no, r.hit) for r in evaluate.credited(evaluate.matches(f, d, ["case"]), ["case"]).collect()}
    assert got == {1: (1, True), 2: (1, False), 5: (2, True)}
    r = one(spark, a=F.struct(*evaluate.rates(F.lit(0), F.lit(0), F.lit(0))), b=F.struct(*evaluate.rates(F.lit(0), F.lit(2), F.lit(3))))
    assert tuple(r.a) == (1.0, 1.0, 1.0) and tuple(r.b) == (0.0, 0.0, 0.0)
    x = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert tuple(x.agg(evaluate.spread(F.col("x")).alias("s")).first().s) == (2.0, 1.0, 1.0, 3.0, 2)
    assert x.agg(evaluate.all_or_null_sum(F.col("x")).alias("s")).first().s is None and x.limit(0).agg(evaluate.all_or_null_sum(F.col("x")).alias("s")).first().s == 0


def test_queue_steps(spark):
    rows = [(1, "a", "pending", 0, "2025-01-01 00:00:00", None), (2, "b", "running", 2, "2025-01-01 00:01:00", "2025-01-01 00:02:00"), (3, "c", "running", 3, "2025-01-01 00:02:00", "2025-01-01 01:00:00"), (4, "d", "pending", 0, "2025-01-01 00:00:00", None)]
    df = spark.createDataFrame(rows, "id int, delivery_id string, state string, attempts int, c string, k string").select("id", "delivery_id", "state", "attempts", F.col("c").cast("timestamp").alias("created_at"), F.col("k").cast("timestamp").alias("claimed_at"), F.lit(None).cast("string").alias("run_id"), F.lit(None).cast("string").alias("last_error"), F.lit(None).cast("timestamp").alias("finished_at"), F.lit(None).cast("string").alias("superseded_by"), F.lit("o").alias("owner"))
    now = F.lit("2025-01-01 01:10:00").cast("timestamp")
    claim = jobs.claimed(df, now).first()
    assert (claim.id, claim.state, claim.attempts) == (1, "running", 1)
    ends = {r.id: (r.state, r.last_error, r.run_id) for r in jobs.finished(df, spark.createDataFrame([(2, None, "x" * 3000), (3, None, "bad")], "id int, result_run string, error string"), now).collect()}
    assert ends == {2: ("pending", "x" * 2000, None), 3: ("failed", "bad", None)}
    assert {r.id for r in jobs.reclaimed(df, now).where("stale").collect()} == {2}
    assert {r.id: r.superseded_by for r in jobs.superseded(df, ["owner"], ["created_at", "id"]).where("state = 'superseded'").collect()} == {1: "d", 4: "b"}
    with pytest.raises(Exception, match="unknown state"):
        jobs.checked_states(df.withColumn("state", F.lit("odd"))).collect()


def test_fingerprints_and_hits(spark):
    tokens = [f"t{i}" for i in range(60)]
    units = spark.createDataFrame([(1, tokens), (2, tokens), (3, tokens[:30] + ["x"] + tokens[30:]), (4, [f"z{i}" for i in range(60)]), (5, ["a"] * 4), (6, None)], "unit int, tokens array<string>")
    prints = similarity.fingerprints(units)
    rated = similarity.cosines(prints, similarity.candidate_pairs(units))
    sims = {(r.a, r.b): round(r.similarity, 3) for r in rated.collect()}
    assert sims[(1, 2)] == 1.0 and 0.85 < sims[(1, 3)] < 1.0 and (1, 4) not in sims
    once = similarity.first_direction(similarity.hits_per_unit(rated)).collect()
    assert {(r.unit, r.other) for r in once} == {(1, 2), (1, 3), (2, 3)}
    assert similarity.fingerprints(units.where("unit > 4")).count() == 0


def test_large_families_and_copies_meet(spark):
    body = [f"t{i}" for i in range(80)]
    rows = {i: body[: i % 80] + [f"e{i}"] + body[i % 80 + 1 :] for i in range(100)} | {1000 + i: [f"c{j}" for j in range(50)] for i in range(60)}
    rows |= {2000 + i: body[:40] + [f"o{i}_{j}" for j in range(40)] for i in range(10)}
    units = spark.createDataFrame(list(rows.items()), "unit int, tokens array<string>")
    every = spark.range(2100).select(F.col("id").cast("int").alias("unit")).join(units.select("unit"), "unit", "left_semi")
    pairs = every.toDF("a").crossJoin(every.toDF("b")).where("a < b")
    truth = {(r.a, r.b) for r in similarity.cosines(similarity.fingerprints(units), pairs).where(F.col("similarity") >= similarity.THRESHOLD).collect()}
    assert len(truth) > 5_000
    got = [(r.a, r.b) for r in similarity.rated(units, crowd=20).collect()]
    assert len(got) == len(set(got)) and set(got) == truth


def test_unlike_units_that_share_a_shingle_are_not_paired(spark):
    body = lambda i: [f"s{i % 6}_{j}" for j in range(8)] + [f"u{i}_{j}" for j in range(30)] + [f"c{j}" for j in range(22)]
    rows = {i: body(i) for i in range(120)} | {500 + i: body(i)[:-3] + ["e"] * 3 for i in range(0, 120, 10)}
    units = spark.createDataFrame(list(rows.items()), "unit int, tokens array<string>")
    prints = similarity.fingerprints(units)
    loose = similarity.candidate_pairs(units).cache()
    truth = {(r.a, r.b) for r in similarity.cosines(prints, loose).where(F.col("similarity") >= similarity.THRESHOLD).collect()}
    assert truth == {(i, 500 + i) for i in range(0, 120, 10)} and loose.count() > 1_000
    for crowd, cells in ((2000, 50), (2000, 10**6), (3, 10**6)):
        ready = similarity.prepared(units, crowd).cache()
        near = [(r.a, r.b) for r in similarity.near_pairs(ready, 5000, part_cells=cells).collect()]
        assert len(near) == len(set(near)) < 100 and truth <= set(near)
        assert {(r.a, r.b) for r in similarity.measured(ready, loose).where(F.col("similarity") >= similarity.THRESHOLD).collect()} == truth
    assert similarity.rated(units.limit(0)).count() == 0


def test_prepared_fingerprints_equal_those_of_shingles(spark):
    rows = [(1, ["a b", "c", None, "d", "", "e", "f"] * 9), (2, ["a", "b c", None, "d", "", "e", "f"] * 9), (3, [None] * 6), (4, ["x"] * 4), (5, []), (6, None), (7, ["é", "ü"] * 30)]
    units = spark.createDataFrame(rows, "unit int, tokens array<string>")
    ready = {r.unit: {i: int(x) for i, x in enumerate(np.frombuffer(r.w, np.int32)) if x} for r in similarity.prepared(units).collect()}
    truth = {}
    for r in similarity.fingerprints(units).collect():
        truth.setdefault(r.unit, {})[r.bucket] = r.w
    assert ready == truth and set(truth) == {1, 2, 3, 7}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "r", "f", "s", 1, "e", "2025-01-01"), (2, "r", "f", "s", 1, "e", "2025-01-02"), (3, "q", "f", "s", 1, "e", None)], "fp_id int, repo string, file string, symbol string, start_line int, embedder string, updated_at string")
    root = str(tmp_path / "snap")
    assert sinks.replace_snapshot(rows, root) and not sinks.replace_snapshot(rows.limit(0), root)
    assert sinks.replace_snapshot(rows.where("fp_id = 1"), root)
    assert {r.fp_id for r in spark.read.parquet(root).collect()} == {1, 3}
    assert sinks.save_run({"runs": rows}, str(tmp_path / "rec"), "x") and not sinks.save_run({"bad": rows.select(F.raise_error(F.lit("no")))}, str(tmp_path / "rec"), "y")
    for bad in (0, 16_001, True, 1.5):
        with pytest.raises(ValueError):
            sinks.checked_width(bad)


def test_repair_loop_stops_at_three_calls(spark):
    prompts = spark.createDataFrame([(1, "p")], "id int, prompt string")
    got = inputs.completed(prompts, lambda prompt: "never", sequential.checked_findings, "id").first()
    assert (got.calls, got.problem) == (3, "no JSON found")
    echo = inputs.echo_answers(spark.createDataFrame([(1, "see [E2] and [E1] in src/a.ts, [E2]")], "id int, prompt string"), "id").first()
    assert (echo.refs, echo.file, echo.input_tokens) == (["E2", "E1"], "src/a.ts", 9)
