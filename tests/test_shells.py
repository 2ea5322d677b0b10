"""Git as a source, models over HTTP, reports, embedders, token counters and source text."""

from __future__ import annotations

import json
import subprocess

import pytest
from pyspark.sql import functions as F

from ripplefold.functions import code, tokens
from ripplefold.operators import embedders, intervals, similarity
from ripplefold.sources import diffs, inputs, models, modules, reports, repository
from ripplefold.functions.sequential import checked_findings
from ripplefold.streaming import jobs as stream


def git(folder, *words):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=x", "-c", "user.email=x@x", *words], check=True, capture_output=True)


@pytest.fixture
def repo(tmp_path):
    git(tmp_path, "init", "-q", "-b", "main", ".")
    (tmp_path / "a.ts").write_text("one\ntwo\n")
    (tmp_path / "long.ts").write_text("\n".join(f"line {i}" for i in range(30)))
    git(tmp_path, "add", "-A")
    git(tmp_path, "commit", "-qm", "base")
    git(tmp_path, "checkout", "-qb", "work")
    git(tmp_path, "mv", "long.ts", "moved.ts")
    (tmp_path / "a.ts").write_text("one\nthree\n")
    git(tmp_path, "commit", "-qam", "work")
    return tmp_path


def test_two_trees_and_files_at_revisions(spark, repo, tmp_path_factory):
    found = repository.Repository(str(repo))
    files = {r.path: (r.status, r.previous_path) for r in diffs.changed_files(found.difference(spark, "main", "work")).collect()}
    assert files == {"a.ts": ("modified", None), "moved.ts": ("renamed", "long.ts")}
    assert found.file_at("main", "a.ts") == "one\ntwo\n" and found.file_at("main", "moved.ts") is None and found.is_clean() and found.identity() is None
    (repo / "a.ts").write_text("x")
    git(repo, "remote", "add", "origin", "git@Host.org:Team/App.git")
    assert not found.is_clean() and found.identity() == "host.org/team/app"
    with pytest.raises(repository.UnknownRevision):
        found.resolved("nowhere")
    with pytest.raises(repository.NotARepository):
        repository.Repository(str(tmp_path_factory.mktemp("plain")))


def test_pull_requests_are_compared_with_the_merge_base(repo):
    base = repository.Repository(str(repo)).resolved("main")
    git(repo, "checkout", "-q", "main")
    (repo / "later.ts").write_text("x")
    git(repo, "add", "-A")
    git(repo, "commit", "-qm", "later")
    head = repository.Repository(str(repo)).resolved("work")
    with repository.pull_request(f"file://{repo}", head, "main") as (copy, against):
        assert against == base and copy.resolved("HEAD") == head
        folder = copy.folder
    assert not subprocess.os.path.exists(folder)
    with pytest.raises(repository.CheckoutFailed) as failed, repository.pull_request("http://127.0.0.1:9/x", head, "main", "s3cret"):
        pass
    assert "s3cret" not in str(failed.value)


def test_models_try_again_only_what_may_pass():
    said, waits = [], []
    answers = iter([(429, "slow"), OSError("gone"), (200, json.dumps({"choices": [{"message": {"content": "[]"}}], "usage": {"prompt_tokens": 7, "completion_tokens": 1}}))])

    def transport(url, headers, body, patience):
        said.append(json.loads(body))
        answer = next(answers)
        if isinstance(answer, Exception):
            raise answer
        return answer

    model = models.OpenAi("k", "m", transport=transport, sleep=waits.append)
    assert model("hello") == models.Answer("[]", 7, 1) and waits == [1.0, 2.0] and said[0]["messages"][1]["content"] == "hello"
    for status, calls in ((401, 1), (503, 3)):
        seen = []
        broken = models.Gemini("k", "m", transport=lambda *a: seen.append(1) or (status, "no"), sleep=lambda s: None)
        with pytest.raises(models.ModelRefused):
            broken("x")
        assert len(seen) == calls
    told = models.Gemini("k", "m", transport=lambda *a: (200, json.dumps({"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]})))("x")
    assert told == models.Answer("ab", None, None)


def test_repairs_sum_their_tokens_and_state_the_form(spark):
    def model(prompt):
        return models.Answer("[]" if '"evidenceRefs"' in prompt else "no", 10, None if "uncounted" in prompt else 2)

    rows = inputs.completed(spark.createDataFrame([(1, "p"), (2, "uncounted")], "id int, prompt string"), model, checked_findings, "id").collect()
    assert {(r.id, r.calls, r.problem, r.input_tokens, r.output_tokens) for r in rows} == {(1, 2, None, 20, 4), (2, 2, None, 20, None)}


FINDINGS = [
    {"severity": "low", "category": "correctness", "file": "a.ts", "line": 3, "summary": "s|1", "rationale": "r1", "evidence_refs": ["E1"]},
    {"severity": "critical", "category": "architecture", "file": "b.ts", "line": 9, "summary": "<s2>", "rationale": "r2", "evidence_refs": []},
]


def test_reports():
    sites = [{"origin": "a#f", "file": f"s{i}.ts", "line": i + 1, "hops": 1 + i % 2, "symbol_id": f"s{i}#g"} for i in range(10)]
    text = reports.impact_text([{"id": "a#f", "name": "f", "file": "a.ts", "line": 1, "change_kind": "modified"}, {"id": "b#<module>", "name": "<module>", "file": "b.ts", "line": 0, "change_kind": "added"}], sites, [{"node_ids": ["x", "y"], "introduced": True}], unparsed=["z.ts"])
    assert "and 2 more" in text and text.index("1 hop ") < text.index("2 hops") and "introduced: x <-> y" in text and "z.ts" in text and "module only" in text
    run = {"id": "r<1>", "base_ref": "a", "head_ref": "b", "graph_grounded": True, "provider": "echo", "model": "m", "created_at": None, "findings_count": 2}
    said = reports.review_text(run, FINDINGS, [{"summary": "gone", "reason": "no-evidence"}])
    assert said.index("critical") < said.index("low") and "gone: no-evidence" in said and "No findings" in reports.review_text(run, [])
    evidence = [{"evidence_id": f"E{i}", "kind": "cycle", "summary": f"a|{i}"} for i in range(30)]
    payload = reports.review_payload("sha", FINDINGS, evidence, {("a.ts", 3)}, 1)
    assert [c["path"] for c in payload["comments"]] == ["a.ts"] and payload["event"] == "COMMENT" and "and 5 more" in payload["body"] and "a\\|24" in payload["body"] and "E25" not in payload["body"]
    sent = []
    assert reports.post_review(lambda *a: sent.append(a) or (200, '{"id": 5}'), "tok", "o", "r", 7, payload) == 5 and "/repos/o/r/pulls/7/reviews" in sent[0][0]
    with pytest.raises(RuntimeError, match="404"):
        reports.post_review(lambda *a: (404, "tok missing"), "tok", "o", "r", 7, payload)
    columns = [{"hops": 1, "symbol_id": "<a>", "r": 1, "overflow": 4}, {"hops": 2, "symbol_id": "b", "r": 1, "overflow": 0}]
    svg = reports.blast_svg(columns, [{"from_id": "<a>", "to_id": "b"}, {"from_id": "gone", "to_id": "b"}])
    assert svg.count("<line") == 1 and "+4 more" in svg and "&lt;a&gt;" in svg
    assert "&lt;1&gt;" in reports.runs_page([run]) and "<s2>" not in reports.run_page(run, FINDINGS)
    arms = {"on": {"f1": {"mean": 0.5, "stdev": 0.1, "n": 3}, "structural_recall": {"mean": 0.25, "stdev": 0.0, "n": 2}, "failures": 1}, "off": {}}
    assert "| f1 | 0.50 ± 0.10 | none |" in reports.scorecard_markdown(arms, "v") and "| failures | 1 | 0 |" in reports.scorecard_markdown(arms, "v")
    assert json.loads(reports.scorecard_json(arms, "v"))["verdict"] == "v" and "25.0%" in reports.scorecard_svg(arms)
    assert "lower bound" in reports.user_prompt("a", "b", "diff", "[E1] x", 1, 3) and "not consulted" in reports.user_prompt("a", "b", "d", "", 0)


def test_embedders_give_unit_vectors_of_their_width(spark):
    words = [f"t{i}" for i in range(60)]
    units = spark.createDataFrame([(1, words), (2, words[:30] + ["x"] + words[30:]), (3, ["a"]), (4, None)], "unit int, tokens array<string>")
    made = embedders.stored(embedders.ShingleEmbedder(), units)
    rows = {r.unit: r for r in made.collect()}
    assert {len(r.embedding) for r in rows.values()} == {256} and abs(sum(x * x for x in rows[1].embedding) - 1) < 1e-6 and set(rows[3].embedding) == set(rows[4].embedding) == {0.0}
    pair = made.where("unit = 1").select(F.col("embedding").alias("p")).crossJoin(made.where("unit = 2").select(F.col("embedding").alias("q")))
    exact = similarity.cosines(similarity.fingerprints(units), spark.createDataFrame([(1, 2)], "a int, b int")).first().similarity
    assert abs(pair.select(embedders.dense_cosine(F.col("p"), F.col("q")).alias("c")).first().c - exact) < 1e-6
    with pytest.raises(Exception, match="width"):
        pair.select(embedders.dense_cosine(F.col("p"), F.slice("q", 1, 5))).collect()
    with pytest.raises(ValueError):
        embedders.ShingleEmbedder(0).embed(units)


def test_token_counters_fall_back(spark, tmp_path):
    import public_tokenizers

    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "i int, t string")
    exact = {r.i: r.n for r in df.select("i", tokens.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))(F.col("t")).alias("n")).collect()}
    rough = {r.i: r.n for r in df.select("i", tokens.token_counter(str(tmp_path / "none"))(F.col("t")).alias("n")).collect()}
    assert exact == {1: 2, 2: None, 3: 0} and rough == {1: 9, 2: None, 3: 0}
    assert {r.n for r in df.select(tokens.token_counter(None)(F.col("t")).alias("n")).collect()} == {9, None, 0}


SOURCE = """import { a } from './a'; // function no() { import './never' }
export interface Item { id: string; tags: string[] }
type Pair<T> = { a: T;
  b: T };
export enum Kind { A, B }
export default async function load<T>(x: T, y = { z: 1 }): Promise<{ ok: boolean }> { return fetch(`/x/${x.map(q => { return q.id; })}/y`); }
const sum = (a: number, b: number): number => a + b;
const typed: Fn<string> = async (p) => { await p.run(/[/"]}/); };
class Cart extends Base {
  private items = new Map<string, Item>();
  constructor(private readonly repo: Repo) { super(); this.repo = repo; }
  get size(): number { return this.items.size; }
  set size(v) { this.items.set("}", v); }
  static async add<T>(item: T) { if (item) { this.items.push(item); } for (const x of y) { go(x); } }
  handler = (e) => { this.add(e); };
  abstract nope(x: string): void;
  [Symbol.iterator]() { return 1; }
}
const obj = { run() { return 2; }, other: function () { return 3; }, arrow: x => x * 2 };
list.forEach(function named(x) { console.log(x ? (y) : z); });
"""


def test_units_of_source_text(spark):
    found = [(u.name, u.kind, u.line, u.end_line) for u in code.units_of(SOURCE)]
    assert found == [
        ("load", "function", 6, 6), ("<anonymous>", "arrow", 6, 6), ("sum", "arrow", 7, 7), ("typed", "arrow", 8, 8), ("Cart.constructor", "constructor", 11, 11), ("Cart.size", "get", 12, 12), ("Cart.size", "set", 13, 13),
        ("Cart.add", "method", 14, 14), ("Cart.handler", "arrow", 15, 15), ("Cart.<computed>", "method", 17, 17), ("run", "method", 19, 19), ("other", "function expression", 19, 19), ("arrow", "arrow", 19, 19), ("named", "function expression", 20, 20),
    ]
    assert [c[:3] for c in code.contracts_of(SOURCE)] == [("Item", "interface", 2), ("Pair", "type", 3), ("Kind", "enum", 5)]
    assert code.levelled(code.scanned("total = price.net(3, 'x') + other // y")) == ["ID", "=", "ID", ".", "N:net", "(", "NUM", ",", "STR", ")", "+", "ID"]
    renamed = code.units_of(SOURCE.replace("item)", "thing)").replace("item:", "thing:"))
    assert [u.tokens for u in renamed if u.name == "Cart.add"] == [u.tokens for u in code.units_of(SOURCE) if u.name == "Cart.add"]
    for cut in range(0, len(SOURCE), 7):  # a text that breaks off anywhere
        code.units_of(SOURCE[:cut]), code.contracts_of(SOURCE[:cut])
    df = spark.createDataFrame([(1, SOURCE), (2, None), (3, ""), (4, "{" * 3000)], "i int, c string")
    assert {r.i: r.n for r in df.select("i", F.size(code.function_units(F.col("c"), 1)).alias("n")).collect()} == {1: 14, 2: 0, 3: 0, 4: 0}
    assert df.select(code.contracts(F.col("c")).alias("k"), code.normal_tokens(F.col("c")).alias("t")).count() == 4


def test_imports_are_found_in_code_only(spark):
    text = "/* import './no' */\nconst a = await import('./late');\nimport x from './one';\nconst s = \"import('./str')\";\nconst t = `\nimport './tpl'\n`;\nexport { y } from '../two';\nreimport('./not');\n"
    rows = modules.imports(spark.createDataFrame([("f", text)], "path string, content string")).orderBy("ord").collect()
    assert [r.specifier for r in rows] == ["./late", "./one", "../two"]


def test_project_files_of_a_project_file(spark):
    told = '{ // comment\n "include": ["src/**/*.ts", "lib"], /* x */ "exclude": ["**/*.spec.ts"], }'
    tree = spark.createDataFrame([(p,) for p in ("src/a.ts", "src/d/b.ts", "src/a.spec.ts", "lib/c.js", "other/d.ts", "src/e.d.ts")], "path string")
    assert {r.path for r in modules.included(tree, told).collect()} == {"src/a.ts", "src/d/b.ts", "lib/c.js"}
    assert {r.path for r in modules.included(tree, None).collect()} == {"src/a.ts", "src/d/b.ts", "src/a.spec.ts", "lib/c.js", "other/d.ts"}
    assert {r.path for r in modules.included(tree, '{"files": ["other/d.ts"]}').collect()} == {"other/d.ts"}


def test_changed_symbols_tell_what_was_not_parsed(spark):
    files = spark.createDataFrame([("a.ts", "modified", [3, 99]), ("gone.ts", "deleted", [1]), ("README.md", "modified", [1]), ("lost.ts", "modified", [1]), ("new.ts", "added", [])], "file string, status string, changed array<int>")
    ranges = spark.createDataFrame([("a.ts", 1, 9, "a#C"), ("a.ts", 2, 5, "a#C.f"), ("new.ts", 1, 2, "new#g"), ("gone.ts", 1, 5, "gone#x")], "file string, start int, end int, decl string")
    got = {tuple(r) for r in intervals.changed_symbols(files, ranges).collect()}
    assert got == {("a#C.f", "a.ts", 3, "modified"), ("a.ts#<module>", "a.ts", 99, "modified"), ("new#g", "new.ts", 1, "added"), (None, "lost.ts", None, "unparsed")}


def test_late_and_repeated_deliveries_keep_the_newest_pending(spark, tmp_path):
    rows = [[("d2", 7, "2025-01-02"), ("d1", 7, "2025-01-01")], [("d0", 7, "2020-01-01"), ("d2", 7, "2025-01-02"), ("e1", 8, "2025-01-01")], [("d3", 7, "2025-01-03")]]
    started = []
    for i, batch in enumerate(rows):
        df = spark.createDataFrame([(k, "o", "r", n, t) for k, n, t in batch], "delivery_id string, owner string, repo string, pull_number int, t string").selectExpr("delivery_id", "owner", "repo", "pull_number", "cast(t as timestamp) created_at")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        stream.drain(stream.queue_changes(source), stream.by_batch(str(tmp_path / "out")), str(tmp_path / "state"), at_start=lambda: started.append(1)).awaitTermination()
    changes = spark.read.schema(stream.CHANGES).parquet(str(tmp_path / "out"))
    states = {r.delivery_id: r.state for r in stream.final_states(changes).collect()}
    assert states == {"d0": "superseded", "d1": "superseded", "d2": "superseded", "d3": "pending", "e1": "pending"} and len(started) == 3
    again = stream.by_batch(str(tmp_path / "out"))
    again(changes.limit(0), 0)
    again(changes.limit(0), 0)
    assert spark.read.parquet(str(tmp_path / "out") + "/batch=0").count() == 0
