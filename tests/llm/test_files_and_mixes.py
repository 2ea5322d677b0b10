from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ripplefold.llm import handwritten, mixing

FILE = "repo string, file string, head string, n_lines int, n_bytes long, path string"
CODE = "import { A } from './a';\n\nexport class B {\n"


def reasons(spark, rows, attributes=()):
    files = spark.createDataFrame([(*r, "extra") for r in rows], FILE)
    told = spark.createDataFrame(list(attributes), "repo string, file string, content string")
    return {(r.repo, r.file): r.reason for r in handwritten.not_handwritten(files, told).collect()}


def test_globs():
    import re

    def fits(glob, path):
        return re.search(handwritten.glob_regex(glob), path) is not None

    assert fits("*.gen.ts", "a/b/x.gen.ts") and not fits("*.gen.ts", "a/x.gen.tsx")
    assert fits("api/*.ts", "api/x.ts") and not fits("api/*.ts", "lib/api/x.ts") and not fits("api/*.ts", "api/v1/x.ts")
    assert fits("**/out/**", "a/out/b/c") and fits("**/out/**", "out/b") and fits("/top.ts", "top.ts") and not fits("/top.ts", "a/top.ts")
    assert fits("a[0-9]?.js", "q/a1b.js") and not fits("a[!0-9].js", "a1.js") and not fits("dir/", "dir/x")


def test_attribute_files_decide_by_depth_and_line(spark):
    rows = [("r", f, CODE, 100, 3000) for f in ("lib/a.ts", "lib/sub/b.ts", "lib/sub/keep.ts", "x_pb.js", "src/c.ts")] + [("s", "lib/a.ts", CODE, 100, 3000)]
    attributes = [("r", ".gitattributes", "# x\nlib/** linguist-vendored\n*_pb.js -linguist-generated\n"), ("r", "lib/sub/.gitattributes", "*.ts linguist-vendored=false\nb.ts linguist-vendored\n"), ("s", ".gitattributes", None)]
    assert reasons(spark, rows, attributes) == {("r", "lib/a.ts"): "declared", ("r", "lib/sub/b.ts"): "declared"}


ATTRIBUTES = {
    ".gitattributes": """# rules
[attr]vend linguist-vendored
[attr]ours -linguist-vendored !linguist-generated
lib/** vend
lib/sub/*.js ours
*.gen.ts linguist-generated
/top.ts linguist-generated=true
a**b.ts linguist-generated
**/out/** linguist-generated
deep/**/x.ts linguist-vendored
dir/ linguist-generated
!neg.ts linguist-generated
"sp ace.ts" linguist-generated
k[0-9][!a].ts linguist-generated
*.txt text
both.ts linguist-generated -linguist-generated linguist-vendored=false
""",
    "lib/.gitattributes": "*.gen.ts !linguist-generated\nkeep.ts -linguist-vendored\nown/* vend\n",
    "lib/sub/.gitattributes": "b.ts linguist-vendored=false\n/c.ts linguist-generated\n",
}
PATHS = [
    "lib/a.ts", "lib/keep.ts", "lib/sub/b.ts", "lib/sub/c.ts", "lib/sub/d/c.ts", "lib/sub/e.js", "lib/x.gen.ts", "src/x.gen.ts", "top.ts", "src/top.ts", "axxb.ts", "a/xb.ts", "out/f.ts", "q/out/r/f.ts",
    "deep/x.ts", "deep/y/z/x.ts", "deep/y/x.tsx", "dir/f.ts", "neg.ts", "!neg.ts", "sp ace.ts", "k1b.ts", "k1a.ts", "kxb.ts", "notes.txt", "both.ts", "lib/own/p.ts", "own/p.ts", "outfile.ts", "src/out",
]


def test_attributes_resolve_as_git_resolves_them(spark, tmp_path):
    import subprocess

    for name, content in ATTRIBUTES.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(content)
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True, env={"HOME": str(tmp_path), "PATH": "/usr/bin:/bin:/usr/local/bin"})
    told = subprocess.run(["git", "-C", str(tmp_path), "check-attr", "-z", "linguist-generated", "linguist-vendored", "--", *PATHS], check=True, capture_output=True, text=True).stdout.split("\0")
    values = {}
    for path, _, value in zip(told[::3], told[1::3], told[2::3]):
        values.setdefault(path, []).append({"set": True, "true": True, "unset": False, "false": False}.get(value))
    truth = {p: True if True in v else False for p, v in values.items() if v != [None, None]}
    rules = handwritten.attribute_rules(spark.createDataFrame([("r", f, c) for f, c in ATTRIBUTES.items()] + [("s", ".gitattributes", None)], "repo string, file string, content string"))
    paths = spark.createDataFrame([(r, p) for r in ("r", "s") for p in PATHS] + [(None, "a.ts"), ("r", None)], "repo string, path string")
    got = {(x.repo, x.path): x.declared for x in handwritten.declared(paths, rules).collect()}
    assert got == {("r", p): v for p, v in truth.items()} and len(truth) > 15


def test_cut_attribute_files_are_refused(spark):
    whole = "lib/** linguist-vendored\n"
    rows = [("r", ".gitattributes", whole, 1, len(whole)), ("s", "x\\\\.gitattributes", whole, 9, 4000), ("t", "a/.gitattributes", whole, None, None), ("u", "my.gitattributes", whole, 1, 5), ("v", ".gitattributes", None, 1, 5)]
    got = handwritten.whole_attribute_files(spark.createDataFrame(rows, "repo string, file string, head string, n_lines int, n_bytes long"))
    assert {(r.repo, r.content) for r in got.collect()} == {("r", whole), ("t", whole)}


def test_phrases_stop_at_code(spark):
    heads = ["// Made by x 1.2.3\n\ncode();\n// later words here too", None, "", "code();", "/* one */"]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(heads)], "i int, head string")
    got = {r.i: r.p for r in df.select("i", handwritten.phrases(F.col("head")).alias("p")).collect()}
    assert got == {0: ["^ made by", "made by x", "by x #", "x # $"], 1: [], 2: [], 3: [], 4: ["^ one $"]}


def test_mined_phrases_and_deep_paths_reach_silent_files(spark):
    told = "// shaped with care by loom 1.0\n" + CODE
    rows = [(f"r{i % 9}", f"src/m{i}/api{i}.pb.ts", told, 50, 1500) for i in range(40)] + [(f"r{i % 9}", f"src/n{i}/plain{i}.ts", told, 50, 1500) for i in range(9)]
    rows += [(f"r{i % 9}", f"src/o{i}/cart.store.ts", "// our own words\n" + CODE, 50, 1500) for i in range(200)]
    marked = "// @generated by the compiler 1.0\n" + CODE
    rows += [(f"r{i % 9}", f"kit{i}/snap/{'/'.join('abcdefgh'[: i % 8 + 1])}/u{i}-{i}x/one_{i}.dart", marked if i % 4 else CODE, 50, 1500) for i in range(40)]
    got = reasons(spark, rows)
    assert all(got[(r, f)] == "phrase" for r, f, h, *_ in rows if h == told)
    assert set(got) == {(r, f) for r, f, h, *_ in rows if h in (told, marked) or f.endswith(".dart")}


def test_files_tell_by_themselves(spark):
    rows = [
        ("r", "a.ts", "// Code generated by x v1. DO NOT EDIT.\n" + CODE, 10, 300),
        ("r", "b.ts", "/*! lib v1.0 | (c) them | MIT */\n" + CODE, 10, 300),
        ("r", "c.js", '"use strict";\nObject.defineProperty(exports, "__esModule", { value: true });\n', 10, 300),
        ("r", "d.ts", "export const X = [\n" + " 12.5, 77," * 30, 40, 900),
        ("r", "e.js", CODE, 3, 90_000),
        ("r", ".\\odd\\f.min.js", CODE, 20, 500),
        ("r", "n/g.ts", None, None, 300),
        ("r", "h.ts", "// do not edit the cart directly, go through the store\n" + CODE, 10, 300),
        ("r", "i.ts", "// the id is generated by the store and must stay unique\n" + CODE, 10, 300),
        ("r", "vendor/vendor-list.ts", CODE, 10, 300),
        (None, None, None, None, None),
    ]
    assert reasons(spark, rows * 2) == {("r", "a.ts"): "generated", ("r", "b.ts"): "vendored", ("r", "c.js"): "built", ("r", "d.ts"): "data", ("r", "e.js"): "minified", ("r", ".\\odd\\f.min.js"): "convention"}
    assert reasons(spark, []) == {}


def test_patterns_of_marked_files_reach_silent_ones(spark):
    marked = "// @generated by the compiler 1.0\n" + CODE
    rows = [(f"r{i}", f"src/m{i}/gen/part{i}-types.ts", marked if i % 3 else CODE, 50, 1500) for i in range(60)]
    rows += [(f"r{i}", f"src/m{i}/gen/gen-plan{i}.view.ts", CODE, 50, 1500) for i in range(60)]
    rows += [(f"r{i % 7}", f"src/m{i}/cart.store.ts", CODE, 50, 1500) for i in range(300)]
    got = reasons(spark, rows)
    assert set(got) == {(r, f) for r, f, *_ in rows if f.endswith("-types.ts")} and set(got.values()) == {"generated", "pattern"}


def test_splits_add_up_and_stay_even():
    counts = np.array([97, 13, 0, 400])
    leaves = mixing.split_tree(counts, 11)
    assert (leaves.sum(0) == counts).all() and leaves.min() >= 0 and np.ptp(leaves.sum(1)) <= 4


DOCS = "doc_id long, source string, n_tokens long, extra string"


def test_mix_reaches_targets_within_caps(spark):
    docs = [(i, " Big ", 100, "") for i in range(3000)] + [(10_000 + i, "SMALL", 90 + i % 21, "") for i in range(400)] + [(20_000 + i, "tiny", 50, "") for i in range(10)] + [(30_000, None, 5, ""), (30_001, "other", 5, ""), (30_002, "big", 0, "")]
    targets = spark.createDataFrame([("big", 0.6, 1), ("Small", 0.3, 5), ("tiny", 0.06, 2), ("absent", 0.04, 9)], "source string, target_share double, max_repeats int")
    docs += [(40_000 + i, "\u00a0BIG\u2003", 10, "") for i in range(5)]
    placed = mixing.named(spark.createDataFrame(docs, DOCS), targets, "doc_id", "source")
    mix = mixing.Mix(spark, placed, targets, "doc_id", shards=5)
    assert mix.plan["big"]["size"] == 300_050
    assert {r.source for r in mix.short().collect()} == {"tiny", "absent"}
    shares = {r.source: r for r in mix.shares().collect()}
    assert abs(shares["big"].used_tokens / shares["big"].want_tokens - 1) < 0.01 and abs(shares["Small"].used_tokens / shares["Small"].want_tokens - 1) < 0.02
    assert shares["tiny"].used_tokens == 2 * shares["tiny"].size_tokens and shares["absent"].used_tokens == 0
    rows = mix.rows().collect()
    assert max(r.repeat for r in rows if r.source == "small") < 5 and len({(r.doc_id, r.repeat) for r in rows}) == len(rows)
    assert sum(r.n_tokens for r in rows) == sum(s.used_tokens for s in shares.values()) and {r.shard for r in rows} == set(range(5))
    assert all((r.doubled, r.over_cap, r.broken) == (0, 0, 0) for r in mix.audit().collect()) and abs(sum(s.actual_share for s in shares.values()) - 1) < 1e-9
    # Each shard holds exactly the blocks its leaf of the tree drew.
    blocks = {n: p["blocks"] for n, p in mix.plan.items()}
    numbered = {r.doc_id: r.b for n in blocks for r in placed.where(F.col("source") == n).select("doc_id", mix._block(F.lit(blocks[n])).alias("b")).collect()}
    held = {(r.shard, r.source, numbered[r.doc_id], r.repeat) for r in rows}
    for i, name in enumerate(mix.names):
        per = [len({x for x in held if x[0] == s and x[1] == name}) for s in range(5)]
        assert all(p <= q for p, q in zip(per, mix.quota[:, i])) and len({x[2:] for x in held if x[1] == name}) == sum(per)


def test_partial_passes_end_at_the_nearest_block_at_any_size(spark):
    docs = spark.createDataFrame([(i, "a", 7, "") for i in range(20_000)], DOCS)
    for share in (0.1, 0.37, 0.999):
        targets = spark.createDataFrame([("a", share, 1)], "source string, target_share double, max_repeats int")
        mix = mixing.Mix(spark, mixing.named(docs, targets, "doc_id", "source"), targets, "doc_id", block_tokens=2)
        got = mix.shares().first()
        assert mix.plan["a"]["blocks"] == 70_000 and abs(got.used_tokens - share * 140_000) <= 21 and not got.short
    twice = spark.createDataFrame([("a", 0.5, 1), (" A", 0.5, 1), (None, 0.1, 1), ("b", None, None)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(spark, mixing.named(docs, twice, "doc_id", "source"), twice, "doc_id")
    assert [(r.source, r.used_tokens, r.short) for r in mix.shares().orderBy("source").collect()] == [(" A", 140_000, False), ("a", 140_000, False), ("b", 0, False)]


def test_odd_targets_draw_nothing(spark):
    docs = spark.createDataFrame([(i, s, 5, "") for i in range(50) for s in ("a", "b", "c", "d")], DOCS)
    targets = spark.createDataFrame([("a", -0.5, 1), ("b", float("nan"), 2), ("c", 0.5, -3), ("d", 0.5, 1), ("", 0.1, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(spark, mixing.named(docs, targets, "doc_id", "source"), targets, "doc_id")
    assert {r.source: (r.used_tokens, r.short) for r in mix.shares().collect()} == {"a": (0, False), "b": (0, False), "c": (0, True), "d": (250, True), "": (0, True)}


def test_too_many_sources_are_an_error(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(mixing, "MOST_SOURCES", 2)
    targets = spark.createDataFrame([(x, 0.1, 1) for x in "abc"], "source string, target_share double, max_repeats int")
    with pytest.raises(ValueError):
        mixing.named(spark.createDataFrame([], DOCS), targets, "doc_id", "source")


def test_empty_mixes(spark):
    none = spark.createDataFrame([], DOCS)
    targets = spark.createDataFrame([("a", 1.0, 2)], "source string, target_share double, max_repeats int")
    mix = mixing.Mix(spark, mixing.named(none, targets, "doc_id", "source"), targets, "doc_id")
    assert mix.rows().count() == 0 and mix.short().count() == 0 and mix.shares().first().actual_share == 0.0
    mix = mixing.Mix(spark, mixing.named(none, targets.limit(0), "doc_id", "source"), targets.limit(0), "doc_id")
    assert mix.rows().count() == 0 and mix.short().count() == 0
