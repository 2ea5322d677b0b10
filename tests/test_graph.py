from __future__ import annotations

import random
from collections import deque

from pyspark.sql import functions as F

from ripplefold.operators import blast, evidence, graph
from ripplefold.plans import graphs, stores

EDGE = "src string, dst string, specifier string, ord long"


def edge_frame(spark, pairs):
    return spark.createDataFrame([(a, b, f"./{b}", i) for i, (a, b) in enumerate(pairs)], EDGE)


def components(spark, pairs, **more):
    return {r.id: r.component for r in graph.strong_components(edge_frame(spark, pairs), **more).collect()}


def test_components_of_small_shapes(spark):
    assert components(spark, [("a", "b"), ("b", "c")]) == {}
    assert components(spark, [("a", "b"), ("b", "a"), ("x", "x"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "a")]) == {"a": "a", "b": "a", "x": "x", "c": "c", "d": "c", "e": "c"}
    assert components(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b"), ("q", "a")]) == {"a": "a", "b": "a", "c": "a"}
    assert components(spark, []) == {}


def test_long_chain_closed_at_its_end(spark):
    chain = [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(4000)] + [("n04000", "n03999")]
    assert components(spark, chain, rounds=4) == {"n03999": "n03999", "n04000": "n03999"}


def test_large_remainders_go_on_in_rounds(spark):
    ring = [(f"r{i:02d}", f"r{(i + 1) % 24:02d}") for i in range(24)]
    tail = [("t0", "r00"), ("r05", "u0"), ("u0", "u1"), ("u1", "u0")]
    truth = {**{f"r{i:02d}": "r00" for i in range(24)}, "u0": "u0", "u1": "u0"}
    assert components(spark, ring + tail, rounds=3, small=0) == truth == components(spark, ring + tail, rounds=3, small=10)


def test_a_chain_of_fifty_thousand_links(spark):
    chain = [(f"n{i:05d}", f"n{i + 1:05d}") for i in range(50_000)] + [("n50000", "n49999")]
    assert components(spark, chain, rounds=2) == {"n49999": "n49999", "n50000": "n49999"}


def test_introduced_cycles_are_told_as_sets(spark):
    frame = lambda rows: spark.createDataFrame(rows, "id string, component string")
    now = frame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c"), ("x", "x")])
    before = frame([("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")])
    assert {(r.component, r.n, r.introduced) for r in graph.introduced_cycles(now, before).collect()} == {("a", 2, False), ("c", 3, True), ("x", 1, True)}


def test_numbers_of_large_groups_match_a_window(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(50), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, w int, i int")
    got = {r.i: r.place for r in evidence.numbered(df, ["g"], [F.desc("w"), F.asc("i")], "place").collect()}
    truth, seen = {}, {}
    for g, w, i in sorted(rows, key=lambda r: (str(r[0]), -r[1], r[2])):
        truth[i] = seen[g] = seen.get(g, 0) + 1
    assert got == truth
    assert evidence.numbered(df.limit(0), ["g"], [F.desc("w")], "place").count() == 0


def test_random_components_match_reachability(spark):
    rng = random.Random(8)
    pairs = list({(f"v{rng.randrange(30)}", f"v{rng.randrange(30)}") for _ in range(45)})
    ahead = {}
    for a, b in pairs:
        ahead.setdefault(a, set()).add(b)

    def reach(v):
        seen, todo = set(), [v]
        while todo:
            for x in ahead.get(todo.pop(), ()):
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return seen

    reached = {v: reach(v) for v in {x for p in pairs for x in p}}
    truth = {v: min(u for u in reached[v] if v in reached[u]) for v in reached if v in reached[v]}
    assert components(spark, pairs) == truth
    assert components(spark, pairs, rounds=2) == truth


def test_nested_components_equal_separate_ones(spark):
    rng = random.Random(11)
    for k in (20, 34, 60):
        pairs = list({(f"v{rng.randrange(30):02d}", f"v{rng.randrange(30):02d}") for _ in range(k)}) + [("z", "z")]
        part = pairs[: k // 2]
        was, now = graph.nested_components(edge_frame(spark, part), edge_frame(spark, pairs))
        assert {r.id: r.component for r in was.collect()} == components(spark, part)
        rows = now.collect()
        assert len(rows) == len({r.id for r in rows}) and {r.id: r.component for r in rows} == components(spark, pairs)


def test_cycles_by_number_equal_cycles_by_name(spark):
    rng = random.Random(5)
    name = lambda i: f"b{(i * 7) % 10}/t/{i}"
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(40)}
    rows = [(name(a), name(b), a, b, "1999-01-01" if rng.random() < 0.7 else "2001-11-02") for a, b in pairs]
    e = spark.createDataFrame(rows, "src string, dst string, ord long, dst_no long, seen string").withColumn("first_seen", F.col("seen").cast("timestamp"))
    names = spark.createDataFrame([(i, name(i)) for i in range(25)], "no long, id string")
    by_name, by_number = (sorted(map(tuple, graphs.weighted_cycles(e, *more).collect())) for more in ((), (names,)))
    assert by_name == by_number and len({w for *_, w in by_name}) == 2


def test_coupling_counts_and_zeroes(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("lone",)], "id string")
    rows = {r.id: (r.fan_in, r.fan_out, r.instability) for r in graph.coupling(nodes, edge_frame(spark, [("a", "b"), ("a", "gone")])).collect()}
    assert rows == {"a": (0, 2, 1.0), "b": (1, 0, 0.0), "lone": (0, 0, 0.0)}


def test_rules_and_introduced_edges(spark):
    edges = edge_frame(spark, [("src/domain/a.ts", "src/infra/db.ts"), ("src/ui/a.ts", "src/infra/db.ts")])
    broken = graph.violations(edges, [("deny src/domain/** -> src/infra/**", "src/domain/**", "src/infra/**")]).collect()
    assert [(r.from_module, r.to_module) for r in broken] == [("src/domain/a.ts", "src/infra/db.ts")]
    assert graph.violations(edges, []).count() == 0
    flags = {r.src: r.introduced for r in graph.introduced(edges, edges.limit(0), ["src", "dst"]).collect()}
    assert set(flags.values()) == {True}


def fifo(pairs, changed, hops, lookups):
    """A queue-driven model of the walk."""
    seen, sites, queue, looked, cut = set(changed), [], deque((c, c, 0) for c in changed), 0, False
    while queue:
        at, origin, depth = queue.popleft()
        if depth == hops:
            continue
        if looked == lookups:
            cut = True
            break
        looked += 1
        for a, b in pairs:
            if b == at and a not in seen:
                seen.add(a)
                sites.append((a, depth + 1, origin, at))
                queue.append((a, origin, depth + 1))
    return sites, cut


def test_walk_matches_a_queue(spark):
    rng = random.Random(2)
    for lookups in (400, 7):
        pairs = list(dict.fromkeys((f"v{rng.randrange(40)}", f"v{rng.randrange(40)}") for _ in range(90)))
        changed = ["v1", "v2", "v30"]
        frame = spark.createDataFrame([(c, i) for i, c in enumerate(changed)], "id string, ord int")
        found, cut = blast.blast_radius(edge_frame(spark, pairs), frame, 3, lookups)
        rows = sorted(found.collect(), key=lambda r: (r.hops, r.path))
        truth, cut_truth = fifo(pairs, changed, 3, lookups)
        assert [(r.symbol_id, r.hops, r.origin, r.via) for r in rows] == truth and cut == cut_truth


def test_module_walk_stops_at_hops_and_cap(spark):
    pairs = [("mid", "core"), ("top", "mid")]
    assert [(r.symbol_id, r.hops) for r in blast.module_dependants(edge_frame(spark, pairs), "core").collect()] == [("mid", 1), ("top", 2)]
    assert [r.symbol_id for r in blast.module_dependants(edge_frame(spark, pairs), "core", 1).collect()] == ["mid"]
    hub = edge_frame(spark, [(f"d{i}", "core") for i in range(200)])
    assert blast.module_dependants(hub, "core", 3, 5).count() == 5


def test_base_graph_takes_back_a_change(spark):
    head = edge_frame(spark, [("new.ts", "x"), ("kept.ts", "x"), ("to.ts", "x")])
    changed = spark.createDataFrame([("new.ts", None, "added"), ("to.ts", "from.ts", "renamed")], "path string, previous_path string, status string")
    base = graph.base_edges(head, changed, spark.createDataFrame([("from.ts", "x", "./x")], "src string, dst string, specifier string"))
    assert {r.src for r in base.collect()} == {"kept.ts", "from.ts"}


def test_references_that_are_uses(spark):
    rows = [("s", "a.ts", 1, "a.ts", 1, False), ("s", "b.ts", 1, "a.ts", 1, True), ("s", "b.ts", 9, "a.ts", 1, False), ("s", "node_modules/x.ts", 2, "a.ts", 1, None), ("s", "c.ts", 1, None, None, None)]
    got = blast.usable_references(spark.createDataFrame(rows, "symbol_id string, path string, line int, declared_path string, declared_line int, in_import boolean"))
    assert {(r.path, r.line) for r in got.collect()} == {("b.ts", 9), ("c.ts", 1)}


def test_introduced_cycles_and_duplicates_are_evidence(spark, tiny_dir):
    seen = [("a", "b", "1999-01-01"), ("b", "a", "2001-11-02"), ("c", "d", "1998-01-01"), ("d", "c", "1998-01-01")]
    e = spark.createDataFrame(seen, "src string, dst string, first_seen string").withColumn("first_seen", F.col("first_seen").cast("timestamp"))
    assert {(r.id, r.weight) for r in graphs.weighted_cycles(e).collect()} == {("a", 1000), ("b", 1000), ("c", 250), ("d", 250)}
    rows = stores.j9_impact_evidence(spark, tiny_dir).collect()
    copies = [r for r in rows if r.kind == "duplicate"]
    assert copies and {r.change for r in copies} == {r.change for r in rows} and all(685 <= r.weight <= 700 for r in copies)
