from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from ripplefold.durable import cut
from ripplefold.llm import components, near_duplicates, neighbours, quantiles

MATCH = "unit_no long, match_no long, similarity double, v string"


def smallest_of_group(nodes, edges):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_groups_match_union_find(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 70)] + [(200 + rng.randrange(60), 200 + rng.randrange(60)) for _ in range(40)] + [(500, x) for x in range(501, 560)]
    rows = [(a, b, 0.9, "x") for a, b in edges] * 2 + [(b, a, 1.0001, "y") for a, b in edges[:20]]
    rows += [(900, 901, 0.84, "low"), (902, 903, float("nan"), "n"), (904, 905, None, "n"), (906, None, 0.99, "n"), (None, 907, 0.99, "n"), (None, None, 1.0, "n"), (908, 908, 1.0, "self"), (909, 910, 0.85, "at")]
    got = {r.unit_no: r.group_no for r in components.groups(spark.createDataFrame(rows, MATCH), "unit_no", "match_no", "similarity", 0.85).collect()}
    nodes = {x for a, b, *_ in rows for x in (a, b) if x is not None}
    assert got == smallest_of_group(nodes, [*edges, (909, 910)])


def test_no_links_and_no_rows(spark):
    assert components.groups(spark.createDataFrame([], MATCH), "unit_no", "match_no", "similarity", 0.85).count() == 0
    alone = components.groups(spark.createDataFrame([(3, 4, 0.1, "")], MATCH), "unit_no", "match_no", "similarity", 0.85).collect()
    assert {(r.unit_no, r.group_no) for r in alone} == {(3, 3), (4, 4)}


def test_percentiles_keep_their_error_and_merge(spark):
    rng = np.random.default_rng(2)
    values = [(g, float(x), "s") for g in ("a", "b") for x in np.concatenate([rng.lognormal(5, 2, 3000), -rng.lognormal(1, 1, 500), np.zeros(50)])]
    odd = [("a", None, ""), ("a", float("nan"), ""), ("a", float("inf"), ""), ("c", None, ""), (None, 7.0, "")]
    df = spark.createDataFrame(values + odd, "g string, x double, sign string").select("g", "x")
    whole = quantiles.sketch(df, ["g"], "x")
    parts = [quantiles.sketch(df.where(c), ["g"], "x") for c in ("x < 10", "x >= 10", "x is null")]
    assert sorted(map(tuple, quantiles.merge(*parts, by=["g"]).collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)
    for r in quantiles.estimate(whole, ["g"], [0.0, 0.1, 0.5, 0.95, 1.0]).where("g is not null").collect():
        truth = float(np.quantile([x for g, x, _ in values if g == r.g], r.q, method="lower"))
        assert abs(r.value - truth) <= quantiles.ALPHA * abs(truth) * 1.0001 and r.low - 1e-9 <= truth <= r.high + 1e-9
    finite = df.where("x is not null and not isnan(x) and abs(x) < double('infinity') and g is not null")
    from pyspark.sql import functions as F

    for q in (0.05, 0.5, 0.95):
        for r in quantiles.exact(finite, quantiles.sketch(finite, ["g"], "x"), ["g"], "x", F.lit(q)).collect():
            assert math.isclose(r.exact_q, float(np.quantile([x for g, x, _ in values if g == r.g], q)), rel_tol=1e-12)
    assert quantiles.estimate(quantiles.sketch(df.limit(0), ["g"], "x"), ["g"], [0.5]).count() == 0


def runs(tokens, width=5):
    return {tuple(tokens[i : i + width]) for i in range(len(tokens) - width + 1)}


def brute_pairs(units, least, least_tokens=40):
    sets = {u: runs(t) for u, t in units.items() if t is not None and len(t) >= least_tokens}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


def edited_units(n_families=40, seed=4):
    rng = random.Random(seed)
    units, no = {}, 0
    for _ in range(n_families):
        base = [f"t{rng.randrange(300)}" for _ in range(rng.randint(45, 120))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(copy))
                copy[at : at + 1] = rng.choice([[], ["edit"], ["x", "y"], [None]])
            units[no := no + 1] = copy
    units[no + 1], units[no + 2], units[no + 3] = None, [], ["a"] * 39
    units[no + 4] = units[no + 5] = ["a"] * 60
    return units


def frame(spark, units):
    return spark.createDataFrame([(u, t, "k") for u, t in units.items()] * 2, "unit_no long, tokens array<string>, id string")


def test_near_duplicates_match_brute_force(spark):
    units = edited_units()
    truth = brute_pairs(units, 0.5)
    got = {tuple(r) for r in near_duplicates.pairs(frame(spark, units), "unit_no", "tokens", 0.5, 40).collect()}
    assert got <= truth and len(got) >= 0.98 * len(truth)
    rows = near_duplicates.class_links(frame(spark, units), "unit_no", "tokens", 0.5, 40).collect()
    assert len(rows) == sum(1 for t in units.values() if t and len(t) >= 40)


def test_crowded_bands_are_split_not_dropped(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"t{i}" for i in range(80)]
    units = {i: base[:40] + [f"u{i}_{rng.randrange(9)}"] + base[40:] for i in range(300)}
    sequences = frame(spark, units).select(F.col("unit_no").alias("class_id"), "tokens").distinct()
    got = near_duplicates.similar_classes(sequences, 0.5, crowd=1).count()
    assert got >= 0.9 * 300 * 299 / 2


def test_crowded_bands_lose_no_pair(spark):
    rng = random.Random(3)
    body = [f"t{i}" for i in range(120)]
    units = {i: body[:86] + [f"u{i}_{j}" for j in range(34 - rng.randrange(8))] for i in range(300)}
    sequences = frame(spark, units).select(F.col("unit_no").alias("class_id"), "tokens").distinct()
    plain, crowded = ({(r.a, r.b) for r in near_duplicates.similar_classes(sequences, 0.5, crowd=crowd).collect()} for crowd in (10**6, 1))
    truth = brute_pairs(units, 0.5)
    assert crowded == plain and len(truth) > 20_000 and len(crowded) >= 0.98 * len(truth)


def test_copies_are_one_class_and_nothing_is_empty(spark):
    units = {i: ["a", "b", "c", "d"] * 15 for i in range(1, 51)}
    rows = near_duplicates.class_links(frame(spark, units), "unit_no", "tokens", 0.5, 40).collect()
    assert {(r.class_id, r.copies, r.links) for r in rows} == {(1, 50, 0)} and len(rows) == 50
    assert near_duplicates.pairs(frame(spark, {1: None}).limit(0), "unit_no", "tokens", 0.5, 40).count() == 0


def test_repeated_rows_and_hot_copies_stay_one_class(spark):
    body = [f"t{i}" for i in range(60)]
    rows = [(1, body), (2, body[:30] + ["x"] + body[30:]), (3, body), (4, ["short"] * 4)] * 50 + [(5, None), (6, []), (None, body)]
    df = spark.createDataFrame([(u, t, "k") for u, t in rows], "unit_no long, tokens array<string>, id string")
    assert sorted(tuple(r) for r in near_duplicates.pairs(df, "unit_no", "tokens", 0.5, 40).collect()) == [(1, 2), (1, 3), (2, 3)]
    links = near_duplicates.class_links(df, "unit_no", "tokens", 0.5, 0)
    assert {(r.unit_no, r.class_id, r.copies, r.links) for r in links.collect()} == {(1, 1, 2, 1), (3, 1, 2, 1), (2, 2, 1, 1), (4, 4, 1, 0), (6, 6, 1, 0)}


def vectors(n_families=120, d=48, seed=7):
    rng = np.random.default_rng(seed)
    out, no = {}, 0
    for _ in range(n_families):
        base = rng.normal(size=d)
        for _ in range(rng.integers(1, 5)):
            out[no := no + 1] = (base + rng.normal(size=d) * 0.35 * rng.random()).astype(np.float32).tolist()
    return out


FP = "fp_id long, e string, ver int, embedding array<float>, g string"


def nearest_pairs(vecs, k=3, least=0.7):
    ids = sorted(vecs)
    x = np.array([vecs[i] for i in ids], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = x @ x.T
    np.fill_diagonal(s, -2)
    order = np.argsort(-np.round(s, 10), axis=1, kind="stable")[:, :k]
    return {tuple(sorted((ids[i], ids[j]))) for i in range(len(ids)) for j in order[i] if s[i, j] >= least}


def test_neighbours_are_found(spark):
    vecs = vectors()
    rows = [(i, "m", 1, v, "x") for i, v in vecs.items()]
    bad = [(9001, "m", 1, None, ""), (9002, "m", 1, [], ""), (9003, "m", 1, [0.0] * 48, ""), (9004, "m", 1, [float("nan")] * 48, ""), (9005, "m", 1, [float("inf")] + [1.0] * 47, ""), (9006, "m", 1, [None] + [1.0] * 47, ""), (9007, "m", 1, [1.0] * 40, "")]
    other = [(10_000 + i, "m", 2, v, "x") for i, v in list(vecs.items())[:1]]
    got = {tuple(r) for r in neighbours.pairs(spark.createDataFrame(rows + bad + rows[:9] + other, FP), "fp_id", "embedding", ["e", "ver"]).collect()}
    truth = nearest_pairs(vecs)
    assert len(got & truth) >= 0.9 * len(truth) and all(max(p) < 9000 for p in got)


def test_copies_and_crowds_keep_their_neighbours(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=16).astype(np.float32).tolist()
    rows = [(i, "m", 1, base, "") for i in range(1, 61)]
    lists = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, FP), "fp_id", "embedding", ["e", "ver"], 3).collect():
        lists[r.id].append(r.other)
    assert len(lists) == 60 and sorted(lists[1]) == [2, 3, 4] and sorted(lists[9]) == [1, 2, 3]
    near = spark.createDataFrame([(i, "m", 1, (np.array(base) + rng.normal(size=16) * 0.01).astype(np.float32).tolist(), "") for i in range(400)], FP)
    packed = neighbours.usable(near, "fp_id", "embedding", ["e", "ver"])
    met = neighbours.candidates(packed, crowd=1).select("a").union(neighbours.candidates(packed, crowd=1).select("b")).distinct().count()
    assert met >= 390
    assert neighbours.pairs(near.limit(0), "fp_id", "embedding", ["e", "ver"]).count() == 0


def test_crowded_buckets_lose_no_pair(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=256)
    base *= 16 / np.linalg.norm(base)
    rows = [(i, "m", 1, (base + rng.normal(size=256) * 0.5).astype(np.float32).tolist(), "") for i in range(400)]
    packed = cut(neighbours.usable(spark.createDataFrame(rows, FP), "fp_id", "embedding", ["e", "ver"])).df
    plain, crowded = ({(r.a, r.b) for r in neighbours.candidates(packed, crowd=crowd).collect()} for crowd in (10**6, 1))
    assert crowded == plain and len(crowded) >= 0.9 * 400 * 399 / 2


def test_wider_buckets_keep_their_recall(spark):
    rng = np.random.default_rng(6)
    vecs, no = {}, 0
    for _ in range(250):
        base = rng.normal(size=256)
        for _ in range(4):
            vecs[no := no + 1] = (base + rng.normal(size=256) * 0.55 * rng.random()).astype(np.float32).tolist()
    packed = cut(neighbours.usable(spark.createDataFrame([(i, "m", 1, v, "x") for i, v in vecs.items()], FP), "fp_id", "embedding", ["e", "ver"])).df
    x = np.array([vecs[i] for i in sorted(vecs)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    truth = {(int(a) + 1, int(b) + 1) for a, b in np.argwhere(np.triu(x @ x.T >= 0.7, 1))}
    assert len(truth) > 1000 and [neighbours.width_for(n)[0] for n in (0, 1 << 22, (1 << 22) + 1, 1 << 40)] == [2, 2, 3, 4]
    for _, parts, tables in neighbours.WIDTHS:
        found = {(r.a, r.b) for r in neighbours.candidates(packed, tables, parts=parts).collect()}
        assert len(found & truth) >= 0.9 * len(truth), (parts, len(found & truth) / len(truth))
