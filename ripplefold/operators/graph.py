"""Dependency graphs: metrics, components, revisions, rules."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefold.durable import cut
from ripplefold.functions.text import layer_glob


def first_edges(edges: DataFrame, order: str = "ord") -> DataFrame:
    """(src, dst, specifier): each edge once, with the specifier that came first."""
    return edges.groupBy("src", "dst").agg(F.min_by("specifier", order).alias("specifier"))


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, fan_in, fan_out, instability) of every node of ``nodes(id)``; instability is 0 without edges.

    An edge end that is no node counts nowhere. Both counts come from one grouping.
    """
    ends = edges.select(F.inline(F.array(F.struct(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))))
    counted = ends.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    all_nodes = nodes.select("id").distinct().join(counted, "id", "left").na.fill(0, ["fan_in", "fan_out"])
    total = F.col("fan_in") + F.col("fan_out")
    return all_nodes.withColumn("instability", F.when(total == 0, 0.0).otherwise(F.col("fan_out") / F.when(total == 0, 1).otherwise(total)))


def instability_deltas(changed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """(module, before, after) of changed files present afterwards whose metrics are new or differ.

    ``changed`` is (path, previous_path); the earlier metrics are those of the previous path where there is one.
    """
    was = before.select(F.col("id").alias("was_id"), F.struct("fan_in", "fan_out", "instability").alias("before"))
    now = after.select("id", F.struct("fan_in", "fan_out", "instability").alias("after"))
    keyed = changed.select(F.col("path").alias("id"), F.coalesce("previous_path", "path").alias("was_id"))
    both = keyed.join(now, "id").join(was, "was_id", "left")
    return both.where("before is null or not (before <=> after)").select(F.col("id").alias("module"), "before", "after")


def base_edges(head: DataFrame, changed: DataFrame, base_imports: DataFrame) -> DataFrame:
    """Edges before a change, as a delta on the edges after it.

    ``changed`` is (path, previous_path, status); ``base_imports`` is (src, dst, specifier) of the changed
    files' earlier contents. Edges of every touched file leave, by its new and its old path; the earlier ones come.
    """
    touched = changed.select(F.explode(F.array("path", "previous_path")).alias("src")).where("src is not null").distinct()
    return head.join(touched, "src", "left_anti").select("src", "dst", "specifier").unionByName(base_imports.select("src", "dst", "specifier"))


def introduced(now: DataFrame, before: DataFrame, keys: list[str], flag: str = "introduced") -> DataFrame:
    """``now`` with a flag that is true where ``before`` has no row of the same keys."""
    known = before.select(*keys).distinct().withColumn("_known", F.lit(True))
    return now.join(known, keys, "left").withColumn(flag, F.col("_known").isNull()).drop("_known")


def violations(edges: DataFrame, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """(rule, from_module, to_module, specifier): one row per edge and broken rule.

    ``rules`` are (text, from glob, to glob), few and from a file; each becomes two literal patterns of one
    pass over the edges, so no join is needed.
    """
    hits = [F.when(F.col("src").rlike(layer_glob(a)) & F.col("dst").rlike(layer_glob(b)), F.lit(text)) for text, a, b in rules]
    if not hits:
        return edges.where("false").select(F.lit("").alias("rule"), F.col("src").alias("from_module"), F.col("dst").alias("to_module"), "specifier")
    broken = edges.select("src", "dst", "specifier", F.explode(F.array_compact(F.array(*hits))).alias("rule"))
    return broken.select("rule", F.col("src").alias("from_module"), F.col("dst").alias("to_module"), "specifier")


#: Edges up to which a weakly connected remainder is finished in one task, and rounds before that.
SMALL_COMPONENT = 200_000
ROUNDS = 50


def strong_components(edges: DataFrame, rounds: int = ROUNDS, small: int = SMALL_COMPONENT) -> DataFrame:
    """(id, component) of vertices on cycles: component is the smallest vertex reachable both ways.

    Vertices without an incoming or without an outgoing edge leave repeatedly; what remains is coloured: the
    greatest vertex that reaches each is spread forward, and inside a colour those that reach its root backward
    form a component. Long chains take one round per link; after ``rounds`` rounds the weakly connected remainders
    of at most ``small`` edges are finished with one task each, and larger ones go on in rounds to their end.
    Vertices off all cycles have no row, a self-loop is a cycle of one.
    """
    pairs = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    done = pairs.df.where("src = dst").select(F.col("src").alias("id"), F.col("src").alias("component"))
    parts, left = _coloured(pairs.df.where("src <> dst"), rounds)
    if left is not None:
        labels = cut(weak_components(left)).df
        placed = left.join(labels.select(F.col("id").alias("src"), "group_no"), "src").select("src", "dst", "group_no")
        sized = cut(placed.join(placed.groupBy("group_no").agg((F.count(F.lit(1)) <= small).alias("few")), "group_no"), F.max((~F.col("few")).cast("int")).alias("many"))
        kind = edges.schema["src"].dataType.simpleString()
        parts = parts.unionByName(sized.df.where("few").select("src", "dst", "group_no").groupBy("group_no").applyInPandas(_components_of, f"id {kind}, c {kind}"))
        if sized.metrics["many"]:
            parts = parts.unionByName(_coloured(sized.df.where("not few").select("src", "dst"), None)[0])
    groups = parts.groupBy("c").agg(F.min("id").alias("component"), F.count(F.lit(1)).alias("n")).where("n > 1")
    cyclic = parts.join(groups, "c").select("id", "component")
    return cyclic.unionByName(done.join(cyclic.select("id"), "id", "left_anti"))


def nested_components(part: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Strong components (id, component) of ``part`` and of ``edges``, which holds all its edges.

    What is a component of the part stays together in the whole, so the whole is done with each of them as one vertex,
    named by its smallest member; only edges between them and outside remain.
    """
    was = cut(strong_components(part)).df
    ends = edges.select("src", "dst").where("src is not null and dst is not null")
    a, b = was.toDF("src", "ca"), was.toDF("dst", "cb")
    left = ends.join(a, "src", "left").join(b, "dst", "left").where("ca is null or cb is null or ca <> cb")
    upper = cut(strong_components(left.select(F.coalesce("ca", "src").alias("src"), F.coalesce("cb", "dst").alias("dst")))).df
    merged = was.join(upper.toDF("component", "above"), "component", "left").select("id", F.coalesce("above", "component").alias("component"))
    return was, merged.unionByName(upper.join(was.select("id"), "id", "left_anti"))


def _coloured(edges: DataFrame, rounds: int | None) -> tuple[DataFrame, DataFrame | None]:
    """((id, c) of the components found, the edges left when the rounds were used, if any)."""
    most = float("inf") if rounds is None else rounds
    left = cut(edges, F.count(F.lit(1)).alias("n"))
    found: list[DataFrame] = []
    used = 0
    while left.metrics["n"] and used < most:
        while used < most:
            used += 1
            inner = left.df.join(left.df.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.df.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi")
            smaller = cut(inner.select("src", "dst"), F.count(F.lit(1)).alias("n"))
            same = smaller.metrics["n"] == left.metrics["n"]
            left.drop()
            left = smaller
            if same or not left.metrics["n"]:
                break
        if not left.metrics["n"] or used >= most:
            break
        vertices = left.df.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        colours = cut(vertices.select("id", F.col("id").alias("c")))
        stable = False
        while not stable and used < most:
            used += 1
            sent = left.df.join(colours.df.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "c", F.lit(None).alias("own"))
            both = sent.unionByName(colours.df.select("id", "c", F.col("c").alias("own"))).groupBy("id").agg(F.max("c").alias("c"), F.max("own").alias("own"))
            after = cut(both.select("id", "c", (F.col("c") > F.col("own")).cast("int").alias("moved")), F.sum("moved").alias("moved"))
            colours.drop()
            colours = after
            stable = not colours.metrics["moved"]
            colours.df = colours.df.select("id", "c")
        if not stable:
            break
        same_colour = cut(left.df.join(colours.df.toDF("src", "cs"), "src").join(colours.df.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst", F.col("cs").alias("c")))
        back = cut(colours.df.where("id = c"), F.count(F.lit(1)).alias("n"))
        while used < most:
            used += 1
            more = same_colour.df.join(back.df.select(F.col("id").alias("dst"), "c"), ["dst", "c"], "left_semi").select(F.col("src").alias("id"), "c")
            grown = cut(back.df.unionByName(more).distinct(), F.count(F.lit(1)).alias("n"))
            same = grown.metrics["n"] == back.metrics["n"]
            back.drop()
            back = grown
            if same:
                break
        else:
            break
        for spent in (same_colour, colours):
            spent.drop()
        found.append(back.df)
        rest = cut(left.df.join(back.df.select(F.col("id").alias("src")), "src", "left_anti").join(back.df.select(F.col("id").alias("dst")), "dst", "left_anti"), F.count(F.lit(1)).alias("n"))
        left.drop()
        left = rest
    parts = edges.sparkSession.createDataFrame([], edges.select(F.col("src").alias("id"), F.col("src").alias("c")).schema)
    for part in found:
        parts = parts.unionByName(part)
    return parts, left.df if left.metrics["n"] else None


def _components_of(frame: pd.DataFrame) -> pd.DataFrame:
    """Strong components of one weak component by two depth-first passes without recursion."""
    ahead: dict = {}
    behind: dict = {}
    for a, b in zip(frame["src"], frame["dst"]):
        ahead.setdefault(a, []).append(b)
        behind.setdefault(b, []).append(a)
    order, seen = [], set()
    for root in {**ahead, **behind}:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(ahead.get(root, ())))]
        while stack:
            vertex, rest = stack[-1]
            following = next((x for x in rest if x not in seen), None)
            if following is None:
                order.append(vertex)
                stack.pop()
            else:
                seen.add(following)
                stack.append((following, iter(ahead.get(following, ()))))
    label: dict = {}
    for root in reversed(order):
        if root in label:
            continue
        label[root] = root
        stack = [root]
        while stack:
            for x in behind.get(stack.pop(), ()):
                if x not in label:
                    label[x] = root
                    stack.append(x)
    return pd.DataFrame({"id": list(label), "c": list(label.values())})


def weak_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, group_no): the smallest vertex of each weakly connected component.

    Every vertex takes the least label of its neighbours and of the vertex its own label names, so labels
    jump along their chains and settle in about a logarithm of the diameter.
    """
    both = cut(edges.select(F.inline(F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("id"), F.col("src").alias("other"))))).distinct()).df
    labels = cut(both.groupBy("id").agg(F.min("other").alias("o")).select("id", F.least("id", "o").alias("group_no")))
    for _ in range(rounds):
        near = both.join(labels.df.toDF("other", "g"), "other").groupBy("id").agg(F.min("g").alias("g"))
        hooked = labels.df.join(near, "id").select("id", "group_no", F.least("group_no", "g").alias("g"))
        roots = hooked.groupBy(F.col("group_no").alias("root")).agg(F.min("g").alias("h"))
        lower = hooked.join(roots, F.col("group_no") == F.col("root")).select("id", "group_no", F.least("g", "h").alias("g"))
        jump = lower.join(lower.select(F.col("id").alias("at"), F.col("g").alias("k")), F.col("g") == F.col("at"), "left").select("id", F.least("g", F.coalesce("k", "g")).alias("group_no"), (F.least("g", F.coalesce("k", "g")) < F.col("group_no")).cast("int").alias("moved"))
        after = cut(jump, F.sum("moved").alias("moved"))
        stable = not after.metrics["moved"]
        after.df = after.df.select("id", "group_no")
        labels.drop()
        labels = after
        if stable:
            return labels.df
    raise RuntimeError(f"labels still moved after {rounds} rounds")


def cycles(components: DataFrame) -> DataFrame:
    """(component, node_ids): sorted members of each cycle, for cycles small enough to be shown as one row."""
    return components.groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("node_ids"))


def cycle_marks(components: DataFrame) -> DataFrame:
    """(component, n, mark): size of each cycle and 128 bits that tell its members, so a cycle is compared as a set
    without ever being gathered."""
    mark = F.struct(F.bit_xor(F.xxhash64("id")), F.bit_xor(F.xxhash64(F.lit(7), "id")))
    return components.groupBy("component").agg(F.count(F.lit(1)).alias("n"), mark.alias("mark"))


def introduced_cycles(now: DataFrame, before: DataFrame) -> DataFrame:
    """(component, n, introduced): cycles of ``now``; introduced where ``before`` has none of the same members."""
    old = cycle_marks(before).select("component", "n", "mark")
    return introduced(cycle_marks(now), old, ["component", "n", "mark"]).select("component", "n", "introduced")
