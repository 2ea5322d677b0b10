"""Graph queries on the part-succession graph.

A node is a part, with path brand/type/key; an edge leads from a line's part to the next one's in the same
order, of all lines. The change is what was shipped in the last days: an edge first seen then is new, all others
belong to the base revision.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ripplefold.durable import cut
from ripplefold.functions.text import edge_key, plural
from ripplefold.operators import blast, evidence, graph
from ripplefold.sources import sinks
from ripplefold.sources.tables import table

RULES = (
    ("deny Brand#1*/** -> Brand#2*/**", "Brand#1*/**", "Brand#2*/**"),
    ("deny **/ECONOMY*/** -> **/PROMO*/**", "**/ECONOMY*/**", "**/PROMO*/**"),
    ("deny Brand#3?/**/*1 -> Brand#4?/**", "Brand#3?/**/*1", "Brand#4?/**"),
)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("id"))


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, specifier, first_seen, ord, dst_no): each edge once; ord and dst_no are the part keys of its ends."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    steps = lines.withColumn("next", F.lead("l_partkey").over(order)).where(F.col("next").isNotNull())
    spec = F.concat_ws(":", F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.col("l_linenumber").cast("string"))
    once = steps.groupBy("l_partkey", "next").agg(F.min(spec).alias("specifier"), F.min("l_shipdate").alias("first_seen"))
    named = nodes(spark, d)
    a, b = named.toDF("l_partkey", "src"), named.toDF("next", "dst")
    return once.join(a, "l_partkey").join(b, "next").select("src", "dst", "specifier", "first_seen", F.col("l_partkey").alias("ord"), F.col("next").alias("dst_no"))


CHANGED_SINCE = "2001-11-01"
BASE = f"first_seen < timestamp '{CHANGED_SINCE}'"
NEW = f"not ({BASE})"

SQL_EDGES = f"""
nodes AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_partkey AS id FROM part),
steps AS (SELECT *, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nxt FROM lineitem),
edges AS (
  SELECT a.id AS src, b.id AS dst, min(lpad(CAST(l_orderkey AS VARCHAR), 12, '0') || ':' || l_linenumber) AS specifier,
         min(l_shipdate) AS first_seen, min(l_partkey) AS ord
  FROM steps JOIN nodes a ON l_partkey = a.p_partkey JOIN nodes b ON nxt = b.p_partkey GROUP BY 1, 2),
base AS (SELECT * FROM edges WHERE first_seen < TIMESTAMP '{CHANGED_SINCE}')
"""


def e2_first_edges(spark, d):
    return edges(spark, d).select("src", "dst", "specifier")


def e1_coupling(spark, d):
    return graph.coupling(nodes(spark, d), edges(spark, d)).select("id", F.col("fan_in").cast("long"), F.col("fan_out").cast("long"), "instability")


def _coupling_sql(name: str, source: str) -> str:
    return f"""{name} AS (
      SELECT id, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out,
             CASE WHEN coalesce(i, 0) + coalesce(o, 0) = 0 THEN 0.0 ELSE CAST(coalesce(o, 0) AS DOUBLE) / (coalesce(i, 0) + coalesce(o, 0)) END AS instability
      FROM nodes LEFT JOIN (SELECT dst, count(*) AS i FROM {source} GROUP BY 1) ON id = dst LEFT JOIN (SELECT src, count(*) AS o FROM {source} GROUP BY 1) ON id = src)"""


def d6_introduced_edges(spark, d):
    e = cut(edges(spark, d)).df
    return graph.introduced(e, e.where(BASE), ["src", "dst"]).select(edge_key(F.col("src"), F.col("dst")).alias("edge"), "introduced")


def d5_violations(spark, d):
    return _violations_of(cut(edges(spark, d)).df)


def _violations_of(e: DataFrame) -> DataFrame:
    broken = graph.violations(e, RULES)
    before = graph.violations(e.where(BASE), RULES).select("from_module", "to_module")
    return graph.introduced(broken, before, ["from_module", "to_module"])


def d8_instability_deltas(spark, d):
    return _deltas_of(nodes(spark, d), cut(edges(spark, d)).df)


def _deltas_of(n: DataFrame, e: DataFrame) -> DataFrame:
    after = graph.coupling(n, e)
    old = e.where(BASE)
    before = graph.coupling(old.select(F.explode(F.array("src", "dst")).alias("id")), old)
    changed = e.where(NEW).select(F.col("src").alias("path")).distinct().withColumn("previous_path", F.lit(None).cast("string"))
    out = graph.instability_deltas(changed, before, after)
    return out.select("module", F.col("before.fan_out").cast("long").alias("out_before"), F.col("before.instability").alias("before"), F.col("after.fan_out").cast("long").alias("out_after"), F.col("after.instability").alias("after"))


def j4_base_graph(spark, d):
    """The graph before the change as a delta on the one after it; touched parts of every fifth key were renamed by it."""
    e = cut(edges(spark, d)).df
    renamed = F.substring_index("src", "/", -1).cast("long") % 5 == 0
    old = F.when(renamed, F.concat("src", F.lit(".old")))
    changed = e.where(NEW).select(F.col("src").alias("path"), old.alias("previous_path")).distinct()
    earlier = e.where(BASE).join(changed.select(F.col("path").alias("src")), "src", "left_semi").select(F.coalesce(old, F.col("src")).alias("src"), "dst", "specifier")
    return graph.base_edges(e, changed, earlier)


def j3_cycles(spark, d):
    return graph.strong_components(edges(spark, d))


def j5_introduced_cycles(spark, d):
    e = cut(edges(spark, d)).df
    return graph.introduced_cycles(cut(graph.strong_components(e)).df, cut(graph.strong_components(e.where(BASE))).df)


CLOSURE = """
{name}_k AS (SELECT DISTINCT CAST(split_part(src, '/', 3) AS INTEGER) AS s, CAST(split_part(dst, '/', 3) AS INTEGER) AS t FROM {source}),
{name}_reach AS (SELECT s, t FROM {name}_k UNION SELECT r.s, e.t FROM {name}_reach r JOIN {name}_k e ON r.t = e.s),
{name} AS (SELECT n.id, least(n.id, min(m.id)) AS component FROM {name}_reach a JOIN {name}_reach b ON a.s = b.t AND a.t = b.s JOIN nodes n ON n.p_partkey = a.s JOIN nodes m ON m.p_partkey = a.t GROUP BY n.id)
"""


def d16_dependants(spark, d):
    """Every module's dependants in order of their edges, as rows."""
    return evidence.numbered(edges(spark, d).select(F.col("dst").alias("module"), F.col("src").alias("dependant"), "ord"), ["module"], [F.asc("ord"), F.asc("dependant")], "place").select("module", "dependant", F.col("place").cast("long").alias("place"))


def _changed(e: DataFrame) -> DataFrame:
    """Targets of edges the change added, ordered by their part key."""
    return e.where(NEW).select(F.col("dst").alias("id"), F.substring_index("dst", "/", -1).cast("long").alias("ord")).distinct()


def _sites(spark, d) -> DataFrame:
    """Sites with their fan-in; vertices are nodes, so an end's edges are all its fan-in."""
    e = cut(edges(spark, d)).df
    sites, _ = blast.blast_radius(e, _changed(e), 3, None)
    return blast.with_fan_in(sites, e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("fan_in")))


def j6_impact_blast_radius(spark, d):
    """Every module within three hops of the change, credited to one origin, weighted and numbered per brand."""
    sites = _sites(spark, d).withColumn("change", F.substring_index("origin", "/", 1)).withColumn("weight", evidence.site_weight(F.col("hops"), F.col("module_fan_in")))
    ranked = evidence.ordinals(sites.withColumn("seq", F.struct("hops", F.negative("module_fan_in"), "path")), ["change"], spread=True)
    return ranked.select("change", "symbol_id", "hops", "origin", "via", "module_fan_in", F.col("weight").cast("long").alias("weight"), F.col("ordinal").cast("int").alias("ordinal"), "evidence_id")


_LEVEL = """
l{k} AS (SELECT src AS id, arg_min(p.origin, list_append(p.path, e.ord)) AS origin, arg_min(p.id, list_append(p.path, e.ord)) AS via, min(list_append(p.path, e.ord)) AS path, {k} AS hops
       FROM l{j} p JOIN edges e ON e.dst = p.id WHERE src NOT IN ({seen}) GROUP BY src)"""
SQL_SITES = (
    f"l0 AS (SELECT dst AS id, dst AS origin, NULL::VARCHAR AS via, [CAST(split_part(dst, '/', 3) AS BIGINT)] AS path, 0 AS hops FROM edges WHERE first_seen >= TIMESTAMP '{CHANGED_SINCE}' GROUP BY dst),"
    + ",".join(_LEVEL.format(k=k, j=k - 1, seen=" UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(k))) for k in (1, 2, 3))
    + ", sites AS (SELECT s.id AS symbol_id, CAST(s.hops AS INTEGER) AS hops, s.origin, s.via, s.path, CAST(c.fan_in AS INTEGER) AS module_fan_in FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) s JOIN coupling c ON c.id = s.id)"
)
_WITH_SITES = f"WITH {SQL_EDGES}, {_coupling_sql('coupling', 'edges')}, {SQL_SITES}"


def j6_stats(spark, d):
    """Counts of a change: its sites, origins and farthest hop."""
    return _sites(spark, d).agg(F.count(F.lit(1)).alias("sites"), F.countDistinct("origin").alias("origins"), F.max("hops").cast("int").alias("farthest"), F.sum("module_fan_in").alias("fan_in"))


def e17_sites_by_origin(spark, d):
    """Sites grouped by origin and hop: how many, and the first and last of them by id."""
    return _sites(spark, d).groupBy("origin", "hops").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("first"), F.max("symbol_id").alias("last"))


def j7_module_walk(spark, d):
    """The first 25 modules that depend on the most used one."""
    e = cut(edges(spark, d)).df
    top = e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dst").first()
    return blast.module_dependants(e, top["dst"] if top else "").select("symbol_id", F.col("hops").cast("int").alias("hops"), "via")


def b6_shown_sites(spark, d):
    return sinks.shown_sites(cut(_sites(spark, d)).df).select("origin", "symbol_id", "hops", F.col("r").cast("int").alias("r"), F.col("more").cast("long").alias("more"))


def b6_impact_text(spark, d):
    """What each changed part reaches, as text: its nearest sites and how many more there are."""
    shown = sinks.shown_sites(cut(_sites(spark, d)).df).withColumn("line", F.concat_ws("  ", plural(F.col("hops"), "hop"), "symbol_id"))
    told = shown.groupBy("origin").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: x["line"]), "\n").alias("text"), F.max("more").alias("more"))
    return told.select("origin", F.concat("text", F.when(F.col("more") > 0, F.concat(F.lit("\nand "), F.col("more").cast("string"), F.lit(" more"))).otherwise("")).alias("text"))


def b10_hop_columns(spark, d):
    return sinks.hop_columns(cut(_sites(spark, d)).df).select("hops", "symbol_id", F.col("r").cast("int").alias("r"), F.col("overflow").cast("long").alias("overflow"))


def d15_drawn_edges(spark, d):
    sites = cut(_sites(spark, d)).df
    return sinks.drawn_edges(sites, sinks.hop_columns(sites))


def d10_via_names(spark, d):
    """Sites with the part name of the vertex they were reached through."""
    names = table(spark, d, "part").select(F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("name"))
    return blast.with_names(_sites(spark, d), names).select("symbol_id", "via", "via_name")


def evidence_items(n: DataFrame, e: DataFrame, cycles: DataFrame) -> DataFrame:
    """(built, kind, module, summary, weight, change) of violations, instability and ``cycles(component, id, weight)``."""
    v = _violations_of(e).select(F.lit(1).alias("built"), F.lit("layer-violation").alias("kind"), F.col("from_module").alias("module"), F.concat_ws(" ", "rule", edge_key(F.col("from_module"), F.col("to_module"))).alias("summary"), evidence.violation_weight(F.col("introduced")).alias("weight"))
    c = cycles.select(F.lit(0).alias("built"), F.lit("cycle").alias("kind"), F.col("component").alias("module"), F.col("id").alias("summary"), "weight")
    i = _deltas_of(n, e).select(F.lit(3).alias("built"), F.lit("instability").alias("kind"), "module", evidence.instability_summary(F.col("module"), F.col("before"), F.col("after")).alias("summary"), F.lit(evidence.WEIGHTS["instability"]).alias("weight"))
    return v.unionByName(c).unionByName(i).withColumn("change", F.substring_index("module", "/", 1))


def weighted_cycles(e: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(component, id, weight) of vertices on cycles; cycles that the base revision did not have weigh as introduced.

    With ``names(no, id)`` cycles are looked for by the numbers of the edges' ends (ord, dst_no) and named at the end.
    """
    links = e if names is None else cut(e.select(F.col("ord").alias("src"), F.col("dst_no").alias("dst"), "first_seen")).df
    was, now = graph.nested_components(links.where(BASE), links)
    now = cut(now).df
    flags = graph.introduced_cycles(now, was).select("component", evidence.cycle_weight(F.col("introduced")).alias("weight"))
    found = now.join(flags, "component").select("component", "id", "weight")
    if names is None:
        return found
    named = found.join(names.distinct().toDF("id", "name"), "id")
    least = named.groupBy("component").agg(F.min("name").alias("least"))
    return named.join(least, "component").select(F.col("least").alias("component"), F.col("name").alias("id"), "weight")


def c10_evidence(spark, d):
    """Violations, cycles and instability as one list of evidence with weights, numbered together per change brand."""
    e, n = cut(edges(spark, d)).df, nodes(spark, d)
    items = evidence_items(n, e, weighted_cycles(e, n)).withColumn("seq", F.struct("built", "module", "summary"))
    return evidence.ordinals(items, ["change"], spread=True).select("change", "kind", "summary", F.col("weight").cast("int").alias("weight"), F.col("ordinal").cast("int").alias("ordinal"))


_DELTAS = f"""
{_coupling_sql('now', 'edges')},
was AS (SELECT c.* FROM ({_coupling_sql('x', 'base').replace('x AS (', '', 1)[:-1]}) c WHERE id IN (SELECT src FROM base UNION ALL SELECT dst FROM base)),
deltas AS (SELECT n.id AS module, w.fan_out AS out_before, w.instability AS before, n.fan_out AS out_after, n.instability AS after
  FROM now n LEFT JOIN was w USING (id)
  WHERE n.id IN (SELECT src FROM edges WHERE first_seen >= TIMESTAMP '{CHANGED_SINCE}') AND (w.id IS NULL OR (w.fan_in, w.fan_out) <> (n.fan_in, n.fan_out)))"""
_VIOLATIONS = f"""
broken AS (
  SELECT 'deny Brand#1*/** -> Brand#2*/**' AS rule, * FROM edges WHERE regexp_matches(src, '^Brand#1[^/]*/.*$') AND regexp_matches(dst, '^Brand#2[^/]*/.*$')
  UNION ALL SELECT 'deny **/ECONOMY*/** -> **/PROMO*/**', * FROM edges WHERE regexp_matches(src, '^(?:.*/)?ECONOMY[^/]*/.*$') AND regexp_matches(dst, '^(?:.*/)?PROMO[^/]*/.*$')
  UNION ALL SELECT 'deny Brand#3?/**/*1 -> Brand#4?/**', * FROM edges WHERE regexp_matches(src, '^Brand#3[^/]/(?:.*/)?[^/]*1$') AND regexp_matches(dst, '^Brand#4[^/]/.*$')),
violations AS (SELECT rule, src AS from_module, dst AS to_module, specifier, first_seen >= TIMESTAMP '{CHANGED_SINCE}' AS introduced FROM broken)"""

SQL_ITEMS = f"""{_VIOLATIONS}, {_DELTAS}, {CLOSURE.format(name='scc', source='edges')}, {CLOSURE.format(name='old', source='base')},
  ck AS (SELECT component, string_agg(id, '|' ORDER BY id) AS key FROM scc GROUP BY component), co AS (SELECT string_agg(id, '|' ORDER BY id) AS key FROM old GROUP BY component),
  items AS (
    SELECT 1 AS built, 'layer-violation' AS kind, from_module AS module, rule || ' ' || from_module || ' -> ' || to_module AS summary, CASE WHEN introduced THEN 950 ELSE 300 END AS weight FROM violations
    UNION ALL SELECT 0, 'cycle', component, id, CASE WHEN key IN (SELECT key FROM co) THEN 250 ELSE 1000 END FROM scc JOIN ck USING (component)
    UNION ALL SELECT 3, 'instability', module, module || CASE WHEN before IS NULL THEN ' is new with instability ' ELSE ' instability ' || printf('%.2f', floor(before * 100 + 0.5) / 100) || ' -> ' END || printf('%.2f', floor(after * 100 + 0.5) / 100), 200 FROM deltas)"""

QUERIES = {f.__name__: f for f in (b6_impact_text, j6_impact_blast_radius, j6_stats, e1_coupling, e2_first_edges, d5_violations, d6_introduced_edges, d8_instability_deltas, d15_drawn_edges, d16_dependants, e17_sites_by_origin, j3_cycles, j4_base_graph, j5_introduced_cycles, j7_module_walk, b6_shown_sites, b10_hop_columns, c10_evidence, d10_via_names)}

SQL = {
    "e1_coupling": f"WITH {SQL_EDGES}, {_coupling_sql('coupling', 'edges')} SELECT * FROM coupling",
    "e2_first_edges": f"WITH {SQL_EDGES} SELECT src, dst, specifier FROM edges",
    "d6_introduced_edges": f"WITH {SQL_EDGES} SELECT src || ' -> ' || dst AS edge, first_seen >= TIMESTAMP '{CHANGED_SINCE}' AS introduced FROM edges",
    "d5_violations": f"WITH {SQL_EDGES}, {_VIOLATIONS} SELECT * FROM violations",
    "d8_instability_deltas": f"WITH {SQL_EDGES}, {_DELTAS} SELECT * FROM deltas",
    "j4_base_graph": f"""WITH {SQL_EDGES} SELECT CASE WHEN src IN (SELECT src FROM edges WHERE first_seen >= TIMESTAMP '{CHANGED_SINCE}') AND CAST(split_part(src, '/', 3) AS BIGINT) % 5 = 0 THEN src || '.old' ELSE src END AS src,
        dst, specifier FROM base""",
    "j3_cycles": f"WITH RECURSIVE {SQL_EDGES}, {CLOSURE.format(name='scc', source='edges')} SELECT id, component FROM scc",
    "j5_introduced_cycles": f"""WITH RECURSIVE {SQL_EDGES}, {CLOSURE.format(name='scc', source='edges')}, {CLOSURE.format(name='old', source='base')},
        k AS (SELECT component, string_agg(id, '|' ORDER BY id) AS key, count(*) AS n FROM scc GROUP BY component), o AS (SELECT string_agg(id, '|' ORDER BY id) AS key FROM old GROUP BY component)
        SELECT component, n, key NOT IN (SELECT key FROM o) AS introduced FROM k""",
    "d16_dependants": f"WITH {SQL_EDGES} SELECT dst AS module, src AS dependant, row_number() OVER (PARTITION BY dst ORDER BY ord, src) AS place FROM edges",
    "j6_impact_blast_radius": _WITH_SITES + """, w AS (SELECT split_part(origin, '/', 1) AS change, *, CAST(greatest(1, 800 - 100 * hops + least(module_fan_in, 50)) AS BIGINT) AS weight FROM sites),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY change ORDER BY weight DESC, hops, module_fan_in DESC, path) AS INTEGER) AS ordinal FROM w)
        SELECT change, symbol_id, hops, origin, via, module_fan_in, weight, ordinal, 'E' || ordinal AS evidence_id FROM r""",
    "j6_stats": _WITH_SITES + " SELECT count(*) AS sites, count(DISTINCT origin) AS origins, CAST(max(hops) AS INTEGER) AS farthest, CAST(sum(module_fan_in) AS BIGINT) AS fan_in FROM sites",
    "e17_sites_by_origin": _WITH_SITES + " SELECT origin, hops, count(*) AS n, min(symbol_id) AS first, max(symbol_id) AS last FROM sites GROUP BY origin, hops",
    "b6_shown_sites": _WITH_SITES + """ SELECT origin, symbol_id, hops, CAST(r AS INTEGER) AS r, CAST(greatest(n - 8, 0) AS BIGINT) AS more FROM (
        SELECT *, row_number() OVER (PARTITION BY origin ORDER BY hops, symbol_id) AS r, count(*) OVER (PARTITION BY origin) AS n FROM sites) WHERE r <= 8""",
    "b10_hop_columns": _WITH_SITES + """ SELECT hops, symbol_id, CAST(r AS INTEGER) AS r, CAST(greatest(n - 10, 0) AS BIGINT) AS overflow FROM (
        SELECT *, row_number() OVER (PARTITION BY hops ORDER BY module_fan_in DESC, symbol_id) AS r, count(*) OVER (PARTITION BY hops) AS n FROM sites) WHERE r <= 10""",
    "d15_drawn_edges": _WITH_SITES + """, drawn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY hops ORDER BY module_fan_in DESC, symbol_id) AS r FROM sites) WHERE r <= 10)
        SELECT via AS from_id, symbol_id AS to_id FROM drawn WHERE via IN (SELECT symbol_id FROM drawn)""",
    "d10_via_names": _WITH_SITES + " SELECT symbol_id, via, coalesce(p_name, via) AS via_name FROM sites LEFT JOIN (SELECT p_brand || '/' || p_type || '/' || p_partkey AS id, min(p_name) AS p_name FROM part GROUP BY 1) n ON n.id = via",
    "j7_module_walk": f"""WITH {SQL_EDGES}, l0 AS (SELECT dst AS id, dst AS origin, [CAST(1 AS BIGINT)] AS path FROM edges GROUP BY dst ORDER BY count(*) DESC, dst LIMIT 1),"""
    + ",".join(_LEVEL.format(k=k, j=k - 1, seen=" UNION ALL ".join(f"SELECT id FROM l{i}" for i in range(k))) for k in (1, 2, 3))
    + " SELECT id AS symbol_id, CAST(hops AS INTEGER) AS hops, via FROM (SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3) ORDER BY hops, path LIMIT 25",
    "c10_evidence": f"""WITH RECURSIVE {SQL_EDGES}, {SQL_ITEMS}
        SELECT split_part(module, '/', 1) AS change, kind, summary, weight, CAST(row_number() OVER (PARTITION BY split_part(module, '/', 1) ORDER BY weight DESC, built, module, summary) AS INTEGER) AS ordinal FROM items""",
    "b6_impact_text": _WITH_SITES + """, r AS (SELECT *, row_number() OVER (PARTITION BY origin ORDER BY hops, symbol_id) AS r, count(*) OVER (PARTITION BY origin) AS n FROM sites),
        t AS (SELECT origin, string_agg(CASE WHEN hops = 1 THEN '1 hop' ELSE hops || ' hops' END || '  ' || symbol_id, chr(10) ORDER BY r) FILTER (r <= 8) AS shown, any_value(n) AS n FROM r GROUP BY origin)
        SELECT origin, shown || CASE WHEN n > 8 THEN chr(10) || 'and ' || (n - 8) || ' more' ELSE '' END AS text FROM t""",
}
