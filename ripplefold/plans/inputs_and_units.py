"""Queries over files, imports, diffs, payloads, code units and their similarity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplefold.durable import cut
from ripplefold.functions import code, sequential, text
from ripplefold.operators import intervals, similarity
from ripplefold.sources import diffs, inputs, modules
from ripplefold.sources.tables import table, unique


def _units(spark, d, *columns):
    return unique(spark, d, "function_units", *columns)


# Files and imports


def _sources(spark, d):
    """(repo, path, content) of source files by plain path; a path stored in several spellings is read once."""
    files = unique(spark, d, "source_files", "repo", "file", "head")
    plain = text.plain_slashes(F.col("file"))
    return files.where(F.col("head").isNotNull()).groupBy("repo", plain.alias("path")).agg(F.min("head").alias("content"))


def a2_file_at_ref(spark, d):
    """Every unit's file with the bytes of the snapshot, null where the snapshot has no such file."""
    asked = table(spark, d, "function_units").select("repo", "file").distinct()
    snapshot = unique(spark, d, "source_files", "repo", "file", "n_bytes").groupBy("repo", "file").agg(F.max("n_bytes").alias("content"))
    return modules.at_revision(asked, snapshot, ["repo", "file"]).select("repo", "file", F.col("content").alias("n_bytes"))


def a10_project_files(spark, d):
    return modules.project_files(table(spark, d, "source_files").select(text.plain_slashes(F.col("file")).alias("path")).distinct())


def _imports(spark, d):
    return modules.imports(_sources(spark, d).withColumn("path", F.concat_ws("\t", "repo", "path"))).select(F.substring_index("path", "\t", 1).alias("repo"), F.substring_index("path", "\t", -1).alias("path"), "ord", "specifier")


def a11_imports(spark, d):
    return _imports(spark, d).select("repo", "path", F.col("ord").cast("int").alias("ord"), "specifier", text.is_external(F.col("specifier")).alias("external"))


def a23_candidates(spark, d):
    """Ordered candidate paths of each relative import."""
    rows = _imports(spark, d).where(~text.is_external(F.col("specifier")))
    tried = rows.select("repo", "path", "specifier", modules.candidates(F.col("path"), F.col("specifier")).alias("c"))
    return tried.select("repo", "path", "specifier", F.element_at("c", 1).alias("as_written"), F.element_at("c", 2).alias("with_ts"), F.element_at("c", -8).alias("index_ts")).distinct()


def _resolved(spark, d):
    known = _sources(spark, d).select("repo", "path")
    return modules.resolved(_imports(spark, d), known, ["repo"]), known


def d1_resolved_imports(spark, d):
    found, _ = _resolved(spark, d)
    return found.select("repo", "path", "specifier", "target").distinct()


def j1_module_graph(spark, d):
    """Every module with its externals and the number of modules it depends on."""
    found, known = _resolved(spark, d)
    nodes, edges = modules.module_graph(found, known, ["repo"])
    out = edges.groupBy("repo", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(out, ["repo", "path"], "left").select("repo", "path", "external_imports", F.coalesce("n", F.lit(0)).alias("n"))


# Diffs: one per unit, made from its columns and parsed back


def _diffs(spark, d):
    """A diff per unit: it adds the unit's lines to a file, after one context line and one removed line."""
    u = _units(spark, d, "unit_no", "file", "line", "end_line").withColumn("path", text.plain_slashes(F.col("file"))).where("line is not null")
    n = F.greatest(F.coalesce("end_line", "line") - F.col("line") + 1, F.lit(1))
    body = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("+added "), i.cast("string"))), "\n")
    new = F.col("unit_no") % 3 == 0
    head = F.concat(F.lit("diff --git a/"), "path", F.lit(" b/"), "path", F.lit("\n"), F.when(new, "new file mode 100644\n").otherwise("index 1..2 100644\n"))
    hunk = F.concat(F.lit("@@ -"), F.col("line").cast("string"), F.lit(",2 +"), F.col("line").cast("string"), F.lit(","), (n + 1).cast("string"), F.lit(" @@\n context\n-removed\n"), body, F.lit("\n"))
    return u.select(F.col("unit_no").cast("string").alias("diff_id"), F.concat(F.lit("noise\n"), head, hunk).alias("raw"))


def a5_changed_files(spark, d):
    """Path, status and hunk shape of every file of every diff."""
    files = diffs.changed_files(_diffs(spark, d))
    h = F.col("hunks")[0]
    return files.select("diff_id", "path", "previous_path", "status", F.size("hunks").alias("hunks"), h["old_start"].alias("old_start"), h["new_lines"].alias("new_lines"), h["changed_new_lines"].alias("changed"))


def a8_split_diffs(spark, d):
    return diffs.split_by_file(_diffs(spark, d)).select("diff_id", F.length("text").alias("n"), F.substring_index("text", "\n", 1).alias("first"))


# Rules and payloads


RULE_TEXT = "# layers\ndeny src/** -> libs/**\n\ndeny apps/*/src/** -> src/modules/**\n"


def a13_rules(spark, d):
    return inputs.rule_lines(spark.createDataFrame([(RULE_TEXT,)], "text string"))


def a14_payloads(spark, d):
    """Deliveries made from jobs as payloads and read back; numbers in quotes and other actions drop out."""
    j = unique(spark, d, "review_jobs", "id", "owner", "repo", "pull_number", "head_sha", "base_ref", "clone_url", "state")
    number = F.when(F.col("state") == "failed", F.col("pull_number").cast("string"))
    body = F.to_json(
        F.struct(
            F.when(F.col("state") == "superseded", "closed").otherwise("synchronize").alias("action"),
            F.struct(F.struct(F.col("head_sha").alias("sha")).alias("head"), F.struct(F.col("base_ref").alias("ref")).alias("base")).alias("pull_request"),
            F.struct(F.struct(F.col("owner").alias("login")).alias("owner"), F.col("repo").alias("name"), "clone_url").alias("repository"),
            F.when(number.isNull(), F.col("pull_number")).alias("number"),
        )
    )
    quoted = F.when(number.isNotNull(), F.regexp_replace(body, r"\}$", F.concat(F.lit(',"number":"'), number, F.lit('"}')))).otherwise(body)
    return inputs.pull_requests(j.select("id", F.lit("pull_request").alias("event"), quoted.alias("body")))


def i26_event_props(spark, d):
    """A nested value picked from JSON text, null where it is missing or text."""
    e = table(spark, d, "events").select("event_id", "props")
    return e.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))


def i15_parsed_answers(spark, d):
    """Findings wrapped as a model's answer and parsed back: kept fields of accepted answers, the problem of others."""
    f = unique(spark, d, "findings", "id", "severity", "category", "file", "line", "summary", "rationale", "evidence_refs")
    one = F.to_json(F.struct("severity", "category", "file", "line", "summary", F.coalesce("rationale", F.lit("")).alias("rationale"), F.col("evidence_refs").alias("evidenceRefs")))
    answer = F.concat(F.lit("Here it is: {not json}\n```json\n{\"findings\":["), one, F.lit("]}\n```\nDone."))
    parsed = sequential.parsed_findings(answer)
    return f.select("id", parsed.alias("p")).select("id", F.col("p.findings")[0]["summary"].alias("summary"), F.col("p.problem").isNull().alias("accepted"))


# Ranges


def d2_enclosing_units(spark, d):
    """Start lines of fingerprints placed in the innermost unit of the same repository and file."""
    key = F.concat_ws("\t", "repo", text.plain_slashes(F.col("file")))
    points = unique(spark, d, "function_fingerprints", "fp_id", "repo", "file", "start_line").select("fp_id", key.alias("file"), F.col("start_line").alias("line")).where("line is not null")
    spans = _units(spark, d, "unit_no", "repo", "file", "line", "end_line").where("line is not null").select(key.alias("file"), F.col("line").alias("start"), F.coalesce("end_line", "line").alias("end"), F.col("unit_no").cast("string").alias("decl"))
    return intervals.enclosing(points, spans).select("fp_id", "decl")


def d3_touched_units(spark, d):
    """Units in which a finding of the same file lies."""
    lines = table(spark, d, "findings").where("line > 0").select(text.plain_slashes(F.col("file")).alias("file"), F.col("line").alias("changed")).distinct()
    units = _units(spark, d, "unit_no", "file", "line", "end_line").withColumn("file", text.plain_slashes(F.col("file"))).where("line is not null")
    return intervals.touched(units, lines).select("unit_no")


def e5_first_symbols(spark, d):
    """Symbols at their first changed line, from all lines of added and the changed lines of other files; of several units
    of one id the first counts."""
    u = _units(spark, d, "unit_no", "id", "line", "end_line").where("line is not null and end_line is not null and end_line >= line")
    u = u.groupBy("id").agg(F.min(F.struct("unit_no", "line", "end_line")).alias("u")).select("id", "u.*")
    status = F.when(F.col("unit_no") % 3 == 0, "added").when(F.col("unit_no") % 3 == 1, "deleted").otherwise("modified")
    files = u.select(F.col("id").alias("file"), status.alias("status"), (F.col("end_line") - F.col("line") + 1).alias("n_lines"), F.when(status == "modified", F.array("line", "end_line")).alias("changed"))
    located = intervals.attributed_lines(files).join(files.select("file", "status"), "file").withColumn("symbol_id", F.col("file"))
    return intervals.first_symbols(located).select("symbol_id", F.col("line").cast("int").alias("line"), "change_kind")


def j8_changed_symbols(spark, d):
    """Symbols that the findings' lines change, each at its first line; source files that the units do not know are unparsed."""
    f = table(spark, d, "findings").where("file is not null").select(text.plain_slashes(F.col("file")).alias("file"), "line")
    files = f.groupBy("file").agg(F.array_sort(F.collect_set(F.when(F.col("line") > 0, F.col("line")))).alias("changed")).withColumn("status", F.lit("modified"))
    units = _units(spark, d, "id", "file", "line", "end_line").where("line is not null").select(text.plain_slashes(F.col("file")).alias("file"), F.col("line").alias("start"), F.coalesce("end_line", "line").alias("end"), F.col("id").alias("decl"))
    return intervals.changed_symbols(files, units).select("symbol_id", "file", F.col("line").cast("int").alias("line"), "change_kind")


# Similarity


def _long_units(spark, d):
    return _units(spark, d, "unit_no", "tokens").where(F.size("tokens") >= similarity.LEAST_TOKENS).select(F.col("unit_no").alias("unit"), "tokens")


def a12_units(spark, d):
    return _units(spark, d, "unit_no", "tokens").where(F.size("tokens") >= similarity.LEAST_TOKENS).select("unit_no", F.size("tokens").alias("n"))


def a12_extracted(spark, d):
    """Functions with a body found in source heads, with the lines and levelled tokens of each."""
    rows = _sources(spark, d).select("repo", "path", F.explode(code.function_units(F.col("content"), 1)).alias("u"))
    return rows.select("repo", "path", "u.name", "u.kind", "u.line", "u.end_line", F.size("u.tokens").alias("n"))


def h1_normal_tokens(spark, d):
    """Levelled tokens of source heads, counted by kind."""
    rows = _sources(spark, d).select("repo", "path", F.explode(code.normal_tokens(F.col("content"))).alias("t"))
    return rows.groupBy("repo", "path").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("t") == "ID", 1)).alias("names"), F.count(F.when(F.startswith("t", F.lit("N:")), 1)).alias("kept"))


def h3_fingerprints(spark, d):
    return similarity.fingerprints(_long_units(spark, d)).select("unit", F.col("bucket").cast("int").alias("bucket"), F.col("w").cast("long").alias("w"))


def h4_norms(spark, d):
    return similarity.norms(similarity.fingerprints(_long_units(spark, d)))


def _rated(spark, d):
    units = table(spark, d, "function_units").where(F.size("tokens") >= similarity.LEAST_TOKENS).select(F.col("unit_no").alias("unit"), "tokens")
    return cut(similarity.rated(units)).df


def h6_similar_units(spark, d):
    """The three most similar units of each, as integers up to the rounded similarity."""
    hits = similarity.hits_per_unit(_rated(spark, d))
    return hits.select("unit", "other", F.col("r").cast("int").alias("r"), F.floor(F.col("similarity") * 100 + 0.5).cast("long").alias("hundredths"))


def f5_pairs(spark, d):
    """Each unordered pair of hits once, in the direction met first."""
    return similarity.first_direction(similarity.hits_per_unit(_rated(spark, d))).select("unit", "other", F.col("r").cast("int").alias("r"))


def _scoped(spark, d):
    where = _units(spark, d, "unit_no", "repo", "file", "line", "end_line").groupBy("unit_no").agg(F.first("repo").alias("repo"), F.first("file").alias("file"), F.first("line").alias("line"), F.first("end_line").alias("end_line"))
    a, b = where.toDF("a", "ra", "fa", "la", "ea"), where.toDF("b", "rb", "fb", "lb", "eb")
    placed = _rated(spark, d).join(a, "a").join(b, "b")
    apart = ~F.coalesce(similarity.overlapping((F.col("ra") == F.col("rb")) & (F.col("fa") == F.col("fb")), F.col("la"), F.col("ea"), F.col("lb"), F.col("eb")), F.lit(False))
    return placed.where(apart).withColumn("local", F.col("ra") == F.col("rb"))


def d14_other_repositories(spark, d):
    """The three most similar units of other repositories, of each unit."""
    return similarity.hits_per_unit(_scoped(spark, d).where("not local")).select("unit", "other", F.col("r").cast("int").alias("r"))


def ranked_matches(spark, d):
    """The ten most important local and other-repository hits of the units in which a finding lies, with their similarity."""
    touched = cut(d3_touched_units(spark, d).select(F.col("unit_no").alias("unit")).distinct()).df
    scoped = cut(_scoped(spark, d).select("a", "b", "similarity", "local")).df
    local = similarity.first_direction(similarity.hits_per_unit(scoped.where("local")).join(touched, "unit", "left_semi")).withColumn("scope", F.lit("this-repository"))
    other = similarity.hits_per_unit(scoped.where("not local")).join(touched, "unit", "left_semi").withColumn("scope", F.lit("other-repository"))
    fan = unique(spark, d, "stored_matches", "match_id", "match_no").where("match_no is not null").groupBy(F.col("match_no").alias("id")).agg(F.count(F.lit(1)).alias("fan_in"))
    return similarity.ranked(local.unionByName(other), fan)


def g2_ranked_matches(spark, d):
    """The ten most important local and other-repository hits of touched units; a unit's fan-in is its number of stored matches."""
    return ranked_matches(spark, d).select("unit", "other", "scope", "importance")


QUERIES = {
    f.__name__: f
    for f in (
        a2_file_at_ref, a5_changed_files, a8_split_diffs, a10_project_files, a11_imports, a12_units, a13_rules, a14_payloads, a23_candidates, d1_resolved_imports, j1_module_graph,
        d2_enclosing_units, d3_touched_units, e5_first_symbols, j8_changed_symbols, a12_extracted, i15_parsed_answers, i26_event_props, h1_normal_tokens, h3_fingerprints, h4_norms, h6_similar_units, f5_pairs,
        d14_other_repositories, g2_ranked_matches,
    )
}

_PLAIN = "regexp_replace(replace(file, chr(92), '/'), '^\\./', '')"
_U = "u AS (SELECT DISTINCT * FROM function_units)"
_SRC = f"src AS (SELECT repo, {_PLAIN} AS path, min(head) AS content FROM source_files WHERE head IS NOT NULL GROUP BY 1, 2)"
_RE = "(?m)^\\s*(?:import|export)\\s+(?:type\\s+)?(?:[^''\";]*?\\sfrom\\s+)?[''\"]([^''\"]+)[''\"]"
_RE_DYNAMIC = "\\bimport\\(\\s*[''\"]([^''\"]+)[''\"]\\s*\\)"
_IMP = f"""{_SRC}, lst AS (SELECT repo, path, list_concat(regexp_extract_all(content, '{_RE}', 1), regexp_extract_all(content, '{_RE_DYNAMIC}', 1)) AS l FROM src),
  imp AS (SELECT repo, path, CAST(i - 1 AS INTEGER) AS ord, l[i] AS specifier FROM lst, unnest(range(1, len(l) + 1)) AS r(i))"""
# The heads import only './x' and '../x/y', so a parent step is one cut of the folder.
_JOIN = """CASE WHEN starts_with(specifier, '../') THEN ltrim(regexp_replace(regexp_replace(path, '/?[^/]*$', ''), '/?[^/]*$', '') || '/' || substr(specifier, 4), '/')
  ELSE ltrim(regexp_replace(path, '/?[^/]*$', '') || '/' || substr(specifier, 3), '/') END"""
_ENDS = "['', '.ts', '.tsx', '.mts', '.cts', '.js', '.jsx', '.mjs', '.cjs', '/index.ts', '/index.tsx', '/index.mts', '/index.cts', '/index.js', '/index.jsx', '/index.mjs', '/index.cjs']"
_RES = f"""{_IMP}, b AS (SELECT *, {_JOIN} AS base FROM imp WHERE starts_with(specifier, '.')),
  t AS (SELECT b.repo, b.path, ord, specifier, arg_min(s.path, i) AS target FROM (SELECT b.*, i, base || ({_ENDS})[i] AS want FROM b, unnest(range(1, 18)) AS x(i)) b JOIN src s ON s.repo = b.repo AND s.path = want GROUP BY 1, 2, 3, 4),
  res AS (SELECT imp.*, target FROM imp LEFT JOIN t USING (repo, path, ord, specifier))"""
_D = f"""{_U}, dd AS (SELECT unit_no, {_PLAIN} AS path, line, greatest(coalesce(end_line, line) - line + 1, 1) AS n FROM u WHERE line IS NOT NULL)"""
_LONG = f"""{_U}, lu AS (SELECT unit_no AS unit, any_value(tokens) AS t FROM u WHERE len(tokens) >= 40 GROUP BY 1),
  gr AS (SELECT unit, array_to_string(t[i:i + 4], ' ') AS g FROM lu, unnest(range(1, len(t) - 3)) AS r(i)),
  fp AS (SELECT unit, CAST(CAST('0x' || substr(sha1(g), 1, 8) AS BIGINT) % 256 AS INTEGER) AS bucket, CAST(sum(CASE WHEN CAST('0x' || substr(sha1(g), 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS w
    FROM gr GROUP BY 1, 2 HAVING sum(CASE WHEN CAST('0x' || substr(sha1(g), 9, 2) AS BIGINT) % 2 = 1 THEN 1 ELSE -1 END) <> 0),
  ss AS (SELECT unit, CAST(sum(w * w) AS BIGINT) AS ss FROM fp GROUP BY 1)"""
_HITS = f"""{_LONG}, dot AS (SELECT a.unit, b.unit AS other, CAST(sum(a.w * b.w) AS BIGINT) AS d FROM fp a JOIN fp b ON a.bucket = b.bucket AND a.unit <> b.unit GROUP BY 1, 2),
  sim AS (SELECT dot.unit, other, d / sqrt(CAST(x.ss * y.ss AS DOUBLE)) AS s FROM dot JOIN ss x ON x.unit = dot.unit JOIN ss y ON y.unit = other),
  wh AS (SELECT unit_no, any_value(repo) AS repo, any_value(file) AS file, any_value(line) AS line, any_value(end_line) AS end_line FROM u GROUP BY 1),
  near AS (SELECT sim.*, x.repo = y.repo AS loc, coalesce(x.repo = y.repo AND x.file = y.file AND x.line <= coalesce(y.end_line, y.line) AND y.line <= coalesce(x.end_line, x.line), false) AS ov
    FROM sim JOIN wh x ON x.unit_no = sim.unit JOIN wh y ON y.unit_no = other WHERE s >= 0.85)"""


def _top(source: str, where: str, name: str) -> str:
    return f"{name} AS (SELECT unit, other, s, r FROM (SELECT *, CAST(row_number() OVER (PARTITION BY unit ORDER BY s DESC, other) AS INTEGER) AS r FROM {source} WHERE {where}) WHERE r <= 3)"


_ONCE = "SELECT unit, other, s, r FROM (SELECT *, row_number() OVER (PARTITION BY least(unit, other), greatest(unit, other) ORDER BY unit, r) AS k FROM {0}) WHERE k = 1"

_TOUCHED = f"""fl AS (SELECT DISTINCT {_PLAIN} AS file, line FROM findings WHERE line > 0),
  touched AS (SELECT DISTINCT unit_no FROM (SELECT *, {_PLAIN} AS pf FROM u WHERE line IS NOT NULL) x WHERE EXISTS (SELECT 1 FROM fl WHERE fl.file = x.pf AND fl.line BETWEEN x.line AND coalesce(x.end_line, x.line)))"""

SQL_RANKED = f"""{_HITS}, {_top('near', 'loc AND NOT ov', 'h')}, {_top('near', 'NOT loc AND NOT ov', 'o')}, fan AS (SELECT match_no AS id, count(DISTINCT match_id) AS n FROM stored_matches WHERE match_no IS NOT NULL GROUP BY 1),
  {_TOUCHED}, ht AS (SELECT * FROM h WHERE unit IN (SELECT unit_no FROM touched)),
  both_hits AS (SELECT *, 'this-repository' AS scope FROM ({_ONCE.format('ht')}) UNION ALL SELECT *, 'other-repository' FROM o WHERE unit IN (SELECT unit_no FROM touched)),
  ranked_hits AS (SELECT unit, other, s, scope, CASE WHEN scope = 'this-repository' THEN greatest(coalesce(x.n, 0), coalesce(y.n, 0)) ELSE coalesce(x.n, 0) END AS importance
    FROM both_hits LEFT JOIN fan x ON x.id = unit LEFT JOIN fan y ON y.id = other ORDER BY importance DESC, floor(s * 100 + 0.5) DESC, unit, r LIMIT 10)"""

SQL = {
    "e5_first_symbols": f"""WITH {_U}, v AS (SELECT id, min((unit_no, line, end_line)) AS s FROM u WHERE end_line >= line GROUP BY id)
        SELECT id AS symbol_id, CASE WHEN s[1] % 3 = 0 THEN 1 ELSE s[2] END AS line, CASE WHEN s[1] % 3 = 0 THEN 'added' ELSE 'modified' END AS change_kind FROM v WHERE s[1] % 3 <> 1""",
    "j8_changed_symbols": f"""WITH {_U}, x AS (SELECT {_PLAIN} AS file, line FROM findings WHERE file IS NOT NULL),
        src AS (SELECT DISTINCT file FROM x WHERE regexp_matches(file, '[.](ts|tsx|mts|cts|js|jsx|mjs|cjs)$') AND NOT suffix(file, '.d.ts')),
        r AS (SELECT {_PLAIN} AS file, line AS a, coalesce(end_line, line) AS b, id FROM u WHERE line IS NOT NULL),
        known AS (SELECT file, max(b) AS n FROM r GROUP BY file),
        p AS (SELECT DISTINCT file, line FROM x WHERE line > 0 AND file IN (SELECT file FROM src) AND file IN (SELECT file FROM known)
          UNION SELECT file, i FROM known, unnest(range(1, n + 1)) AS t(i) WHERE file IN (SELECT file FROM src) AND file NOT IN (SELECT file FROM x WHERE line > 0)),
        l AS (SELECT p.file, p.line, coalesce(arg_min(id, (-a, b, id)) FILTER (id IS NOT NULL), p.file || '#<module>') AS symbol_id FROM p LEFT JOIN r ON r.file = p.file AND p.line BETWEEN a AND b GROUP BY 1, 2)
        SELECT symbol_id, any_value(file) AS file, CAST(min(line) AS INTEGER) AS line, 'modified' AS change_kind FROM l GROUP BY symbol_id
        UNION ALL SELECT NULL, file, NULL, 'unparsed' FROM src WHERE file NOT IN (SELECT file FROM known)""",
    "a2_file_at_ref": "SELECT repo, file, n_bytes FROM (SELECT DISTINCT repo, file FROM function_units) LEFT JOIN (SELECT repo, file, max(n_bytes) AS n_bytes FROM source_files GROUP BY 1, 2) USING (repo, file)",
    "a5_changed_files": f"""WITH {_D} SELECT CAST(unit_no AS VARCHAR) AS diff_id, path, CAST(NULL AS VARCHAR) AS previous_path, CASE WHEN unit_no % 3 = 0 THEN 'added' ELSE 'modified' END AS status, 1 AS hunks, line AS old_start, CAST(n + 1 AS INTEGER) AS new_lines,
        [CAST(x AS INTEGER) FOR x IN range(line + 1, line + n + 1)] AS changed FROM dd""",
    "a8_split_diffs": f"""WITH {_D} SELECT CAST(unit_no AS VARCHAR) AS diff_id, 'diff --git a/' || path || ' b/' || path AS first,
        CAST(length('diff --git a/' || path || ' b/' || path) + 1 + length(CASE WHEN unit_no % 3 = 0 THEN 'new file mode 100644' ELSE 'index 1..2 100644' END) + 1 + length('@@ -' || line || ',2 +' || line || ',' || (n + 1) || ' @@') + 1 + length(' context') + 1 + length('-removed') + 1
        + list_sum([length('+added ' || i) + 1 FOR i IN range(1, n + 1)]) AS INTEGER) AS n FROM dd""",
    "a10_project_files": f"""SELECT path FROM (SELECT DISTINCT {_PLAIN} AS path FROM source_files) WHERE NOT suffix(path, '.d.ts') AND NOT starts_with(path, '..') AND path <> '' AND regexp_matches(path, '(\\.ts|\\.tsx|\\.mts|\\.cts|\\.js|\\.jsx|\\.mjs|\\.cjs)$')
        AND NOT regexp_matches(path, '(^|/)(node_modules|dist|build|out|coverage|\\.git|\\.next|\\.turbo|vendor|tmp)/')""",
    "a11_imports": f"WITH {_IMP} SELECT repo, path, ord, specifier, NOT starts_with(specifier, '.') AS external FROM imp",
    "a12_units": f"WITH {_U} SELECT DISTINCT unit_no, CAST(len(tokens) AS INTEGER) AS n FROM u WHERE len(tokens) >= 40",
    "a13_rules": "SELECT * FROM (VALUES (2, 'deny src/** -> libs/**', 'src/**', 'libs/**'), (4, 'deny apps/*/src/** -> src/modules/**', 'apps/*/src/**', 'src/modules/**')) AS t(line, rule, from_glob, to_glob)",
    "a14_payloads": """SELECT DISTINCT id, 'synchronize' AS action, CAST(pull_number AS BIGINT) AS pull_number, head_sha, base_ref, owner, repo, clone_url FROM review_jobs
        WHERE state NOT IN ('superseded', 'failed') AND pull_number IS NOT NULL AND head_sha IS NOT NULL AND base_ref IS NOT NULL AND owner IS NOT NULL AND repo IS NOT NULL AND clone_url IS NOT NULL""",
    "a23_candidates": f"WITH {_IMP} SELECT DISTINCT repo, path, specifier, {_JOIN} AS as_written, {_JOIN} || '.ts' AS with_ts, {_JOIN} || '/index.ts' AS index_ts FROM imp WHERE starts_with(specifier, '.')",
    "d1_resolved_imports": f"WITH {_RES} SELECT DISTINCT repo, path, specifier, target FROM res",
    "j1_module_graph": f"""WITH {_RES} SELECT s.repo, s.path, coalesce((SELECT list_sort(list(DISTINCT specifier)) FROM res WHERE res.repo = s.repo AND res.path = s.path AND NOT starts_with(specifier, '.')), []) AS external_imports,
        (SELECT count(DISTINCT target) FROM res WHERE res.repo = s.repo AND res.path = s.path) AS n FROM src s""",
    "d2_enclosing_units": f"""WITH {_U}, p AS (SELECT DISTINCT fp_id, repo, {_PLAIN} AS file, start_line FROM function_fingerprints WHERE start_line IS NOT NULL), s AS (SELECT unit_no, repo, {_PLAIN} AS file, line, coalesce(end_line, line) AS e FROM u WHERE line IS NOT NULL)
        SELECT fp_id, coalesce(arg_min(CAST(unit_no AS VARCHAR), (-line, e, CAST(unit_no AS VARCHAR))) FILTER (unit_no IS NOT NULL), '<module>') AS decl
        FROM p LEFT JOIN s ON p.repo = s.repo AND p.file = s.file AND start_line BETWEEN line AND e GROUP BY fp_id, p.repo, p.file, start_line""",
    "d3_touched_units": f"""WITH {_U}, f AS (SELECT DISTINCT {_PLAIN} AS file, line FROM findings WHERE line > 0) SELECT DISTINCT unit_no FROM (SELECT *, {_PLAIN} AS pf FROM u WHERE line IS NOT NULL) x
        WHERE EXISTS (SELECT 1 FROM f WHERE f.file = x.pf AND f.line BETWEEN x.line AND coalesce(x.end_line, x.line))""",
    "i26_event_props": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "i15_parsed_answers": """SELECT DISTINCT id, CASE WHEN ok THEN summary END AS summary, ok AS accepted FROM (SELECT *, coalesce(severity IN ('critical', 'high', 'medium', 'low', 'info')
        AND category IN ('correctness', 'cross-module-regression', 'circular-dependency', 'architecture', 'duplicate-logic', 'security', 'performance', 'maintainability') AND file <> '' AND line >= 0 AND length(summary) BETWEEN 1 AND 200, false) AS ok FROM findings)""",
    "h3_fingerprints": f"WITH {_LONG} SELECT unit, bucket, w FROM fp",
    "h4_norms": f"WITH {_LONG} SELECT * FROM ss",
    "h6_similar_units": f"WITH {_HITS}, {_top('near', 'true', 'h')} SELECT unit, other, r, CAST(floor(s * 100 + 0.5) AS BIGINT) AS hundredths FROM h",
    "f5_pairs": f"WITH {_HITS}, {_top('near', 'true', 'h')} SELECT unit, other, r FROM ({_ONCE.format('h')})",
    "d14_other_repositories": f"WITH {_HITS}, {_top('near', 'NOT loc AND NOT ov', 'h')} SELECT unit, other, r FROM h",
    "g2_ranked_matches": f"WITH {SQL_RANKED} SELECT unit, other, scope, importance FROM ranked_hits",
}
