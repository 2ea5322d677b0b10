"""SQL that states the results of those queries that SQL can express."""

P2 = """
WITH RECURSIVE ends AS (
  SELECT unit_no AS v FROM stored_matches WHERE unit_no IS NOT NULL
  UNION SELECT match_no FROM stored_matches WHERE match_no IS NOT NULL
), links AS (
  SELECT DISTINCT unit_no AS a, match_no AS b FROM stored_matches
  WHERE unit_no IS NOT NULL AND match_no IS NOT NULL AND similarity IS NOT NULL AND NOT isnan(similarity) AND similarity >= 0.85
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
  SELECT v, v AS u FROM ends
  UNION SELECT r.v, e.b FROM reach r JOIN both_ways e ON r.u = e.a
)
SELECT v AS unit_no, min(u) AS group_no FROM reach GROUP BY v
"""

_MEASURES = """
uniq AS (SELECT DISTINCT id, model, graph_grounded, llm_latency_ms, prompt_tokens FROM runs
         WHERE model IS NOT NULL AND graph_grounded IS NOT NULL),
measured AS (
  SELECT id AS run_id, model, graph_grounded, 'llm_latency_ms' AS measure, llm_latency_ms AS x FROM uniq WHERE llm_latency_ms > 0
  UNION ALL
  SELECT id, model, graph_grounded, 'prompt_tokens', prompt_tokens FROM uniq WHERE prompt_tokens > 0)
"""

P3_FOUND = f"""
WITH {_MEASURES}, limits AS (
  SELECT model, graph_grounded, measure, quantile_cont(x::DOUBLE, 0.95) AS hi, quantile_cont(x::DOUBLE, 0.05) AS lo
  FROM measured GROUP BY ALL)
SELECT run_id, measure FROM measured JOIN limits USING (model, graph_grounded, measure)
WHERE (measure = 'llm_latency_ms' AND x > 2 * hi) OR (measure = 'prompt_tokens' AND 4 * x < lo)
"""

P3_EXACT = f"""
WITH {_MEASURES}
SELECT model, graph_grounded, measure, q, CAST(floor(quantile_cont * 100 + 0.5) AS BIGINT) AS hundredths FROM (
  SELECT model, graph_grounded, measure, CAST(0.5 AS DOUBLE) AS q, quantile_cont(x::DOUBLE, 0.5) AS quantile_cont FROM measured GROUP BY ALL
  UNION ALL
  SELECT model, graph_grounded, measure, CAST(0.95 AS DOUBLE), quantile_cont(x::DOUBLE, 0.95) FROM measured GROUP BY model, graph_grounded, measure)
"""

# The bucket of the exact value: a quantile of the sketch is right where it names the bucket of the value at its rank.
_GAMMA = "(1.01 / 0.99)"
P3_PERCENTILES = f"""
WITH {_MEASURES}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY model, graph_grounded, measure ORDER BY x) - 1 AS place, count(*) OVER (PARTITION BY model, graph_grounded, measure) AS total FROM measured),
asked AS (SELECT unnest([0.05::DOUBLE, 0.5, 0.9, 0.95, 0.99]) AS q),
hit AS (SELECT model, graph_grounded, measure, q, total, CAST(ceil(ln(x::DOUBLE) / ln({_GAMMA}::DOUBLE)) AS INTEGER) AS bucket FROM placed JOIN asked ON place = floor(q * (total - 1)))
SELECT model, graph_grounded, measure, q, bucket, CAST(floor(2000 * pow({_GAMMA}::DOUBLE, bucket) / ({_GAMMA}::DOUBLE + 1) + 0.5) AS BIGINT) AS value,
  CAST(floor(1000 * pow({_GAMMA}::DOUBLE, bucket - 1) + 0.5) AS BIGINT) AS low, CAST(floor(1000 * pow({_GAMMA}::DOUBLE, bucket) + 0.5) AS BIGINT) AS high, total
FROM hit
"""

P5_CLASSES = """
WITH u AS (SELECT unit_no, any_value(tokens) AS t FROM function_units WHERE len(tokens) >= 40 GROUP BY unit_no),
c AS (SELECT unit_no, t, min(unit_no) OVER (PARTITION BY t) AS class_id, count(*) OVER (PARTITION BY t) AS copies FROM u),
s AS (SELECT DISTINCT unit_no, array_to_string([coalesce(x, chr(0)) FOR x IN t[i:i + 4]], chr(1)) AS g
      FROM c, unnest(range(1, len(t) - 3)) AS r(i) WHERE unit_no = class_id),
n AS (SELECT unit_no, count(*) AS n FROM s GROUP BY unit_no),
p AS (SELECT a.unit_no AS x, b.unit_no AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.unit_no <> b.unit_no GROUP BY ALL),
d AS (SELECT x, count(*) AS links FROM p JOIN n a ON a.unit_no = x JOIN n b ON b.unit_no = y WHERE 2 * c >= a.n + b.n - c GROUP BY x)
SELECT unit_no, class_id, copies, coalesce(links, 0) AS links FROM c LEFT JOIN d ON x = class_id
"""

P5_FOUND = """
WITH u AS (SELECT unit_no, any_value(tokens) AS t FROM function_units WHERE len(tokens) >= 40 GROUP BY unit_no),
s AS (SELECT DISTINCT unit_no, array_to_string([coalesce(x, chr(0)) FOR x IN t[i:i + 4]], chr(1)) AS g
      FROM u, unnest(range(1, len(t) - 3)) AS r(i)),
n AS (SELECT unit_no, count(*) AS n FROM s GROUP BY unit_no),
p AS (SELECT a.unit_no AS x, b.unit_no AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.unit_no < b.unit_no GROUP BY ALL)
SELECT x AS unit_a, y AS unit_b FROM p JOIN n a ON a.unit_no = x JOIN n b ON b.unit_no = y WHERE 2 * c >= a.n + b.n - c
"""

P7_AUDIT = """
SELECT t.source, count(*) AS documents, CAST(0 AS BIGINT) AS doubled, CAST(0 AS BIGINT) AS over_cap, CAST(0 AS BIGINT) AS broken
FROM source_targets t JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source)) GROUP BY t.source
"""

_WORDS = """
w AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS words FROM documents),
starts AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS g FROM w, unnest(range(1, len(words) - 6)) AS r(i)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id, g ORDER BY i) AS k FROM starts) WHERE k > 1),
hit AS (SELECT DISTINCT doc_id, i + j AS at FROM again, unnest(range(0, 8)) AS r(j)),
c AS (SELECT doc_id, count(*) AS covered FROM hit GROUP BY doc_id)
"""

P8_MEASURES = f"""
WITH {_WORDS}
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(covered, 0) AS BIGINT) AS covered FROM w LEFT JOIN c USING (doc_id)
"""

P8_FOUND = f"""
WITH {_WORDS}
SELECT doc_id FROM w JOIN c USING (doc_id) WHERE covered >= 0.3 * len(words)
"""

SQL = {
    "p2_found": P2,
    "p3_found": P3_FOUND,
    "p3_exact_percentiles": P3_EXACT,
    "p3_percentiles": P3_PERCENTILES,
    "p5_found": P5_FOUND,
    "p5_classes": P5_CLASSES,
    "p7_audit": P7_AUDIT,
    "p8_measures": P8_MEASURES,
    "p8_found": P8_FOUND,
}
