"""Reports for people: an impact and a review as text, a review for a code host, the blast radius as SVG, pages, scorecards.

Reports are made on the driver from rows that other operators have already cut to what is shown, so their size is
bounded by those caps and not by the data.
"""

from __future__ import annotations

import html
import json
from collections.abc import Callable, Iterable

from ripplefold.functions.text import SEVERITIES
from ripplefold.sources.sinks import EVIDENCE_ROWS, PER_HOP, PER_SYMBOL

Row = dict


def _counted(n: int, word: str) -> str:
    return f"{n} {word}" if n == 1 else f"{n} {word}s"


def _place(row: Row) -> str:
    return f"{row['file']}:{row['line']}" if row.get("line") else str(row["file"])


def _gravest_first(findings: Iterable[Row]) -> list[Row]:
    return sorted(findings, key=lambda f: SEVERITIES.index(f["severity"]) if f["severity"] in SEVERITIES else len(SEVERITIES))


def impact_text(symbols: Iterable[Row], sites: Iterable[Row], cycles: Iterable[Row] = (), violations: Iterable[Row] = (), moved: Iterable[Row] = (), duplicates: Iterable[Row] = (), unparsed: Iterable[str] = ()) -> str:
    """What a change reaches: its symbols with their nearest sites, then cycles, broken rules, moved metrics, copies.

    symbols: id, name, file, line, change_kind; sites: origin, file, line, hops, symbol_id, and ``more`` of an origin as
    by ``sinks.shown_sites``; cycles: node_ids, introduced; violations: rule, from_module, to_module, introduced;
    moved: module, before, after; duplicates: name, file, line, other, other_file, other_line, similarity, repo.
    """
    out: list[str] = []
    known = {True: "introduced", False: "known before"}
    if unparsed := list(unparsed):
        out += [f"Not analysed, so what follows is a lower bound: {', '.join(unparsed[:5])}{' ...' if len(unparsed) > 5 else ''}", ""]
    by_origin: dict[str, list[Row]] = {}
    for site in sites:
        by_origin.setdefault(site["origin"], []).append(site)
    for symbol in symbols:
        out.append(f"{symbol['name']} ({symbol['change_kind']}) {_place(symbol)}")
        own = sorted(by_origin.get(symbol["id"], []), key=lambda s: s["hops"])
        if not own and symbol["name"] == "<module>":
            out.append("  changed outside of any declaration; followed by module only")
        elif not own:
            out.append("  reaches nothing beyond the change")
        out += [f"  {_counted(s['hops'], 'hop')}  {_place(s)}  {s['symbol_id']}" for s in own[:PER_SYMBOL]]
        if more := max([s.get("more") or 0 for s in own] + [len(own) - PER_SYMBOL]):
            if more > 0:
                out.append(f"  and {more} more")
    sections = (
        ("Cycles", [f"  {known[bool(c['introduced'])]}: {' <-> '.join(c['node_ids'])}" for c in cycles]),
        ("Broken rules", [f"  {known[bool(v['introduced'])]}: {v['from_module']} -> {v['to_module']} ({v['rule']})" for v in violations]),
        ("Instability", [f"  {m['module']} {'new' if m['before'] is None else format(m['before'], '.2f')} -> {m['after']:.2f}" for m in moved]),
        ("Similar code", [f"  {d['similarity']:.2f} {d['name']} {_place(d)} like {d['other']} {d['other_file']}:{d['other_line']}{' in ' + d['repo'] if d.get('repo') else ''}" for d in duplicates]),
    )
    for title, lines in sections:
        if lines:
            out += ["", f"{title} ({len(lines)})", *lines]
    return "\n".join(out)


def review_text(run: Row, findings: Iterable[Row], rejected: Iterable[Row] = ()) -> str:
    """The findings of a run, gravest first, and those that were dropped with the reason."""
    findings, rejected = _gravest_first(findings), list(rejected)
    out = [f"{run['base_ref']}..{run['head_ref']} {'with' if run['graph_grounded'] else 'without'} the graph, {run['provider']}/{run['model']}", ""]
    out += [f"{_counted(len(findings), 'finding')}" if findings else "No findings."]
    for f in findings:
        out += [f"[{f['severity']}] {f['summary']}", f"  {_place(f)} {f['category']}", f"  {f['rationale']}"]
        if f.get("evidence_refs"):
            out.append(f"  evidence {', '.join(f['evidence_refs'])}")
    if rejected:
        out += ["", f"Dropped without ground ({len(rejected)})", *(f"  {r['summary']}: {r['reason']}" for r in rejected)]
    return "\n".join(out)


def _cell(text: object) -> str:
    return str(text).replace("|", "\\|").replace("\n", " ")


def review_payload(commit: str, findings: Iterable[Row], evidence: list[Row], commentable: set[tuple[str, int]], rejected: int = 0) -> Row:
    """A review as a code host takes it: comments on lines of the diff, and a summary with all other findings and at
    most ``EVIDENCE_ROWS`` rows of evidence. It never blocks a merge."""
    inline, others = [], []
    for f in _gravest_first(findings):
        here = bool(f["line"]) and (f["file"], f["line"]) in commentable
        (inline if here else others).append(f)
    body = ["## Review", ""]
    if others:
        body += [f"### {_counted(len(others), 'finding')} beyond the diff", "", *(f"- **{f['severity']}** `{_place(f)}` {f['summary']}\n  {f['rationale']}" for f in others), ""]
    if not inline and not others:
        body += ["No findings.", ""]
    if evidence:
        body += ["| id | kind | fact |", "|---|---|---|", *(f"| {e['evidence_id']} | {e['kind']} | {_cell(e['summary'])} |" for e in evidence[:EVIDENCE_ROWS])]
        if len(evidence) > EVIDENCE_ROWS:
            body.append(f"| | | and {len(evidence) - EVIDENCE_ROWS} more |")
        body.append("")
    if rejected:
        body.append(f"{_counted(rejected, 'finding')} dropped without ground.")
    comments = [{"path": f["file"], "line": f["line"], "side": "RIGHT", "body": f"**{f['severity']}** {f['summary']}\n\n{f['rationale']}"} for f in inline]
    return {"commit_id": commit, "event": "COMMENT", "body": "\n".join(body), "comments": comments}


def post_review(transport: Callable[[str, dict[str, str], bytes, float], tuple[int, str]], token: str, owner: str, repo: str, number: int, payload: Row) -> int:
    """The id that the code host gave the review; one request, never repeated, as a repeated one would post twice."""
    headers = {"accept": "application/vnd.github+json", "authorization": f"Bearer {token}", "x-github-api-version": "2022-11-28", "content-type": "application/json"}
    status, said = transport(f"https://api.github.com/repos/{owner}/{repo}/pulls/{number}/reviews", headers, json.dumps(payload).encode(), 30)
    if not 200 <= status < 300:
        raise RuntimeError(f"the code host answered {status}: {said.replace(token, '***')[:300]}")
    return int(json.loads(said).get("id") or 0)


def user_prompt(base: str, head: str, diff: str, evidence: str, facts: int, dropped: int = 0) -> str:
    """The diff, then the evidence block of ``evidence.rendered``, last because it is what the answer must cite."""
    out = ["## DIFF", f"{base}..{head}", "", diff.strip(), "", f"## EVIDENCE ({_counted(facts, 'fact')})"]
    if not facts:
        return "\n".join([*out, "The graph was not consulted. Make no claim about what the change reaches."])
    out += ["Ranked by weight; cite the ids.", "", evidence]
    if dropped:
        out += ["", f"[{_counted(dropped, 'fact')} more did not fit, so the sites shown are a lower bound.]"]
    return "\n".join(out)


def blast_svg(columns: Iterable[Row], edges: Iterable[Row], width: int = 220, height: int = 34) -> str:
    """A picture of the sites of ``sinks.hop_columns`` with the edges of ``sinks.drawn_edges``: one column a hop."""
    by_hop: dict[int, list[Row]] = {}
    for row in columns:
        by_hop.setdefault(row["hops"], []).append(row)
    at, boxes = {}, []
    for x, (hop, rows) in enumerate(sorted(by_hop.items())):
        boxes.append(f'<text x="{x * width + 10}" y="20">{html.escape(_counted(hop, "hop"))}</text>')
        for y, row in enumerate(sorted(rows, key=lambda r: r["r"])[:PER_HOP]):
            left, top = x * width + 10, 30 + y * height
            at[row["symbol_id"]] = (left, top)
            name = row["symbol_id"] if len(row["symbol_id"]) <= 24 else row["symbol_id"][:23] + "…"
            boxes.append(f'<rect x="{left}" y="{top}" width="{width - 50}" height="{height - 8}" fill="none" stroke="#888"/><text x="{left + 6}" y="{top + 17}">{html.escape(name)}</text>')
        if over := max(r["overflow"] for r in rows):
            boxes.append(f'<text x="{x * width + 10}" y="{45 + PER_HOP * height}">+{over} more</text>')
    lines = []
    for e in edges:
        if e["from_id"] in at and e["to_id"] in at:
            (x1, y1), (x2, y2) = at[e["from_id"]], at[e["to_id"]]
            lines.append(f'<line x1="{x1 + width - 50}" y1="{y1 + 13}" x2="{x2}" y2="{y2 + 13}" stroke="#bbb"/>')
    wide, tall = max(1, len(by_hop)) * width, 60 + PER_HOP * height
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{wide}" height="{tall}" font-size="12">{"".join(lines + boxes)}</svg>'


def runs_page(runs: Iterable[Row]) -> str:
    """A page that lists runs; every value is escaped."""
    rows = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[c] if r[c] is not None else ''))}</td>" for c in ("id", "created_at", "model", "findings_count")) + "</tr>" for r in runs)
    return f"<!doctype html><title>Runs</title><table><tr><th>run</th><th>at</th><th>model</th><th>findings</th></tr>{rows}</table>"


def run_page(run: Row, findings: Iterable[Row], picture: str = "") -> str:
    """A page of one run; ``picture`` is an SVG of ``blast_svg`` and the only text that is not escaped."""
    parts = [f"<li><b>{html.escape(f['severity'])}</b> {html.escape(_place(f))} {html.escape(f['summary'])}<p>{html.escape(f['rationale'] or '')}</p></li>" for f in _gravest_first(findings)]
    return f"<!doctype html><title>{html.escape(str(run['id']))}</title><h1>{html.escape(str(run['id']))}</h1>{picture}<ul>{''.join(parts)}</ul>"


#: Measures of an arm with the form in which a scorecard shows them.
SHOWN = (("structural_recall", "{:.1%}"), ("recall", "{:.1%}"), ("precision", "{:.1%}"), ("f1", "{:.2f}"), ("prompt_tokens", "{:.0f}"), ("latency_ms", "{:.0f} ms"))


def scorecard_markdown(arms: dict[str, Row], word: str) -> str:
    """A table of arms, each with a dict of mean, stdev and n per measure and its failures, under a verdict."""
    names = list(arms)
    out = [f"**{word}**", "", "| measure | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
    for measure, form in SHOWN:
        cells = [f"{form.format(s['mean'])} ± {form.format(s['stdev'])}" if (s := arms[n].get(measure)) and s["n"] else "none" for n in names]
        out.append(f"| {measure} | " + " | ".join(cells) + " |")
    return "\n".join([*out, "| failures | " + " | ".join(str(arms[n].get("failures", 0)) for n in names) + " |"])


def scorecard_json(arms: dict[str, Row], word: str) -> str:
    return json.dumps({"verdict": word, "arms": arms}, indent=2)


def scorecard_svg(arms: dict[str, Row], measure: str = "structural_recall") -> str:
    """A bar for each arm's mean share."""
    bars = []
    for i, (name, row) in enumerate(arms.items()):
        share = (row.get(measure) or {"mean": 0.0})["mean"]
        bars.append(f'<text x="10" y="{38 + 40 * i}">{html.escape(name)}</text><rect x="140" y="{22 + 40 * i}" width="{max(1, round(300 * share))}" height="22" fill="#47a"/><text x="{150 + round(300 * share)}" y="{38 + 40 * i}">{share:.1%}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="520" height="{40 * len(arms) + 30}" font-size="13">{"".join(bars)}</svg>'
