"""Functions that scan a string in sequence, as Arrow UDFs: JSON in prose, signatures."""

from __future__ import annotations

import hashlib
import hmac
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplefold.functions.text import SEVERITIES

#: Accepted categories of a finding.
CATEGORIES = ("correctness", "cross-module-regression", "circular-dependency", "architecture", "duplicate-logic", "security", "performance", "maintainability")

FINDING = T.ArrayType(
    T.StructType(
        [
            T.StructField("severity", T.StringType()),
            T.StructField("category", T.StringType()),
            T.StructField("file", T.StringType()),
            T.StructField("line", T.LongType()),
            T.StructField("summary", T.StringType()),
            T.StructField("rationale", T.StringType()),
            T.StructField("evidence_refs", T.ArrayType(T.StringType())),
            T.StructField("confidence", T.DoubleType()),
        ]
    )
)
PARSED = T.StructType([T.StructField("findings", FINDING), T.StructField("problem", T.StringType())])

_FENCE = re.compile(r"```(?:json)?\s*\n(.*?)```", re.S)


def balanced_json(text: str | None) -> str | None:
    """The first balanced object or array of a text, a fenced block before the rest; brackets in strings do not count."""
    if not text:
        return None
    fenced = _FENCE.search(text)
    for part in ([fenced[1]] if fenced else []) + [text]:
        start = 0
        while (opened := re.compile(r"[\[{]").search(part, start)) is not None:
            stack, quoted, at = [], False, opened.start()
            while at < len(part):
                c = part[at]
                if quoted:
                    if c == "\\":
                        at += 1
                    elif c == '"':
                        quoted = False
                elif c == '"':
                    quoted = True
                elif c in "[{":
                    stack.append("]" if c == "[" else "}")
                elif c in "]}":
                    if not stack or stack.pop() != c:
                        break
                    if not stack:
                        found = part[opened.start() : at + 1]
                        try:
                            json.loads(found)
                            return found
                        except ValueError:
                            break
                at += 1
            start = opened.start() + 1
    return None


def checked_findings(text: str | None) -> tuple[list[dict] | None, str | None]:
    """(findings, None) of an answer, or (None, what is wrong with it); types are never coerced."""
    found = balanced_json(text)
    if found is None:
        return None, "no JSON found"
    value = json.loads(found)
    rows = value.get("findings") if isinstance(value, dict) else value
    if not isinstance(rows, list):
        return None, "findings: expected a list"
    wrong, out = [], []
    for i, row in enumerate(rows):
        if not isinstance(row, dict):
            wrong.append(f"findings.{i}: expected an object")
            continue
        line, sure, refs = row.get("line"), row.get("confidence"), row.get("evidenceRefs", [])
        for name, good in (
            ("severity", row.get("severity") in SEVERITIES),
            ("category", row.get("category") in CATEGORIES),
            ("file", isinstance(row.get("file"), str) and row["file"] != ""),
            ("line", type(line) is int and line >= 0),
            ("summary", isinstance(row.get("summary"), str) and 1 <= len(row["summary"]) <= 200),
            ("rationale", isinstance(row.get("rationale"), str)),
            ("evidenceRefs", isinstance(refs, list) and all(isinstance(r, str) for r in refs)),
            ("confidence", sure is None or (type(sure) in (int, float) and 0 <= sure <= 1)),
        ):
            if not good:
                wrong.append(f"findings.{i}.{name}: not accepted")
        if not wrong:
            out.append({"severity": row["severity"], "category": row["category"], "file": row["file"], "line": line, "summary": row["summary"], "rationale": row["rationale"], "evidence_refs": refs, "confidence": None if sure is None else float(sure)})
    return (None, "; ".join(wrong[:10])) if wrong else (out, None)


def json_in_prose(text: Column) -> Column:
    """The JSON of a model's answer as text; null where there is none."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(balanced_json)

    return run(text)


def parsed_findings(text: Column) -> Column:
    """struct(findings, problem) of a model's answer."""

    @F.udf(PARSED, useArrow=True)
    def run(answer):
        return checked_findings(answer)

    return run(text)


def signature_check(body: str | bytes | None, header: str | None, secret: str | None) -> str:
    """``ok`` or why a signed payload is refused; without a secret all are."""
    if not secret:
        return "no-secret"
    if not header:
        return "missing"
    if not re.fullmatch(r"sha256=[0-9a-f]{64}", header):
        return "malformed"
    data = body if isinstance(body, bytes) else (body or "").encode()
    made = "sha256=" + hmac.new(secret.encode(), data, hashlib.sha256).hexdigest()
    return "ok" if hmac.compare_digest(made, header) else "mismatch"


def signature_state(body: Column, header: Column, secret: str | None) -> Column:
    """``signature_check`` of each row."""

    @F.pandas_udf(T.StringType())
    def run(bodies: pd.Series, headers: pd.Series) -> pd.Series:
        return pd.Series([signature_check(b, h, secret) for b, h in zip(bodies, headers)])

    return run(body, header)
