"""Source text of the TypeScript family without a compiler: tokens, functions, contracts.

A scanner cuts the text into comments, strings, templates, numbers, regular expressions, names and marks, so that
brackets and words inside the first four are never taken for code. Functions are found from their heads and matched
brackets. Scans are sequential per file and run in Arrow batches; a text that breaks off ends what is open.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are syntax and never names, those after which a slash starts a regular expression, and
#: those that head a block in round brackets without being a function.
KEYWORDS = frozenset(
    "abstract as async await break case catch class const continue debugger declare default delete do else enum export extends false finally for function "
    "get if implements import in instanceof interface let new null of private protected public readonly return set static super switch this throw true try "
    "type typeof var void while with yield".split()
)
BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do yield await".split())
BLOCKS = frozenset("if for while switch catch with".split())
SOFT = frozenset("get set type of as async declare abstract static readonly default".split())  # may also be names

SCAN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<space>\s+)|(?P<string>\"(?:[^\"\\\n]|\\.)*\"?|'(?:[^'\\\n]|\\.)*'?)|(?P<number>(?:0[xXbBoO][\da-fA-F_]+|\d[\d_]*(?:\.[\d_]*)?(?:[eE][+-]?\d+)?|\.\d[\d_]*)n?)"
    r"|(?P<name>[#@]?[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*)|(?P<mark>=>|\.\.\.|\?\.|[=!]==?|&&|\|\||\?\?|\+\+|--|\*\*|[-+*%&|^<>]=?|.)",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*")


class Token(NamedTuple):
    kind: str  # string, template, number, regex, name, mark
    text: str
    line: int


class Unit(NamedTuple):
    name: str
    kind: str
    line: int
    end_line: int
    tokens: list[str]


def scanned(code: str | None) -> list[Token]:
    """The tokens of a text in order, without comments and space; code inside a template's ``${}`` counts as code."""
    out: list[Token] = []
    text, at, line = code or "", 0, 1
    holes: list[int] = []  # open brackets inside each template hole

    def template(start: int) -> int:
        """The end of the template text that starts at ``start``: after its closing tick, or at an opened hole."""
        i = start
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                return i + 1
            elif text.startswith("${", i):
                holes.append(0)
                return i + 2
            else:
                i += 1
        return len(text)

    while at < len(text):
        c = text[at]
        if c == "`" or (c == "}" and holes and holes[-1] == 0):
            if c == "}":
                holes.pop()
            end = template(at + 1)
            if c == "`":
                out.append(Token("template", "STR", line))
        elif c == "/" and (not out or out[-1].kind == "mark" and out[-1].text not in (")", "]", "}") or out[-1].text in BEFORE_REGEX) and (found := REGEX.match(text, at)):
            end = found.end()
            out.append(Token("regex", "REGEX", line))
        else:
            found = SCAN.match(text, at)
            end, kind = found.end(), found.lastgroup
            if kind not in ("comment", "space"):
                out.append(Token(kind, found[0], line))
                if holes and c in "{}":
                    holes[-1] += 1 if c == "{" else -1
        line += text.count("\n", at, end)
        at = end
    return out


def levelled(tokens: list[Token]) -> list[str]:
    """Tokens with names of calls and members kept and other names, strings and numbers levelled to their kind."""
    out = []
    for i, token in enumerate(tokens):
        after = tokens[i + 1].text if i + 1 < len(tokens) else ""
        before = tokens[i - 1].text if i else ""
        member = before in (".", "?.")
        if token.kind == "name" and (member or token.text not in KEYWORDS or token.text in SOFT and after == "("):
            out.append(f"N:{token.text}" if member or after == "(" and before != "function" else "ID")
        else:
            out.append({"string": "STR", "number": "NUM"}.get(token.kind, token.text))
    return out


def _partners(tokens: list[Token]) -> dict[int, int]:
    """The closing place of each opening bracket; one that is never closed ends with the text."""
    pairs, open_ = {}, []
    closes = {"(": ")", "[": "]", "{": "}"}
    for i, token in enumerate(tokens):
        if token.kind == "mark" and token.text in closes:
            open_.append((closes[token.text], i))
        elif token.kind == "mark" and token.text in closes.values():
            while open_:
                closing, start = open_.pop()
                pairs[start] = i
                if closing == token.text:
                    break
    for _, start in open_:
        pairs[start] = len(tokens) - 1
    return pairs


def _body(tokens: list[Token], pairs: dict[int, int], at: int, arrow: bool) -> tuple[int, int] | None:
    """(first, last) token of the body after a parameter list that ends before ``at``; None for a mere signature."""
    text = lambda i: tokens[i].text if i < len(tokens) else ""
    if text(at) == ":":
        at += 1
        start = at
        while at < len(tokens) and text(at) not in (";", "=>", "=", ")", ","):
            if text(at) == "{" and not (at == start or text(at - 1) in ("|", "&", "<", ",", ":", "=>")):
                break
            at = pairs.get(at, at) + 1
    if arrow:
        if text(at) != "=>":
            return None
        at += 1
    if text(at) == "{":
        return at, pairs[at]
    if not arrow or at >= len(tokens):
        return None
    end = at
    while end < len(tokens) and text(end) not in (";", ",", ")", "]", "}"):
        end = pairs.get(end, end) + 1
    return at, end - 1


def units_of(code: str | None, least: int = 0) -> list[Unit]:
    """Functions with a body, in order of their heads: declarations, expressions, arrows, methods, constructors,
    accessors. A member is named after its class; one without a name is ``<anonymous>``. Units of fewer than
    ``least`` levelled tokens of the body are left out."""
    tokens = scanned(code)
    pairs = _partners(tokens)
    words = levelled(tokens)
    text = lambda i: tokens[i].text if 0 <= i < len(tokens) else ""
    named = lambda i: 0 <= i < len(tokens) and tokens[i].kind == "name"
    classes, found, arrows = [], [], set()
    for i, token in enumerate(tokens):
        if token.text == "class" and token.kind == "name" and text(i - 1) not in (".", "?."):
            start = i
            while start < len(tokens) and text(start) != "{":
                start += 1
            if start < len(tokens):
                name = text(i + 1) if named(i + 1) and text(i + 1) not in ("extends", "implements") else "<anonymous>"
                classes.append((start, pairs[start], name))

    def given(i: int) -> str:
        """The name that an expression starting at token ``i`` is given to."""
        if text(i - 1) == "async":
            i -= 1
        if text(i - 1) in ("=", ":") and named(i - 2):
            return text(i - 2)
        if text(i - 1) == "=":  # a typed variable: const name: Type = ...
            j = i - 2
            while j > 0 and text(j) not in (";", "{", "}", "const", "let", "var"):
                j -= 1
            if text(j) in ("const", "let", "var") and named(j + 1):
                return text(j + 1)
        return "<anonymous>"

    def member(i: int, name: str) -> str:
        inside = [c for c in classes if c[0] < i <= c[1]]
        return f"{max(inside)[2]}.{name}" if inside else name

    def keep(i: int, name: str, kind: str, body: tuple[int, int] | None) -> None:
        if body and body[1] >= body[0]:
            own = words[body[0] : body[1] + 1]
            if len(own) >= least:
                found.append(Unit(name, kind, tokens[i].line, tokens[body[1]].line, own))

    for i, token in enumerate(tokens):
        if token.text == "function" and token.kind == "name" and text(i - 1) not in (".", "?."):
            at = i + 1 + (text(i + 1) == "*")
            name = text(at) if named(at) else given(i)
            at += named(at)
            at = _after_types(tokens, at)
            if text(at) == "(":
                declared = named(i + 1 + (text(i + 1) == "*")) and text(i - 1) in ("", ";", "}", "{", "export", "default", "async", "declare", ")")
                keep(i, name, "function" if declared else "function expression", _body(tokens, pairs, pairs[at] + 1, False))
        elif token.text == "(" and token.kind == "mark" and (body := _body(tokens, pairs, pairs[i] + 1, True)) and text(i - 1) != "?":
            arrows.add(body[0] - 1)
            field = text(i - 1) == "=" and any(_direct(pairs, c, i) for c in classes)
            keep(i, member(i, given(i)) if field else given(i), "arrow", body)
        elif named(i) and text(i + 1) == "=>" and i + 1 not in arrows and token.text not in KEYWORDS - SOFT:
            keep(i, given(i), "arrow", _body(tokens, pairs, i + 1, True))
        elif token.kind in ("name", "string", "number") and text(i - 1) not in (".", "?.", "new", "function", "*") or token.text == "]" and token.kind == "mark":
            at = _after_types(tokens, i + 1)
            if text(at) != "(" or token.text in BLOCKS or token.kind == "name" and token.text in KEYWORDS - SOFT:
                continue
            head = i
            if token.text == "]":
                head = next((s for s, e in pairs.items() if e == i), i)
            while text(head - 1) in ("get", "set", "async", "static", "private", "public", "protected", "readonly", "override", "abstract", "*", "#"):
                head -= 1
            if text(head - 1) not in ("{", "}", ";", ",") and not text(head - 1).startswith("@") and text(head - 1) != ")":
                continue
            body = _body(tokens, pairs, pairs[at] + 1, False)
            accessor = next((text(j) for j in range(head, i) if text(j) in ("get", "set")), None)
            name = "<computed>" if token.text == "]" else token.text.strip("'\"")
            keep(head, member(i, name), "constructor" if name == "constructor" else accessor or "method", body)
    return found


def _after_types(tokens: list[Token], at: int) -> int:
    """The place after type parameters in angle brackets, if any start at ``at``."""
    if at >= len(tokens) or tokens[at].text != "<":
        return at
    depth = 0
    for i in range(at, min(at + 200, len(tokens))):
        depth += {"<": 1, ">": -1}.get(tokens[i].text, 0)
        if depth == 0:
            return i + 1
        if tokens[i].text in (";", "{"):
            break
    return at


def _direct(pairs: dict[int, int], body: tuple[int, int, str], i: int) -> bool:
    """Whether token ``i`` stands in a class body itself and in no bracket inside it."""
    return body[0] < i <= body[1] and not any(body[0] < start < i <= end for start, end in pairs.items() if end <= body[1] and start != body[0])


def contracts_of(code: str | None, longest: int = 1500) -> list[tuple[str, str, int, str]]:
    """(name, kind, line, text) of interfaces, type aliases and enums of at most ``longest`` characters."""
    tokens, lines = scanned(code), (code or "").split("\n")
    pairs, out = _partners(tokens), []
    for i, token in enumerate(tokens):
        before = tokens[i - 1].text if i else ""
        if token.kind != "name" or token.text not in ("interface", "type", "enum") or before in (".", "?.") or i + 2 >= len(tokens) or tokens[i + 1].kind != "name":
            continue
        if before not in ("", ";", "}", "{", "export", "declare", "const", "default") and tokens[i - 1].line == token.line:
            continue
        end = i + 2
        if token.text == "type":
            end = _after_types(tokens, end)
            if tokens[end].text != "=":
                continue
            while end < len(tokens) and tokens[end].text != ";" and not (tokens[end].line > tokens[end - 1].line and tokens[end - 1].text not in ("=", "|", "&", "{", "(", "<", ",", "=>", "?", ":") and tokens[end].text not in ("|", "&", "}", ")", ">", "?", ":", "=>")):
                end = pairs.get(end, end) + 1
            end = min(end, len(tokens)) - (end >= len(tokens) or tokens[end].text != ";")
        else:
            while end < len(tokens) and tokens[end].text != "{":
                end += 1
            if end >= len(tokens):
                continue
            end = pairs[end]
        said = "\n".join(lines[token.line - 1 : tokens[min(end, len(tokens) - 1)].line])
        if len(said) <= longest:
            out.append((tokens[i + 1].text, token.text, token.line, said))
    return out


UNITS = "array<struct<name:string,kind:string,line:int,end_line:int,tokens:array<string>>>"
CONTRACTS = "array<struct<name:string,kind:string,line:int,text:string>>"


def _each(schema: str, of) -> callable:
    @F.pandas_udf(schema)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(of)

    return run


def function_units(code: Column, least: int = 40) -> Column:
    """``units_of`` of each text; none for null."""
    return _each(UNITS, lambda t: [u._asdict() for u in units_of(t, least)])(code)


def contracts(code: Column) -> Column:
    """``contracts_of`` of each text; none for null."""
    return _each(CONTRACTS, lambda t: [dict(zip(("name", "kind", "line", "text"), c)) for c in contracts_of(t)])(code)


def normal_tokens(code: Column) -> Column:
    """``levelled`` tokens of each text; none for null."""
    return _each("array<string>", lambda t: levelled(scanned(t)))(code)
