"""Scalar functions over strings and numbers, as column expressions that stay inside code generation.

Null inputs give null unless a docstring says otherwise.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Severities from gravest to mildest.
SEVERITIES = ("critical", "high", "medium", "low", "info")
#: Categories that only a view across files can support.
STRUCTURAL = ("cross-module-regression", "circular-dependency", "architecture", "duplicate-logic")
#: File endings that can be analysed.
SOURCE_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")
#: Fixed value: UTF-16 units to one token of the worst-case estimate.
UNITS_PER_TOKEN = 1.25


def round_half_up(x: Column, digits: int = 2) -> Column:
    """Nearest multiple of 10**-digits with halves upwards, also for negative numbers."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5) / F.lit(scale)


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def estimated_tokens(text: Column) -> Column:
    """Upper estimate of tokens without a vocabulary."""
    return F.ceil(utf16_length(text) / UNITS_PER_TOKEN).cast("long")


def layer_glob(glob: str) -> str:
    """Anchored regular expression of a layer glob.

    ``**/`` stands for any directories or none, ``**`` for anything, ``*`` and ``?`` stay inside a segment.
    """
    pieces = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.split(r"(\*\*/|\*\*|\*|\?)", glob)
    return "^" + "".join(pieces[p] if p in pieces else re.sub(r"[.+^${}()|\[\]\\]", r"\\\g<0>", p) for p in parts) + "$"


def is_source_file(path: Column) -> Column:
    """True for analysable endings, never for declaration files."""
    endings = "|".join(re.escape(e) for e in SOURCE_ENDINGS)
    return path.rlike(f"({endings})$") & ~path.endswith(".d.ts")


def is_external(specifier: Column) -> Column:
    return ~specifier.startswith(".")


def is_project_node(path: Column) -> Column:
    """True for files of the project: no declaration files, no installed packages, nothing above the root."""
    return ~path.endswith(".d.ts") & ~F.concat(F.lit("/"), path).contains("/node_modules/") & ~path.startswith("..") & (path != "")


def joined_path(folder: Column, relative: Column) -> Column:
    """POSIX join and normalisation of two paths by a fold over the segments."""
    parts = F.split(F.concat_ws("/", folder, relative), "/")

    def step(done: Column, part: Column) -> Column:
        last = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(".."))
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when((part == "") | (part == "."), done).when((part == "..") & (last != ".."), up).otherwise(F.concat(done, F.array(part)))

    folded = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.array_join(folded, "/")


def parent_folder(path: Column) -> Column:
    """Everything before the last slash; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def plain_slashes(path: Column) -> Column:
    """Forward slashes, without one leading ``./``."""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", "")


def relative_to(path: Column, root: Column) -> Column:
    """Path below ``root``; null outside of it."""
    prefix = F.concat(root, F.lit("/"))
    return F.when(path.startswith(prefix), F.substr(path, F.length(prefix) + 1))


def edge_key(source: Column, target: Column) -> Column:
    return F.concat_ws(" -> ", source, target)


def component_key(members: Column) -> Column:
    return F.array_join(F.array_sort(members), "|")


def symbol_id(file: Column, name: Column) -> Column:
    return F.concat(file, F.lit("#"), name)


def short_name(symbol: Column) -> Column:
    """What follows the first ``#``; the whole id where there is none."""
    at = F.instr(symbol, "#")
    return F.when(at > 0, F.substr(symbol, at + 1)).otherwise(symbol)


def truncated(text: Column, length: int) -> Column:
    """At most ``length`` characters, the last of which tells that more followed."""
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length - 1), F.lit("…"))).otherwise(text)


def escaped_html(text: Column) -> Column:
    """Text safe inside markup; the ampersand goes first."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def escaped_cell(text: Column) -> Column:
    """Text safe inside a table row."""
    return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def scrubbed(text: Column, secret: Column) -> Column:
    """``text`` without ``secret``; an empty or null secret changes nothing."""
    return F.when(F.coalesce(F.length(secret), F.lit(0)) > 0, F.replace(text, secret, F.lit("***"))).otherwise(text)


#: Steps from a remote address to its identity, in order; the colon step takes the first one only.
REMOTE_STEPS = ((r"^[a-zA-Z][a-zA-Z0-9+.]*://", ""), (r"^ssh://", ""), (r"^[^@/]+@", ""), (r"^(.*?):(?=\D)", "$1/"), (r"\.git$", ""), (r"/+$", ""))


def remote_identity(url: Column) -> Column:
    """Lower-case host and path of a repository address, whatever its protocol and user."""
    out = F.trim(url)
    for pattern, into in REMOTE_STEPS:
        out = F.regexp_replace(out, pattern, into)
    return F.lower(out)


def severity_rank(severity: Column) -> Column:
    """0 for the gravest; null for an unknown word."""
    ranks = F.create_map(*(x for i, s in enumerate(SEVERITIES) for x in (F.lit(s), F.lit(i))))
    return F.try_element_at(ranks, severity)


def percent(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def plural(count: Column, word: str, words: str | None = None) -> Column:
    """``1 word`` or ``n words``."""
    return F.concat_ws(" ", count.cast("string"), F.when(count == 1, word).otherwise(words or word + "s"))


def clamped(x: Column, low: int, high: int) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def iso_instant(ts: Column) -> Column:
    """``2025-01-31T12:00:00.000Z``, milliseconds cut."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def kind_and_rest(text: Column) -> Column:
    """struct(kind, rest) of ``kind: rest``; without a separator the whole text is the kind."""
    return F.struct(F.substring_index(text, ": ", 1).alias("kind"), F.when(F.instr(text, ": ") > 0, F.substr(text, F.instr(text, ": ") + 2)).alias("rest"))


def finding_schema_hint() -> str:
    """What a model is told of the answer's form."""
    return '{"findings":[{"severity":"' + "|".join(SEVERITIES) + '","category":"...","file":"...","line":0,"summary":"...","rationale":"...","evidenceRefs":["E1"]}]}'
