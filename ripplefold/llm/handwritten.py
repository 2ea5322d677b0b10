"""Files that people did not write for their repository: generated, minified, built, vendored or plain data.

Evidence, in order of weight:
1. Attribute files of the repository (``linguist-generated``, ``linguist-vendored``): patterns apply below the
   directory of their file, the deepest directory and in it the last matching line decide. An attribute is set,
   unset or, after ``!``, unspecified again, which says nothing; macros (``[attr]name ...``) stand for what they
   list. A file that is explicitly unset is kept whatever it looks like.
2. The file itself: markers that public tools leave in leading comments, the output shapes of compilers, bytes
   per line, heads of numbers or of encoded strings.
3. What the declared and the marked files have in common is mined for the repositories that declare nothing:
   abstracted paths (a directory and the shape of what lies below it at a fixed or any depth, or the end of the
   file name) and phrases of leading comments. A pattern holds if its files are marked far more often than
   chance, over several repositories; phrases are judged with the files that mined paths mark, and paths again
   with those that mined phrases mark. Files that fit one are out.
4. Conventions that public linguistic tools apply to any repository, written as an attribute file, for paths
   that no mined pattern covers.

Paths are compared with forward slashes and without leading ``./``; results keep them as stored. A null head
or line count is missing evidence, not evidence. Null paths or repositories never match a declaration. Empty
tables give no rows; repeated rows count once; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplefold.durable import cut

#: Paths that public tools hold for generated or vendored in any repository, as an attribute file.
CONVENTIONS = """
**/node_modules/** linguist-vendored
**/bower_components/** linguist-vendored
**/third_party/** linguist-vendored
**/third-party/** linguist-vendored
**/thirdparty/** linguist-vendored
**/3rdparty/** linguist-vendored
**/__generated__/** linguist-generated
**/coverage/lcov-report/** linguist-generated
**/.next/** linguist-generated
**/generated/** linguist-generated
*.min.js linguist-generated
*-min.js linguist-generated
*.min.mjs linguist-generated
*.bundle.js linguist-generated
*.chunk.js linguist-generated
*.gen.ts linguist-generated
*.gen.tsx linguist-generated
*.g.ts linguist-generated
*.generated.ts linguist-generated
*.generated.js linguist-generated
*_pb.js linguist-generated
*.pb.ts linguist-generated
*.pb.js linguist-generated
"""

#: Markers of public tools in a comment line, licence tags that bundlers keep, compilers' output.
COMMENT = r"^\s*(//|/\*|\*|#|<!--|--|;)"
GENERATED_COMMENT = r"(?im)" + COMMENT + r"(\W*auto-?generated\b|.*(@generated\b|\bgenerated (by|from)\b.*\bdo not (edit|modify)\b))"
VENDORED_COMMENT = r"(?im)(^\s*/\*!|" + COMMENT + r".*@(license|preserve)\b)"
COMPILED_HEAD = (
    r"(?m)(Object\.defineProperty\(exports, [\"']__esModule[\"']|^var __\w+ = \(this && this\.__\w+\)"
    r"|^// (Generated|Compiled) by \w+ [0-9]+(\.[0-9]+)+$|^//# sourceMappingURL=|^/\*+ webpackBootstrap)"
)
ENCODED_STRING = r"[\"'`][A-Za-z0-9+/=_-]{160,}"

#: Bytes per line above which nobody typed the lines; bytes of a file whose lines are unknown.
WIDE = 110
HUGE = 50_000

#: A mined pattern needs this many repositories and this lower bound of its share of marked files: in the first
#: pass the share must be a majority; in the second, on the files left, and for phrases, it must stand far
#: above the few per cent that ordinary files show.
LEAST_REPOS = 3
MAJORITY = 0.5
FAR_ABOVE = 0.15
#: Copies of each directory's rules that the files below it are dealt to.
SALTS = 32


def tidy(path: Column) -> Column:
    """A path with forward slashes, without leading ``./`` and repeated slashes."""
    slashed = F.regexp_replace(F.translate(path, "\\", "/"), "/{2,}", "/")
    return F.regexp_replace(slashed, r"^(\./)+", "")


def glob_regex(glob: str) -> str:
    """Regular expression of an attribute pattern, relative to its directory.

    Without a slash inside, it matches the file name at any depth; ``**`` spans directories where it stands alone
    between slashes, else it is ``*``; a trailing slash matches nothing, as attributes apply to files.
    """
    if glob.endswith("/") or not glob:
        return r"(?!)"
    parts = glob.removeprefix("/").split("/")
    out = [] if "/" in glob else ["(?:.*/)?"]
    for i, part in enumerate(parts):
        last = i == len(parts) - 1
        if part == "**" and len(parts) > 1:
            out.append(".+" if last else "(?:.*/)?")
        else:
            out.append(_segment(part) + ("" if last else "/"))
    return "^" + "".join(out) + "$"


def _segment(glob: str) -> str:
    """Regular expression of one segment: stars, question marks and brackets never match a slash."""
    out, at = [], 0
    while at < len(glob):
        c = glob[at]
        close = glob.find("]", at + 2 + (glob[at + 1 : at + 2] in ("!", "^"))) if c == "[" else -1
        if c == "*":
            out.append("[^/]*")
            while glob[at + 1 : at + 2] == "*":
                at += 1
        elif c == "?":
            out.append("[^/]")
        elif close > 0:
            inner = glob[at + 1 : close]
            negative = inner[0] in "!^"
            inner = re.sub(r"[\\\[\]&~|^]", r"\\\g<0>", inner[negative:])
            out.append(f"(?!/)[{'^' if negative else ''}{inner}]")
            at = close
        else:
            at += c == "\\" and at + 1 < len(glob)
            out.append(re.escape(glob[at]))
        at += 1
    return "".join(out)


def _words(line: str) -> tuple[str, list[str]]:
    """(pattern, attributes) of a line; a pattern with spaces stands in quotes."""
    quoted = re.match(r'"((?:[^"\\]|\\.)*)"\s+(.*)', line)
    glob, _, attributes = (re.sub(r"\\([\"\\])", r"\1", quoted[1]), "", quoted[2]) if quoted else line.replace("\t", " ").partition(" ")
    return glob, attributes.split()


def parse_macros(content: str | None) -> dict[str, list[str]]:
    """Attributes that each ``[attr]name`` line of an attribute file stands for; the last line of a name counts."""
    told = (_words(line.strip()) for line in (content or "").splitlines() if line.strip().startswith("[attr]"))
    return {glob[len("[attr]") :]: attributes for glob, attributes in told}


def parse_attributes(content: str | None, macros: dict[str, list[str]] | None = None) -> list[tuple[int, str, bool | None, str]]:
    """(line, regex, value, kind) of each linguist attribute of an attribute file; other lines say nothing.

    The value is None after ``!``, which makes the attribute unspecified again. A set macro stands for its
    attributes, also through other macros; ``macros`` are those of the repository's root. Of two words of a line
    that name the same attribute the later counts. A pattern that starts with ``!`` is not allowed and ignored.
    """
    known = {**(macros or {}), **parse_macros(content)}

    def expanded(words: list[str], inside: tuple[str, ...] = ()) -> Iterator[str]:
        for word in words:
            yield word
            if word in known and word not in inside:
                yield from expanded(known[word], (*inside, word))

    rules = []
    for number, line in enumerate((content or "").splitlines(), 1):
        line = line.strip()
        if not line or line[0] in "#!" or line.startswith("[attr]"):
            continue
        glob, attributes = _words(line)
        values: dict[str, bool | None] = {}
        for word in expanded(attributes):
            told = re.fullmatch(r"([-!]?)linguist-(generated|vendored)(?:=(\w+))?", word)
            if told:
                values[told[2]] = None if told[1] == "!" else not told[1] and (told[3] or "true").lower() not in ("false", "0", "no")
        rules += [(number, glob_regex(glob), value, kind) for kind, value in values.items()]
    return rules


def attribute_rules(files: DataFrame) -> DataFrame:
    """(repo, dir, line, regex, value, kind) of attribute files given as (repo, file, content).

    Macros of a repository's root file hold in all its attribute files. One file is parsed at a time.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(repo, file.rpartition("/")[0], *rule) for repo, file, content, root in frame.itertuples(index=False) for rule in parse_attributes(content, parse_macros(root))]
            yield pd.DataFrame(rows, columns=["repo", "dir", "line", "regex", "value", "kind"]).astype({"value": "boolean"})

    found = files.where("repo is not null and file is not null and content is not null").select("repo", tidy(F.col("file")).alias("file"), "content")
    macros = F.array_join(F.filter(F.split("content", "\n"), lambda line: F.trim(line).startswith("[attr]")), "\n")
    roots = found.where("file not like '%/%'").groupBy("repo").agg(F.max(macros).alias("root"))
    return found.join(roots, "repo", "left").mapInPandas(run, "repo string, dir string, line int, regex string, value boolean, kind string")


def whole_attribute_files(files: DataFrame) -> DataFrame:
    """(repo, file, content) of the attribute files of (repo, file, head, n_bytes) whose head is all of the file.

    A cut file is refused, as the rules that it lacks could turn what the others say; its repository then counts
    as one that declares nothing there.
    """
    named = files.where(F.col("file").rlike(r"(^|[/\\])\.gitattributes$") & F.col("head").isNotNull())
    return named.where(F.coalesce(F.octet_length("head") >= F.col("n_bytes"), F.lit(True))).select("repo", "file", F.col("head").alias("content"))


def declared(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, path, declared): what attribute files say of (repo, path); no row where they say nothing.

    Per attribute the deepest directory and then the last line win, also where they make it unspecified; a file is
    out if either attribute is set, and kept if one is unset and none set. The rules of a directory are copied to
    ``SALTS`` parts, so the files of one repository are spread over as many keys.
    """
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    own = F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int").alias("salt")
    placed = paths.where("repo is not null and path is not null").select("repo", "path", F.explode(above).alias("dir"), own)
    copied = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    below = F.expr("if(dir = '', path, substring(path, length(dir) + 2))")
    hits = placed.join(copied, ["repo", "dir", "salt"]).withColumn("rest", below).where(F.expr("rest rlike regex"))
    order = F.struct(F.size(F.split("dir", "/")) - F.when(F.col("dir") == "", 1).otherwise(0), "line")
    last = hits.groupBy("repo", "path", "kind").agg(F.max_by("value", order).alias("value"))
    return last.where("value is not null").groupBy("repo", "path").agg(F.max("value").alias("declared"))


def conventional(path: Column) -> Column:
    """True where a convention of public tools names the path."""
    rules = parse_attributes(CONVENTIONS)
    return F.lower(path).rlike("|".join(f"(?:{regex})" for _, regex, value, _ in rules if value))


def visible(head: Column, lines: Column, size: Column) -> Column:
    """Kind of evidence in the file itself, or null."""
    digits = F.length(F.regexp_replace(head, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(head, r"[^\p{L}]", ""))
    first = F.length(F.substring_index(head, "\n", 1))
    per_line = F.when(lines > 0, size / lines)
    return (
        F.when(head.rlike(GENERATED_COMMENT), "generated")
        .when(head.rlike(VENDORED_COMMENT), "vendored")
        .when(head.rlike(COMPILED_HEAD), "built")
        .when(head.rlike(ENCODED_STRING) | ((F.length(head) >= 100) & (digits > letters)), "data")
        .when((per_line >= WIDE) | (first >= 2 * WIDE), "minified")
        .when(lines.isNull() & head.isNull() & (size >= HUGE), "data")
    )


def path_patterns(path: Column) -> Column:
    """Abstract forms of a path: the end of its name where that says more than the file type, and each of its last three
    directories with the shape of what lies below."""
    low = F.regexp_replace(F.regexp_replace(F.lower(path), r"[0-9]+(\.[0-9]+)+", "#"), r"(?<=[.-])[0-9a-f]{8,}(?=\.)", "#")
    parts = F.split(low, "/")
    count = F.size(parts)
    name = F.element_at(parts, -1)
    told = F.regexp_extract(name, r"[._-][^._-]+\.[^.]+$", 0)
    end = F.when(told != "", F.array(F.concat(F.lit("*"), told))).otherwise(F.array().cast("array<string>"))
    word = r"[a-z][a-z0-9]*"
    shapes = F.transform(parts, lambda p, i: F.when(i < count - 1, F.regexp_replace(p, word, "*")).otherwise(F.regexp_replace(p, word + r"(?=.*\.[^.]+$)", "*")))
    tails = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(3), count - 1)),
        lambda k: F.concat(F.element_at(parts, (count - k).cast("int")), F.lit("/"), F.array_join(F.slice(shapes, (count - k + 1).cast("int"), k), "/")),
    )
    return F.when(count > 1, F.array_union(end, tails)).otherwise(end)


def deep_patterns(path: Column) -> Column:
    """Each directory of a path with the file type at any depth below it."""
    parts = F.split(F.lower(path), "/")
    kind = F.regexp_extract(F.element_at(parts, -1), r"\.[^.]+$", 0)
    return F.array_distinct(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda d: F.concat(d, F.lit("/**"), kind)))


def phrases(head: Column) -> Column:
    """Runs of three words of the comment lines before the first line of code, with the ends of a line as words and
    numbers as ``#``; none where the head is null or starts with code."""
    lines = F.split(head, "\r?\n")
    code = F.array_position(F.transform(lines, lambda x: ~(x.rlike(COMMENT) | x.rlike(r"^\s*([\"']use \w+[\"'];?\s*)?$"))), F.lit(True))
    leading = F.when(code > 0, F.slice(lines, 1, F.greatest(code - 1, F.lit(0)).cast("int"))).otherwise(lines)

    def runs(line: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+(\.[0-9]+)*", " # "), r"[^\p{L}#@]+", " "))
        words = F.concat(F.array(F.lit("^")), F.split(plain, " +"), F.array(F.lit("$")))
        many = F.greatest(F.size(words) - 2, F.lit(1))
        return F.when(plain != "", F.transform(F.sequence(F.lit(1), many), lambda i: F.concat_ws(" ", F.slice(words, i, 3)))).otherwise(F.array().cast("array<string>"))

    return F.coalesce(F.array_distinct(F.flatten(F.transform(leading, runs))), F.array().cast("array<string>"))


def significant(rows: DataFrame, deviations: float, least: float) -> DataFrame:
    """(pattern) of (repo, pattern, known, marked): those whose share of marked among known files has a lower bound
    of ``least`` or more at so many deviations (Wilson's score), and that at least ``LEAST_REPOS`` repositories have."""
    counted = rows.where("known").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("marked").cast("int")).alias("m"), F.approx_count_distinct("repo").alias("repos"))
    share, z = F.col("m") / F.col("n"), deviations * deviations
    middle = share + z / (2 * F.col("n"))
    margin = deviations * F.sqrt(share * (1 - share) / F.col("n") + z / (4 * F.col("n") * F.col("n")))
    return counted.where((F.col("repos") >= LEAST_REPOS) & ((middle - margin) / (1 + z / F.col("n")) >= least)).select("pattern")


def mined(judged: DataFrame) -> DataFrame:
    """(pattern): abstract paths that mark files as not hand-written, from (repo, path, known, marked).

    The first pass keeps shapes most of whose known files are marked; the second looks only at files that no such
    shape explains, so a plain directory does not inherit the guilt of what lies below it; the third, over any depth,
    only at files that no shape explains, and asks for a majority again.
    """
    files = judged.select("repo", "path", "known", "marked")
    spread = files.withColumn("pattern", F.explode(path_patterns(F.col("path"))))

    def unexplained(rows: DataFrame, patterns: DataFrame) -> DataFrame:
        explained = spread.join(patterns, "pattern", "left_semi").select("repo", "path").distinct()
        return rows.join(explained, ["repo", "path"], "left_anti")

    strong = cut(significant(spread, 3.0, MAJORITY)).df
    shapes = cut(strong.unionByName(significant(unexplained(spread, strong), 4.0, FAR_ABOVE))).df
    deep = unexplained(files, shapes).withColumn("pattern", F.explode(deep_patterns(F.col("path"))))
    return shapes.unionByName(significant(deep, 3.0, MAJORITY))


def _paths() -> Column:
    return F.concat(path_patterns(F.col("path")), deep_patterns(F.col("path")))


def _fitting(judged: DataFrame, patterns: DataFrame, of: Column, name: str) -> DataFrame:
    """(repo, file, ``name``) of files one of whose patterns ``of`` is among ``patterns``."""
    some = judged.select("repo", "file", F.explode(of).alias("pattern")).join(patterns, "pattern", "left_semi")
    return some.select("repo", "file").distinct().withColumn(name, F.lit(True))


def not_handwritten(files: DataFrame, attributes: DataFrame) -> DataFrame:
    """(repo, file, reason): files of (repo, file, head, n_lines, n_bytes) that people did not write there.

    ``attributes`` is (repo, file, content) of attribute files. Repeated rows count once; a file with
    differing rows is out if any of them is. ``reason`` is declared, the kind of visible evidence, phrase, pattern
    or convention.
    """
    looked = cut(
        files.select(
            "repo", "file", tidy(F.col("file")).alias("path"), visible(F.col("head"), F.col("n_lines"), F.col("n_bytes")).alias("evidence"),
            (F.col("head").isNotNull() | F.col("n_lines").isNotNull()).alias("known"), phrases(F.col("head")).alias("phrases"),
        ).distinct()
    ).df
    says = declared(looked.select("repo", "path").distinct(), attribute_rules(attributes))
    judged = cut(looked.join(says, ["repo", "path"], "left").withColumn("usual", conventional(F.col("path")))).df
    told = F.coalesce("declared", F.col("evidence").isNotNull())
    paths = cut(mined(judged.withColumn("marked", told))).df
    hinted = judged.where(F.size("phrases") > 0).join(_fitting(judged, paths, _paths(), "near"), ["repo", "file"], "left")
    said = hinted.select("repo", "known", F.coalesce("declared", F.col("evidence").isNotNull() | F.col("usual") | F.col("near"), F.lit(False)).alias("marked"), F.explode("phrases").alias("pattern"))
    heard = cut(_fitting(judged, significant(said, 2.0, FAR_ABOVE), F.col("phrases"), "heard")).df
    known = cut(judged.join(heard, ["repo", "file"], "left")).df
    fits = _fitting(known, mined(known.withColumn("marked", F.coalesce(told | F.col("heard"), told))), _paths(), "fits")
    reason = (
        F.when(F.col("declared"), "declared")
        .when(~F.col("declared"), None)
        .when(F.col("evidence").isNotNull(), F.col("evidence"))
        .when(F.col("heard"), "phrase")
        .when(F.col("fits"), "pattern")
        .when(F.col("usual"), "convention")
    )
    decided = known.join(fits, ["repo", "file"], "left").withColumn("reason", reason).where("reason is not null")
    return decided.groupBy("repo", "file").agg(F.min("reason").alias("reason"))
