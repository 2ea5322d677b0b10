"""Modules of a project: which files count, what they import, and where an import leads."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplefold.functions.text import SOURCE_ENDINGS, is_external, is_project_node, joined_path, layer_glob, parent_folder

#: Statements that name a module, and endings that stand for another one's source.
IMPORT = (
    r"//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`"
    r"|(?:(?m:^)\s*(?:import|export)\s+(?:type\s+)?(?:[^'\";`/]*?\sfrom\s*)?|(?<![\w$.])import\(\s*)['\"]([^'\"\n]+)['\"]"
    r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
)
REWRITES = {".js": ".ts", ".jsx": ".tsx", ".mjs": ".mts", ".cjs": ".cts"}
IGNORED = ("node_modules", "dist", "build", "out", "coverage", ".git", ".next", ".turbo", "vendor", "tmp")


def read_tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, content) of the files below a folder, in one distributed read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    base = root.rstrip("/") + "/"
    return files.select(F.regexp_replace("path", f"^(file:/*)?.*?{base.lstrip('/')}", "").alias("path"), F.decode("content", "UTF-8").alias("content"))


def glob_lists(tsconfig: str | None) -> tuple[list[str], list[str]]:
    """(included, excluded) globs of a project file with comments and trailing commas; no file names mean everything."""
    plain = re.sub(r'("(?:[^"\\]|\\.)*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", tsconfig or "{}", flags=re.S)
    told = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain))
    return [*told.get("files", []), *told.get("include", [] if "files" in told else ["**/*"])], told.get("exclude", [])


def included(tree: DataFrame, tsconfig: str | None) -> DataFrame:
    """``project_files`` that a project file names: in one of its globs and in none that it excludes. A glob that names a
    folder stands for all below; without a project file all are in."""
    wanted, left_out = glob_lists(tsconfig)

    def fits(globs: list[str]) -> Column:
        spelled = [g.removeprefix("./").rstrip("/") for g in globs]
        every = [layer_glob(g) for g in spelled] + [layer_glob(f"{g}/**") for g in spelled if "." not in g.rpartition("/")[2]]
        return F.col("path").rlike("|".join(f"(?:{x})" for x in every)) if every else F.lit(False)

    return project_files(tree).where(fits(wanted) & ~fits(left_out))


def project_files(tree: DataFrame) -> DataFrame:
    """Rows of ``tree(path, ...)`` that are source of the project itself."""
    ignored = "|".join(IGNORED).replace(".", r"\.")
    return tree.where(is_project_node(F.col("path")) & ~F.col("path").rlike(f"(^|/)({ignored})/") & F.col("path").rlike("(" + "|".join(e.replace(".", r"\.") for e in SOURCE_ENDINGS) + ")$"))


def imports(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, ord, specifier): static, side-effect, type, re-exported and dynamic imports of literal names, in order
    of place. Comments, strings and templates are passed over whole; a null content imports nothing."""
    found = F.filter(F.regexp_extract_all(content, F.lit(IMPORT), 1), lambda x: x != "")
    return files.where(F.col(content).isNotNull()).select(F.col(path).alias("path"), F.posexplode(found).alias("ord", "specifier"))


def candidates(path: Column, specifier: Column) -> Column:
    """Ordered paths a relative specifier may mean: as written, with endings, rewritten, as a folder's index."""
    base = joined_path(parent_folder(path), specifier)
    plain = [base, *(F.concat(base, F.lit(e)) for e in SOURCE_ENDINGS)]
    rewritten = [F.when(base.endswith(a), F.regexp_replace(base, a.replace(".", r"\.") + "$", b)) for a, b in REWRITES.items()]
    index = [F.concat(base, F.lit("/index" + e)) for e in SOURCE_ENDINGS]
    return F.array(*plain, *rewritten, *index)


def resolved(imported: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """(by..., path, ord, specifier, target, external) of ``imported``; target is the first candidate that is known.

    A specifier that is neither known nor external has a null target.
    """
    rows = imported.withColumn("external", is_external(F.col("specifier")))
    tried = rows.where("not external").select(*by, "path", "ord", "specifier", F.posexplode(candidates(F.col("path"), F.col("specifier"))).alias("at", "target"))
    hit = tried.join(known.select(*by, F.col("path").alias("target")).distinct(), [*by, "target"])
    best = hit.groupBy(*by, "path", "ord").agg(F.min_by("target", "at").alias("target"))
    return rows.join(best, [*by, "path", "ord"], "left").select(*by, "path", "ord", "specifier", "target", "external")


def module_graph(found: DataFrame, known: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): nodes (by..., path, external_imports), kept without edges; edges once with the first specifier."""
    outer = found.where("external").groupBy(*by, "path").agg(F.array_sort(F.collect_set("specifier")).alias("external_imports"))
    nodes = known.select(*by, "path").distinct().join(outer, [*by, "path"], "left").withColumn("external_imports", F.coalesce("external_imports", F.array().cast("array<string>")))
    edges = found.where("target is not null").groupBy(*by, F.col("path").alias("src"), F.col("target").alias("dst")).agg(F.min_by("specifier", "ord").alias("specifier"))
    return nodes, edges


def at_revision(asked: DataFrame, snapshot: DataFrame, by: list[str]) -> DataFrame:
    """Asked paths with the content of the snapshot, null where it has none."""
    return asked.join(snapshot.select(*by, "content"), by, "left")
