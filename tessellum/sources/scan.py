"""Source trees: files with their bytes, without what names, globs and ignore files leave out."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders and files that no scan reads.
SKIP_DIRS = [".git", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", ".mypy_cache", ".pytest_cache", "target"]
SKIP_FILES = ["package-lock.json", "entities.json"]


@dataclass(frozen=True)
class IgnoreRule:
    regex: str  # of the path below the ignore file's folder, files only
    ignored: bool


def _segment(part: str) -> str:
    """One path segment with ``*``, ``?`` and ``[...]``."""
    out, k = "", 0
    while k < len(part):
        c = part[k]
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "[" and "]" in part[k + 2 :]:
            end = part.index("]", k + 2)
            body = part[k + 1 : end]
            out += f"[{'^' + body[1:] if body[0] == '!' else body}]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return out


def parse_ignore(lines: list[str]) -> list[IgnoreRule]:
    """Rules of an ignore file, in order. A pattern with a slash starts at the file's folder, others match any segment;
    a slash at the end means folders, so something must stand below; ``**`` is any number of segments; ``!`` takes back."""
    rules = []
    for raw in lines:
        line = raw.strip()
        if line.startswith("#") or not line:
            continue
        line = line.removeprefix("\\") if line[:2] in ("\\#", "\\!") else line
        keep = line.startswith("!")
        line = line[1:] if keep else line
        rooted, folder = line.startswith("/"), line.endswith("/")
        parts = [p for p in line.strip("/").split("/") if p]
        if not parts:
            continue
        body = ""
        for k, p in enumerate(parts):
            last = k + 1 == len(parts)
            body += (".*" if last else "(?:[^/]+/)*") if p == "**" else _segment(p) + ("" if last else "/")
        start = "^" if rooted or len(parts) > 1 else "(?:^|/)"
        rules.append(IgnoreRule(start + body + ("/" if folder else "(?:/|$)"), not keep))
    return rules


def ignored(relative: Column, rules: list[IgnoreRule]) -> Column:
    """Whether the last rule that matches ignores the path."""
    verdict = F.lit(False)
    for rule in rules:  # later rules wrap earlier ones
        verdict = F.when(relative.rlike(rule.regex), rule.ignored).otherwise(verdict)
    return verdict


def nested_ignored(relative: Column, files: dict[str, list[str]]) -> Column:
    """As ``ignored`` over ignore files of several folders (relative path -> lines), outer folders first."""
    verdict = F.lit(False)
    for folder in sorted(files, key=lambda f: (f.count("/") if f else -1, f)):
        below = relative if not folder else F.when(F.startswith(relative, F.lit(folder + "/")), F.substring(relative, len(folder) + 2, 1 << 30))
        for rule in parse_ignore(files[folder]):
            verdict = F.when(F.coalesce(below.rlike(rule.regex), F.lit(False)), rule.ignored).otherwise(verdict)
    return verdict


def glob_excluded(relative: Column, globs: list[str]) -> Column:
    """``*`` crosses slashes; ``**/`` is also nothing."""
    from tessellum.functions.text import glob_regex

    hit = F.lit(False)
    for g in globs:
        for form in {g, g.replace("**/", "")} if "**" in g else {g}:
            hit = hit | relative.rlike(glob_regex(form))
    return hit


def select_files(files: DataFrame, root: str, extensions: list[str], ignore: dict[str, list[str]] | None = None, skip_globs: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    """Rows (``path``) of a scan with their ``relative`` path; ``include`` names paths that stay whatever the rules say."""
    rel = F.regexp_replace(F.col("path"), "^(file:)?/*" + re.escape(root.removeprefix("file:").strip("/")) + "/", "")
    rows = files.withColumn("relative", rel)
    name = F.element_at(F.split("relative", "/"), -1)
    folders = F.slice(F.split("relative", "/"), 1, F.greatest(F.size(F.split("relative", "/")) - 1, F.lit(0)))
    known = F.lower(name).rlike("(" + "|".join(re.escape(e) for e in extensions) + ")$")
    out = F.arrays_overlap(folders, F.array(*map(F.lit, SKIP_DIRS))) | name.isin(SKIP_FILES) | glob_excluded(F.col("relative"), skip_globs or []) | nested_ignored(F.col("relative"), ignore or {})
    forced = F.col("relative").isin(include or [])
    return rows.filter(forced | (known & ~out))


def scan(spark: SparkSession, root: str, extensions: list[str], max_bytes: int | None = None, **rules) -> DataFrame:
    """``(path, relative, length, content, source_hash)`` of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rows = select_files(files, root, extensions, **rules)
    content = F.col("content") if max_bytes is None else F.substring("content", 1, max_bytes)
    return rows.select("path", "relative", "length", content.alias("content"), F.sha2("content", 256).alias("source_hash"))
