"""Kubernetes, Helm and Ansible files, and relations between types of C#."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.operators.chunking import MIN_CHARS, chunk_column, merge_split

_SCALAR = re.compile(r":\s*[|>][+-]?\d*\s*(#.*)?$")


def yaml_documents(text: str) -> list[str]:
    """Documents between ``---`` at the margin; what belongs to a block scalar parts nothing."""
    docs: list[list[str]] = [[]]
    scalar: int | None = None
    for line in text.splitlines():
        bare, indent = line.strip(), len(line) - len(line.lstrip(" "))
        if scalar is not None and bare and indent <= scalar:
            scalar = None
        if scalar is None and indent == 0 and bare == "---":
            docs.append([])
            continue
        docs[-1].append(line)
        if scalar is None and _SCALAR.search(line):
            scalar = indent
    return ["\n".join(d) for d in docs]


def manifest_chunks(files: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """A chunk a resource with ``Kind/name`` as symbol; short documents go."""

    def chunks(text: str | None) -> list[str]:
        return [c for d in yaml_documents(text or "") if len(d.strip()) >= MIN_CHARS for c in merge_split([d.strip()])]

    out = chunk_column(files, keep, text_col, how=chunks)
    kind = F.regexp_extract("content", r"(?m)^kind:\s*(\w+)", 1)
    name = F.regexp_extract("content", r"(?m)^\s{2}name:\s*(\S+)", 1)
    return out.withColumns({"symbol_name": F.when(kind == "", "").when(name == "", kind).otherwise(F.concat_ws("/", kind, name)), "symbol_type": F.lower(kind)})


_HEAD = r"(?m)^[ \t]*(?:(?:public|internal|private|protected|abstract|sealed|static|partial|readonly|file|new|unsafe)\s+)*(class|struct|interface|record(?:\s+class|\s+struct)?)\s+(\w+)[^\n:{]*:\s*([^\n{;]+(?:,\s*\n[^\n{;]+)*)"


def csharp_relations(files: DataFrame, text_col: str = "text") -> DataFrame:
    """``(subject, predicate, object)``: structs implement, interfaces extend; a class implements what is named like an
    interface (I and a capital) and inherits else. Comments, generic arguments and constraints don't count."""
    code = F.regexp_replace(F.regexp_replace(F.col(text_col), r"(?s)/\*.*?\*/", ""), r"//[^\n]*", "")
    heads = files.select(F.explode(F.regexp_extract_all(code, F.lit(_HEAD), F.lit(0))).alias("h"))
    parts = heads.select(F.regexp_extract("h", _HEAD, 1).alias("kind"), F.regexp_extract("h", _HEAD, 2).alias("subject"), F.regexp_extract("h", _HEAD, 3).alias("b"))
    bases = F.regexp_replace(F.col("b"), r"(?s)\swhere\s.*", "")
    for _ in range(4):  # nested generic arguments from the inside out
        bases = F.regexp_replace(bases, r"<[^<>]*>", "")
    rows = parts.select("kind", "subject", F.explode(F.split(bases, ",")).alias("o")).select("kind", "subject", F.trim(F.regexp_replace("o", r"\(.*|\s+$", "")).alias("object"))
    rows = rows.select("kind", "subject", F.trim(F.regexp_replace("object", r"\s+", "")).alias("object")).filter(F.col("object").rlike(r"^[A-Za-z]"))
    predicate = F.when(F.col("kind").rlike("struct"), "implements").when(F.col("kind") == "interface", "extends").when(F.col("object").rlike("^I[A-Z]"), "implements").otherwise("inherits")
    return rows.select("subject", predicate.alias("predicate"), "object").distinct()


def ansible_items(files: DataFrame, keep: list[str], kind: str = "play", role: str | None = None, text_col: str = "text") -> DataFrame:
    """A chunk a top-level list item of a playbook (``play``) or of a role's ``task`` or ``handler`` file, of any length.

    The symbol is the item's name; a play without one is named by its hosts, an item of a role by the role.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    items = F.filter(F.transform(F.split(text, r"(?m)(?=^- )"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: F.startswith(x, F.lit("- ")))
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = F.when(F.size(items) > 0, items).when(whole != "", F.array(whole)).otherwise(F.array().cast("array<string>"))
    out = files.select(*keep, F.posexplode(parts).alias("chunk_index", "content"))
    quoted = lambda c: F.regexp_replace(F.trim(c), r"^['\"]|['\"]$", "")
    name = quoted(F.regexp_extract("content", r"(?m)^(?:- |  )name:[ \t]*(.+)$", 1))
    hosts = quoted(F.regexp_extract("content", r"(?m)^(?:- |  )hosts:[ \t]*(.+)$", 1))
    other = hosts if kind == "play" else F.lit(role or "")
    return out.withColumns({"symbol_name": F.when(name != "", name).otherwise(other), "symbol_type": F.lit(f"ansible_{kind}")})


def helm_values(files: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Top-level keys of a values file with the comments right above them, merged by size."""

    def chunks(text: str | None) -> list[str]:
        lines, starts = (text or "").split("\n"), []
        for i, line in enumerate(lines):
            if re.match(r"[\w.-]+:", line):
                while i and lines[i - 1].startswith("#"):
                    i -= 1
                starts.append(i)
        cuts = sorted({0, *starts, len(lines)})
        return merge_split([b for b in ("\n".join(lines[a:z]).strip() for a, z in zip(cuts, cuts[1:], strict=False)) if b])

    return chunk_column(files, keep, text_col, how=chunks)


def helm_symbol(content: Column, chart: bool = False) -> Column:
    """``HelmChart/name`` of a chart, or ``Kind/name`` of a template; lines that are template control only don't count,
    and a name that is made by a template is left out."""
    if chart:
        name = F.regexp_replace(F.regexp_extract(content, r"(?m)^name:\s*(\S+)", 1), "['\"]", "")
        return F.when(name != "", F.concat(F.lit("HelmChart/"), name)).otherwise("")
    seen = F.regexp_replace(content, r"(?m)^\s*\{\{.*?\}\}\s*$", "")
    kind, name = F.regexp_extract(seen, r"(?m)^kind:\s*(\w+)", 1), F.regexp_extract(seen, r"(?m)^\s{2}name:\s*(\S+)", 1)
    return F.when(kind == "", "").when((name == "") | F.contains(name, F.lit("{{")), kind).otherwise(F.concat_ws("/", kind, name))
