"""Files to chunks, each by the way of its language and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.code_tables import BOUNDARIES
from tessellum.functions.text import strip
from tessellum.operators import code, manifests, markdown
from tessellum.operators.chunking import MIN_CHARS, chunk_column

# Endings of .NET projects, and the places of Helm and Ansible files.
PROJECTS = (".csproj", ".fsproj", ".vbproj")
HELM_VALUES, ROLE, INVENTORY = r"^values.*\.ya?ml$", r"(?:^|[/\\])roles[/\\]([^/\\]+)[/\\](tasks|handlers|vars|defaults)[/\\]", r"^inventory\.(ini|ya?ml)$"


def route(path: Column, lang: Column) -> Column:
    """The way of a file: project, code, prose, kubernetes, helm_chart, helm_values, helm_template, ansible_vars, ansible_task,
    ansible_handler, ansible_inventory, ansible_play, or lines for all others."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    role = F.regexp_extract(path, ROLE, 2)
    helm = F.when(name == "Chart.yaml", "helm_chart").when(name.rlike(HELM_VALUES), "helm_values").otherwise("helm_template")
    ansible = F.when(role.isin("vars", "defaults"), "ansible_vars").when(role == "tasks", "ansible_task").when(role == "handlers", "ansible_handler").when(name.rlike(INVENTORY), "ansible_inventory").otherwise("ansible_play")
    project = F.regexp_extract(F.lower(path), r"(\.[^./]+)$", 1).isin(*PROJECTS)
    return F.when(project, "project").when(lang.isin(*BOUNDARIES), "code").when(lang.isin("markdown", "text"), "prose").when(lang == "kubernetes", "kubernetes").when(lang == "helm", helm).when(lang == "ansible", ansible).otherwise("lines")


# What a chunk of prose tells about its section, and of none.
SECTION = {"heading": "", "heading_level": 0, "heading_path": "", "doc_section_type": "", "contains_mermaid": 0, "contains_code": 0, "contains_table": 0}


def chunk_files(files: DataFrame, path_col: str = "path", text_col: str = "text", lang: Column | None = None, metadata: bool = False, look: bool = False) -> DataFrame:
    """``(path, route, chunk_index, content, symbol_name, symbol_type)`` of files of all kinds; with ``metadata`` also the
    ``language`` and what is known of a section (``SECTION``).

    A project file, an inventory and a role's variables are one chunk each; null and blank texts give none. Each way is a
    filter over the files. ``look``: the ways that there are, of fourteen, are looked up first and no other is planned; for
    files that are written or cached.
    """
    found = code.language(F.col(path_col), F.col(text_col)) if lang is None else lang
    rows = files.select(F.col(path_col).alias("path"), F.col(text_col).alias("text"), found.alias("lang")).withColumn("route", route(F.col("path"), F.col("lang")))
    keep, names = ["path", "route"], ["path", "route", "chunk_index", "content", "symbol_name", "symbol_type"]
    if metadata:
        rows = rows.withColumn("language", F.col("lang"))
        keep, names = [*keep, "language"], [*names, "language", *SECTION]
    of = lambda *ways: rows.filter(F.col("route").isin(*ways))

    def plain(df: DataFrame, name: Column | None = None, kind: Column | None = None) -> DataFrame:
        return sections(df.withColumns({"symbol_name": name if name is not None else F.lit(""), "symbol_type": kind if kind is not None else F.lit("")}))

    def sections(df: DataFrame) -> DataFrame:
        """All columns of the result, without those that the way of a file doesn't give."""
        return df.select(*[F.lit(SECTION[c]).alias(c) if c in SECTION and c not in df.columns else F.col(c) for c in names])

    def whole(df: DataFrame, least: int, name: Column, kind: Column) -> DataFrame:
        out = df.select(*keep, strip(F.col("text")).alias("content"), F.lit(0).alias("chunk_index")).filter(F.length("content") >= least)
        return plain(out, name, kind)

    role = F.regexp_extract("path", ROLE, 1)

    def items(kind: str) -> DataFrame:
        found = manifests.ansible_items(of(f"ansible_{kind}"), keep, kind, "")
        return plain(found, F.when(F.col("symbol_name") != "", F.col("symbol_name")).otherwise(role), F.lit(f"ansible_{kind}"))

    def template() -> DataFrame:
        name = manifests.helm_symbol(F.col("content"))
        return plain(chunk_column(of("helm_template"), keep), name, F.lower(F.element_at(F.split(name, "/"), 1)))

    ways = {
        "code": lambda: sections(code.code_chunks(of("code"), keep, F.col("lang"))),
        "prose": lambda: plain(markdown.markdown_chunks(of("prose"), keep)),
        "kubernetes": lambda: sections(manifests.manifest_chunks(of("kubernetes"), keep)),
        "project": lambda: whole(of("project"), MIN_CHARS, F.lit(""), F.lit("")),
        "helm_chart": lambda: plain(chunk_column(of("helm_chart"), keep), manifests.helm_symbol(F.col("content"), chart=True), F.lit("helm_chart")),
        "helm_values": lambda: plain(manifests.helm_values(of("helm_values"), keep), F.lit(""), F.lit("helm_values")),
        "helm_template": template,
        "ansible_vars": lambda: whole(of("ansible_vars"), 1, role, F.lit("ansible_vars")),
        "ansible_inventory": lambda: whole(of("ansible_inventory"), 1, F.lit(""), F.lit("ansible_inventory")),
        "ansible_play": lambda: sections(manifests.ansible_items(of("ansible_play"), keep)),
        "ansible_task": lambda: items("task"),
        "ansible_handler": lambda: items("handler"),
        "lines": lambda: plain(chunk_column(of("lines"), keep)),
    }
    there = {r["route"] for r in rows.select("route").distinct().collect()} if look else ways
    out = None
    for way, chunks in ways.items():
        if way in there or (out is None and way == "lines"):
            out = chunks() if out is None else out.unionByName(chunks())
    return out
