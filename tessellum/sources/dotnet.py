"""Project and solution files of .NET as facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1), r"\.[^.]*$", "")


def project_facts(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(subject, predicate, object)``: frameworks, output type, packages (``name@version``) and referenced projects.

    Elements are found whatever their namespace; a file that is no XML gives nothing.
    """
    t = F.regexp_replace(F.col(text_col), r'(?s)<\?xml.*?\?>|<!--.*?-->|\sxmlns(:\w+)?="[^"]*"', "")
    rows = files.select(_stem(F.col(path_col)).alias("subject"), t.alias("x")).filter(F.col("x").rlike(r"(?s)^\s*<Project\b.*</Project>\s*$"))
    facts = F.concat(
        F.transform(F.flatten(F.transform(F.xpath("x", F.lit("//TargetFramework/text()")), lambda v: F.array(v))), lambda v: F.struct(F.lit("targets_framework").alias("p"), v.alias("o"))),
        F.transform(F.flatten(F.transform(F.xpath("x", F.lit("//TargetFrameworks/text()")), lambda v: F.split(v, ";"))), lambda v: F.struct(F.lit("targets_framework").alias("p"), v.alias("o"))),
        F.transform(F.xpath("x", F.lit("//OutputType/text()")), lambda v: F.struct(F.lit("has_output_type").alias("p"), v.alias("o"))),
        F.transform(F.regexp_extract_all("x", F.lit(r"<PackageReference\b[^>]*>"), F.lit(0)), lambda e: F.struct(F.lit("depends_on").alias("p"), _package(e).alias("o"))),
        F.transform(F.xpath("x", F.lit("//ProjectReference/@Include")), lambda v: F.struct(F.lit("references_project").alias("p"), _stem(v).alias("o"))),
    )
    return rows.select("subject", F.explode(facts).alias("f")).select("subject", F.col("f.p").alias("predicate"), F.trim("f.o").alias("object")).filter("object <> ''")


def _package(element: Column) -> Column:
    name, version = (F.regexp_extract(element, rf'\b{a}="([^"]*)"', 1) for a in ("Include", "Version"))
    return F.when((name != "") & (version != ""), F.concat_ws("@", name, version)).otherwise(name)


def solution_facts(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``contains_project`` facts of the real projects of a solution; its folders don't count."""
    rx = r'(?m)^Project\("[^"]*"\)\s*=\s*"([^"]+)",\s*"([^"]+\.(?i:csproj|fsproj|vbproj))"'
    return files.select(_stem(F.col(path_col)).alias("subject"), F.lit("contains_project").alias("predicate"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(rx), F.lit(1))).alias("object"))


def architecture_facts(types: DataFrame, project: str, patterns: dict[str, list[str]], layers: list[tuple[str, list[str], list[str]]]) -> DataFrame:
    """``(subject, predicate, object, source_file)``: patterns and layer of each type (``type_name``, ``namespace``,
    ``source_file``), its namespace and project, and the project of each namespace once."""
    from tessellum.operators.code_graph import layer_of, patterns_of

    name, space = F.col("type_name"), F.col("namespace")
    own = [
        types.select(name.alias("subject"), F.lit("is_pattern").alias("predicate"), F.explode(patterns_of(name, patterns)).alias("object"), "source_file"),
        types.select(name.alias("subject"), F.lit("is_layer").alias("predicate"), layer_of(name, space, layers).alias("object"), "source_file").filter("object IS NOT NULL"),
        types.filter(space != "").select(name.alias("subject"), F.lit("in_namespace").alias("predicate"), space.alias("object"), "source_file"),
        types.filter(space != "").select(space.alias("subject")).distinct().select("subject", F.lit("in_project").alias("predicate"), F.lit(project).alias("object"), F.lit(f"namespace:{project}").alias("source_file")),
        types.select(name.alias("subject"), F.lit("in_project").alias("predicate"), F.lit(project).alias("object"), "source_file"),
    ]
    out = own[0]
    for part in own[1:]:
        out = out.union(part)
    return out.distinct()
