"""Relations between types of F#, VB.NET and C# files, and their choice by file ending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.operators.code import python_relations
from tessellum.operators.manifests import csharp_relations

# Lines of F# and VB.NET that open a type, end it, and name what it stands on.
FS_TYPE, FS_MODULE, FS_INHERIT, FS_INTERFACE = r"^\s*type\s+(\w+)", r"^\s*module\s+\w+", r"^\s+inherit\s+(\w+)", r"^\s+interface\s+(\w+)"
VB_CLASS = r"(?i)^\s*(?:(?:Protected\s+Friend|Private\s+Protected|Public|Private|Protected|Friend)\s+)?(?:(?:Partial|MustInherit|NotInheritable|Shadows)\s+)*Class\s+(\w+)"
VB_STRUCT = r"(?i)^\s*(?:(?:Protected\s+Friend|Private\s+Protected|Public|Private|Protected|Friend)\s+)?(?:(?:Partial|Shadows)\s+)*Structure\s+(\w+)"
VB_INTERFACE = r"(?i)^\s*(?:(?:Protected\s+Friend|Private\s+Protected|Public|Private|Protected|Friend)\s+)?(?:(?:Partial|Shadows)\s+)*Interface\s+(\w+)"
VB_INHERITS, VB_IMPLEMENTS, VB_END = r"(?i)^\s*Inherits\s+(\w+)", r"(?i)^\s*Implements\s+(.+)", r"(?i)^\s*End\s+(?:Class|Structure|Interface)\b"


def _lines(files: DataFrame, path_col: str, text_col: str) -> DataFrame:
    return files.select(F.col(path_col).alias("_file"), F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "line"))


def _scoped(lines: DataFrame, opened: Column, kind: Column) -> DataFrame:
    """Lines with the ``type`` and ``kind`` that stand open at them; ``opened`` is '' at a line that ends a type, null at others."""
    so_far = Window.partitionBy("_file").orderBy("_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.when(opened.isNotNull(), F.struct(opened.alias("type"), kind.alias("kind")))
    return lines.withColumn("_at", F.last(at, ignorenulls=True).over(so_far)).withColumn("_opens", opened.isNotNull()).filter(~F.col("_opens") & (F.col("_at.type") != ""))


def fsharp_relations(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(subject, predicate, object)``: what types inherit, and the interfaces that they implement, up to the next type or module."""
    line = F.col("line")
    opened = F.when(line.rlike(FS_TYPE), F.regexp_extract(line, FS_TYPE, 1)).when(line.rlike(FS_MODULE), F.lit(""))
    rows = _scoped(_lines(files, path_col, text_col), opened, F.lit("type"))
    said = F.when(line.rlike(FS_INHERIT), F.struct(F.lit("inherits").alias("p"), F.regexp_extract(line, FS_INHERIT, 1).alias("o"))).when(line.rlike(FS_INTERFACE), F.struct(F.lit("implements").alias("p"), F.regexp_extract(line, FS_INTERFACE, 1).alias("o")))
    return rows.withColumn("_x", said).filter("_x IS NOT NULL").select(F.col("_at.type").alias("subject"), F.col("_x.p").alias("predicate"), F.col("_x.o").alias("object")).distinct()


def vbnet_relations(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(subject, predicate, object)`` of classes, structures and interfaces up to their end: an interface extends what a class
    inherits; of generic interfaces the name counts."""
    line = F.col("line")
    opened, kind = F.when(line.rlike(VB_END), F.lit("")), F.lit("")
    for pattern, what in ((VB_CLASS, "class"), (VB_STRUCT, "struct"), (VB_INTERFACE, "interface")):
        opened = opened.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1))
        kind = F.when(line.rlike(pattern), F.lit(what)).otherwise(kind)
    rows = _scoped(_lines(files, path_col, text_col), opened, kind)
    bases = F.when(line.rlike(VB_INHERITS), F.array(F.struct(F.when(F.col("_at.kind") == "interface", "extends").otherwise("inherits").alias("p"), F.regexp_extract(line, VB_INHERITS, 1).alias("o"))))
    names = F.filter(F.transform(F.split(F.regexp_extract(line, VB_IMPLEMENTS, 1), ","), lambda x: F.trim(F.element_at(F.split(F.trim(x), r"\("), 1))), lambda x: x != "")
    bases = bases.when(line.rlike(VB_IMPLEMENTS), F.transform(names, lambda x: F.struct(F.lit("implements").alias("p"), x.alias("o"))))
    return rows.select(F.col("_at.type").alias("subject"), F.explode(bases).alias("_x")).select("subject", F.col("_x.p").alias("predicate"), F.col("_x.o").alias("object")).distinct()


def type_relations(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """Relations of all files by their ending: ``.py``, ``.cs``, ``.fs`` and ``.fsi``, ``.vb``; others give none."""
    ending = F.lower(F.regexp_extract(path_col, r"(\.[^./]+)$", 1))
    of = lambda *ends: files.filter(ending.isin(*ends))
    out = python_relations(of(".py"), path_col, text_col).union(csharp_relations(of(".cs"), text_col))
    return out.union(fsharp_relations(of(".fs", ".fsi"), path_col, text_col)).union(vbnet_relations(of(".vb"), path_col, text_col)).distinct()
