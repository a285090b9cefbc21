"""Code: languages of files, structural chunks, the symbol of a chunk, and relations between types."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.code_tables import ANNOTATIONS, BOUNDARIES, COMMENTS, IMPORT, LANGUAGES, MORE_COMMENTS, ONLY_ANNOTATIONS, SCRIPTS, SYMBOLS
from tessellum.functions.text import strip
from tessellum.operators.chunking import chunk_lines, merge_blocks

OWN = "__tessellum_"


def language(path: Column, content: Column | None = None) -> Column:
    """By file ending; a script's first line may name python, node or a shell; Kubernetes manifests by their keys."""
    ending = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])[ending]
    if content is None:
        return F.coalesce(known, F.lit("unknown"))
    first = F.regexp_extract(content, r"\A#!([^\n]*)", 1)
    shebang = F.when(F.contains(first, F.lit("python")), "python").when(F.contains(first, F.lit("node")), "javascript").when(first.rlike(r"\b(ba|z|k)?sh\b"), "shell")
    k8s = known.isin("yaml") & content.rlike(r"(?m)^apiVersion:\s") & content.rlike(r"(?m)^kind:\s")
    return F.when(k8s, "kubernetes").otherwise(F.coalesce(known, shebang, F.lit("unknown")))


def _by_language(lang: Column, of: Callable[[str], Column], names: list[str], other: Column) -> Column:
    """``of(name)`` of the row's language; languages with equal expressions share a branch."""
    out = None
    for name in names:
        out = F.when(lang == name, of(name)) if out is None else out.when(lang == name, of(name))
    return other if out is None else out.otherwise(other)


def symbol(content: Column, lang: Column) -> Column:
    """Struct ``symbol_name``, ``symbol_type`` of the first declaration found; empty without one; chunks of scripts that
    start with an import and declare nothing are ``import``."""

    def pair(name: Column, kind: str) -> Column:
        return F.struct(name.alias("symbol_name"), F.lit(kind).alias("symbol_type"))

    none = pair(F.lit(""), "")

    def of(name: str) -> Column:
        imports = F.regexp_extract(content, r"\A\s*(import\s|from\s|require\s*\()", 1) != ""
        out = None
        for pattern, kind in SYMBOLS[name]:
            expression = "(?m)" + pattern
            found = F.when(content.rlike(expression), pair(F.regexp_extract(content, expression, 1), kind))
            out = found if out is None else F.coalesce(out, found)
        return F.coalesce(out, F.when(imports, pair(F.lit(""), "import")), none) if name in SCRIPTS else F.coalesce(out, none)

    return _by_language(lang, of, list(SYMBOLS), none)


def code_blocks(files: DataFrame, lang: Column, text_col: str = "text", row: str = f"{OWN}row") -> DataFrame:
    """``(row, nth, block)``: stretches of lines that start at declarations, with the comments right above them, and at runs
    of imports. Files of other languages, and without a declaration, give none.

    A run of comment lines and the line behind it are one group, and a group with a declaration starts a stretch; so the
    stretches come from running sums over the table of lines.
    """
    known = files.select(row, lang.alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isin(list(BOUNDARIES)))
    lines = known.select(row, "lang", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).withColumn("bare", strip(F.col("line")))
    scripts = F.col("lang").isin(list(SCRIPTS))
    imports = scripts & F.col("bare").rlike(IMPORT)
    declares = _by_language(F.col("lang"), lambda k: F.col("line" if k in SCRIPTS else "bare").rlike(BOUNDARIES[k]), list(BOUNDARIES), F.lit(False))

    def comment(k: str) -> Column:
        starts = [F.col("bare").startswith(c) for c in (*COMMENTS, *MORE_COMMENTS.get(k, ()))]
        any_of = starts[0]
        for s in starts[1:]:
            any_of = any_of | s
        return any_of & (~F.col("bare").startswith("@") | F.col("bare").rlike(ANNOTATIONS)) if k in ONLY_ANNOTATIONS else any_of

    said = _by_language(F.col("lang"), comment, list(MORE_COMMENTS), comment(""))
    marked = lines.select(row, "pos", "line", imports.alias("imports"), (declares & ~imports & (F.col("bare") != "")).alias("declares"), (said & (F.col("bare") != "")).alias("comment"))
    order = Window.partitionBy(row).orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    above = {c: F.coalesce(F.lag(c).over(order), F.lit(False)) for c in ("comment", "imports")}
    grouped = marked.withColumn("group", F.sum(F.when(above["comment"], 0).otherwise(1)).over(so_far)).withColumn("first_import", F.col("imports") & ~above["imports"]).withColumn("first_of_group", ~above["comment"])
    started = grouped.withColumn("starts", (F.max("declares").over(Window.partitionBy(row, "group")) & F.col("first_of_group")) | F.col("first_import"))
    counted = started.withColumn("nth", F.sum(F.col("starts").cast("int")).over(so_far)).withColumn("some", F.max("starts").over(Window.partitionBy(row)))
    blocks = counted.filter("some").groupBy(row, "nth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("line", F.lit("")).alias("line")))), lambda x: x["line"]), "\n").alias("block"))
    return blocks.select(row, "nth", strip(F.col("block")).alias("block")).filter("block <> ''")


def code_chunks(files: DataFrame, keep: list[str], lang: str | Column, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` with ``chunk_index``, ``content``, ``symbol_name`` and ``symbol_type`` of the chunks of files.

    Blocks are merged and split by size in the order of the file; files of a language without boundaries, and without any
    declaration, are cut at blank lines. Null and short texts give no chunk.
    """
    language_of = F.lit(lang) if isinstance(lang, str) else lang
    rows = files.withColumn(f"{OWN}row", F.monotonically_increasing_id())
    blocks = code_blocks(rows, language_of, text_col).groupBy(f"{OWN}row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "block"))), lambda x: x["block"]).alias(f"{OWN}blocks"))
    joined = rows.select(*keep, f"{OWN}row", F.col(text_col).alias(f"{OWN}text"), language_of.alias(f"{OWN}lang")).join(blocks, f"{OWN}row", "left")
    out = merge_blocks(joined.drop(f"{OWN}row"), [*keep, f"{OWN}lang"], f"{OWN}blocks", f"{OWN}text", chunk_lines)
    return out.withColumn(f"{OWN}s", symbol(F.col("content"), F.col(f"{OWN}lang"))).select(*keep, "chunk_index", "content", f"{OWN}s.symbol_name", f"{OWN}s.symbol_type")


# Bases that make a Python class an implementation.
ABSTRACT = ("ABC", "ABCMeta", "Protocol")


def python_relations(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``(subject, predicate, object)`` of Python files: class bases, and the modules that a module imports."""
    code = F.regexp_replace(F.col(text_col), r"#[^\n]*", "")
    stem = F.regexp_extract(path_col, r"([^/]+)\.py$", 1)
    module = F.when(stem == "__init__", F.regexp_extract(path_col, r"([^/]+)/__init__\.py$", 1)).otherwise(stem)
    base = files.select(module.alias("module"), code.alias("code"))
    heads = base.select(F.explode(F.regexp_extract_all("code", F.lit(r"(?m)^\s*class\s+(\w+\s*\([^)\n]*\))\s*:"), F.lit(1))).alias("head"))
    bases = heads.select(F.regexp_extract("head", r"^(\w+)", 1).alias("subject"), F.explode(F.split(F.regexp_replace(F.regexp_extract("head", r"\((.*)\)", 1), r"\[.*?\]", ""), ",")).alias("b"))
    bases = bases.select("subject", F.regexp_replace(F.trim("b"), r"\]+$", "").alias("object")).filter(F.col("object").rlike(r"^[A-Za-z][\w.]*$"))
    classes = bases.select("subject", F.when(F.col("object").isin(*ABSTRACT), "implements").otherwise("inherits").alias("predicate"), "object")
    plain = base.select("module", F.explode(F.regexp_extract_all("code", F.lit(r"(?m)^import[ \t]+([^\n;]+)"), F.lit(1))).alias("m")).select("module", F.explode(F.split("m", ",")).alias("m"))
    plain = plain.select("module", F.trim(F.element_at(F.split("m", " as "), 1)).alias("m")).filter(F.col("m").rlike(r"^[A-Za-z_][\w.]*$"))
    from_ = base.select("module", F.explode(F.regexp_extract_all("code", F.lit(r"(?m)^from[ \t]+([A-Za-z_][\w.]*)[ \t]+import\b"), F.lit(1))).alias("m"))
    imports = plain.union(from_).select(F.col("module").alias("subject"), F.lit("depends_on").alias("predicate"), F.col("m").alias("object"))
    return classes.union(imports).distinct()
