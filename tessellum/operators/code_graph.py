"""Facts about code: implementations, references, project graphs, patterns and layers of types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.text import glob_regex
from tessellum.operators.lineage import settled

# Predicates of facts and the categories they belong to.
CATEGORIES = {"implements": "implementations", "inherits": "subclasses", "extends": "extensions", "depends_on": "dependents", "references_project": "project_references"}
PROJECT_PREDICATES = ("contains_project", "depends_on", "references_project", "targets_framework", "has_output_type")
ABSTRACT_BASES = ("abc", "abcmeta", "protocol")


def _open(facts: DataFrame) -> DataFrame:
    return facts.filter(F.col("valid_to").isNull())


def implementations(facts: DataFrame, interface: str) -> DataFrame:
    """``(type, relationship)``: what implements the interface; also what inherits it, if it is an abstract base itself."""
    rows = _open(facts)
    direct = rows.filter((F.col("object") == interface) & (F.col("predicate") == "implements"))
    abstract = rows.filter((F.col("subject") == interface) & (F.col("predicate") == "implements") & F.lower("object").isin(*ABSTRACT_BASES)).select(F.col("subject").alias("_base")).distinct()
    by_base = rows.filter((F.col("object") == interface) & (F.col("predicate") == "inherits")).join(abstract, F.col("object") == F.col("_base"), "left_semi")
    both = direct.select("subject", "predicate").union(by_base.select("subject", "predicate"))
    return both.groupBy(F.col("subject").alias("type")).agg(F.min("predicate").alias("relationship"))


def references(facts: DataFrame, name: str) -> DataFrame:
    """``(category, n, types)`` of the open facts that point at a type."""
    of = F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv])
    rows = _open(facts).filter(F.col("object") == name).select(F.coalesce(of[F.col("predicate")], F.col("predicate")).alias("category"), "subject")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("subject")), ",").alias("types"))


def project_graph(facts: DataFrame, solution: str | None = None) -> DataFrame:
    """``(predicate, subject, object)`` of project facts, of one solution and the projects it contains if one is given."""
    rows = _open(facts).filter(F.col("predicate").isin(*PROJECT_PREDICATES)).select("predicate", "subject", "object").distinct()
    if solution is None:
        return rows
    inside = rows.filter((F.col("subject") == solution) & (F.col("predicate") == "contains_project")).select(F.col("object").alias("_in"))
    own = rows.filter(F.col("subject") == solution)
    return own.union(rows.filter(F.col("subject") != solution).join(inside, F.col("subject") == F.col("_in"), "left_semi"))


def patterns_of(type_name: Column, patterns: dict[str, list[str]]) -> Column:
    """Names of all patterns of which a suffix ends the type's name or stands in it."""
    hits = [F.when(F.greatest(*[F.contains(type_name, F.lit(s)).cast("int") for s in suffixes], F.lit(0)) == 1, F.lit(name)) for name, suffixes in patterns.items()]
    return F.array_compact(F.array(*hits))


def layer_of(type_name: Column, namespace: Column, layers: list[tuple[str, list[str], list[str]]]) -> Column:
    """The one layer of a type: by namespace glob first, then by name suffix, in order of declaration."""
    out = F.lit(None).cast("string")
    for name, _, suffixes in reversed(layers):
        for s in suffixes:
            out = F.when(F.endswith(type_name, F.lit(s)), name).otherwise(out)
    for name, globs, _ in reversed(layers):
        for g in globs:
            out = F.when(namespace.rlike(glob_regex(g)), name).otherwise(out)
    return out


def reusable(facts: DataFrame, entity: str, max_depth: int = 3, platform: tuple[str, ...] = ("framework", "platform"), predicates: tuple[str, ...] = ("depends_on", "references_project", "inherits", "implements", "extends", "contains_project")) -> DataFrame:
    """``(name, depth, kind)`` of what an entity reaches: ``platform`` by name, ``glue`` if it depends on some, else ``core``."""
    edges = _open(facts).filter(F.col("predicate").isin(*predicates)).select(F.col("subject").alias("own"), F.col("object").alias("name"))
    seen = facts.sparkSession.createDataFrame([(entity, 0)], "name string, depth int")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = settled(frontier.select(F.col("name").alias("own")).join(edges, "own").select("name").distinct().join(seen, "name", "left_anti").withColumn("depth", F.lit(depth)))
        seen, frontier = seen.union(step), step
    is_platform = F.lit(False)
    for word in platform:
        is_platform = is_platform | F.contains(F.lower("name"), F.lit(word))
    marked = seen.withColumn("platform", is_platform)
    uses = edges.join(marked.filter("platform").select("name"), "name").select(F.col("own").alias("user")).distinct()
    kind = F.when(F.col("platform"), "platform").when(F.col("user").isNotNull(), "glue").otherwise("core")
    return marked.join(uses, F.col("name") == F.col("user"), "left").select("name", "depth", kind.alias("kind"))
