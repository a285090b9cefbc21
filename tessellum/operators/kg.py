"""The temporal graph of facts: triples with validity windows over named entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.temporal import in_window, instant
from tessellum.functions.text import entity_id
from tessellum.operators.lineage import settled

TYPE_PREDICATES = ("inherits", "implements", "extends")
FACT = ("subject", "predicate", "object", "valid_from", "valid_to", "confidence", "source_file")


def _at(as_of: str | None) -> Column | None:
    return None if as_of is None else instant(F.lit(as_of))


def _id(name: str) -> str:
    return name.lower().replace(" ", "_").replace("'", "")


def query_entity(triples: DataFrame, entities: DataFrame, name: str, as_of: str | None = None, direction: str = "outgoing") -> DataFrame:
    """``(direction, subject, predicate, object, valid_from, valid_to, confidence, current)`` of one entity's facts.

    The entity is echoed as asked; a fact about itself comes twice under ``both``; facts whose other end isn't a known
    entity don't come.
    """
    moment, out = _at(as_of), None
    names = entities.select(F.col("id").alias("other"), "name")
    for way, own, far in (("outgoing", "subject", "object"), ("incoming", "object", "subject")):
        if direction not in (way, "both"):
            continue
        rows = triples.filter(F.col(own) == _id(name))
        if moment is not None:
            rows = rows.filter(in_window(F.col("valid_from"), F.col("valid_to"), moment))
        rows = rows.join(names, F.col(far) == F.col("other")).select(
            F.lit(way).alias("direction"),
            (F.lit(name) if own == "subject" else F.col("name")).alias("subject"),
            "predicate",
            (F.lit(name) if own == "object" else F.col("name")).alias("object"),
            "valid_from",
            "valid_to",
            "confidence",
            F.col("valid_to").isNull().alias("current"),
        )
        out = rows if out is None else out.unionAll(rows)
    if out is None:
        raise ValueError(f"unknown direction {direction}")
    return out


def _named(triples: DataFrame, entities: DataFrame) -> DataFrame:
    s = entities.select(F.col("id").alias("subject"), F.col("name").alias("subject_name"))
    o = entities.select(F.col("id").alias("object"), F.col("name").alias("object_name"))
    return triples.join(s, "subject").join(o, "object")


def query_relationship(triples: DataFrame, entities: DataFrame, predicate: str, as_of: str | None = None) -> DataFrame:
    rows = triples.filter(F.col("predicate") == predicate.lower().replace(" ", "_"))
    if as_of is not None:
        rows = rows.filter(in_window(F.col("valid_from"), F.col("valid_to"), _at(as_of)))
    return _named(rows, entities).select(F.col("subject_name").alias("subject"), "predicate", F.col("object_name").alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current"))


def timeline(triples: DataFrame, entities: DataFrame, name: str | None = None, limit: int = 100) -> DataFrame:
    """The first facts by valid_from as text, open ones last, ties by id."""
    rows = triples if name is None else triples.filter((F.col("subject") == _id(name)) | (F.col("object") == _id(name)))
    named = _named(rows, entities).orderBy(F.asc_nulls_last("valid_from"), "id").limit(limit)
    return named.select("id", F.col("subject_name").alias("subject"), "predicate", F.col("object_name").alias("object"), "valid_from", "valid_to", F.col("valid_to").isNull().alias("current"))


def as_of_join(moments: DataFrame, triples: DataFrame, key: str, moment: str = "at") -> DataFrame:
    """Each row of ``moments`` with the facts of its ``key`` (a subject) that hold at its moment: an equi-join on the
    subject with the window as a condition beside it, so nothing is compared across subjects."""
    windows = triples.select(*[F.col(c) for c in ("id", "subject", "predicate", "object", "valid_from", "valid_to")])
    return moments.join(windows, (F.col(key) == F.col("subject")) & in_window(F.col("valid_from"), F.col("valid_to"), F.col(moment)))


def stats(triples: DataFrame, entities: DataFrame) -> DataFrame:
    t = triples.agg(
        F.count("*").alias("triples"),
        F.count_if(F.col("valid_to").isNull()).alias("current_facts"),
        F.count_if(F.col("valid_to").isNotNull()).alias("expired_facts"),
        F.array_join(F.sort_array(F.collect_set("predicate")), ",").alias("predicates"),
    )
    return entities.agg(F.count("*").alias("entities")).crossJoin(t)  # two single rows


def window_errors(triples: DataFrame) -> DataFrame:
    """Rows whose bounds aren't temporal text or end before they start (a date counts as its midnight)."""
    bad = lambda c: F.col(c).isNotNull() & instant(F.col(c)).isNull()
    error = F.when(bad("valid_from"), "invalid valid_from").when(bad("valid_to"), "invalid valid_to").when(instant(F.col("valid_to")) < instant(F.col("valid_from")), "valid_to before valid_from")
    return triples.withColumn("error", error).filter("error IS NOT NULL")


def add_triples(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Stored and new facts. An incoming fact goes if an open fact of the same three is stored, or came before it in
    order of ``id``; closed facts are no obstacle."""
    key = ["subject", "predicate", "object"]
    open_keys = stored.filter("valid_to IS NULL").select(*key).distinct()
    fresh = incoming.join(open_keys, key, "left_anti")
    before = Window.partitionBy(*key).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    open_before = F.coalesce(F.max(F.col("valid_to").isNull()).over(before), F.lit(False))
    return stored.unionByName(fresh.withColumn("_held", open_before).filter("NOT _held").drop("_held"))


def auto_entities(entities: DataFrame, names: DataFrame) -> DataFrame:
    """Entities with those added that ``names`` (name, order) brings; the first name of an id wins."""
    made = names.select(entity_id(F.col("name")).alias("id"), "name", "order").groupBy("id").agg(F.min_by("name", "order").alias("name"))
    return entities.unionByName(made.join(entities.select("id"), "id", "left_anti").select("id", "name", F.lit("unknown").alias("type")), allowMissingColumns=True)


def invalidate(triples: DataFrame, condition: Column, ended: str) -> DataFrame:
    """Open facts that meet the condition end at ``ended``, unless they only start behind it."""
    start = instant(F.col("valid_from"))
    hit = F.col("valid_to").isNull() & condition & (start.isNull() | (start <= instant(F.lit(ended))))
    return triples.withColumn("valid_to", F.when(hit, F.lit(ended)).otherwise(F.col("valid_to")))


def late_starts(triples: DataFrame, condition: Column, ended: str) -> DataFrame:
    """Open facts that meet the condition and only start behind ``ended``."""
    return triples.filter(F.col("valid_to").isNull() & condition & (instant(F.col("valid_from")) > instant(F.lit(ended))))


def under_root(source_file: Column, root: str) -> Column:
    """Whether a path is the root or below it, at a path boundary."""
    root = root.rstrip("/")
    return (source_file == root) | F.startswith(source_file, F.lit(root + "/"))


def type_chain(triples: DataFrame, name: str, max_depth: int = 3, upward: bool = True, predicates: tuple[str, ...] = TYPE_PREDICATES) -> DataFrame:
    """``(type, relationship, depth)`` of ancestors (or descendants) over open facts, each at its first depth.

    A frontier step a depth, minus what was seen: cycles end, and paths aren't enumerated.
    """
    own, far = ("subject", "object") if upward else ("object", "subject")
    edges = triples.filter(F.col("valid_to").isNull() & F.col("predicate").isin(*predicates)).select(F.col(own).alias("own"), F.col(far).alias("type"), "predicate")
    seen = triples.sparkSession.createDataFrame([(_id(name),)], "type string")
    frontier, out = seen, None
    for depth in range(1, max_depth + 1):
        step = frontier.select(F.col("type").alias("own")).join(edges, "own").join(seen, "type", "left_anti")
        step = settled(step.groupBy("type").agg(F.min("predicate").alias("relationship")).select("type", "relationship", F.lit(depth).alias("depth")))
        out = step if out is None else out.union(step)
        seen, frontier = seen.union(step.select("type")), step.select("type")
    return out
