"""Export and import as JSON lines: one header, then drawers and facts, told apart by ``type``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators.facts_store import TRIPLE, FactStore
from tessellum.operators.store import CHUNK_COLUMNS, VECTOR, ChunkStore
from tessellum.operators.vector import without_near_duplicates

#: Columns of a chunk go by their names, but ``type``, which tells records apart, and the vector.
RENAMED = {"type": "drawer_type", VECTOR: "embedding"}
DRAWER = ", ".join(f"{RENAMED.get(n, n)} {k}" for n, k in (CHUNK_COLUMNS | {VECTOR: "array<float>"}).items())
FACT = TRIPLE


# Strategies of chunks that were written by hand.
MANUAL = ("manual_v1", "diary_v1")


def export_filter(chunks: DataFrame, only_manual: bool = False, wing: str | None = None, room: str | None = None, since: str | None = None) -> DataFrame:
    """Chunks of an export: by hand only, of a wing, of a room, filed at a time or later (unknown times are earlier than all)."""
    rows = chunks.filter(F.col("chunker_strategy").isin(*MANUAL)) if only_manual else chunks
    for column, value in (("wing", wing), ("room", room)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows.filter(F.coalesce("filed_at", F.lit("")) >= since) if since else rows


def drawer_records(chunks: DataFrame) -> DataFrame:
    """``value``: a JSON object a chunk, with its vector where there is one; columns that aren't of a chunk don't go along."""
    names = [F.col(n).alias(RENAMED.get(n, n)) for n in [*CHUNK_COLUMNS, VECTOR] if n in chunks.columns]
    return chunks.select(F.to_json(F.struct(F.lit("drawer").alias("type"), *names)).alias("value"))


def named(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Facts with the names of their entities in place of ids, as far as they are known."""
    names = entities.select("id", "name")
    out = triples
    for side in ("subject", "object"):
        known = names.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
        out = out.join(known, F.col(side) == F.col("_id"), "left").withColumn(side, F.coalesce("_name", side)).drop("_id", "_name")
    return out


def fact_records(triples: DataFrame, since: str | None = None) -> DataFrame:
    """Facts without a start stay with ``since``."""
    rows = triples if since is None else triples.filter(F.col("valid_from").isNull() | (F.col("valid_from") >= since))
    names = [f.split()[0] for f in FACT.split(", ") if f.split()[0] in triples.columns]
    return rows.select(F.to_json(F.struct(F.lit("kg_triple").alias("type"), *names)).alias("value"))


def write(path: str, chunks: DataFrame, triples: DataFrame | None = None, since: str | None = None, filters: dict[str, str] | None = None) -> None:
    """Text files below ``path``, written in parallel, the header in one of its own partitions."""
    facts = fact_records(triples, since) if triples is not None else None
    counts = chunks.agg(F.count("*").alias("drawer_count"))
    counts = counts.crossJoin(facts.agg(F.count("*").alias("kg_count"))) if facts is not None else counts.withColumn("kg_count", F.lit(0))  # a row each
    told = F.to_json(F.create_map(*[F.lit(x) for kv in filters.items() for x in kv])) if filters else F.lit("{}")
    head = counts.select(F.to_json(F.struct(F.lit("export_header").alias("type"), F.lit("1").alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("exported_at"), told.alias("filters"), "drawer_count", "kg_count")).alias("value"))
    out = head.union(drawer_records(chunks))
    (out.union(facts) if facts is not None else out).write.mode("overwrite").text(path)


def parse_drawers(lines: DataFrame) -> DataFrame:
    rows = lines.filter(F.get_json_object("value", "$.type") == "drawer").select(F.from_json("value", DRAWER).alias("r")).select("r.*")
    return rows.withColumnsRenamed({v: k for k, v in RENAMED.items()})


def parse_facts(lines: DataFrame) -> DataFrame:
    return lines.filter(F.get_json_object("value", "$.type") == "kg_triple").select(F.from_json("value", FACT).alias("r")).select("r.*")


def checked_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the lines that aren't blank. One that is no JSON object fails with its file and text."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file")).filter(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull() | ~F.col("value").rlike(r"^\s*\{")
    return lines.select(F.when(bad, F.raise_error(F.concat(F.lit("no JSON object in "), "_file", F.lit(": "), F.left("value", F.lit(80))))).otherwise(F.col("value")).alias("value"))


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Drawers and facts. A line that is no JSON object fails the read: an import is all or nothing."""
    checked = checked_lines(spark, path)
    return parse_drawers(checked), parse_facts(checked)


def import_into(spark: SparkSession, path: str, chunks: ChunkStore, facts: FactStore | None = None, skip_near: float | None = 0.9, wing: str | None = None, dry_run: bool = False) -> dict:
    """Merge an export into stores, chunks as one version and facts as another; counts and warnings.

    All lines are parsed before anything is written. Chunks without text don't count; rows of known ids replace these.
    ``skip_near``: chunks this similar to what the store held before under another id are skipped (None: none are).
    ``wing``: goes in place of theirs. Vectors of the export are kept, missing ones made by the store. ``dry_run`` writes
    nothing and counts the same.
    """
    lines = checked_lines(spark, path)
    kinds = {r["k"]: r["count"] for r in lines.groupBy(F.get_json_object("value", "$.type").alias("k")).count().collect()}
    versions = {r["v"] for r in lines.filter(F.get_json_object("value", "$.type") == "export_header").select(F.get_json_object("value", "$.version").alias("v")).distinct().limit(10).collect()}
    warnings = [] if "export_header" in kinds else ["no header"]
    warnings += [f"made by version {v}" for v in sorted(versions - {None, "1"})]
    rows = parse_drawers(lines).filter("length(coalesce(text, '')) > 0")
    if wing is not None:
        rows = rows.withColumn("wing", F.lit(wing))
    rows = rows.withColumn(VECTOR, F.coalesce(VECTOR, chunks.embed(F.col("text")).cast("array<float>"))).cache()
    told = rows.count()
    kept = rows
    if skip_near is not None and told and chunks.count():
        stored = chunks.read(vectors=True)
        new = rows.join(stored.select("id"), "id", "left_anti")
        near = new.select("id").subtract(without_near_duplicates(new.select("id", VECTOR), stored.select("id", VECTOR), skip_near).select("id"))
        kept = rows.join(near, "id", "left_anti").cache()
    n = kept.count()
    triples = parse_facts(lines)
    out = {"imported_drawers": n, "skipped_duplicates": told - n, "imported_triples": kinds.get("kg_triple", 0) if facts else 0, "warnings": warnings}
    if not dry_run:
        if n:
            chunks.upsert(kept, reason="import")
        if out["imported_triples"]:
            facts.add(triples.drop("id"))
    rows.unpersist()
    return out
