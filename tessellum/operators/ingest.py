"""Incremental ingest: what has changed between the stored and the walked files, and keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def file_changes(stored: DataFrame, walked: DataFrame) -> DataFrame:
    """``(source_file, change)``: new, changed or deleted, by one full join on the file; unchanged files don't come."""
    s = stored.select("source_file", F.col("source_hash").alias("old"))
    w = walked.select("source_file", F.col("source_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "deleted").otherwise("changed")
    return s.join(w, "source_file", "full_outer").filter(~F.col("old").eqNullSafe(F.col("new"))).select("source_file", change.alias("change"))


def stale(stored: DataFrame, walked: DataFrame) -> DataFrame:
    return stored.select("source_file").distinct().join(walked.select("source_file"), "source_file", "left_anti")


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "id", order: str | None = None, place: str | None = None) -> DataFrame:
    """Stored rows whose key doesn't come in, and the last incoming row of each key (by ``order``, else the greatest).

    Of several rows that are last by ``order`` the first by ``place`` is taken (left out: any of them); ``place`` is dropped.
    """
    if not order:
        last = incoming.groupBy(key).agg(F.max(F.struct(*[c for c in incoming.columns if c != key])).alias("_m")).select(key, "_m.*").select(*incoming.columns)
    else:
        by = [F.desc(order), *([F.asc(place)] if place else [])]
        last = incoming.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*by))).filter("_k = 1").drop("_k", *([place] if place else []))
    return stored.join(incoming.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def newest_per_kind(rows: DataFrame, keep: int, kind: str = "kind", age: str = "mtime", name: str = "name") -> DataFrame:
    """Rows with ``retained``: the newest ``keep`` of each kind, by time and name."""
    w = Window.partitionBy(kind).orderBy(F.desc(age), F.desc(name))
    return rows.withColumn("retained", F.row_number().over(w) <= keep)


def distinct_sources(chunks: DataFrame, wing: str) -> DataFrame:
    """``(source_file)`` of a wing, each once."""
    return chunks.filter(F.col("wing") == wing).select("source_file").distinct()


def first_hashes(chunks: DataFrame, wing: str) -> DataFrame:
    """``(source_file, source_hash)`` of a wing: the hash of each file's first chunk (ties by id)."""
    return chunks.filter(F.col("wing") == wing).groupBy("source_file").agg(F.min_by("source_hash", F.struct("chunk_index", "id")).alias("source_hash"))
