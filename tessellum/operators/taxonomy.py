"""Counts over the two scope columns, wing and room, and validation of scopes against them."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.groupBy(column).agg(F.count("*").alias("n"))


def count_by_pair(chunks: DataFrame, a: str = "wing", b: str = "room") -> DataFrame:
    return chunks.groupBy(a, b).agg(F.count("*").alias("n"))


def status(chunks: DataFrame) -> DataFrame:
    """One row in all, one a wing and one a room: ``(level, wing, room, n)``, by grouping sets in one pass."""
    sets = chunks.groupingSets([[], ["wing"], ["room"]], "wing", "room").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return sets.select(F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "wing").otherwise("room").alias("level"), "wing", "room", "n")


def summary(chunks: DataFrame) -> DataFrame:
    """drawers, wings, rooms (pairs), from the pair counts."""
    pairs = count_by_pair(chunks)
    return pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("drawers"), F.count_distinct("wing").alias("wings"), F.count("*").alias("rooms"))


def suggestions(value: str, candidates: list[str], n: int = 3, least: float = 0.4) -> list[str]:
    """Close names of a bounded list, best first, then by name."""

    def plain(s: str) -> str:
        return s.lower().replace("-", " ").replace("_", " ").strip()

    scored = [(difflib.SequenceMatcher(None, plain(value), plain(c)).ratio(), c) for c in candidates]
    return [c for r, c in sorted(scored, key=lambda x: (-x[0], x[1])) if r >= least][:n]


def scope_errors(requests: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(wing, room, error)`` of requested scopes; null error where the scope exists or the taxonomy is empty.

    An unknown wing comes first, then an unknown room, then an unknown pair; empty or null parts aren't asked for.
    """
    wings = pairs.select(F.col("wing").alias("w1")).distinct()
    rooms = pairs.select(F.col("room").alias("r1")).distinct()
    both = pairs.select(F.col("wing").alias("w2"), F.col("room").alias("r2")).distinct()
    any_row = pairs.limit(1).select(F.lit(1).alias("_some"))
    asked = requests.join(wings, F.col("wing") == F.col("w1"), "left").join(rooms, F.col("room") == F.col("r1"), "left")
    asked = asked.join(both, (F.col("wing") == F.col("w2")) & (F.col("room") == F.col("r2")), "left").join(F.broadcast(any_row), F.lit(True), "left")
    has_wing, has_room = F.coalesce(F.col("wing"), F.lit("")) != "", F.coalesce(F.col("room"), F.lit("")) != ""
    error = F.when(F.col("_some").isNull(), None).when(has_wing & F.col("w1").isNull(), "unknown_wing").when(has_room & F.col("r1").isNull(), "unknown_room")
    error = error.when(has_wing & has_room & F.col("r2").isNull(), "unknown_wing_room")
    return asked.select("wing", "room", error.alias("error"))
