"""Layers of recall: identity text, the essential story, chunks of a scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.text import strip

# Chunks, characters and snippet length of the essential story, and its lines.
STORY_CHUNKS, STORY_CHARS, SNIPPET = 15, 3200, 200
TITLE, MORE, NOTHING = "## L1 — ESSENTIAL STORY", "  ... (more in L3 search)", "## L1 — No memories yet."
DEFAULT_IMPORTANCE = 3.0


def token_estimate(text: str) -> int:
    return len(text) // 4


def snippet(text: Column, most: int = SNIPPET) -> Column:
    flat = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > most, F.concat(F.left(flat, F.lit(most - 3)), F.lit("..."))).otherwise(flat)


def essential_story(chunks: DataFrame, wing: str | None = None, budget: int = STORY_CHARS) -> DataFrame:
    """One row ``story``: the fifteen most important chunks (ties by id) by room, up to the first that passes the budget.

    Without an ``importance`` column all weigh alike. Only those fifteen rows meet in one task.
    """
    rows = chunks.filter(F.col("wing") == wing) if wing else chunks
    weight = F.coalesce(F.col("importance").cast("double"), F.lit(DEFAULT_IMPORTANCE)) if "importance" in chunks.columns else F.lit(DEFAULT_IMPORTANCE)
    top = rows.select("id", "room", "text", "source_file", weight.alias("w")).orderBy(F.desc("w"), "id").limit(STORY_CHUNKS)
    name = F.element_at(F.split("source_file", "/"), -1)
    entry = F.concat(F.lit("  - "), snippet(F.col("text")), F.when(F.coalesce(name, F.lit("")) != "", F.concat(F.lit("  ("), name, F.lit(")"))).otherwise(""))
    entries = top.select("room", F.row_number().over(Window.partitionBy("room").orderBy(F.desc("w"), "id")).alias("k"), entry.alias("line"))
    heads = top.select("room").distinct().select("room", F.lit(0).alias("k"), F.concat(F.lit("\n["), "room", F.lit("]")).alias("line"))
    so_far = Window.orderBy("room", "k").rowsBetween(Window.unboundedPreceding, 0)
    sized = heads.union(entries).withColumn("total", F.sum(F.length("line")).over(so_far))
    marked = sized.withColumn("past", F.max((F.col("k") > 0) & (F.col("total") > budget)).over(so_far))
    lines = F.transform(F.array_sort(F.collect_list(F.when(~F.col("past"), F.struct("room", "k", "line")))), lambda x: x["line"])
    more = F.when(F.coalesce(F.max("past"), F.lit(False)), F.array(F.lit(MORE))).otherwise(F.array().cast("array<string>"))
    told = marked.agg(F.count("*").alias("n"), F.array_join(F.concat(F.array(F.lit(TITLE)), lines, more), "\n").alias("story"))
    return told.select(F.when(F.col("n") == 0, NOTHING).otherwise(F.col("story")).alias("story"))


def wake_up(identity: str, chunks: DataFrame, wing: str | None = None) -> DataFrame:
    """One row ``text``: the identity, a blank line and the essential story; with an estimate of its tokens."""
    story = essential_story(chunks, wing)
    return story.select(F.concat(F.lit(identity.strip() + "\n\n"), "story").alias("text")).withColumn("tokens", F.floor(F.length("text") / 4))


def recall(chunks: DataFrame, wing: str | None = None, room: str | None = None, n: int = 10) -> DataFrame:
    """The first ``n`` chunks of a scope in order of id, with their snippets of up to 300 characters."""
    rows = chunks
    for column, value in (("wing", wing), ("room", room)):
        if value:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy("id").limit(n).select("id", "room", "source_file", snippet(F.col("text"), 300).alias("snippet"))


def compression_stats(pairs: DataFrame, original: str = "text", compressed: str = "summary") -> DataFrame:
    """Characters, token estimates and ratio of each pair."""
    from tessellum.functions.text import token_estimate as tokens

    before, after = tokens(F.col(original)), tokens(F.col(compressed))
    return pairs.select("*", before.alias("original_tokens"), after.alias("compressed_tokens"), (before / F.greatest(after, F.lit(1))).alias("ratio"), F.length(original).alias("original_chars"), F.length(compressed).alias("compressed_chars"))
