"""Turns and transcripts: pairing, exchanges, topics, line groups, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.functions.text import strip

MIN_CHUNK = 30
REPLY_LINES = 8
GROUP_LINES = 25

# Topics in order of declaration, and the words that speak for them.
TOPICS = {
    "technical": ["code", "python", "function", "bug", "error", "api", "database", "server", "deploy", "git", "test", "debug", "refactor"],
    "architecture": ["architecture", "design", "pattern", "structure", "schema", "interface", "module", "component", "service", "layer"],
    "planning": ["plan", "roadmap", "milestone", "deadline", "priority", "sprint", "backlog", "scope", "requirement", "spec"],
    "decisions": ["decided", "chose", "picked", "switched", "migrated", "replaced", "trade-off", "alternative", "option", "approach"],
    "problems": ["problem", "issue", "broken", "failed", "crash", "stuck", "workaround", "fix", "solved", "resolved"],
}
TOPIC_CHARS = 3000


def exchange_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``(conv, turn, prompt, reply)``: each user turn with the assistant turn right behind it; null without one."""
    w = Window.partitionBy(conv).orderBy(turn)
    rows = turns.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w))
    return rows.filter("role = 'user'").select(conv, turn, F.col("text").alias("prompt"), F.when(F.col("_role") == "assistant", F.col("_text")).alias("reply"))


def transcript(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``(conv, transcript)``: user turns behind ``> ``; a reply follows its prompt, then a blank line."""
    w = Window.partitionBy(conv).orderBy(turn)
    replied = (F.col("role") == "user") & (F.coalesce(F.lead("role").over(w), F.lit("")) == "assistant")
    line = F.when(F.col("role") == "user", F.concat(F.lit("> "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    rows = turns.select(conv, turn, F.concat(line, F.when(replied, "\n").otherwise("\n\n")).alias("line"))
    parts = F.array_sort(F.collect_list(F.struct(turn, "line")))
    whole = F.array_join(F.transform(parts, lambda x: x["line"]), "")
    return rows.groupBy(conv).agg(F.regexp_replace(whole, r"\n\z", "").alias("transcript"))


def topic(text: Column, topics: dict[str, list[str]] = TOPICS, chars: int = TOPIC_CHARS) -> Column:
    """The topic with most distinct words in the head of the text, by substring; the earlier declared wins; else general."""
    head = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(chars)))
    counted = []
    for k, (name, words) in enumerate(topics.items()):
        n = sum((F.contains(head, F.lit(w)).cast("int") for w in words), F.lit(0))
        counted.append(F.struct(n.alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*counted))
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = GROUP_LINES, least: int = MIN_CHUNK) -> DataFrame:
    """``(id, chunk_index, content)``: groups of lines, stripped, longer than ``least``; numbered anew without the others."""
    lines = F.split(F.coalesce(text_col, F.lit("")), "\n")
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(size))
    groups = F.transform(starts, lambda s: strip(F.array_join(F.slice(lines, s, size), "\n")))
    kept = F.filter(groups, lambda g: F.length(g) > least)
    return docs.select(id_col, F.posexplode(kept).alias("chunk_index", "content"))


def exchange_chunks(lines: DataFrame, doc: str = "doc_id", pos: str = "pos", line: str = "line", least: int = MIN_CHUNK) -> DataFrame:
    """``(doc, pos, content)``: a ``>`` line and up to eight non-blank lines of its reply, which ends at ``---``."""
    w = Window.partitionBy(doc).orderBy(pos)
    text = strip(F.col(line))
    marked = lines.select(doc, pos, text.alias("t")).withColumn("user", F.startswith("t", F.lit(">"))).withColumn("cut", F.startswith("t", F.lit("---")))
    blocks = marked.withColumn("block", F.sum((F.col("user") | F.col("cut")).cast("int")).over(w))
    nth = F.row_number().over(Window.partitionBy(doc, "block").orderBy(pos))
    first = blocks.filter("t <> ''").withColumn("nth", nth).filter(F.col("nth") <= REPLY_LINES + 1)  # what a chunk can hold, and no more
    parts = first.groupBy(doc, "block").agg(F.array_sort(F.collect_list(F.struct(pos, "t", "user"))).alias("x"))
    parts = parts.filter((F.size("x") > 0) & F.col("x")[0]["user"])
    reply = F.array_join(F.transform(F.slice("x", 2, REPLY_LINES), lambda r: r["t"]), " ")
    content = F.when(F.size("x") > 1, F.concat(F.col("x")[0]["t"], F.lit("\n"), reply)).otherwise(F.col("x")[0]["t"])
    return parts.select(doc, F.col("x")[0][pos].alias(pos), content.alias("content")).filter(F.length("content") > least)


def session_starts(lines: DataFrame, marker: str, restored: list[str], doc: str = "doc_id", pos: str = "pos", line: str = "line") -> DataFrame:
    """Lines that hold the marker, unless they or the five lines behind them show a restored session."""
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(0, 5)
    seen = F.lit(False)
    for r in restored:
        seen = seen | F.contains(line, F.lit(r))
    rows = lines.withColumn("_restored", F.max(seen).over(w))
    return rows.filter(F.contains(line, F.lit(marker)) & ~F.col("_restored")).select(doc, pos)


# Lines with > that make a talk, lines that make a block long, and windows of lines.
LEAST_QUOTES, LONG_BLOCK = 3, 20
WINDOW_LINES, WINDOW_OVERLAP = 80, 10


def paragraphs(text: Column, least: int = MIN_CHUNK) -> Column:
    """Paragraphs longer than ``least``; of a single long one groups of 25 lines."""
    lines = F.split(text, "\n")
    parts = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda x: x != "")
    groups = F.transform(F.sequence(F.lit(1), F.size(lines), F.lit(GROUP_LINES)), lambda k: strip(F.array_join(F.slice(lines, k, GROUP_LINES), "\n")))
    chosen = F.when((F.size(parts) <= 1) & (F.size(lines) - 1 > LONG_BLOCK), groups).otherwise(parts)
    return F.filter(chosen, lambda x: F.length(x) > least)


def talk_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, chunk_index, content)``: exchanges of texts with three lines of ``>`` and more, paragraphs of others."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    quotes = F.size(F.filter(F.split(text, "\n"), lambda x: F.startswith(strip(x), F.lit(">"))))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_text"), (quotes >= LEAST_QUOTES).alias("_talk"))
    lines = rows.filter("_talk").select("doc_id", F.posexplode(F.split("_text", "\n")).alias("pos", "line"))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    talks = exchange_chunks(lines).select("doc_id", order.alias("chunk_index"), "content")
    plain = rows.filter("NOT _talk").select("doc_id", F.posexplode(paragraphs(F.col("_text"))).alias("chunk_index", "content"))
    return talks.unionByName(plain).withColumnRenamed("doc_id", id_col)


def line_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW_LINES, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """``(id, chunk_index, content)``: windows of ``size`` lines that share ``overlap``; blank ones go, the others keep their number."""
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    starts = F.sequence(F.lit(1), F.size(lines), F.lit(max(1, size - overlap)))
    rows = docs.select(id_col, F.posexplode(F.transform(starts, lambda k: strip(F.array_join(F.slice(lines, k, size), "\n")))).alias("chunk_index", "content"))
    return rows.filter("content <> ''")
