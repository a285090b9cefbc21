"""Reranking of search candidates by query intent and by token overlap."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tokens, pairs and file endings that show interest in project files, and what they are worth.
PROJECT_TOKENS = {"packagereference", "projectreference", "targetframework", "nuget", "csproj", "fsproj", "vbproj", "sdk", "itemgroup", "propertygroup"}
PROJECT_PAIRS = ("package reference", "project reference", "target framework")
PROJECT_ENDINGS = (".csproj", ".fsproj", ".vbproj", ".sln")
PROJECT_BONUS, STEM_BONUS, SYMBOL_BONUS = 0.50, 0.20, 0.15
OVERFETCH_FACTOR, OVERFETCH_LEAST, OVERFETCH_MOST = 15, 50, 150


def query_words(query: str) -> list[str]:
    return [w.lower() for w in re.findall("[A-Za-z][A-Za-z0-9]*", query)]


def wants_project_file(query: str) -> bool:
    return bool(PROJECT_TOKENS & set(query_words(query))) or any(p in query.lower() for p in PROJECT_PAIRS)


def wants_symbol(query: str) -> bool:
    return re.search("[A-Z][a-z][A-Za-z0-9]*[A-Z]", query) is not None


def overfetch_limit(n: int) -> int:
    return max(n, min(max(n * OVERFETCH_FACTOR, OVERFETCH_LEAST), OVERFETCH_MOST))


def stem(path: Column) -> Column:
    name = F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1)
    return F.lower(F.regexp_replace(name, r"\.[^.]*$", ""))


def split_tokens(text: Column) -> Column:
    """Lower-case tokens, parted at other characters and inside camelCase and ACRONYMWord."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    t = F.regexp_replace(t, "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.transform(F.filter(F.split(t, "[^a-zA-Z0-9]+"), lambda x: x != ""), F.lower)


def lexical_surface(columns: list[str]) -> Column:
    fields = [c for c in ("text", "source_file", "symbol_name", "symbol_type", "language", "room", "wing") if c in columns]
    return F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in fields])


def token_overlap(query_tokens: Column, doc_tokens: Column) -> Column:
    """Share of the distinct query tokens that the document has; 0 where either side is empty."""
    distinct = F.array_distinct(query_tokens)
    return F.when((F.size(query_tokens) == 0) | (F.size(doc_tokens) == 0), 0.0).otherwise(F.size(F.array_intersect(distinct, doc_tokens)) / F.size(distinct))


def intent_score(query: str, columns: list[str]) -> Column:
    """Distance less the bonuses of the query's intents."""
    words = sorted(set(query_words(query)))
    known = F.array(*[F.lit(w) for w in words]).cast("array<string>")
    source = F.coalesce(F.col("source_file"), F.lit("")) if "source_file" in columns else F.lit("")
    in_stem = F.array_contains(known, stem(source))
    score = F.col("distance")
    if wants_project_file(query):
        ends = F.lower(source).rlike(r"(\.csproj|\.fsproj|\.vbproj|\.sln)$")
        score = score - F.when(ends, F.lit(PROJECT_BONUS) + F.when(in_stem, STEM_BONUS).otherwise(0.0)).otherwise(0.0)
    if wants_symbol(query):
        symbol = F.lower(F.coalesce(F.col("symbol_name"), F.lit(""))) if "symbol_name" in columns else F.lit("")
        score = score - F.when(in_stem, STEM_BONUS).otherwise(0.0) - F.when((symbol != "") & F.array_contains(known, symbol), SYMBOL_BONUS).otherwise(0.0)
    return score


def intent_rerank(candidates: DataFrame, query: str, n: int, id_col: str = "id") -> DataFrame:
    """The best ``n`` candidates (columns ``distance``, ``rank``) by intent score, ties by rank; by rank without intent."""
    if not (wants_project_file(query) or wants_symbol(query)):
        return candidates.orderBy("rank").limit(n)
    return candidates.withColumn("intent_score", intent_score(query, candidates.columns)).orderBy("intent_score", "rank").limit(n)


def hybrid_rerank(candidates: DataFrame, query: str, lexical_weight: float = 0.5) -> DataFrame:
    """All candidates (``rank`` from 0) with ``hybrid``, the blend of rank and token overlap; best first, ties by rank.

    The pool is a search's bounded result (at most a few hundred rows), so its size comes from one small aggregate.
    """
    wanted = split_tokens(F.lit(query))
    pool = candidates.crossJoin(F.broadcast(candidates.agg(F.count("*").alias("_n"))))  # a single row
    by_rank = (F.col("_n") - F.col("rank")) / F.col("_n")
    overlap = token_overlap(wanted, split_tokens(lexical_surface(candidates.columns)))
    scored = pool.withColumn("overlap", overlap).withColumn("hybrid", (1 - lexical_weight) * by_rank + lexical_weight * F.col("overlap")).drop("_n")
    return scored.orderBy(F.desc("hybrid"), "rank")


def ranked(candidates: DataFrame, id_col: str = "id") -> DataFrame:
    """``rank`` from 0 by distance and id of a bounded candidate pool."""
    return candidates.withColumn("rank", F.row_number().over(Window.orderBy("distance", id_col)) - 1)
