"""Queries of the registry of names, over the conversations and names that they hold themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessellum.operators import registry
from tessellum.plans.registry import register
from tessellum.plans.views import table

#: Words of the conversations that are taken for names and common words at once.
_COMMON = ["the", "that", "and", "for", "der", "ein", "les", "que", "una", "ing"]


def _seeded(spark, sf):
    """Capitalised words that come three times: of three letters and more people, some with an alias, of two projects."""
    words = F.split("text", r"[^\p{L}\p{N}_]+")
    names = table(spark, sf, "conversations").select(F.explode(F.filter(words, lambda w: w.rlike("^[A-Z][a-z]{1,19}$"))).alias("name")).groupBy("name").count().filter("count >= 3")
    people, projects = names.filter("length(name) > 2").select("name"), names.filter("length(name) = 2").select("name")
    return registry.seeded(people, projects, people.filter("length(name) > 3").select(F.concat("name", F.lit("s")).alias("alias"), "name"))


_SEEDED = (
    r"WITH tok AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM conversations), nm AS (SELECT w AS name FROM tok WHERE regexp_full_match(w, '[A-Z][a-z]{1,19}') GROUP BY w HAVING count(*) >= 3), "
    "pe AS (SELECT name FROM nm WHERE length(name) > 2), reg AS (SELECT name, 'person' AS kind, 0 AS place, CASE WHEN length(name) > 3 THEN [lower(name), lower(name || 's')] ELSE [lower(name)] END AS forms FROM pe "
    "UNION ALL SELECT name || 's', 'person', 1, [lower(name || 's'), lower(name)] FROM pe WHERE length(name) > 3 AND name || 's' NOT IN (SELECT name FROM pe) UNION ALL SELECT name, 'project', 0, [lower(name)] FROM nm WHERE length(name) = 2), "
    "fm AS (SELECT unnest(forms) AS form, name, kind, place FROM reg), best AS (SELECT form, arg_min({'name': name, 'kind': kind}, {'a': kind = 'project', 'b': place, 'c': name}) AS known FROM fm GROUP BY form)"
)
_FIRST, _LAST = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def _signs(patterns: list[str], word: str, text: str) -> str:
    """Signs around a common word; an expression for each word, as constant ones are compiled once."""
    cases = []
    for w in _COMMON:
        out = []
        for p in patterns:
            before, after = p.split("{name}")
            before = _FIRST + before.removeprefix(r"\b") if before.startswith(r"\b") else before
            after = after.removesuffix(r"\b") + _LAST if after.endswith(r"\b") else after
            out.append(f"CAST(regexp_matches({text}, '{(before + w + after).replace(chr(39), chr(39) * 2)}') AS INT)")
        cases.append(f"WHEN '{w}' THEN {' + '.join(out)}")
    return f"CASE {word} {' '.join(cases)} END"


_IN_COMMON = "(" + ", ".join(f"'{w}'" for w in _COMMON) + ")"


@register(
    "registry_lookup",
    f"{_SEEDED}, ask AS (SELECT DISTINCT t.conv_id, t.turn, w AS word, lower(w) AS low, lower(c.text) AS ctx FROM tok t JOIN conversations c USING (conv_id, turn) WHERE regexp_full_match(w, '[A-Z]\\p{{L}}+')), "
    f"kn AS (SELECT ask.*, known, known.kind = 'person' AND low IN {_IN_COMMON} AS open FROM ask LEFT JOIN best ON low = form), "
    f"sg AS (SELECT *, CASE WHEN open THEN {_signs(registry.PERSON, 'low', 'ctx')} ELSE 0 END AS p, CASE WHEN open THEN {_signs(registry.CONCEPT, 'low', 'ctx')} ELSE 0 END AS c FROM kn) "
    "SELECT conv_id, turn, word, CASE WHEN known IS NULL THEN 'unknown' WHEN c > p THEN 'concept' ELSE known.kind END AS type, CAST(CASE WHEN known IS NULL THEN 0 WHEN p > c THEN round(least(0.95, 0.7 + p * 0.1), 6) WHEN c > p THEN round(least(0.9, 0.7 + c * 0.1), 6) ELSE 1 END AS DOUBLE) AS confidence, "
    "CASE WHEN known IS NULL THEN 'none' WHEN c > p THEN 'context_disambiguated' ELSE 'onboarding' END AS source, CASE WHEN known IS NULL OR p <> c THEN word ELSE known.name END AS name, CASE WHEN p <> c THEN 'context_patterns' END AS disambiguated_by FROM sg",
)
def registry_lookup(spark, sf):
    """All capitalised words of all turns, judged with the turn as their context."""
    turns = table(spark, sf, "conversations")
    words = turns.select("conv_id", "turn", F.explode(F.array_distinct(F.filter(F.split("text", r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(r"^[A-Z]\p{L}+$")))).alias("word"), F.col("text").alias("context"))
    return registry.lookup(words, _seeded(spark, sf), common=_COMMON).drop("context")


@register(
    "people_in_texts",
    f"{_SEEDED}, hit AS (SELECT DISTINCT t.conv_id, t.turn, form, name, lower(c.text) AS ctx FROM tok t JOIN fm ON kind = 'person' AND lower(w) = form JOIN conversations c USING (conv_id, turn)) "
    f"SELECT conv_id, turn, name FROM hit WHERE form NOT IN {_IN_COMMON} UNION SELECT conv_id, turn, name FROM hit WHERE form IN {_IN_COMMON} AND {_signs(registry.PERSON, 'form', 'ctx')} > {_signs(registry.CONCEPT, 'form', 'ctx')}",
)
def people_in_texts(spark, sf):
    return registry.people_in(table(spark, sf, "conversations"), _seeded(spark, sf), ["conv_id", "turn"], common=_COMMON)


@register("people_mentioned", _SEEDED + r", head AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(array_to_string(string_split(text, chr(10))[:3], chr(10))), '[\p{L}\p{N}_]+')) AS w FROM conversations) SELECT DISTINCT conv_id, turn, name FROM head JOIN pe ON w = lower(name)")
def people_mentioned(spark, sf):
    """Names in the first three lines of each turn."""
    people = _seeded(spark, sf).filter("kind = 'person' AND place = 0").select("name")
    return registry.mentions(table(spark, sf, "conversations"), people, ["conv_id", "turn"], first_lines=3)


_NONE = "(" + ", ".join(f"'{w}'" for w in registry.NO_NAMES) + ")"


@register(
    "name_boosts",
    r"WITH t AS (SELECT conv_id, turn, text, lower(lead(text) OVER (PARTITION BY conv_id ORDER BY turn)) AS reply FROM conversations), "
    rf"n AS (SELECT conv_id, turn, reply, list_filter(list_distinct(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,15}}') AND w NOT IN {_NONE}) AS names FROM t) "
    "SELECT conv_id, turn, CAST(len(names) AS INT) AS names, CASE WHEN len(names) = 0 OR reply IS NULL THEN 0.0 ELSE len(list_filter(names, lambda w: contains(reply, lower(w)))) / len(names) END AS boost FROM n",
)
def name_boosts(spark, sf):
    """What share of the names of a turn its reply takes up."""
    turns = table(spark, sf, "conversations").withColumn("reply", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")))
    names = registry.person_names(F.col("text"))
    return turns.select("conv_id", "turn", F.size(names).alias("names"), registry.name_boost(names, F.coalesce(F.col("reply"), F.lit(""))).alias("boost"))
