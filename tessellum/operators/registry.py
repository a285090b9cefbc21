"""Registry of names: people with their aliases, projects and confirmed words; lookups, people in texts, learning from texts.

Names are found in texts by an automaton over all of them at once, which is broadcast; names of more bytes than it may hold
are dealt to several automata, of which each passes over the texts once.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators import entities, memories
from tessellum.operators.chunking import slices
from tessellum.operators.log_table import NOTHING, ConflictError, LogTable

ROW = "id string, name string, kind string, forms array<string>, source string, context string, relationship string, confidence double, place long, seen long"
#: Bytes of names in one automaton (some 40 times as many in memory), lines of a transcript that mentions are looked for in.
NAMES_BYTES, FIRST_LINES = 2 << 20, 100
LEARNED_FROM, TRIES = 0.75, 10

# Words that are also names, and what stands around a name and around the word.
COMMON = [
    "ever", "grace", "will", "bill", "mark", "april", "may", "june", "joy", "hope", "faith", "chance", "chase", "hunter", "dash", "flash", "star", "sky", "river", "brook", "lane", "art", "clay", "gil", "nat", "max", "rex", "ray", "jay", "rose",
    "violet", "lily", "ivy", "ash", "reed", "sage", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "january", "february", "march", "july", "august", "september", "october", "november", "december",
]
PERSON = [
    r"\b{name}\s+said\b", r"\b{name}\s+told\b", r"\b{name}\s+asked\b", r"\b{name}\s+laughed\b", r"\b{name}\s+smiled\b", r"\b{name}\s+was\b", r"\b{name}\s+is\b", r"\b{name}\s+called\b", r"\b{name}\s+texted\b", r"\bwith\s+{name}\b", r"\bsaw\s+{name}\b",
    r"\bcalled\s+{name}\b", r"\btook\s+{name}\b", r"\bpicked\s+up\s+{name}\b", r"\bdrop(?:ped)?\s+(?:off\s+)?{name}\b", r"\b{name}(?:'s|s')\b", r"\bhey\s+{name}\b", r"\bthanks?\s+{name}\b", r"^{name}[:\s]",
    r"\bmy\s+(?:son|daughter|kid|child|brother|sister|friend|partner|colleague|coworker)\s+{name}\b",
]
CONCEPT = [
    r"\bhave\s+you\s+{name}\b", r"\bif\s+you\s+{name}\b", r"\b{name}\s+since\b", r"\b{name}\s+again\b", r"\bnot\s+{name}\b", r"\b{name}\s+more\b", r"\bwould\s+{name}\b", r"\bcould\s+{name}\b", r"\bwill\s+{name}\b",
    r"(?:the\s+)?{name}\s+(?:of|in|at|for|to)\b",
]
# Capitalised words of questions that are no names.
NO_NAMES = [
    "What", "When", "Where", "Who", "How", "Which", "Did", "Do", "Was", "Were", "Have", "Has", "Had", "Is", "Are", "The", "My", "Our", "Their", "Can", "Could", "Would", "Should", "Will", "Shall", "May", "Might", "Monday", "Tuesday", "Wednesday",
    "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December", "In", "On", "At", "For", "To", "Of", "With", "By", "From", "And", "But", "I", "It", "Its",
    "This", "That", "These", "Those", "Previously", "Recently", "Also", "Just", "Very", "More", "Said", "Speaker", "Person", "Time", "Date", "Year",
]


def signs_of(patterns: list[str], word: Column, text: Column) -> Column:
    """How many of the patterns a text (both in lower case) meets with the word in place of the name."""
    plain = F.regexp_replace(word, r"([^\w\s])", r"\\$1")
    out = F.lit(0)
    for p in patterns:
        before, after = p.split("{name}")
        out = out + F.rlike(text, F.concat(F.lit(before), plain, F.lit(after))).cast("int")
    return out


# ---- rows of a registry


def seeded(people: DataFrame, projects: DataFrame | None = None, aliases: DataFrame | None = None) -> DataFrame:
    """Rows of a registry from what a user told: people (``name``, ``context``, ``relationship``, optionally ``place`` in
    order), projects (``name``) and aliases (``alias``, ``name``). An alias is a person, too. Blank names go; of several
    rows of a name the first by place stays; of several aliases of a person the last by the alphabet."""
    has = lambda df, c, default: F.col(c) if c in df.columns else F.lit(default)
    named = people.select(F.trim("name").alias("name"), F.coalesce(has(people, "context", "personal"), F.lit("personal")).alias("context"), F.coalesce(has(people, "relationship", ""), F.lit("")).alias("relationship"), has(people, "place", 0).cast("long").alias("place"))
    named = named.filter("name <> ''").groupBy("name").agg(F.min_by(F.struct("context", "relationship", "place"), F.struct("place", "context", "relationship")).alias("x")).select("name", "x.*")
    spark = people.sparkSession
    also = aliases.groupBy("name").agg(F.max("alias").alias("alias")) if aliases is not None else spark.createDataFrame([], "name string, alias string")
    both = named.join(also, "name", "left")
    told = both.select("name", F.array_compact(F.array("name", "alias")).alias("forms"), "context", "relationship", (2 * F.col("place")).alias("place"))
    # an alias stands behind its person; of several persons of an alias the first
    made = both.filter("alias IS NOT NULL").select(F.col("alias").alias("name"), F.array("alias", "name").alias("forms"), "context", "relationship", (2 * F.col("place") + 1).alias("place"))
    made = made.groupBy("name").agg(F.min_by(F.struct("forms", "context", "relationship", "place"), F.struct("place", "forms")).alias("x")).select("name", "x.*").join(named.select("name"), "name", "left_anti")
    out = _row(told.unionByName(made), "person", "onboarding", F.lit(1.0))
    if projects is not None:
        plain = projects.select("name", has(projects, "place", 0).cast("long").alias("place")).filter("name <> ''").groupBy("name").agg(F.min("place").alias("place"))
        out = out.unionByName(_row(plain.select("name", F.array("name").alias("forms"), F.lit("").alias("context"), F.lit("").alias("relationship"), "place"), "project", "onboarding", F.lit(1.0)))
    return out


def _row(rows: DataFrame, kind: str, source: str, confidence: Column, seen: Column | None = None) -> DataFrame:
    out = rows.withColumns({"kind": F.lit(kind), "source": F.lit(source), "confidence": confidence, "seen": (seen if seen is not None else F.lit(0)).cast("long")})
    return out.withColumn("id", F.concat_ws(":", "kind", "name")).select(*[c.split()[0] for c in ROW.split(", ")])


# ---- questions

_ORDER = {"person": 0, "project": 1, "confirmed": 2}


def lookup(words: DataFrame, registry: DataFrame, word_col: str = "word", context_col: str = "context", common: list[str] = COMMON) -> DataFrame:
    """The rows of ``words`` with ``type`` (person, project, concept, unknown or what was confirmed), ``confidence``, ``source``,
    ``name`` and ``disambiguated_by``.

    A name or alias of a person comes first, then projects, then confirmed words, in the order of their places; case doesn't
    matter. A person's name that is a common word, too, is judged by the context, if there is one: more signs of a name make
    it a person, fewer a concept, as many leave it a person. One join with the forms of all names; null words are unknown.
    """
    rank = F.create_map(*[F.lit(x) for kv in _ORDER.items() for x in kv])
    kinds = registry.select(F.explode(F.transform("forms", F.lower)).alias("_form"), F.when(F.col("kind").isin("person", "project"), F.col("kind")).otherwise("confirmed").alias("_as"), "kind", "name", "source", "confidence", "place")
    best = kinds.groupBy("_form").agg(F.min_by(F.struct("_as", "kind", "name", "source", "confidence"), F.struct(rank[F.col("_as")], "place", "name")).alias("_known"))
    rows = words.withColumn("_low", F.lower(word_col)).join(best, F.col("_low") == F.col("_form"), "left")
    context = F.lower(F.coalesce(F.col(context_col), F.lit("")))
    known = F.col("_known")
    asked = (known["_as"] == "person") & F.col("_low").isin(common) & (context != "")
    rows = rows.withColumn("_p", F.when(asked, signs_of(PERSON, F.col("_low"), context)).otherwise(0)).withColumn("_c", F.when(asked, signs_of(CONCEPT, F.col("_low"), context)).otherwise(0))
    person, concept = F.col("_p") > F.col("_c"), F.col("_c") > F.col("_p")
    kind = F.when(known.isNull(), "unknown").when(concept, "concept").otherwise(known["kind"])
    sure = F.when(known.isNull(), 0.0).when(person, F.least(F.lit(0.95), 0.7 + F.col("_p") * 0.1)).when(concept, F.least(F.lit(0.90), 0.7 + F.col("_c") * 0.1)).otherwise(known["confidence"])
    source = F.when(known.isNull(), "none").when(concept, "context_disambiguated").when(known["_as"] == "confirmed", "wiki").otherwise(known["source"])
    name = F.when(known.isNull() | person | concept | (known["_as"] == "confirmed"), F.col(word_col)).otherwise(known["name"])
    return rows.select(*[F.col(f"`{c}`") for c in words.columns], kind.alias("type"), F.round(sure, 6).alias("confidence"), source.alias("source"), name.alias("name"), F.when(person | concept, "context_patterns").alias("disambiguated_by"))


def _lower(text: str) -> str:
    """In lower case, with every character in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


class _Automaton:
    def __init__(self, names: list[str]):
        self.names, self.found = names, ahocorasick.Automaton()
        for i, n in enumerate(names):
            self.found.add_word(n, i)
        if names:
            self.found.make_automaton()

    def at_words(self, text: str, bounds: bool) -> list[str]:
        """The names that stand in a text in lower case: with ``bounds`` where words part on both sides, as ``\\b`` says, else
        with no character of a word on either side."""
        out = set()
        for end, i in self.found.iter(text) if self.names else ():
            name = self.names[i]
            start = end + 1 - len(name)
            before, after = start > 0 and _word(text[start - 1]), end + 1 < len(text) and _word(text[end + 1])
            if (before != _word(name[0]) and after != _word(name[-1])) if bounds else not (before or after):
                out.add(name)
        return sorted(out)


_made: dict[tuple, _Automaton] = {}


def _hits(batches, names: list[str], kept: list[str], bounds: bool):
    """The rows of ``_scanned`` texts that hold names, with which; batches are taken apart in short runs, so that what a worker
    holds beside the automaton doesn't grow with the table."""
    key = (len(names), hash(tuple(names)))
    if key not in _made:
        _made.clear()
        _made[key] = _Automaton(names)
    for b in slices(batches):
        hits = [_made[key].at_words(_lower(t), bounds) if t else [] for t in b.column("_scanned").to_pylist()]
        rows = pa.RecordBatch.from_arrays([*b.select(kept).columns, pa.array(hits, pa.list_(pa.string()))], names=[*kept, "_forms"])
        yield rows.filter(pa.array([bool(h) for h in hits], pa.bool_()))


def found_names(texts: DataFrame, names: DataFrame, text_col: str = "text", bounds: bool = True, most_bytes: int = NAMES_BYTES) -> DataFrame:
    """Rows of ``texts`` that hold names (column ``form``, lower case), with ``_forms``: which. A row may come once for each of
    several automata, with names of its own."""
    forms = names.select("form").filter("form <> ''").distinct()
    size = forms.agg(F.sum(F.octet_length("form"))).first()[0] or 0
    parts = max(1, -(-size // most_bytes))
    source = texts.select("*", F.col(text_col).alias("_scanned"))
    kept = [c for c in source.columns if c != "_scanned"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)
    out = None
    for k in range(parts):
        part = forms.filter(F.pmod(F.xxhash64("form"), F.lit(parts)) == k) if parts > 1 else forms
        shared = texts.sparkSession.sparkContext.broadcast(sorted(r["form"] for r in part.collect()))

        def run(batches, shared=shared):
            yield from _hits(batches, shared.value, kept, bounds)

        found = source.mapInArrow(run, f"{types}, _forms array<string>")
        out = found if out is None else out.unionByName(found)
    return out


def people_in(texts: DataFrame, registry: DataFrame, keep: list[str], text_col: str = "text", common: list[str] = COMMON, most_bytes: int = NAMES_BYTES) -> DataFrame:
    """``keep`` and ``name``: the people of the registry that texts name, or an alias of them, each once a row of ``keep``.

    A form that is a common word, too, counts only where the text has more signs of a name than of the word.
    """
    forms = registry.filter("kind = 'person'").select(F.explode("forms").alias("form"), "name").select(F.lower("form").alias("form"), "name").distinct()
    asked = texts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    hits = found_names(asked, forms, "_text", True, most_bytes)
    rows = hits.withColumn("form", F.explode("_forms"))
    low = F.lower("_text")
    sure = F.when(F.col("form").isin(common), signs_of(PERSON, F.col("form"), low) > signs_of(CONCEPT, F.col("form"), low)).otherwise(True)
    named = rows.filter(sure).join(forms, "form")
    return named.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "name").distinct()


def mentions(texts: DataFrame, people: DataFrame, keep: list[str], users: DataFrame | None = None, text_col: str = "text", first_lines: int = FIRST_LINES) -> DataFrame:
    """``keep`` and ``name``: people (``name``) in the first lines of transcripts, and those whose user folder is named first
    there (``users``: ``user``, ``name``)."""
    head = texts.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)], F.array_join(F.slice(F.split(F.col(text_col), "\n"), 1, first_lines), "\n").alias("_text"))
    forms = people.select(F.lower("name").alias("form"), "name").distinct()
    out = found_names(head, forms, "_text", False).withColumn("form", F.explode("_forms")).join(forms, "form").select(*[f"_k{i}" for i in range(len(keep))], "name")
    if users is not None:
        home = head.withColumn("user", F.regexp_extract("_text", r"(?U)/Users/(\w+)/", 1)).filter("user <> ''")
        out = out.union(home.join(users, "user").select(*[f"_k{i}" for i in range(len(keep))], "name"))
    return out.distinct().select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "name")


def person_names(text: Column, no_names: list[str] = NO_NAMES) -> Column:
    """Capitalised words of 3 to 16 letters that may be names, each once."""
    words = F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][a-z]{2,15})\b"), F.lit(1))
    return F.array_except(F.array_distinct(words), F.array(*map(F.lit, no_names)))


def name_boost(names: Column, text: Column) -> Column:
    """The share of names that a text holds, whatever the case; 0 without names."""
    low = F.lower(text)
    share = F.size(F.filter(names, lambda n: F.contains(low, F.lower(n)))) / F.greatest(F.size(names), F.lit(1))
    return F.coalesce(share, F.lit(0.0))


# ---- learning


def learned(texts: DataFrame, registry: DataFrame, stop: list[str], key: str, text_col: str = "text", context: str = "personal", least: float = LEARNED_FROM) -> DataFrame:
    """Rows for a registry: names in the texts that it doesn't know and that are people for sure (see ``entities``)."""
    names = memories.name_candidates(texts, stop, text_col)
    new = names.join(registry.filter("kind IN ('person', 'project')").select("name"), "name", "left_anti")
    sure = entities.classify(new, entities.signs(texts, new, key, text_col)).filter((F.col("type") == "person") & (F.col("confidence") >= least))
    rows = sure.select("name", F.array("name").alias("forms"), F.lit(context).alias("context"), F.lit("").alias("relationship"), F.lit(1 << 40).alias("place"), "confidence", "frequency")
    return _row(rows, "person", "learned", F.col("confidence"), F.col("frequency"))


class Registry:
    """A registry in a log of commits: what is told replaces what was learned of the same name; learning never replaces."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = LogTable(spark, path, ROW)

    def rows(self) -> DataFrame:
        return self.log.read()

    def seed(self, people: DataFrame, projects: DataFrame | None = None, aliases: DataFrame | None = None) -> int:
        rows = seeded(people, projects, aliases)
        return self.log.commit(rows, rows.select("id"), "seed")

    def confirm(self, word: str, kind: str, confidence: float = 1.0) -> int:
        """A word that was looked up elsewhere. One that is a person is one from now on."""
        rows = self.log.spark.createDataFrame([(word, [word], "personal", "", 1 << 41)], "name string, forms array<string>, context string, relationship string, place long")
        rows = _row(rows, kind, "wiki", F.lit(confidence))
        return self.log.commit(rows, rows.select("id"), "confirm")

    def learn(self, texts: DataFrame, stop: list[str], key: str, text_col: str = "text", least: float = LEARNED_FROM) -> int:
        """Names that are new and people for sure are kept; their number."""
        for attempt in range(TRIES):
            head = self.log.head() or NOTHING
            rows = learned(texts, self.log.read(version=head["version"]), stop, key, text_col, least=least).cache()
            try:
                n = rows.count()
                if n:
                    self.log.commit(rows, None, "learn", head)
                return n
            except ConflictError:
                if attempt + 1 == TRIES:
                    raise
            finally:
                rows.unpersist()
        raise AssertionError
