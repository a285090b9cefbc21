"""Scalar text functions as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at both ends (not just blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def entity_id(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit("_")), F.lit("'"), F.lit(""))


def chunk_id(wing: Column, room: Column, source_file: Column, chunk_index: Column) -> Column:
    """``drawer_{wing}_{room}_`` and 16 digits of an md5 of file and index, with a separator between the two."""
    return F.concat(F.lit("drawer_"), wing, F.lit("_"), room, F.lit("_"), F.left(F.md5(F.concat_ws("|", source_file, chunk_index.cast("string"))), F.lit(16)))


def wing_name(name: Column) -> Column:
    """Lower case with ``_`` for blanks and dashes; ``project`` if nothing is left."""
    plain = F.regexp_replace(F.translate(F.lower(name), " -", "__"), "[^a-z0-9_]", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("project"))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, cut to an integer, at least 1."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.floor(words * 1.3)).cast("long")


def format_bytes(n: Column) -> Column:
    """``1536`` as ``1.5 KiB``."""
    x = n.cast("double")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((1, "KiB"), (2, "MiB"), (3, "GiB")):
        out = F.when(x >= 1024.0**power, F.format_string(f"%.1f {unit}", F.bround(x / 1024.0**power, 1))).otherwise(out)
    return out


# Suffixes of byte counts.
SUFFIXES = {"tib": 1024**4, "gib": 1024**3, "mib": 1024**2, "kib": 1024, "tb": 1000**4, "gb": 1000**3, "mb": 1000**2, "kb": 1000, "b": 1, "": 1}


def parse_bytes(text: Column) -> Column:
    """``1.5 KiB`` as 1536; null for what is no count or is negative."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"^(\d+(?:\.\d+)?)\s*([kmgt]i?b|b)?$", 1).try_cast("double")
    unit = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])[F.regexp_extract(low, r"^\d+(?:\.\d+)?\s*([kmgt]i?b|b)?$", 1)]
    return F.floor(number * unit).cast("long")


def room_name(name: Column) -> Column:
    """As ``wing_name`` with dots as ``_``; ``general`` if nothing is left."""
    plain = F.regexp_replace(F.translate(F.lower(name), ".- ", "___"), "[^a-z0-9_]", "")
    return F.coalesce(F.nullif(plain, F.lit("")), F.lit("general"))


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"))


def has_sequence(needle: Column, haystack: Column) -> Column:
    """Whether one array of words stands in the other without a gap."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(pad(haystack), pad(needle))


def count_sequence(words: Column, keyword: list[str]) -> Column:
    """Non-overlapping occurrences of a sequence of plain words: each word takes its own blank along."""
    if not keyword:
        return F.lit(0)
    text = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    return F.regexp_count(text, F.lit(" " + "  ".join(keyword) + " "))


# Words of good and bad mood.
POSITIVE = [
    "pride", "proud", "joy", "happy", "love", "loving", "beautiful", "amazing", "wonderful", "incredible", "fantastic", "brilliant", "perfect", "excited", "thrilled", "grateful", "warm",
    "breakthrough", "success", "works", "working", "solved", "fixed", "nailed", "heart", "hug", "precious", "adore",
]
NEGATIVE = [
    "bug", "error", "crash", "crashing", "crashed", "fail", "failed", "failing", "failure", "broken", "broke", "breaking", "breaks", "issue", "problem", "wrong", "stuck", "blocked", "unable",
    "impossible", "missing", "terrible", "horrible", "awful", "worse", "worst", "panic", "disaster", "mess",
]


def sentiment(text: Column) -> Column:
    """``positive``, ``negative`` or ``neutral``, by the distinct words of either mood."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))
    good, bad = (F.size(F.array_intersect(words, F.array(*map(F.lit, w)))) for w in (POSITIVE, NEGATIVE))
    return F.when(good > bad, "positive").when(bad > good, "negative").otherwise("neutral")


def phrase_share(phrases: Column, text: Column) -> Column:
    """Share of the phrases that the text holds, whatever their case; 0 without phrases."""
    low = F.lower(text)
    hits = F.size(F.filter(phrases, lambda p: F.contains(low, F.lower(p))))
    return F.when(F.size(phrases) > 0, F.least(F.lit(1.0), hits / F.size(phrases))).otherwise(0.0)


def quoted_phrases(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit('"([^"]+)"'))


def keywords(query: Column, stop: list[str], most: int = 3) -> Column:
    """The longest words of a query (three letters and more, earlier of equals)."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(stop))
    placed = F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(placed), 1, most), lambda x: x["w"])


def evidence_recall(found: Column, wanted: Column) -> Column:
    """Share of the wanted ids that were found; 1 where none is wanted."""
    return F.when(F.size(wanted) == 0, 1.0).otherwise(F.size(F.filter(wanted, lambda w: F.array_contains(found, w))) / F.size(wanted))


def drift_percent(current: Column, baseline: Column) -> Column:
    """Change against the baseline in percent; null without one."""
    return F.when(baseline != 0, F.abs(current - baseline) / baseline * 100)


# Months of transcript headers.
MONTHS = [
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
]


def session_time(text: Column) -> Column:
    """``2026-01-05_241PM`` from ``⏺ 2:41 PM Monday, January 05, 2026``; empty without one."""
    rx = r"⏺\s+(\d{1,2}:\d{2}\s+[AP]M)\s+\w+,\s+(\w+)\s+(\d{1,2}),\s+(\d{4})"
    part = [F.regexp_extract(text, rx, k) for k in range(5)]
    month = F.create_map(*[x for k, m in enumerate(MONTHS, 1) for x in (F.lit(m), F.lit(f"{k:02d}"))])[part[2]]
    stamp = F.concat(part[4], F.lit("-"), F.coalesce(month, F.lit("00")), F.lit("-"), F.lpad(part[3], 2, "0"), F.lit("_"), F.regexp_replace(part[1], r"[:\s]", ""))
    return F.when(part[0] != "", stamp).otherwise("")


def subject_slug(text: Column) -> Column:
    """The first ``> `` line of over five characters that is no command, as a name of up to sixty characters."""
    prompts = F.transform(F.regexp_extract_all(text, F.lit("(?m)^> (.*)$")), strip)
    command = r"^(\./|cd |ls |python|bash|git |cat |source |export |claude|./activate)"
    first = F.get(F.filter(prompts, lambda p: (F.length(p) > 5) & ~p.rlike(command)), F.lit(0))
    slug = F.regexp_replace(F.trim(F.regexp_replace(first, r"(?U)[^\w\s-]", "")), r"\s+", "-")
    return F.coalesce(F.left(slug, F.lit(60)), F.lit("session"))


def embed(text: Column, dims: int = 384) -> Column:
    """A test vector of unit length: each distinct-or-not word adds or takes one at a place that its md5 names."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"))

    def place(t: Column) -> Column:
        h = F.md5(t)
        return F.struct(F.pmod(F.conv(F.left(h, F.lit(8)), 16, 10).cast("long"), F.lit(dims)).alias("i"), F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0).alias("s"))

    placed = F.transform(tokens, place)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda d: F.aggregate(F.filter(placed, lambda p: p["i"] == d), F.lit(0.0), lambda a, p: a + p["s"]))
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(raw, lambda x: x / norm)).otherwise(raw)


def glob_regex(pattern: str) -> str:
    """A pattern in which ``*`` and ``?`` cross slashes, as a regular expression of the whole path."""
    out = ""
    k = 0
    while k < len(pattern):
        c = pattern[k]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and "]" in pattern[k + 2 :]:
            end = pattern.index("]", k + 2)
            body = pattern[k + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
            k = end
        else:
            out += "\\" + c if not c.isalnum() and c != "_" else c
        k += 1
    return f"(?s)^{out}$"


def fused_distance(distance: Column, overlap: Column, weight: float = 0.30) -> Column:
    """A distance made less by the overlap of words."""
    return distance * (1.0 - weight * overlap)


def file_matches(source_file: Column, expected: Column) -> Column:
    """Whether a path is the expected file: by its name, or by its end."""
    plain = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    return (F.element_at(F.split(plain(source_file), "/"), -1) == plain(expected)) | F.endswith(plain(source_file), plain(expected))


# Words that no spelling correction touches.
LEAST_WORD = 4
UNTOUCHED = [r"\d", r"[A-Z][a-z]+[A-Z]", r"^[A-Z_@#$%^&*()+=\[\]{}|<>?.:/\\]+$", r"[-_]", r"(?i)https?://|www\.|/Users/|~/|\.[a-z]{2,4}$", r"[`*_#{}\[\]\\]"]


def spelling_stays(word: Column, known: list[str]) -> Column:
    """Whether a word is left as it is: short, with digits, mixed or all capitals, technical, a path, code, or a known name."""
    return (F.length(word) < LEAST_WORD) | word.rlike("|".join(f"(?:{p})" for p in UNTOUCHED)) | F.lower(word).isin(known)
