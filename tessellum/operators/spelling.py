"""Correction of spelling by a dictionary with counts: words that share a form with characters left out are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellum.functions.text import spelling_stays

#: Marks at a token's end that aren't part of the word.
_END = r"""[.,!?;:'")]*$"""


def _shorter(word: Column) -> Column:
    """A word and all that are left of it without one character."""
    cut = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), F.when(F.length(word) > 0, cut).otherwise(F.array().cast("array<string>"))))


def _forms(word: Column, edits: int) -> Column:
    out = F.array(word)
    for _ in range(edits):
        out = F.array_distinct(F.flatten(F.transform(out, _shorter)))
    return out


def corrections(words: DataFrame, dictionary: DataFrame, edits: int = 1) -> DataFrame:
    """``(word, correction)`` of the distinct ``word`` that the dictionary (``word``, ``count``) doesn't hold and that is up to
    ``edits`` edits from one it holds: the nearest, of these the most frequent, then the first by its letters.

    Two words within so many edits share a form from which as many characters at most were left out on either side, so a join
    on forms finds all pairs; their distance is checked. Forms of a word are as many as its characters (squared for two edits).
    """
    unknown = words.select("word").filter("word IS NOT NULL").distinct().join(dictionary.select("word"), "word", "left_anti")
    asked = unknown.select("word", F.explode(_forms(F.col("word"), edits)).alias("_form"))
    known = dictionary.select(F.col("word").alias("_entry"), "count", F.explode(_forms(F.col("word"), edits)).alias("_form"))
    pairs = asked.join(known, "_form").select("word", "_entry", "count").distinct().withColumn("_far", F.levenshtein("word", "_entry")).filter(F.col("_far") <= edits)
    return pairs.groupBy("word").agg(F.min_by("_entry", F.struct("_far", -F.col("count"), "_entry")).alias("correction"))


def _tokens(text: Column) -> Column:
    """Runs of white space and of other characters, in turn."""
    return F.regexp_extract_all(text, F.lit(r"(\s+|\S+)"), F.lit(1))


def _word(token: Column) -> Column:
    return F.regexp_replace(token, _END, "")


def _open(text: Column) -> Column:
    """The words of a text that may be corrected: not capitalised, and none that stays (see ``spelling_stays``)."""
    words = F.array_distinct(F.transform(_tokens(text), _word))
    return F.filter(words, lambda w: ~spelling_stays(w, []) & ~w.rlike(r"^(\p{Lu}|\s|$)"))


def _said(line: Column) -> Column:
    """Whether a line is what a user said: behind ``>`` something follows."""
    return F.ltrim(line).startswith(">") & (F.trim(F.substring(line, _before(line) + 1, F.length(line))) != "")


def _before(line: Column) -> Column:
    return F.length(line) - F.length(F.ltrim(line)) + 2


def correct(texts: DataFrame, key: str, dictionary: DataFrame, text_col: str = "text", known: DataFrame | None = None, edits: int = 1, transcript: bool = False) -> DataFrame:
    """``texts`` with the words of ``text_col`` corrected; white space and marks stay as they are.

    ``key`` names a row. Words of the dictionary, and those of ``known`` (``name``, whatever the case), stay. ``transcript``: only
    what stands behind ``>`` in lines of a user is touched. Each distinct word is corrected once; a row gets its own
    corrections alone. Null texts stay null.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    message = lambda line: F.substring(line, _before(line) + 1, F.length(line))
    if transcript:
        open_ = F.array_distinct(F.flatten(F.transform(F.filter(F.split(text, "\n"), _said), lambda line: _open(message(line)))))
    else:
        open_ = _open(text)
    words = texts.select(F.col(key).alias("_key"), F.explode(open_).alias("word"))
    if known is not None:
        names = known.select(F.lower("name").alias("_name")).distinct()
        words = words.join(names, F.lower("word") == F.col("_name"), "left_anti")
    found = words.join(corrections(words, dictionary, edits), "word").groupBy("_key").agg(F.map_from_entries(F.collect_set(F.struct("word", "correction"))).alias("_fixes"))

    def fixed(token: Column) -> Column:
        word = _word(token)
        return F.when(F.map_contains_key("_fixes", word), F.concat(F.col("_fixes")[word], F.substring(token, F.length(word) + 1, F.length(token)))).otherwise(token)

    def whole(c: Column) -> Column:
        return F.array_join(F.transform(_tokens(c), fixed), "")

    new = whole(F.col(text_col))
    if transcript:
        new = F.array_join(F.transform(F.split(F.col(text_col), "\n"), lambda line: F.when(_said(line), F.concat(F.substring(line, F.lit(1), _before(line)), whole(message(line)))).otherwise(line)), "\n")
    rows = texts.join(found, F.col(key) == F.col("_key"), "left")
    return rows.withColumn(text_col, F.when(F.col("_fixes").isNull(), F.col(text_col)).otherwise(new)).drop("_key", "_fixes")
