"""Rooms of files, by folder, file name and words of the content."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellum.functions.text import count_sequence, has_sequence, words_of

CONTENT_CHARS = 2000


def _plain(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def file_room(relative: Column, content: Column, rooms: dict[str, list[str]]) -> Column:
    """The room of a file: the first folder (from the top) that names a room or one of its words, else the file's name,
    else most occurrences in the head of the content; the room declared first wins; ``general`` without any."""
    parts = F.split(F.lower(relative), "/")
    folders = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), words_of)
    name = words_of(F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", ""))

    def named(words: Column) -> Column:
        out = F.lit(None).cast("string")
        for room, keys in reversed(rooms.items()):
            hit = F.lit(False)
            for k in filter(None, map(_plain, [room, *keys])):
                key = F.array(*map(F.lit, k))
                hit = hit | has_sequence(words, key) | has_sequence(key, words)
            out = F.when(hit, room).otherwise(out)
        return out

    by_folder = F.get(F.filter(F.transform(folders, named), lambda r: r.isNotNull()), F.lit(0))
    body = words_of(F.left(F.coalesce(content, F.lit("")), F.lit(CONTENT_CHARS)))
    scored = [F.struct(sum((count_sequence(body, _plain(k)) for k in [*keys, room]), F.lit(0)).alias("n"), F.lit(-i).alias("i"), F.lit(room).alias("room")) for i, (room, keys) in enumerate(rooms.items())]
    best = F.array_max(F.array(*scored))
    return F.coalesce(by_folder, named(name), F.when(best["n"] > 0, best["room"]), F.lit("general"))
