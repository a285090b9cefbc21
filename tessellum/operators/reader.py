"""Lines of chunks and the resolution of source paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_slice(chunks: DataFrame, start: int, end: int, text_col: str = "text", first_line: str | None = None) -> DataFrame:
    """Each chunk's lines from ``start`` to ``end`` (from 1; in the file, where ``first_line`` names the chunk's first)."""
    if start < 1 or end < start:
        raise ValueError("a range starts at 1 and doesn't end before it starts")
    rows = chunks.select("*", F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "_line")).drop(text_col)
    line = F.col("_pos") + (F.col(first_line) if first_line else F.lit(1))
    return rows.withColumn("line", line).filter(F.col("line").between(start, end)).withColumnRenamed("_line", "text").drop("_pos")


def aliases(path: str) -> list[str]:
    """Other spellings of a path on systems whose /var and /tmp are links into /private."""
    out = []
    for top in ("/var", "/tmp"):
        if path == top or path.startswith(top + "/"):
            out.append("/private" + path)
        elif path == f"/private{top}" or path.startswith(f"/private{top}/"):
            out.append(path.removeprefix("/private"))
    return out


def resolve_source(chunks: DataFrame, wanted: str) -> DataFrame:
    """``(source_file, how)``: the exact path, else another spelling of it, else the paths that end in the wanted components
    (several: ambiguous)."""
    files = chunks.select("source_file").distinct()
    parts = [p for p in wanted.split("/") if p]
    ends = F.slice(F.split("source_file", "/"), -len(parts), len(parts)) == F.array(*map(F.lit, parts))
    how = F.when(F.col("source_file") == wanted, "exact").when(F.col("source_file").isin(aliases(wanted)), "alias").when((F.size(F.split("source_file", "/")) >= len(parts)) & ends, "suffix")
    found = files.withColumn("how", how).filter("how IS NOT NULL")
    counted = found.agg(*[F.count_if(F.col("how") == k).alias(f"_{k}") for k in ("exact", "alias", "suffix")])
    rows = found.crossJoin(F.broadcast(counted))  # a single row
    best = F.when(F.col("_exact") > 0, "exact").when(F.col("_alias") > 0, "alias").otherwise("suffix")
    rows = rows.filter(F.col("how") == best)
    return rows.select("source_file", F.when((F.col("how") == "suffix") & (F.col("_suffix") > 1), "ambiguous").otherwise(F.col("how")).alias("how"))


def read_ranges(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(source_file, line, text)`` of ranges of lines (``source_file``, ``start``, ``end``; one a file) from the chunks that
    overlap them; a line of several chunks is that of the chunk that starts first. Chunks without a place have no lines."""
    held = chunks.filter("line_start > 0").select("id", "source_file", "text", "line_start", "line_end").join(wanted, "source_file")
    held = held.filter("line_start <= end AND line_end >= start")
    lines = held.select("id", "source_file", "line_start", "start", "end", F.posexplode(F.split("text", "\n")).alias("_pos", "_line")).withColumn("line", F.col("line_start") + F.col("_pos"))
    return lines.filter("line BETWEEN start AND end").groupBy("source_file", "line").agg(F.min_by("_line", F.struct("line_start", "id")).alias("text"))


def read_slice(chunks: DataFrame, wanted: str, start: int, end: int) -> DataFrame:
    """``(status, source_file, line, text)`` of a file's lines by an exact path, another spelling or its last parts.

    Status ``ok``: a row a line. Else one row without a line: ``stale`` (no chunk overlaps the range), ``not_found``, or
    ``ambiguous`` for each file that may be meant.
    """
    if start < 1 or end < start:
        raise ValueError("a range starts at 1 and doesn't end before it starts")
    which = resolve_source(chunks, wanted)
    lines = read_ranges(chunks, F.broadcast(which.filter("how <> 'ambiguous'").select("source_file", F.lit(start).alias("start"), F.lit(end).alias("end"))))
    asked = chunks.sparkSession.range(1).select(F.lit(wanted).alias("_wanted"))
    found = asked.join(which, F.lit(True), "left").join(lines, "source_file", "left")
    status = F.when(F.col("how").isNull(), "not_found").when(F.col("how") == "ambiguous", "ambiguous").when(F.col("line").isNull(), "stale").otherwise("ok")
    return found.select(status.alias("status"), F.coalesce("source_file", "_wanted").alias("source_file"), "line", "text").orderBy("line", "source_file")


def pick(chunks: DataFrame, ids: DataFrame | list[str]) -> DataFrame:
    """Rows of these ids; a table of ids is joined, a list becomes a filter that reaches the scan."""
    return chunks.filter(F.col("id").isin(ids)) if isinstance(ids, list) else chunks.join(ids.select("id"), "id", "left_semi")


def file_context(chunks: DataFrame, source_file: str, most: int = 10_000) -> DataFrame:
    """A file's chunks in order, ten thousand at most."""
    return chunks.filter(F.col("source_file") == source_file).orderBy("chunk_index", "id").limit(most)


def latest(entries: DataFrame, n: int = 10, at: str = "filed_at", id_col: str = "id") -> DataFrame:
    """The latest entries of a diary, newest first, ties by id downwards."""
    return entries.orderBy(F.desc(at), F.desc(id_col)).limit(n)
