"""Queries through ingest: files made of the documents table, chunked, placed, stored and read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import chunking, places, reader
from tessellum.operators.store import ChunkStore
from tessellum.plans.registry import register
from tessellum.plans.store_queries import _folder, _no_vector
from tessellum.plans.text_queries import CHUNKED
from tessellum.plans.views import table
from tessellum.streaming.watch import chunk_rows

# Chunks are looked for behind the one before, in a text in which runs of newlines are one; places in the text itself are
# further on by what the runs before have lost.
_FOLD = r"regexp_replace({0}, '\n{{2,}}', chr(10), 'g')"
_STATE = "{{'cur': 0::BIGINT, 'w': {0}, 't': {1}, 'found': []::STRUCT(pos BIGINT, past BIGINT)[]}}"
_HIT = "strpos(substr(a.t, a.cur + 1), x.w)"
PLACED = (
    CHUNKED + ", o AS (SELECT c.doc_id, " + _FOLD.format("any_value(d.text)") + " AS text, list(" + _STATE.format(_FOLD.format("content"), "''") + " ORDER BY chunk_index) AS ws FROM chunked c JOIN documents d ON c.doc_id = d.doc_id GROUP BY c.doc_id), "
    "f0 AS (SELECT doc_id, list_reduce(list_prepend(" + _STATE.format("''", "text") + ", ws), lambda a, x: {'cur': CASE WHEN " + _HIT + " > 0 THEN a.cur + " + _HIT + " - 1 + length(x.w) ELSE a.cur END, 'w': '', 't': a.t, "
    "'found': a.found || [{'pos': CASE WHEN " + _HIT + " > 0 THEN a.cur + " + _HIT + " - 1 ELSE -1 END, 'past': a.cur + " + _HIT + " - 1 + length(x.w)}]}).found AS found FROM o), "
    "f1 AS (SELECT doc_id, unnest(found) AS p, generate_subscripts(found, 1) - 1 AS chunk_index FROM f0), "
    r"n0 AS (SELECT doc_id, regexp_split_to_array(text, '\n{2,}') AS parts, regexp_extract_all(text, '\n{2,}') AS runs FROM documents), n1 AS (SELECT doc_id, unnest(runs) AS run, unnest(parts[:len(runs)]) AS part, generate_subscripts(runs, 1) AS k FROM n0), "
    "n2 AS (SELECT doc_id, CAST(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS past, CAST(sum(length(run) - 1) OVER (PARTITION BY doc_id ORDER BY k) AS BIGINT) AS lost FROM n1), "
    "f2 AS (SELECT f1.doc_id, chunk_index, p, coalesce(max(lost) FILTER (n2.past <= p.pos), 0) AS a, coalesce(max(lost) FILTER (n2.past <= p.past - 1), 0) AS b FROM f1 LEFT JOIN n2 ON f1.doc_id = n2.doc_id GROUP BY ALL), "
    "f3 AS (SELECT doc_id, chunk_index, CASE WHEN p.pos < 0 THEN -1 ELSE p.pos + a END AS char_start, CASE WHEN p.pos < 0 THEN -1 ELSE p.past + b END AS char_end FROM f2), "
    "placed AS (SELECT c.doc_id, c.chunk_index, c.content, f.char_start::INT AS char_start, f.char_end::INT AS char_end, "
    "CASE WHEN char_start < 0 THEN 0 ELSE 1 + length(left(text, char_start)) - length(replace(left(text, char_start), chr(10), '')) END::INT AS line_start, CASE WHEN char_start < 0 THEN 0 ELSE 1 + length(left(text, char_end - 1)) - length(replace(left(text, char_end - 1), chr(10), '')) END::INT AS line_end "
    "FROM f3 f JOIN documents d ON f.doc_id = d.doc_id JOIN chunked c ON c.doc_id = f.doc_id AND c.chunk_index = f.chunk_index)"
)


@register("chunk_places", f"{PLACED} SELECT doc_id, chunk_index, char_start, char_end, line_start, line_end FROM placed")
def chunk_places(spark, sf):
    docs = table(spark, sf, "documents")
    made = chunking.chunk_column(docs, ["doc_id"])
    placed = places.place_chunks(docs, made, key="doc_id")
    return placed.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), *places.PLACE)


_LINES = f"{PLACED}, ls AS (SELECT doc_id, chunk_index, line_start, unnest(string_split(content, chr(10))) AS text, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS k FROM placed WHERE line_start > 0 AND line_start <= 5 AND line_end >= 2)"


@register("read_ingested", f"{_LINES} SELECT 'notes/' || (doc_id % 7) || '/' || doc_id || '.log' AS source_file, (line_start + k)::INT AS line, arg_min(text, struct_pack(a := line_start, b := chunk_index)) AS text FROM ls WHERE line_start + k BETWEEN 2 AND 5 GROUP BY ALL")
def read_ingested(spark, sf):
    """All documents as files, ingested by the dispatcher and stored; then lines 2 to 5 of each."""
    docs = table(spark, sf, "documents").withColumn("path", F.concat_ws("", F.lit("notes/"), F.col("doc_id") % 7, F.lit("/"), "doc_id", F.lit(".log")))
    store = ChunkStore(spark, _folder(spark), _no_vector)
    store.add(chunk_rows(docs.select("path", "text", F.md5("text").alias("source_hash")), "notes"))
    stored = store.read(wings=["notes"])
    return reader.read_ranges(stored, docs.select(F.col("path").alias("source_file"), F.lit(2).alias("start"), F.lit(5).alias("end")))
