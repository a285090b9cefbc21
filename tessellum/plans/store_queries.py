"""Queries through the stores and tools: what comes back of what was written, changed and asked."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessellum.operators.facts_store import FactStore
from tessellum.operators.store import ChunkStore
from tessellum.plans.registry import register
from tessellum.plans.search_queries import _DIST
from tessellum.plans.views import CHUNKS, chunks, query_vector, table
from tessellum.tools import Tools


def _folder(spark: SparkSession) -> str:
    """A new folder where all machines see it; on this machine only where nothing else is set and all runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    base = base or f"file://{tempfile.gettempdir()}"
    return f"{base.rstrip('/')}/tessellum-stores/{uuid.uuid4().hex}"


def _no_vector(text):
    return F.array().cast("array<float>")


def _changed(spark: SparkSession, sf: str) -> ChunkStore:
    c = chunks(spark, sf)
    store = ChunkStore(spark, _folder(spark), _no_vector)
    store.add(c.filter("doc_id % 3 <> 0"))
    store.upsert(c.filter("doc_id % 5 = 0").withColumn("room", F.lit("new")))
    store.delete(F.col("chunk_index") == 4)
    store.delete_wing("src7")
    return store


@register("store_changes", f"WITH {CHUNKS} SELECT id, wing, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE room END AS room, chunk_index FROM chunks WHERE (doc_id % 3 <> 0 OR doc_id % 5 = 0) AND chunk_index <> 4 AND wing <> 'src7'")
def store_changes(spark, sf):
    return _changed(spark, sf).read().select("id", "wing", "room", "chunk_index")


@register("store_restored", f"WITH {CHUNKS} SELECT id, wing, CASE WHEN doc_id % 5 = 0 THEN 'new' ELSE room END AS room FROM chunks WHERE (doc_id % 3 <> 0 OR doc_id % 5 = 0) AND wing IN ('src7', 'src8')")
def store_restored(spark, sf):
    """The second version, restored after a compaction, of two wings."""
    store = _changed(spark, sf)
    store.compact()
    store.restore(2)
    return store.read(wings=["src7", "src8"]).select("id", "wing", "room")


@register("store_page", f"WITH {CHUNKS} SELECT id, source_hash FROM chunks WHERE wing = 'src3' ORDER BY id LIMIT 7 OFFSET 3")
def store_page(spark, sf):
    store = ChunkStore(spark, _folder(spark), _no_vector)
    store.add(chunks(spark, sf))
    return store.get(where=F.col("wing") == "src3", limit=7, offset=3).select("id", "source_hash")


def _with_vectors(spark: SparkSession, sf: str) -> Tools:
    tools = Tools(spark, _folder(spark), lambda _: query_vector(spark, sf, 7), _no_vector)
    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    tools.chunks.add(chunks(spark, sf).join(v, "doc_id").withColumns({"language": F.col("room"), "symbol_name": F.concat(F.lit("Sym"), F.col("doc_id").cast("string"))}))
    return tools


_NEAR = f"WITH {CHUNKS}, n AS (SELECT c.*, {_DIST} AS d FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 7) q)"


@register("tool_search", f"{_NEAR} SELECT id, room, round(1 - d, 3) AS similarity FROM n WHERE room = 'en' ORDER BY d, id LIMIT 6")
def tool_search(spark, sf):
    return _with_vectors(spark, sf).search("plain words", limit=6, room="en").select("id", "room", "similarity")


@register("tool_code_search", f"{_NEAR}, p AS (SELECT * FROM n WHERE room = 'de' ORDER BY d, id LIMIT 24) SELECT id, 'Sym' || doc_id AS symbol_name, round(1 - d, 3) AS similarity FROM p WHERE contains(CAST(doc_id AS VARCHAR), '1') AND source_file LIKE '/src/src%' ORDER BY d, id LIMIT 8")
def tool_code_search(spark, sf):
    found = _with_vectors(spark, sf).code_search("plain words", language="de", symbol_name="1", file_glob="/src/**/file_*", n_results=8)
    return found.select("id", "symbol_name", "similarity")


@register("tool_duplicates", f"{_NEAR} SELECT id, wing, room, similarity FROM (SELECT id, wing, room, d, round(1 - d, 3) AS similarity FROM n ORDER BY d, id LIMIT 5) WHERE similarity >= 0.3")
def tool_duplicates(spark, sf):
    return _with_vectors(spark, sf).check_duplicate("plain words", 0.3).select("id", "wing", "room", "similarity")


@register(
    "fact_store",
    "SELECT replace(lower(n_name), ' ', '_') AS subject, 'lies_in' AS predicate, replace(lower(r_name), ' ', '_') AS object, CASE WHEN n_regionkey = 2 THEN '2024-05-05' END AS valid_to FROM nation JOIN region ON n_regionkey = r_regionkey",
)
def fact_store(spark, sf):
    """Facts added twice, of which the second finds them open, and ended for one region."""
    store = FactStore(spark, _folder(spark))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    facts = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("lies in").alias("predicate"), F.col("r_name").alias("object"), F.lit("2024-01-01").alias("valid_from"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("source_file"))
    store.add(facts)
    store.add(facts)
    store.invalidate(F.col("source_file") == "r2", "2024-05-05")
    return store.triples().select("subject", "predicate", "object", "valid_to")


@register("fact_entities", "SELECT replace(lower(n_name), ' ', '_') AS id, n_name AS name FROM nation UNION SELECT replace(lower(r_name), ' ', '_'), r_name FROM region")
def fact_entities(spark, sf):
    store = FactStore(spark, _folder(spark))
    facts = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("subject"), F.lit("lies in").alias("predicate"), F.col("r_name").alias("object"))
    store.add(facts)
    return store.entities().select("id", "name")


@register("backup_restored", f"WITH {CHUNKS} SELECT id, wing, room FROM chunks WHERE wing IN ('src1', 'src2') AND chunk_index < 5")
def backup_restored(spark, sf):
    """A store that was backed up, changed, and brought back."""
    from tessellum.operators.backup import Backups

    store, backups = ChunkStore(spark, _folder(spark), _no_vector), Backups(spark, _folder(spark))
    store.add(chunks(spark, sf).filter("wing IN ('src1', 'src2') AND chunk_index < 5"))
    name = backups.create(store)
    store.delete(F.col("chunk_index") < 3)
    backups.restore(name, store, force=True)
    return store.read().select("id", "wing", "room")


@register(
    "import_merged",
    f"WITH {CHUNKS}, m AS (SELECT c.*, CAST(e.embedding[1] AS DOUBLE) AS v, chunk_index % 2 = 0 AS hand FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.doc_id) "
    "SELECT id, wing, CASE WHEN hand THEN room ELSE 'before' END AS room, CASE WHEN hand THEN date ELSE '' END AS filed_at, CASE WHEN hand THEN 'manual_v1' ELSE '' END AS strategy, CASE WHEN hand THEN room ELSE '' END AS language, round(CASE WHEN hand THEN coalesce(v, 0.5) ELSE 0.25 END, 6) AS v FROM m",
)
def import_merged(spark, sf):
    """What was written by hand, exported with its vectors and merged into a store that holds all chunks in another room."""
    from tessellum.sources import jsonl

    v = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    how = F.when(F.col("chunk_index") % 2 == 0, "manual_v1").otherwise("lines")
    rows = chunks(spark, sf).join(v, "doc_id", "left").withColumns({"filed_at": F.col("date"), "language": F.col("room"), "chunker_strategy": how})
    source, target = (ChunkStore(spark, _folder(spark), lambda _, x=x: F.array(F.lit(x))) for x in (0.5, 0.25))
    source.add(rows)
    target.add(chunks(spark, sf).withColumn("room", F.lit("before")))
    path = _folder(spark)
    jsonl.write(path, jsonl.export_filter(source.read(vectors=True), only_manual=True))
    jsonl.import_into(spark, path, target, skip_near=None)
    out = target.read(vectors=True)
    return out.select("id", "wing", "room", "filed_at", F.col("chunker_strategy").alias("strategy"), "language", F.round(F.col("vector")[0].cast("double"), 6).alias("v"))
