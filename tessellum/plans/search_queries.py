"""Vector search, filters, counts, reranking and metrics over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import ingest, metrics, reader, rerank, taxonomy, vector
from tessellum.operators.where import predicate
from tessellum.plans.registry import register
from tessellum.plans.views import CHUNKS, chunks, query_vector, table, vectors

_DIST = "list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE))))"


def _out(df):
    return df.select("id", F.round("distance", 6).alias("distance"), vector.similarity(F.col("distance")).alias("similarity"))


@register("vector_topk", f"SELECT e.vec_id AS id, round({_DIST}, 6) AS distance, round(1 - {_DIST}, 3) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_DIST}, e.vec_id LIMIT 10")
def vector_topk(spark, sf):
    return _out(vector.top_k(vectors(spark, sf), query_vector(spark, sf, 7), 10))


@register("vector_topk_filtered", f"SELECT e.vec_id AS id, round({_DIST}, 6) AS distance, round(1 - {_DIST}, 3) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q WHERE e.label IN (1, 3, 5) AND e.vec_id >= 20 ORDER BY {_DIST}, e.vec_id LIMIT 10")
def vector_topk_filtered(spark, sf):
    v = vectors(spark, sf)
    return _out(vector.top_k(v, query_vector(spark, sf, 7), 10, predicate({"wing": {"$in": [1, 3, 5]}, "id": {"$gte": 20}}, v.columns)))


@register(
    "vector_topk_each",
    f"SELECT query_id, id, rank, round(d, 6) AS distance FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, {_DIST} AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE rank <= 5",
)
def vector_topk_each(spark, sf):
    v = vectors(spark, sf)
    asked = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    return vector.top_k_each(v.select("id", "vector"), asked, 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 6).alias("distance"))


@register("similarity_duplicates", f"SELECT * FROM (SELECT e.vec_id AS id, round(1 - {_DIST}, 3) AS similarity FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY {_DIST}, e.vec_id LIMIT 5) WHERE similarity >= 0.2")
def similarity_duplicates(spark, sf):
    return vector.duplicates(vectors(spark, sf), query_vector(spark, sf, 7), 0.2).select("id", "similarity")


@register(
    "import_without_near_duplicates",
    f"WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0) SELECT q.vec_id AS id FROM q WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id % 20 <> 0 AND 1 - {_DIST} / 2 >= 0.55)",
)
def import_without_near_duplicates(spark, sf):
    v = vectors(spark, sf)
    return vector.without_near_duplicates(v.filter("id % 20 = 0"), v.filter("id % 20 <> 0"), 0.55).select("id")


@register("filter_language", f"WITH {CHUNKS} SELECT doc_id, wing, room, chunk_index FROM chunks WHERE (wing = 'src1' OR (room IN ('de', 'fr') AND chunk_index >= 3 AND chunk_index < 8)) AND hall <> 'q0' AND n_chars > 500 AND n_chars <= 5000")
def filter_language(spark, sf):
    c = chunks(spark, sf)
    where = {"$and": [{"$or": [{"wing": "src1"}, {"room": {"$in": ["de", "fr"]}, "chunk_index": {"$gte": 3, "$lt": 8}}]}, {"hall": {"$ne": "q0"}}, {"n_chars": {"$gt": 500, "$lte": 5000}}]}
    return c.filter(predicate(where, c.columns)).select("doc_id", "wing", "room", "chunk_index")


@register("scope_page", f"WITH {CHUNKS} SELECT id, chunk_index, source_file FROM chunks WHERE wing = 'src0' AND room = 'en' ORDER BY id LIMIT 20 OFFSET 5")
def scope_page(spark, sf):
    c = chunks(spark, sf)
    return c.filter(predicate({"wing": "src0", "room": "en"}, c.columns)).orderBy("id").offset(5).limit(20).select("id", "chunk_index", "source_file")


@register("point_lookup", f"WITH {CHUNKS} SELECT id, wing, room FROM chunks WHERE id IN (SELECT id FROM chunks ORDER BY doc_id LIMIT 3)")
def point_lookup(spark, sf):
    c = chunks(spark, sf)
    return reader.pick(c, c.orderBy("doc_id").limit(3)).select("id", "wing", "room")


@register("count_by_wing", f"WITH {CHUNKS} SELECT wing, count(*) AS n FROM chunks GROUP BY wing")
def count_by_wing(spark, sf):
    return taxonomy.count_by(chunks(spark, sf), "wing")


@register("taxonomy_counts", f"WITH {CHUNKS} SELECT wing, room, count(*) AS n FROM chunks GROUP BY wing, room")
def taxonomy_counts(spark, sf):
    return taxonomy.count_by_pair(chunks(spark, sf))


@register("status_rollup", f"WITH {CHUNKS} SELECT CASE WHEN grouping(wing) = 0 THEN 'wing' WHEN grouping(room) = 0 THEN 'room' ELSE 'total' END AS level, wing, room, count(*) AS n FROM chunks GROUP BY GROUPING SETS ((), (wing), (room))")
def status_rollup(spark, sf):
    return taxonomy.status(chunks(spark, sf))


@register("status_summary", f"WITH {CHUNKS} SELECT count(*) AS drawers, count(DISTINCT wing) AS wings, count(DISTINCT wing || '/' || room) AS rooms FROM chunks")
def status_summary(spark, sf):
    return taxonomy.summary(chunks(spark, sf))


@register(
    "unknown_scope_check",
    f"WITH {CHUNKS}, r(wing, room) AS (VALUES ('src1', 'en'), ('src99', 'en'), ('src1', 'xx'), ('', 'de'), ('src2', '')) SELECT r.wing, r.room, CASE WHEN r.wing <> '' AND r.wing NOT IN (SELECT wing FROM chunks) THEN 'unknown_wing' WHEN r.room <> '' AND r.room NOT IN (SELECT room FROM chunks) THEN 'unknown_room' END AS error FROM r",
)
def unknown_scope_check(spark, sf):
    asked = spark.createDataFrame([("src1", "en"), ("src99", "en"), ("src1", "xx"), ("", "de"), ("src2", "")], "wing string, room string")
    return taxonomy.scope_errors(asked, taxonomy.count_by_pair(chunks(spark, sf)))


@register("distinct_source_files", f"WITH {CHUNKS} SELECT DISTINCT source_file FROM chunks WHERE wing = 'src3'")
def distinct_source_files(spark, sf):
    return ingest.distinct_sources(chunks(spark, sf), "src3")


@register("source_hash_first", f"WITH {CHUNKS} SELECT source_file, source_hash FROM (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY chunk_index, id) AS k FROM chunks WHERE wing = 'src3') WHERE k = 1")
def source_hash_first(spark, sf):
    return ingest.first_hashes(chunks(spark, sf), "src3")


@register(
    "changed_files",
    f"WITH {CHUNKS}, stored AS (SELECT source_file, source_hash FROM chunks WHERE doc_id % 9 <> 0), walked AS (SELECT source_file, CASE WHEN doc_id % 5 = 0 THEN md5(source_hash) ELSE source_hash END AS source_hash FROM chunks WHERE doc_id % 7 <> 0), "
    "s AS (SELECT source_file, min(source_hash) AS h FROM stored GROUP BY 1), w AS (SELECT source_file, min(source_hash) AS h FROM walked GROUP BY 1) "
    "SELECT source_file, CASE WHEN s.h IS NULL THEN 'new' WHEN w.h IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM s FULL JOIN w USING (source_file) WHERE s.h IS DISTINCT FROM w.h",
)
def changed_files(spark, sf):
    from tessellum.operators.ingest import file_changes

    c = chunks(spark, sf)
    stored = c.filter("doc_id % 9 <> 0").groupBy("source_file").agg(F.min("source_hash").alias("source_hash"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.md5("source_hash")).otherwise(F.col("source_hash"))
    walked = c.filter("doc_id % 7 <> 0").withColumn("source_hash", changed).groupBy("source_file").agg(F.min("source_hash").alias("source_hash"))
    return file_changes(stored, walked)


_TOKENS = r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_POOL = f"pool AS (SELECT c.*, d, row_number() OVER (ORDER BY d, id) - 1 AS rank FROM (SELECT c.*, {_DIST} AS d FROM chunks c JOIN embeddings e ON e.vec_id = c.doc_id, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY d, id LIMIT 30) c)"


def _pool(spark, sf, k=30):
    c = chunks(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id")
    return rerank.ranked(vector.top_k(c, query_vector(spark, sf, 7), k).drop("vector"))


QUERY = "the tion src4 file_12 en stating"


@register(
    "token_overlap_rerank",
    f"WITH {CHUNKS}, {_POOL}, t AS (SELECT *, {_TOKENS.format(chr(39) + QUERY + chr(39))} AS q, {_TOKENS.format('concat_ws(' + repr(' ') + ', text, source_file, room, wing)')} AS dt FROM pool) "
    "SELECT id, rank, round(len(list_intersect(list_distinct(q), list_distinct(dt))) / len(list_distinct(q)), 6) AS overlap, round(0.5 * (30 - rank) / 30 + 0.5 * len(list_intersect(list_distinct(q), list_distinct(dt))) / len(list_distinct(q)), 6) AS hybrid FROM t",
)
def token_overlap_rerank(spark, sf):
    return rerank.hybrid_rerank(_pool(spark, sf), QUERY).select("id", F.col("rank").cast("long").alias("rank"), F.round("overlap", 6).alias("overlap"), F.round("hybrid", 6).alias("hybrid"))


@register(
    "intent_rerank",
    f"WITH {CHUNKS}, {_POOL}, s AS (SELECT id, rank, d - CASE WHEN lower(regexp_replace(string_split(source_file, '/')[-1], '\\.[^.]*$', '')) IN ('file_12', 'todoitem', 'en') THEN 0.20 ELSE 0.0 END - CASE WHEN room IN ('todoitem', 'en') THEN 0.15 ELSE 0.0 END AS score FROM pool) SELECT id, rank, round(score, 6) AS intent_score FROM s ORDER BY score, rank LIMIT 10",
)
def intent_rerank(spark, sf):
    pool = _pool(spark, sf).withColumn("symbol_name", F.col("room"))
    return rerank.intent_rerank(pool, "where is TodoItem en", 10).select("id", F.col("rank").cast("long").alias("rank"), F.round("intent_score", 6).alias("intent_score"))


@register(
    "code_search_pipeline",
    f"WITH {CHUNKS}, {_POOL}, t AS (SELECT *, {_TOKENS.format(chr(39) + QUERY + chr(39))} AS q, {_TOKENS.format('concat_ws(' + repr(' ') + ', text, source_file, room, wing)')} AS dt FROM pool), "
    "h AS (SELECT *, 0.5 * (30 - rank) / 30 + 0.5 * len(list_intersect(list_distinct(q), list_distinct(dt))) / len(list_distinct(q)) AS hybrid FROM t) "
    "SELECT id, source_file, round(hybrid, 6) AS hybrid, round(1 - d, 3) AS similarity FROM h WHERE regexp_matches(source_file, '^/src/.*/file_.*\\.txt$') AND contains(lower(room), 'e') ORDER BY h.hybrid DESC, rank LIMIT 8",
)
def code_search_pipeline(spark, sf):
    from tessellum.functions.text import glob_regex

    found = rerank.hybrid_rerank(_pool(spark, sf), QUERY).filter(F.col("source_file").rlike(glob_regex("/src/*/file_*.txt")) & F.lower("room").contains("e"))
    return found.orderBy(F.desc("hybrid"), "rank").limit(8).select("id", "source_file", F.round("hybrid", 6).alias("hybrid"), vector.similarity(F.col("distance")).alias("similarity"))


_RANKED = f"WITH r AS (SELECT q.vec_id AS query_id, e.vec_id AS item, q.label AS ql, e.label AS el, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_DIST}, e.vec_id) AS rank FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q WHERE e.vec_id <> q.vec_id), res AS (SELECT *, CASE WHEN ql = el THEN 1 ELSE 0 END AS rel FROM r WHERE rank <= 10)"


def _results(spark, sf):
    v = vectors(spark, sf)
    asked = v.filter("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("wing").alias("ql"))
    near = vector.top_k_each(v, asked, 11).filter("id <> query_id").withColumn("rel", (F.col("ql") == F.col("wing")).cast("int"))
    from pyspark.sql import Window

    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))).filter("rank <= 10").withColumnRenamed("id", "item")


@register(
    "recall_mrr",
    f"{_RANKED}, f AS (SELECT query_id, ql, min(CASE WHEN rel = 1 THEN rank END) AS h FROM res GROUP BY ALL) SELECT ql AS category, count(*) AS queries, round(avg(CASE WHEN h <= 5 THEN 1.0 ELSE 0.0 END), 6) AS r_at_5, round(avg(CASE WHEN h <= 10 THEN 1.0 ELSE 0.0 END), 6) AS r_at_10, round(avg(coalesce(1.0 / h, 0.0)), 6) AS mrr FROM f GROUP BY ql",
)
def recall_mrr(spark, sf):
    res = _results(spark, sf)
    ranks = res.groupBy("query_id", "ql").agg(F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("hit_rank"))
    out = metrics.recall_and_mrr(ranks, ["ql"])
    return out.select(F.col("ql").alias("category"), "queries", *[F.round(c, 6).alias(c) for c in ("r_at_5", "r_at_10", "mrr")])


@register(
    "ndcg_at_10",
    f"{_RANKED}, b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rank) AS best FROM res), g AS (SELECT query_id, sum(rel / log2(rank + 1.0)) AS dcg, sum(rel / log2(best + 1.0)) AS idcg FROM b GROUP BY 1) SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END, 6) AS ndcg FROM g",
)
def ndcg_at_10(spark, sf):
    return metrics.ndcg(_results(spark, sf)).select("query_id", F.round("ndcg", 6).alias("ndcg"))


@register("latency_percentiles", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf):
    out = metrics.percentiles(table(spark, sf, "events"), "value", ["event_type"], {"median": 0.5, "p95": 0.95})
    return out.select("event_type", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@register("token_estimates", r"SELECT doc_id, greatest(1, CAST(floor(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) * 1.3) AS BIGINT)) AS tokens FROM documents")
def token_estimates(spark, sf):
    from tessellum.functions.text import token_estimate

    return table(spark, sf, "documents").select("doc_id", token_estimate(F.col("text")).alias("tokens"))


@register("close_names")
def close_names(spark, sf):
    """The three names of parts closest to each twentieth one's (its own first); no SQL has the ratio of matching blocks."""
    from tessellum.operators.similar_names import close_names

    parts = table(spark, sf, "part")
    return close_names(parts.filter("p_partkey % 20 = 0").select(F.col("p_name").alias("value")), parts.select(F.col("p_name").alias("name")))
