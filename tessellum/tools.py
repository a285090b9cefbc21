"""The engine's tools as one Python API over a chunk store, its vectors and a store of facts.

Each tool gives a DataFrame (or writes). ``embedder`` turns a query text into a vector; without a model the test
embedder of ``functions.text`` serves.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellum.functions.text import chunk_id, glob_regex
from tessellum.functions.text import embed as test_embed
from tessellum.operators import code_graph, graph, kg, reader, rerank, taxonomy, vector
from tessellum.operators.facts_store import FactStore
from tessellum.operators.store import ChunkStore

MOST_RESULTS = 50


def embedded_by(embedder: Callable[[str], list[float]]) -> Callable[[Column], Column]:
    """A text's vector as a column; the workers get the embedder."""

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [float(x) for x in embedder(t)])

    return vectors


class Tools:
    def __init__(self, spark: SparkSession, path: str, embedder: Callable[[str], list[float]] | None = None, embed: Callable[[Column], Column] | None = None):
        """``embed``: the vectors of chunks that are written, as a column; without it ``embedder`` makes them, in batches on the
        workers, so that chunks and queries lie in one space."""
        self.spark = spark
        self.chunks = ChunkStore(spark, f"{path}/chunks", embed or (embedded_by(embedder) if embedder else test_embed))
        self.facts = FactStore(spark, f"{path}/facts")
        self._embedder = embedder

    def _vector(self, text: str) -> list[float]:
        if self._embedder:
            return self._embedder(text)
        return list(self.spark.createDataFrame([(text,)], "t string").select(self.chunks.embed(F.col("t"))).first()[0])

    def _vectors(self, wing: str | None = None) -> DataFrame:
        return self.chunks.read(wings=[wing] if wing else None, vectors=True)

    # read
    def status(self) -> DataFrame:
        return taxonomy.status(self.chunks.read())

    def list_wings(self) -> DataFrame:
        return taxonomy.count_by(self.chunks.read(), "wing")

    def list_rooms(self, wing: str | None = None) -> DataFrame:
        return taxonomy.count_by(self.chunks.read(wings=[wing] if wing else None), "room")

    def get_taxonomy(self) -> DataFrame:
        return taxonomy.count_by_pair(self.chunks.read())

    # facts
    def kg_query(self, entity: str, as_of: str | None = None, direction: str = "both") -> DataFrame:
        return kg.query_entity(self.facts.triples(), self.facts.entities(), entity, as_of, direction)

    def kg_add(self, subject: str, predicate: str, object: str, valid_from: str | None = None, valid_to: str | None = None, source_closet: str | None = None, source_file: str | None = None) -> None:
        row = (subject, predicate, object, valid_from, valid_to, source_closet, source_file)
        self.facts.add(self.spark.createDataFrame([row], "subject string, predicate string, object string, valid_from string, valid_to string, source_closet string, source_file string"))

    def kg_invalidate(self, subject: str, predicate: str, object: str, ended: str | None = None) -> None:
        hit = (F.col("subject") == kg._id(subject)) & (F.col("predicate") == predicate.lower().replace(" ", "_")) & (F.col("object") == kg._id(object))
        self.facts.invalidate(hit, ended, refuse_late=True)

    def kg_timeline(self, entity: str | None = None) -> DataFrame:
        return kg.timeline(self.facts.triples(), self.facts.entities(), entity)

    def kg_stats(self) -> DataFrame:
        return kg.stats(self.facts.triples(), self.facts.entities())

    # code
    def find_implementations(self, interface: str) -> DataFrame:
        return code_graph.implementations(self.facts.triples(), kg._id(interface))

    def find_references(self, type_name: str) -> DataFrame:
        return code_graph.references(self.facts.triples(), kg._id(type_name))

    def show_project_graph(self, solution: str | None = None) -> DataFrame:
        return code_graph.project_graph(self.facts.triples(), solution and kg._id(solution))

    def show_type_dependencies(self, type_name: str, max_depth: int = 3) -> DataFrame:
        up, down = (kg.type_chain(self.facts.triples(), type_name, max_depth, upward=u).withColumn("side", F.lit(s)) for u, s in ((True, "ancestor"), (False, "descendant")))
        return up.union(down)

    def explain_subsystem(self, query: str, wing: str | None = None, language: str | None = None, n_results: int = 5) -> DataFrame:
        """Facts of the symbols that a code search finds, by symbol and side."""
        hits = self.code_search(query, language=language, wing=wing, n_results=n_results).filter("symbol_name <> ''")
        symbols = hits.select(F.lower("symbol_name").alias("symbol")).distinct()
        t = self.facts.triples().filter("valid_to IS NULL")
        out = t.join(F.broadcast(symbols), F.col("subject") == F.col("symbol")).select("symbol", F.lit("outgoing").alias("side"), "predicate", F.col("object").alias("other"))
        into = t.join(F.broadcast(symbols), F.col("object") == F.col("symbol")).select("symbol", F.lit("incoming").alias("side"), "predicate", F.col("subject").alias("other"))
        return out.union(into).groupBy("symbol", "side", "predicate").agg(F.sort_array(F.collect_set("other")).alias("others"))

    def extract_reusable(self, entity: str, max_depth: int = 3) -> DataFrame:
        return code_graph.reusable(self.facts.triples(), kg._id(entity), max_depth)

    # rooms
    def traverse(self, start_room: str, max_hops: int = 2) -> DataFrame:
        return graph.traverse(graph.nodes(self.chunks.read()), start_room, max_hops)

    def find_tunnels(self, wing_a: str | None = None, wing_b: str | None = None) -> DataFrame:
        return graph.tunnels(graph.nodes(self.chunks.read()), wing_a, wing_b)

    def graph_stats(self) -> DataFrame:
        return graph.stats(graph.nodes(self.chunks.read()))

    # search
    def search(self, query: str, limit: int = 5, wing: str | None = None, room: str | None = None) -> DataFrame:
        where = F.col("room") == room if room else None
        found = vector.top_k(self._vectors(wing), self._vector(query), limit, where)
        return found.drop("vector").withColumn("similarity", vector.similarity(F.col("distance")))

    def code_search(self, query: str, language: str | None = None, symbol_name: str | None = None, symbol_type: str | None = None, file_glob: str | None = None, wing: str | None = None, n_results: int = 10, rerank_by: str | None = None) -> DataFrame:
        n = max(1, min(n_results, MOST_RESULTS))
        pool = min(5 * n, 200) if rerank_by == "hybrid" else min(3 * n, 150)
        where = F.lit(True)
        for column, value in (("language", language), ("symbol_type", symbol_type)):
            if value:
                where = where & (F.col(column) == value)
        fetch = rerank.overfetch_limit(pool) if rerank.wants_project_file(query) or rerank.wants_symbol(query) else pool
        found = rerank.ranked(vector.top_k(self._vectors(wing), self._vector(query), fetch, where).drop("vector"))
        if fetch > pool:
            found = rerank.intent_rerank(found, query, pool)
            best = F.row_number().over(Window.orderBy("intent_score", "rank")) - 1  # a pool of at most 150 rows
            found = found.withColumn("rank", best)
        order = [F.col("rank")]
        if rerank_by == "hybrid":
            found = rerank.hybrid_rerank(found, query)
            order = [F.desc("hybrid"), F.col("rank")]
        if symbol_name:
            found = found.filter(F.contains(F.lower("symbol_name"), F.lit(symbol_name.lower())))
        if file_glob:
            found = found.filter(F.col("source_file").rlike(glob_regex(file_glob)))
        return found.orderBy(*order).limit(n).withColumn("similarity", vector.similarity(F.col("distance")))

    def file_context(self, source_file: str, wing: str | None = None) -> DataFrame:
        return reader.file_context(self.chunks.read(wings=[wing] if wing else None), source_file)

    def check_duplicate(self, content: str, threshold: float = 0.9) -> DataFrame:
        near = vector.duplicates(self._vectors(), self._vector(content), threshold)
        return near.select("id", "wing", "room", "similarity", F.left("text", F.lit(200)).alias("preview"))

    def read(self, source_file: str, start_line: int, end_line: int, wing: str | None = None) -> DataFrame:
        """Lines of a file's chunks, each once, with a status; see ``reader.read_slice``."""
        return reader.read_slice(self.chunks.read(wings=[wing] if wing else None), source_file, start_line, end_line)

    # write
    def add_drawer(self, wing: str, room: str, content: str, source_file: str | None = None, added_by: str = "tool") -> str | None:
        """The new id; None if the store holds a near duplicate."""
        if not self.check_duplicate(content).isEmpty():
            return None
        row = self.spark.createDataFrame([(wing, room, content, source_file or "", added_by)], "wing string, room string, text string, source_file string, added_by string")
        row = row.withColumns({"chunk_index": F.lit(0), "id": chunk_id(F.col("wing"), F.col("room"), F.md5("text"), F.lit(0)), "filed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "chunker_strategy": F.lit("manual_v1")})
        self.chunks.upsert(row)
        return row.select("id").first()[0]

    def delete_drawer(self, drawer_id: str) -> int:
        return self.chunks.delete(F.col("id") == drawer_id)

    def delete_wing(self, wing: str) -> int:
        return self.chunks.delete_wing(wing)

    def mine(self, directory: str, wing: str, extensions: list[str], **rules) -> dict[str, int]:
        from tessellum.streaming.watch import ingest

        return ingest(self.spark, directory, self.chunks, wing, extensions, **rules)

    def diary_write(self, agent_name: str, entry: str, topic: str = "general") -> None:
        row = self.spark.createDataFrame([(agent_name, entry, topic)], "agent string, text string, topic string")
        at = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        row = row.withColumns({"wing": F.concat(F.lit("wing_"), F.lower("agent")), "room": F.lit("diary"), "hall": F.lit("hall_diary"), "type": F.lit("diary_entry"), "filed_at": at, "date": F.left(at, F.lit(10)), "chunker_strategy": F.lit("diary_v1")})
        self.chunks.add(row.withColumn("id", F.concat_ws("_", F.lit("diary"), "wing", F.md5(F.concat("text", "filed_at")))))

    def diary_read(self, agent_name: str, last_n: int = 10) -> DataFrame:
        rows = self.chunks.read(wings=[f"wing_{agent_name.lower()}"]).filter("room = 'diary'")
        return reader.latest(rows, last_n).select("date", "filed_at", "topic", "text")
