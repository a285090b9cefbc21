"""A versioned store of chunks with their vectors, on a log of commits.

A write adds the rows that it brings and the ids that go; nothing else is written anew, and readers of an older version go
on reading theirs. Vectors are made once, when a chunk is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellum.functions.text import embed as test_embed
from tessellum.operators.lease import Lease
from tessellum.operators.log_table import LEFT_S, LogTable
from tessellum.operators.reader import pick

# The columns of a chunk and what stands for unknown.
CHUNK_COLUMNS = {
    "id": "string", "text": "string", "wing": "string", "room": "string", "source_file": "string", "chunk_index": "int", "added_by": "string", "filed_at": "string", "hall": "string", "topic": "string", "type": "string", "agent": "string", "date": "string",
    "ingest_mode": "string", "extract_mode": "string", "compression_ratio": "float", "original_tokens": "int", "language": "string", "symbol_name": "string", "symbol_type": "string", "heading": "string", "heading_level": "int", "heading_path": "string",
    "doc_section_type": "string", "contains_mermaid": "int", "contains_code": "int", "contains_table": "int", "source_hash": "string", "extractor_version": "string", "chunker_strategy": "string", "line_start": "int", "line_end": "int",
}
VECTOR = "vector"


def conform(rows: DataFrame, embed: Callable[[Column], Column] = test_embed) -> DataFrame:
    """The columns of a chunk: unknown ones go, missing ones and nulls get '' or 0, others are cast (bad numbers: 0). A missing
    vector is made from the text."""
    out = []
    for name, kind in CHUNK_COLUMNS.items():
        empty = F.lit("") if kind == "string" else F.lit(0).cast(kind)
        out.append((F.coalesce(F.col(name).try_cast(kind), empty) if name in rows.columns else empty).alias(name))
    made = embed(F.coalesce(F.col("text"), F.lit(""))).cast("array<float>") if "text" in rows.columns else F.array().cast("array<float>")
    vector = F.coalesce(F.col(VECTOR).cast("array<float>"), made) if VECTOR in rows.columns else made
    return rows.select(*out, vector.alias(VECTOR))


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str, embed: Callable[[Column], Column] = test_embed, lease: Lease | None = None):
        """``embed``: the vector of a text, for chunks that come without one. ``lease``: see ``LogTable``."""
        self.spark, self.path, self.embed = spark, path.rstrip("/"), embed
        self.log = LogTable(spark, self.path, ", ".join(f"{n} {k}" for n, k in CHUNK_COLUMNS.items()) + f", {VECTOR} array<float>", "wing", lease)

    # ---- reading

    def version(self) -> int:
        head = self.log.head()
        return head["version"] if head else 0

    def read(self, where: Column | None = None, wings: list[str] | None = None, version: int | None = None, vectors: bool = False) -> DataFrame:
        """Rows of the newest (or a given) version; of ``wings`` only their files are read, and no vectors unless asked for."""
        rows = self.log.read(where, wings, version)
        return rows if vectors else rows.drop(VECTOR)

    def get(self, ids: list[str] | None = None, where: Column | None = None, limit: int = 10_000, offset: int = 0) -> DataFrame:
        """Rows of these ids, or a page in order of id."""
        rows = self.read(where)
        return pick(rows, ids) if ids is not None else rows.orderBy("id").offset(offset).limit(limit)

    def count(self) -> int:
        return self.log.count()

    # ---- writing

    def add(self, rows: DataFrame, reason: str = "add") -> int:
        """Rows with new ids; cost follows them."""
        return self.log.commit(conform(rows, self.embed), None, reason)

    def upsert(self, rows: DataFrame, order: str | None = None, reason: str = "upsert") -> int:
        """Rows replace those of the same id, in whatever wing; of several incoming rows of an id the last by ``order``, else the
        greatest by its columns. What is stored isn't read, so an upsert follows whatever other writers have made."""
        if order is not None:
            last = Window.partitionBy("id").orderBy(F.desc(order))
            new = conform(rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1"), self.embed)
        else:
            new = conform(rows, self.embed)
            new = new.groupBy("id").agg(F.max(F.struct(*[c for c in new.columns if c != "id"])).alias("_m")).select("id", "_m.*")
        return self.log.commit(new, new.select("id"), reason)

    def replace(self, rows: DataFrame, gone: DataFrame, reason: str, after: dict | None = None) -> int:
        """One version with ``rows`` and without the rows of the ids ``gone``; ``after``: the version that both were made from."""
        return self.log.commit(conform(rows, self.embed), gone, reason, after)

    def delete(self, condition: Column, reason: str = "delete", wings: list[str] | None = None) -> int:
        """Rows that meet the condition go; returns their number. Without any, no version is made."""
        head = self.log.head()
        if not head:
            return 0
        hit = self.read(condition, wings, head["version"]).select("id")
        n = hit.count()
        if n:
            self.log.commit(None, hit, reason, head)
        return n

    def delete_wing(self, wing: str) -> int:
        return self.delete(F.col("wing") == wing, "delete wing", [wing])

    def delete_sources(self, source_files: list[str], wing: str) -> int:
        return self.delete((F.col("wing") == wing) & F.col("source_file").isin(source_files), "delete sources", [wing])

    # ---- maintenance

    def compact(self, file_rows: int = 1_000_000, backup: Callable[[], bool] | None = None) -> int:
        """All rows in files of up to ``file_rows``; a backup that fails comes before, and the number of rows is checked."""
        if backup is not None and not backup():
            raise RuntimeError("no backup, so nothing was changed")
        return self.log.compact(file_rows)

    def vacuum(self, older_than: float = 0.0, leftovers: float = LEFT_S) -> int:
        """Forget older versions and delete what only they read, and what dead writers left so many seconds ago."""
        return self.log.vacuum(older_than, leftovers)

    def health(self, version: int | None = None) -> dict:
        """Counts, a first row and a grouping, each tried on its own."""
        out: dict = {"ok": True, "errors": []}
        rows = self.read(version=version)
        for name, probe in (("count", rows.count), ("head", lambda: rows.limit(1).collect()), ("group", lambda: rows.groupBy("wing").count().collect())):
            try:
                out[name] = probe()
            except Exception as e:
                out["ok"] = False
                out["errors"].append(f"{name}: {str(e)[:200]}")
        return out

    def restore(self, version: int) -> int:
        """A new version that reads what an older one read."""
        return self.log.restore(version)

    def recover(self, dry_run: bool = True) -> int | None:
        """The newest version whose probes all pass (restored unless ``dry_run``); None if none does."""
        for r in self.log.versions().orderBy(F.desc("version")).select("version").collect():
            if self.health(r["version"])["ok"]:
                if not dry_run and r["version"] != self.version():
                    self.restore(r["version"])
                return r["version"]
        return None

    def stats(self) -> dict[str, int]:
        """Bytes and files of all versions, versions, and bytes that the newest doesn't read."""
        from pyspark.errors import AnalysisException

        try:
            files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.path}/data").select("path", "length")
            sums = files.groupBy(F.regexp_extract("path", r"/c=(\w+)/", 1).alias("folder")).agg(F.sum("length").alias("bytes"), F.count("*").alias("files")).collect()
        except AnalysisException:
            sums = []
        head = self.log.head()
        live = {d["folder"] for d in head["data"]} if head else set()
        total = sum(r["bytes"] for r in sums)
        return {"bytes": total, "files": sum(r["files"] for r in sums), "versions": self.log.versions().count(), "reclaimable": total - sum(r["bytes"] for r in sums if r["folder"] in live)}
