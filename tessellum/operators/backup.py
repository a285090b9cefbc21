"""Backups of a chunk store and its facts as Parquet snapshots, their catalogue, retention and restoring."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.operators.facts_store import KINDS, FactStore
from tessellum.operators.ingest import newest_per_kind
from tessellum.operators.log_table import NOTHING
from tessellum.operators.store import ChunkStore

CATALOGUE = "name string, kind string, mtime double, chunks long, triples long, entities long, bytes long"
#: A backup older than this is stale, one over this size oversized.
STALE_S, OVERSIZED = 7 * 86400.0, 10 << 30


class Backups:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def size_of(self, path: str) -> int:
        """Bytes below a folder, 0 where there is none: an estimate of what a backup of it takes."""
        fs, target = self._fs(path)
        return fs.getContentSummary(target).getLength() if fs.exists(target) else 0

    def create(self, chunks: ChunkStore, facts: FactStore | None = None, kind: str = "manual", keep: int | None = None, room_for: Callable[[int], bool] = lambda needed: True) -> str:
        """A snapshot of what the stores read now; its name. Without room for the estimate nothing is written. ``keep``: of this
        kind only the newest so many stay."""
        needed = self.size_of(chunks.path) + (self.size_of(facts.path) if facts else 0)
        if not room_for(needed):
            raise RuntimeError(f"no room for a backup of about {needed} bytes")
        now = self.spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
        name = f"{kind}_{now}"
        tables = {"chunks": chunks.read(vectors=True)} | ({"triples": facts.triples(), "entities": facts.entities()} if facts else {})
        counts = {}
        for what, rows in tables.items():
            path = f"{self.root}/{name}/{what}"
            rows.write.parquet(path)
            counts[what] = self.spark.read.schema(rows.schema).parquet(path).count()
        row = {"name": name, "kind": kind, "mtime": now / 1e6, "triples": 0, "entities": 0} | counts | {"bytes": self.size_of(f"{self.root}/{name}")}
        fs, target = self._fs(f"{self.root}/catalogue/{name}.json")
        out = fs.create(target, False)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()
        if keep is not None:
            self.retain(keep, kind)
        return name

    def catalogue(self, stale_s: float = STALE_S, oversized: int = OVERSIZED) -> DataFrame:
        """All backups, newest first, with their age in seconds and whether they are stale or oversized."""
        fs, folder = self._fs(f"{self.root}/catalogue")
        rows = self.spark.read.schema(CATALOGUE).json(f"{self.root}/catalogue/*.json") if fs.exists(folder) and fs.listStatus(folder) else self.spark.createDataFrame([], CATALOGUE)
        age = F.unix_micros(F.current_timestamp()) / 1e6 - F.col("mtime")
        return rows.withColumns({"age": age, "stale": age > stale_s, "oversized": F.col("bytes") > oversized}).orderBy(F.desc("mtime"), "name")

    def retain(self, keep: int, kind: str) -> list[str]:
        """Delete all but the newest ``keep`` backups of a kind; the names of those that went."""
        rows = newest_per_kind(self.catalogue().filter(F.col("kind") == kind), keep).filter("NOT retained")
        gone = [r["name"] for r in rows.select("name").collect()]
        for name in gone:
            for path in (f"{self.root}/catalogue/{name}.json", f"{self.root}/{name}"):
                fs, target = self._fs(path)
                fs.delete(target, True)
        return gone

    def restore(self, name: str, chunks: ChunkStore, facts: FactStore | None = None, force: bool = False) -> int:
        """Bring a snapshot into the stores as one version each; stores with rows are refused unless ``force``, which replaces
        them. Snapshots that are not whole are refused."""
        row = self.catalogue().filter(F.col("name") == name).first()
        if row is None:
            raise ValueError(f"no backup {name}")
        stores = {"chunks": chunks.log} | ({"facts": facts} if facts else {})
        if not force and any(store.count() for store in stores.values()):
            raise ValueError("the store holds rows; force replaces them")
        schemas = {"chunks": chunks.log.schema} | (KINDS if facts else {})
        parts = {what: self.spark.read.schema(schema).parquet(f"{self.root}/{name}/{what}") for what, schema in schemas.items() if row[what] or what == "chunks"}
        for what, rows in parts.items():
            if rows.count() != row[what]:
                raise ValueError(f"{what} of {name} are not whole")
        head = chunks.log.head() or NOTHING
        chunks.log.commit(parts.pop("chunks"), chunks.log.read(version=head["version"]).select("id") if head["data"] else None, f"restore {name}", head)
        if parts:
            facts.replace_all(parts, f"restore {name}")
        return row["chunks"]
