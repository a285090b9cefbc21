"""The stored graph of facts: triples and entities in one log of commits, so that a fact and its entities come together."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.functions.text import entity_id
from tessellum.operators import kg
from tessellum.operators.lease import Lease
from tessellum.operators.log_table import NOTHING, ConflictError, LogTable

TRIPLE = "id string, subject string, predicate string, object string, valid_from string, valid_to string, confidence double, source_closet string, source_file string, extracted_at string"
ENTITY = "id string, name string, type string, properties string, created_at string"
KINDS = {"triples": TRIPLE, "entities": ENTITY}
#: How often an addition is made anew because another writer brought the same facts or entities meanwhile.
TRIES = 10


class FactStore:
    """A fact that is added or ended is written alone. Ids in the log start with their kind, as an entity may be named as a fact."""

    def __init__(self, spark: SparkSession, path: str, lease: Lease | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        columns = dict(c.split() for kind in KINDS.values() for c in kind.split(", "))
        self._log = LogTable(spark, self.path, ", ".join(f"{n} {k}" for n, k in columns.items()) + ", kind string", "kind", lease)

    def _read(self, kind: str, version: int | None = None) -> DataFrame:
        names = [c.split()[0] for c in KINDS[kind].split(", ")]
        return self._log.read(parts=[kind], version=version).withColumn("id", F.substring("id", len(kind) + 2, 1 << 30)).select(*names)

    def _rows(self, kind: str, rows: DataFrame) -> DataFrame:
        """Rows of a kind as the log holds them."""
        out = [F.concat(F.lit(f"{kind}:"), F.col("id")).alias("id")]
        for f in self._log.schema:
            if f.name not in ("id", "kind"):
                out.append(F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name))
        return rows.select(*out, F.lit(kind).alias("kind"))

    def triples(self) -> DataFrame:
        return self._read("triples")

    def entities(self) -> DataFrame:
        return self._read("entities")

    def count(self) -> int:
        return self._log.count()

    def replace_all(self, tables: dict[str, DataFrame], reason: str) -> int:
        """One version that holds these triples and entities alone."""
        head = self._log.head() or NOTHING
        rows = None
        for kind, table in tables.items():
            of_kind = self._rows(kind, table)
            rows = of_kind if rows is None else rows.unionByName(of_kind)
        return self._log.commit(rows, self._log.read(version=head["version"]).select("id") if head["data"] else None, reason, head)

    def add(self, facts: DataFrame) -> None:
        """Facts by name (``subject``, ``predicate``, ``object`` and what else of a triple there is): entities are made
        as needed, open duplicates aren't added, and windows that end before they start raise."""
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        rows = facts
        for name, kind in (c.split() for c in TRIPLE.split(", ")):
            if name not in facts.columns:
                default = {"confidence": 1.0, "extracted_at": now}.get(name)
                rows = rows.withColumn(name, F.lit(default).cast(kind))
        ids = rows.withColumns({"_s": F.col("subject"), "_o": F.col("object"), "subject": entity_id(F.col("subject")), "object": entity_id(F.col("object")), "predicate": F.replace(F.lower("predicate"), F.lit(" "), F.lit("_"))})
        key = F.concat_ws("|", "subject", "predicate", "object", F.coalesce("valid_from", F.lit("")), F.coalesce("valid_to", F.lit("")))
        ids = ids.withColumn("id", F.concat_ws("_", F.lit("t"), "subject", "predicate", "object", F.left(F.md5(F.concat(key, F.lit(now))), F.lit(8))))
        bad = kg.window_errors(ids).first()
        if bad:
            raise ValueError(f"{bad['error']}: {bad['_s']} {bad['predicate']} {bad['_o']}")
        names = ids.select(F.col("_s").alias("name"), F.lit(0).alias("order")).union(ids.select(F.col("_o"), F.lit(1)))
        for attempt in range(TRIES):
            head = self._log.head() or NOTHING
            held, known = (self._read(kind, head["version"]) for kind in KINDS)
            made = kg.auto_entities(known, names).withColumn("created_at", F.coalesce("created_at", F.lit(now))).join(known.select("id"), "id", "left_anti")
            new = kg.add_triples(held, ids.drop("_s", "_o")).join(held.select("id"), "id", "left_anti")
            try:
                self._log.commit(self._rows("entities", made).unionByName(self._rows("triples", new)), None, "add", head)
                return
            except ConflictError:
                if attempt + 1 == TRIES:
                    raise

    def add_entity(self, name: str, kind: str = "unknown", properties: str = "{}") -> None:
        now = datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        new = self.spark.createDataFrame([(name, kind, properties, now)], "name string, type string, properties string, created_at string").withColumn("id", entity_id(F.col("name")))
        rows = self._rows("entities", new)
        self._log.commit(rows, rows.select("id"), "add entity")

    def invalidate(self, condition: Column, ended: str | None = None, refuse_late: bool = False) -> None:
        """End the open facts that meet the condition. One that starts behind the end stays open, or is an error. Facts that
        another writer has changed meanwhile are looked at anew."""
        day = ended or datetime.date.today().isoformat()
        for attempt in range(TRIES):
            head = self._log.head() or NOTHING
            before = self._read("triples", head["version"])
            late = kg.late_starts(before, condition, day).first() if refuse_late else None
            if late:
                raise ValueError(f"{late['subject']} {late['predicate']} {late['object']} starts at {late['valid_from']}, after {day}")
            ended_now = kg.invalidate(before, condition, day).join(before.filter("valid_to IS NULL").select("id"), "id", "left_semi").filter("valid_to IS NOT NULL")
            rows = self._rows("triples", ended_now)
            try:
                self._log.commit(rows, rows.select("id"), "invalidate", head)
                return
            except ConflictError:
                if attempt + 1 == TRIES:
                    raise
