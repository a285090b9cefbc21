"""A versioned table of rows with an id, on plain Parquet: a commit adds a folder of rows and a folder of ids that go.

A writer puts its rows and ids in folders of names that nobody else can guess; they count only once a version names them. A
version is a small file, made by an exclusive create (or under a lease, where a file system has none), that lists the folders
it reads. Of two writers at once one makes the version; the other looks at what came between: if its own commit was made from
an older version and touches ids that the others touched, it fails with a ``ConflictError``; else it follows them. Commits
that were made from nothing (plain additions, upserts) always follow. What a dead writer left is read by nobody; ``vacuum``
deletes it by age. Rows are merged when they are read: an id that went with commit n hides rows of earlier commits.
``compact`` folds the folders into one; older versions stay readable until ``vacuum``.
"""

from __future__ import annotations

import contextlib
import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG = "version long, reason string, at double, kind string, own string, data array<struct<seq: long, rows: long, folder: string>>, gone array<struct<seq: long, folder: string>>"
#: Before the first version.
NOTHING = {"version": 0, "data": [], "gone": []}
#: How often a writer follows others; seconds after which a version file without content is given up; age of leftovers.
TRIES, GRACE_S, LEFT_S = 50, 10.0, 86400.0
#: Stored bytes of one file that a compaction writes, about.
FILE_BYTES = 64 << 20


class ConflictError(RuntimeError):
    """Another writer made this version first, or has changed the same ids since."""


class LogTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, part: str | None = None, lease=None):
        """``schema``: columns with an ``id``. ``part``: the column that folders are cut by; filters on it skip files.
        ``lease``: held while a version is made (see ``lease.Lease``)."""
        self.spark, self.path, self.part, self.lease = spark, path.rstrip("/"), part, lease
        self.schema = T._parse_datatype_string(schema)

    # ---- files

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), target

    def _delete(self, path: str) -> None:
        fs, target = self._fs(path)
        fs.delete(target, True)

    # ---- versions

    def versions(self) -> DataFrame:
        """All versions; empty where there is no table yet."""
        fs, folder = self._fs(f"{self.path}/log")
        if not fs.exists(folder):
            return self.spark.createDataFrame([], LOG)
        return self.spark.read.schema(LOG).json(f"{self.path}/log/*.json")

    def head(self, version: int | None = None) -> dict | None:
        """What the newest (or a given) version reads."""
        if version == 0:
            return None
        rows = self.versions()
        if version is not None:
            rows = rows.filter(F.col("version") == version)
        row = rows.orderBy(F.desc("version")).first()
        return row.asDict(recursive=True) if row else None

    def _make(self, data: list[dict], gone: list[dict], reason: str, after: dict | None, kind: str = "write", own: str = "") -> int:
        """The version behind ``after``; a ConflictError if there is one already."""
        version = (after["version"] if after else 0) + 1
        row = json.dumps({"version": version, "reason": reason, "at": self._now(), "kind": kind, "own": own, "data": data, "gone": gone})
        with self.lease.held() if self.lease else contextlib.nullcontext():
            fs, target = self._fs(f"{self.path}/log/{version:012d}.json")
            if self.lease and fs.exists(target):
                raise ConflictError(f"version {version} of {self.path} was made meanwhile")
            try:
                out = fs.create(target, False)
            except Exception as e:
                if "already exists" in str(e).lower() or "AlreadyExists" in str(e):
                    raise ConflictError(f"version {version} of {self.path} was made meanwhile") from None
                raise
            try:
                out.write(bytearray((row + "\n").encode()))
            finally:
                out.close()
        return version

    def _now(self) -> float:
        return self.spark._jvm.java.lang.System.currentTimeMillis() / 1e3

    def _newest(self) -> dict:
        """The newest version. One whose file has no content yet is waited for; it is void after ``GRACE_S``, so that a writer
        that died between the file and its content holds up nobody (one that only slept writes to a file that is gone)."""
        while True:
            fs, folder = self._fs(f"{self.path}/log")
            files = {int(f.getPath().getName()[:12]): f for f in fs.listStatus(folder) if f.getPath().getName().endswith(".json")} if fs.exists(folder) else {}
            head = self.head() or dict(NOTHING)
            last = max(files, default=0)
            if last <= head["version"]:
                return head
            if self._now() - files[last].getModificationTime() / 1e3 < GRACE_S:
                time.sleep(0.1)
                continue
            fs.delete(files[last].getPath(), False)
            with contextlib.suppress(ConflictError):
                self._make(head["data"], head["gone"], "void", {"version": last - 1}, "void")

    def _follows(self, after: dict, head: dict, own: str) -> None:
        """Raises a ConflictError if versions since ``after`` touched ids of the folders ``own``, or can't be told."""
        since = self.versions().filter((F.col("version") > after["version"]) & (F.col("version") <= head["version"])).select("version", "kind", "own").collect()
        if len(since) < head["version"] - after["version"] or any(r["kind"] == "restore" for r in since):
            raise ConflictError(f"{self.path} was brought to another state after version {after['version']}")
        others = [r["own"] for r in since if r["kind"] == "write"]
        if others and not self._ids([own]).join(self._ids(others), "id", "left_semi").isEmpty():
            raise ConflictError(f"ids of {self.path} were changed by another writer after version {after['version']}")

    def _ids(self, names: list[str]) -> DataFrame:
        """All ids that commits of these names added or took away."""
        paths = [p for name in names for p in (f"{self.path}/data/c={name}", f"{self.path}/gone/c={name}") if self._there(p)]
        return self.spark.read.schema("id string").parquet(*paths).distinct()

    def _bytes(self, path: str) -> int:
        fs, target = self._fs(path)
        return fs.getContentSummary(target).getLength() if fs.exists(target) else 0

    def _there(self, path: str) -> bool:
        fs, target = self._fs(path)
        return fs.exists(target)

    def commit(self, rows: DataFrame | None, gone: DataFrame | None, reason: str, after: dict | None = None) -> int:
        """A version with ``rows`` added and the rows of the ids ``gone`` (from before) left out; cost follows these two.
        ``after``: the version that they were made from; without it the commit follows whatever is newest."""
        own, n = uuid.uuid4().hex, 0
        if rows is not None:
            self._write(rows, own)
            n = self.spark.read.schema("id string").parquet(f"{self.path}/data/c={own}").count()
        if gone is not None:
            gone.select("id").distinct().write.parquet(f"{self.path}/gone/c={own}")
        try:
            for _ in range(TRIES):
                head = self._newest()
                if after is not None and head["version"] > after["version"]:
                    self._follows(after, head, own)
                seq = head["version"] + 1
                data = [*head["data"], *([{"seq": seq, "rows": n, "folder": own}] if rows is not None else [])]
                left = [*head["gone"], *([{"seq": seq, "folder": own}] if gone is not None else [])]
                with contextlib.suppress(ConflictError):
                    return self._make(data, left, reason, head, own=own)
            raise ConflictError(f"{self.path}: other writers made {TRIES} versions meanwhile")
        except ConflictError:
            self._delete(f"{self.path}/data/c={own}")
            self._delete(f"{self.path}/gone/c={own}")
            raise

    def _write(self, rows: DataFrame, own: str) -> None:
        out = rows.select(*[F.col(f.name) for f in self.schema])
        writer = out.withColumn("part", F.concat(F.lit("p"), F.col(self.part))).write.partitionBy("part") if self.part else out.write
        writer.parquet(f"{self.path}/data/c={own}")

    # ---- reading

    def read(self, where: Column | None = None, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows of the newest (or a given) version; of ``parts`` only their files."""
        head = self.head(version)
        if not head or not head["data"]:
            return self.spark.createDataFrame([], self.schema)
        schema = T.StructType([*self.schema, *([T.StructField("part", T.StringType())] if self.part else []), T.StructField("c", T.StringType())])
        full = [d for d in head["data"] if d["rows"]] or head["data"][:1]
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/c={d['folder']}" for d in full])
        if parts is not None and self.part:
            rows = rows.filter(F.col("part").isin([f"p{p}" for p in parts]))
        if where is not None:
            rows = rows.filter(where)
        if head["gone"]:
            ids = self.spark.read.schema("id string, c string").option("basePath", f"{self.path}/gone").parquet(*[f"{self.path}/gone/c={g['folder']}" for g in head["gone"]])
            last = ids.groupBy("id").agg(F.max(_seq(head["gone"])).alias("_gone"))
            rows = rows.join(last, "id", "left").filter(F.coalesce(F.col("_gone"), F.lit(0)) <= _seq(full))
        return rows.select(*[f.name for f in self.schema])

    def count(self) -> int:
        """From the version alone while nothing has gone."""
        head = self.head()
        if not head:
            return 0
        return self.read().count() if head["gone"] else sum(d["rows"] for d in head["data"])

    # ---- maintenance

    def compact(self, file_rows: int = 1_000_000) -> int:
        """All rows in one folder, with files of up to ``file_rows``, and of FILE_BYTES about by what is stored now: a task
        writes one range of ``part`` and id, so that a large part is dealt to several."""
        head = self.head()
        if not head:
            return 0
        n, own = self.read(version=head["version"]).count(), uuid.uuid4().hex
        files = max(1, -(-n // file_rows), -(-sum(self._bytes(f"{self.path}/data/c={d['folder']}") for d in head["data"]) // FILE_BYTES))
        keys = [self.part] if self.part else []
        self._write(self.read(version=head["version"]).repartitionByRange(files, *keys, "id"), own)
        written = self.spark.read.schema("id string").parquet(f"{self.path}/data/c={own}").count() if n else 0
        if written != n:
            self._delete(f"{self.path}/data/c={own}")
            raise RuntimeError(f"{written} of {n} rows were written; nothing was changed")
        for _ in range(TRIES):  # what others have written meanwhile stays behind the fold
            now = self._newest()
            since = self.versions().filter(F.col("version") > head["version"]).select("kind").collect()
            if any(r["kind"] in ("compact", "restore") for r in since):
                break
            later = [[x for x in now[what] if x["seq"] > head["version"]] for what in ("data", "gone")]
            with contextlib.suppress(ConflictError):
                return self._make([{"seq": head["version"], "rows": n, "folder": own}, *later[0]], later[1], "compact", now, "compact", own)
        self._delete(f"{self.path}/data/c={own}")
        raise ConflictError(f"{self.path} was folded or brought to another state meanwhile")

    def restore(self, version: int) -> int:
        """A new version that reads what an older one read."""
        old = self.head(version)
        if old is None:
            raise ValueError(f"no version {version}")
        return self._make(old["data"], old["gone"], f"restore {version}", self._newest(), "restore")

    def vacuum(self, older_than: float = 0.0, leftovers: float = LEFT_S) -> int:
        """Forget versions older than so many seconds, but the newest, and delete folders that no version left reads; those
        that no version has ever named once they are older than ``leftovers``, as their writer may still be at work.
        Returns the number of versions that went."""
        rows = [r.asDict(recursive=True) for r in self.versions().orderBy("version").collect()]
        if not rows:
            return 0
        newest = rows[-1]
        limit = self._now() - older_than
        old = [r for r in rows[:-1] if r["at"] <= limit]
        keep = [r for r in rows if r not in old] or [newest]
        for what in ("data", "gone"):
            held = {d["folder"] for r in keep for d in r[what]}
            known = {d["folder"] for r in old for d in r[what]}
            fs, folder = self._fs(f"{self.path}/{what}")
            for f in fs.listStatus(folder) if fs.exists(folder) else []:
                name = f.getPath().getName().removeprefix("c=")
                left = name not in known and self._now() - f.getModificationTime() / 1e3 > leftovers
                if name not in held and (name in known or left):
                    fs.delete(f.getPath(), True)
        for r in old:
            self._delete(f"{self.path}/log/{r['version']:012d}.json")
        return len(old)


def _seq(folders: list[dict]) -> Column:
    """The version that a row's folder came with."""
    return F.create_map(*[F.lit(x) for f in folders for x in (f["folder"], f["seq"])])[F.col("c")]
