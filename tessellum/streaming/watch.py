"""Ingest of folders, once or as a stream of what has changed in them."""

from __future__ import annotations

import contextlib
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessellum.functions.text import chunk_id
from tessellum.operators.dispatch import chunk_files
from tessellum.operators.ingest import file_changes
from tessellum.operators.log_table import NOTHING
from tessellum.operators.places import place_chunks
from tessellum.operators.store import ChunkStore
from tessellum.sources import folders

DEBOUNCE = "5 seconds"
#: Commits that an initial run tries again after, as their store was damaged or written by others.
RECOVER = 1


def _stored(store: ChunkStore, wing: str, version: int) -> DataFrame:
    """(source_file, source_hash) of a wing, by its first chunks."""
    return store.read(wings=[wing], version=version).groupBy("source_file").agg(F.min_by("source_hash", F.struct("chunk_index", "id")).alias("source_hash"))


def ingest(spark: SparkSession, root: str, store: ChunkStore, wing: str, extensions: list[str], room: str = "general", max_bytes: int | None = None, **rules) -> dict[str, int]:
    """Bring the store up to the folder: new and changed files are chunked, files that are gone go. Files are told apart by the
    hash of their bytes, so each is read once; of unchanged ones nothing more is done. Returns counts by kind of change."""
    head = store.log.head() or NOTHING
    walked = folders.listing(spark, root, folders.Rules.of(extensions, **rules)).filter("reason = ''").select("relative")
    hashed = folders.read_files(walked, root, max_bytes).filter("reason = ''").select(F.col("relative").alias("source_file"), "source_hash")
    changes = file_changes(_stored(store, wing, head["version"]), hashed).cache()
    try:
        return _apply(spark, root, store, wing, changes, head, room, max_bytes)
    finally:
        changes.unpersist()


def ingest_changes(spark: SparkSession, root: str, store: ChunkStore, wing: str, changed: DataFrame, room: str = "general", max_bytes: int | None = None) -> dict[str, int]:
    """Bring the store up to these files (``relative``, ``change``) alone, which are all that is read. One that is told to be
    deleted (or left out by now), or is no longer there, goes; one whose bytes are as stored stays."""
    head = store.log.head() or NOTHING
    names = changed.select("relative").distinct()
    hashed = folders.read_files(changed.filter("change <> 'deleted'").select("relative").distinct(), root, max_bytes).filter("reason = ''").select(F.col("relative").alias("source_file"), "source_hash")
    stored = _stored(store, wing, head["version"]).join(names.select(F.col("relative").alias("source_file")), "source_file", "left_semi")
    changes = file_changes(stored, hashed).cache()
    try:
        return _apply(spark, root, store, wing, changes, head, room, max_bytes)
    finally:
        changes.unpersist()


def _apply(spark: SparkSession, root: str, store: ChunkStore, wing: str, changes: DataFrame, head: dict, room: str, max_bytes: int | None) -> dict[str, int]:
    counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
    if not counts:
        return counts
    fresh = changes.filter("change <> 'deleted'").select(F.col("source_file").alias("relative"))
    files = folders.read_files(fresh, root, max_bytes).filter("reason = ''")
    files = files.select(F.col("relative").alias("path"), "source_hash", F.decode("content", "UTF-8").alias("text")).cache()
    old = store.read(wings=[wing], version=head["version"]).join(changes.select("source_file"), "source_file", "left_semi")
    store.replace(chunk_rows(files, wing, room), old.select("id"), "ingest", head)
    files.unpersist()
    return counts


def chunk_rows(files: DataFrame, wing: str, room: str = "general") -> DataFrame:
    """Rows of a store from files (``path``, ``text``, ``source_hash``), chunked by the way of their language: with language,
    symbol, section and lines."""
    made = chunk_files(files, metadata=True, look=True)
    rows = place_chunks(files, made).withColumnsRenamed({"content": "text", "path": "source_file", "route": "chunker_strategy"})
    rows = rows.join(files.select(F.col("path").alias("source_file"), "source_hash"), "source_file")
    rows = rows.withColumns({"wing": F.lit(wing), "room": F.lit(room), "filed_at": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"), "ingest_mode": F.lit("projects")})
    return rows.withColumn("id", chunk_id(F.col("wing"), F.col("room"), F.col("source_file"), F.col("chunk_index")))


def initial(spark: SparkSession, root: str, store: ChunkStore, wing: str, extensions: list[str], **rules) -> dict[str, int]:
    """The first ingest of a watch; where the store can't be read, it is brought to its newest version that can, once."""
    for attempt in range(RECOVER + 1):
        try:
            return ingest(spark, root, store, wing, extensions, **rules)
        except Exception:
            if attempt == RECOVER or store.recover(dry_run=False) is None:
                raise
    raise AssertionError


def room_left(spark: SparkSession, path: str, least: int) -> Callable[[], bool]:
    """A gate: whether the file system of a folder has so many bytes left."""

    def gate() -> bool:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        return fs.getStatus(target if fs.exists(target) else None).getRemaining() >= least

    return gate


def _state(checkpoint: str) -> str:
    return f"{folders.local(checkpoint)}/listings"


def _start(spark: SparkSession, root: str, store: ChunkStore, wing: str, extensions: list[str], checkpoint: str, on: str, gate: Callable[[], bool], tell: Callable[[int, dict | None], None], around, available_now: bool, rules: dict) -> StreamingQuery:
    state = _state(checkpoint)
    feed = folders.changes(spark, root, folders.Rules.of(extensions, **rules), state, on)

    def run(batch: DataFrame, number: int) -> None:
        changed = batch.select("relative", "change")
        if not gate():
            told = {r["relative"]: r["change"] for r in changed.collect()} if number else {"": "all"}
            folders.put_back(state, told, f"{number}-{uuid.uuid4().hex}")
            tell(number, None)
            return
        waiting = folders.pending(state)
        with around:
            if number == 0 or "" in waiting:  # the first run, or one that was put back
                counts = initial(batch.sparkSession, root, store, wing, extensions, **rules)
            else:
                if waiting:
                    before = batch.sparkSession.createDataFrame(list(waiting.items()), changed.schema)
                    changed = changed.union(before.join(changed, "relative", "left_anti"))
                counts = {} if changed.isEmpty() else ingest_changes(batch.sparkSession, root, store, wing, changed)
        folders.done(state)
        tell(number, counts)

    writer = feed.writeStream.queryName(f"watch_{wing}_{uuid.uuid4().hex[:8]}").foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=DEBOUNCE)).start()


def watch(spark: SparkSession, root: str, store: ChunkStore, wing: str, extensions: list[str], checkpoint: str, gate: Callable[[], bool] = lambda: True, on_batch: Callable[[int, dict], None] | None = None, available_now: bool = False, **rules) -> StreamingQuery:
    """A streaming query over the folder: the first batch brings the store up to it, each further one does what has changed,
    and nothing else is read. A batch that ``gate`` refuses (see ``room_left``) comes again with the next trigger. Ignore files
    are read anew by each listing. The listings lie in the checkpoint folder, which must be one that machines share."""

    def tell(number: int, counts: dict | None) -> None:
        if counts and on_batch:
            on_batch(number, counts)

    return _start(spark, root, store, wing, extensions, checkpoint, "files", gate, tell, contextlib.nullcontext(), available_now, rules)


def ref_folder(root: str) -> str:
    """Where a project's git keeps its branches; a commit changes a file below."""
    return f"{root.rstrip('/')}/.git/refs/heads"


def state_line(wing: str, number: int, counts: dict[str, int]) -> str:
    """What a batch did, in one line."""
    told = ", ".join(f"{counts[k]} {k}" for k in ("new", "changed", "deleted") if counts.get(k)) or "nothing to do"
    return f"[{wing}] batch {number}: {told}"


def watch_many(spark: SparkSession, projects: dict[str, str], store: ChunkStore, extensions: list[str], checkpoint: str, on_commit: bool = False, gate: Callable[[], bool] = lambda: True, log: Callable[[str], None] = print, optimise_after: int = 64, available_now: bool = False, **rules) -> dict[str, StreamingQuery]:
    """A streaming query for each wing of ``projects`` (wing -> folder): on changes of files, or ``on_commit`` when a branch of the
    project has moved; a batch then does what has changed since the last one. Batches of the wings are serial; a store of many
    commits is compacted behind a batch. Two wings of one folder are refused."""
    roots = [root.rstrip("/") for root in projects.values()]
    if len(set(roots)) < len(roots):
        raise ValueError("a folder is watched for one wing only")
    one = threading.Lock()
    out = {}
    for wing, root in projects.items():

        def tell(number: int, counts: dict | None, wing: str = wing) -> None:
            log(f"[{wing}] batch {number}: put back" if counts is None else state_line(wing, number, counts))
            head = store.log.head()
            if counts and head and len(head["data"]) > optimise_after:
                with one:
                    store.compact()

        out[wing] = _start(spark, root, store, wing, extensions, f"{checkpoint.rstrip('/')}/{wing}", "refs" if on_commit else "files", gate, tell, one, available_now, rules)
    return out
