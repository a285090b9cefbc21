"""Shared pieces of the training-data operators: tables, Arrow blocks, hashed words, shared checkpoints."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of the names of columns that stages add for a while.
OWN = "__tessellum_"
#: Text bytes that one vectorised step works on; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; null ids give null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.crc32(c.cast("string")) % modulus


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. A temporary one of this machine only where none is
    set and everything runs in one process (local tests); on a cluster that is an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not conf:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
        conf = f"file://{tempfile.gettempdir()}/tessellum-checkpoints"
    return conf.rstrip("/")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Write to Parquet in the shared folder and read back: cuts lineage and survives lost executors.

    The tables of an application lie in a folder of its id, which may go once the application has ended; ``discard``
    deletes one that no result reads any more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessellum/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote; nothing may read them afterwards."""
    for df in tables:
        path = getattr(df, "_written_to", None)
        if path:
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() to the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    offs = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32, count=column.offset + n + 1)[column.offset :].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offs[0] : offs[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def give_back() -> None:
    """Free memory goes back to the system, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def blocks(batches, column: str, limit: int = BLOCK_BYTES, rows: int = 4096):
    """Row slices of the batches with at most ``limit`` bytes of ``column`` each (or one row), and at most ``rows`` rows."""
    yield from _slices(batches, column, limit, rows)
    give_back()


def _slices(batches, column: str, limit: int, rows: int):
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offs = utf8(batch.column(column))
        lo = 0
        while lo < n:
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1))
            yield batch.slice(lo, hi - lo)
            lo = hi


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20240229)
#: A random odd word for each byte, A-Z as a-z, so that equal words give equal sums.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` (or of other bytes than ``space``); no word crosses a document's end."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z
    inside = ~space[data]
    first = np.zeros(len(data) + 1, bool)
    first[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(64-bit hash, start, end, document) of each word, A-Z lower-cased."""
    starts, ends = word_spans(data, offs)
    out = np.zeros(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):  # by spans of about BLOCK_BYTES, so that one long document needs no more memory
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + BLOCK_BYTES)))
        s, e = starts[lo:hi], ends[lo:hi]
        lens = e - s
        at = np.cumsum(lens) - lens
        within = np.arange(int(lens.sum())) - np.repeat(at, lens)
        power = np.cumprod(np.full(int(lens.max()) + 1, _BASE, np.uint64))
        out[lo:hi] = np.add.reduceat(_BYTE[data[within + np.repeat(s, lens)]] * power[within], at)
        lo = hi
    return mix64(out), starts, ends, np.searchsorted(offs, starts, side="right") - 1


def segment_sum(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sums of float values by owner (0..n-1)."""
    return np.bincount(owner, weights=values, minlength=n)


class Table64:
    """Counts of 64-bit keys: two sorted arrays; ``get`` gives 0 for others."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.counts = keys[order], counts[order]
        #: First index for each value of the top 16 bits, so that a search stays in a short span.
        self.top = np.searchsorted(self.keys >> np.uint64(48), np.arange(65537, dtype=np.uint64))

    def get(self, q: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(q), np.int64)
        at = np.minimum(np.searchsorted(self.keys, q), len(self.keys) - 1)
        return np.where(self.keys[at] == q, self.counts[at], 0)
