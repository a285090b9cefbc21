"""The closest names of a table to each of a stated set of values, by the ratio of matching blocks."""

from __future__ import annotations

import difflib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of values that go to the workers at once; more are dealt to passes of their own.
VALUES_BYTES = 1 << 20
#: Classes of characters whose counts bound a ratio.
CLASSES = 64


def plain(name: Column) -> Column:
    """In lower case, with blanks for dashes and underscores, and none at the ends."""
    return F.trim(F.translate(F.lower(name), "-_", "  "))


def _profiles(names: list[str]) -> np.ndarray:
    """Counts of the characters of each name by class; characters of a class count as equal, so a bound stays one."""
    out = np.zeros((len(names), CLASSES), np.int32)
    for i, n in enumerate(names):
        codes = np.frombuffer(n.encode("utf-32-le", "surrogatepass"), np.uint32) % CLASSES
        out[i] = np.bincount(codes, minlength=CLASSES)
    return out


def _closest(values: list[str], names: list[str], own: list[str], n: int, least: float, held: list[list]) -> None:
    """Put the names that may be among the ``n`` closest of each value on its heap of (ratio, name reversed in order)."""
    a, b = _profiles(values), _profiles(names)
    lens = np.array([len(v) for v in values])
    for j, name in enumerate(names):
        if not name:
            continue
        # twice the characters that both have, over the characters of both: no ratio is higher
        bound = 2.0 * np.minimum(a, b[j]).sum(axis=1) / (lens + len(name))
        matcher = None
        for i in np.flatnonzero(bound >= least):
            heap = held[i]
            if len(heap) == n and bound[i] < heap[0][0]:
                continue
            if matcher is None:
                matcher = difflib.SequenceMatcher(None, "", name)
            matcher.set_seq1(values[i])
            ratio = matcher.ratio()
            if ratio >= least:
                entry = (ratio, _Later(own[j]))
                if len(heap) < n:
                    heapq.heappush(heap, entry)
                elif entry > heap[0]:
                    heapq.heapreplace(heap, entry)


class _Later:
    """A name whose order is turned around: of equal ratios the first name is the best."""

    def __init__(self, name: str):
        self.name = name

    def __lt__(self, other: _Later) -> bool:
        return self.name > other.name

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Later) and self.name == other.name


def close_names(values: DataFrame, names: DataFrame, value_col: str = "value", name_col: str = "name", n: int = 3, least: float = 0.4, most_bytes: int = VALUES_BYTES) -> DataFrame:
    """``(value, rank, name, ratio)``: for each distinct value the ``n`` names closest to it, of a ratio of ``least`` or more,
    best first, then by name. The ratio is that of ``difflib.SequenceMatcher(None, value, name)`` on plain forms.

    Names are read once for each megabyte of values; a task keeps ``n`` names a value, and ratios are found only for names
    that share characters enough. Null and blank values and names match nothing.
    """
    asked = values.select(F.col(value_col).alias("_value"), plain(F.col(value_col)).alias("_plain")).filter("_plain <> ''").distinct()
    size = asked.agg(F.sum(F.octet_length("_value") + F.octet_length("_plain"))).first()[0] or 0
    passes = max(1, -(-size // most_bytes))
    listed = names.select(F.col(name_col).alias("_name")).filter("_name IS NOT NULL").distinct().select("_name", plain(F.col("_name")).alias("_form"))
    out = None
    for k in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("_value"), F.lit(passes)) == k) if passes > 1 else asked
        shared = values.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in part.collect()])

        def run(batches, shared=shared):
            told = shared.value
            held: list[list] = [[] for _ in told]
            for b in batches:
                _closest([p for _, p in told], b.column("_form").to_pylist(), b.column("_name").to_pylist(), n, least, held)
            rows = [(v, entry[1].name, entry[0]) for (v, _), heap in zip(told, held, strict=True) for entry in heap]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["value", "name", "ratio"])

        found = listed.mapInArrow(run, "value string, name string, ratio double")
        out = found if out is None else out.unionByName(found)
    rank = F.row_number().over(Window.partitionBy("value").orderBy(F.desc("ratio"), "name"))
    return out.withColumn("rank", rank).filter(F.col("rank") <= n).select("value", "rank", "name", "ratio")
