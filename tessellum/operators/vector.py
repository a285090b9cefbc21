"""Exact vector search: distances in double, top-k with a total order, duplicate checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries of one call that are put to every row by a join; more are put as matrices of up to QUERY_BYTES.
QUERY_BLOCK = 512
QUERY_BYTES = 64 << 20
#: Numbers of one matrix product or one array of differences, and candidates beyond k whose distances are worked out term by term.
CELLS, SPARE = 1 << 20, 8
#: Queries of one batch of results.
OUT_QUERIES = 1 << 13


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, d: s + d)


def cosine_distance(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, d: s + d)

    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


METRICS = {"l2": squared_l2, "cosine": cosine_distance}


def similarity(distance: Column) -> Column:
    """One minus the distance, to three places; may be negative."""
    return F.round(1 - distance, 3)


def top_k(vectors: DataFrame, query: list[float], k: int, where: Column | None = None, metric: str = "l2", id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """The ``k`` nearest rows with ``distance``, nearest first, ties by id. The filter comes before the search."""
    rows = vectors if where is None else vectors.filter(where)
    literal = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("distance", METRICS[metric](F.col(vec_col), literal)).orderBy("distance", id_col).limit(k)


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", vec_col: str = "vector", query_id: str = "query_id", query_vec: str = "query_vector", block: int = QUERY_BLOCK, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` nearest rows of each row of ``queries``, ranked from 1, ties by id.

    The stated queries are put to all rows: a few in one broadcast join, many as matrices of at most ``query_bytes`` in one
    scan of the rows each; every task keeps its own best ``k`` a query, so only those are shuffled.
    """
    n = queries.count()
    best = Window.partitionBy(query_id).orderBy("distance", id_col)
    if n <= block:
        met = vectors.join(F.broadcast(queries), F.lit(True)).withColumn("distance", METRICS[metric](F.col(vec_col), F.col(query_vec)))
        return met.drop(vec_col, query_vec).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    first = queries.filter(F.col(query_vec).isNotNull()).select(F.size(query_vec)).first()
    blocks = -(-n * 8 * max(1, first[0] if first else 1) // query_bytes)
    found = None
    for b in range(blocks):
        part = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(blocks)) == b) if blocks > 1 else queries
        near = _nearest(vectors, part, k, metric, id_col, vec_col, query_id, query_vec)
        found = near if found is None else found.union(near)
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(vectors.drop(vec_col), id_col).join(queries.drop(query_vec), query_id)


def queries_at_once(rows: int, take: int, dim: int) -> int:
    """Queries of one step, so that neither products with all rows nor differences to the rows taken pass CELLS numbers."""
    return max(1, CELLS // max(1, rows, take * max(1, dim)))


def _nearest(vectors: DataFrame, queries: DataFrame, k: int, metric: str, id_col: str, vec_col: str, query_id: str, query_vec: str) -> DataFrame:
    """``(query_id, id, distance)``: each task's best ``k`` rows of each query; ``queries`` fit a broadcast."""
    held = queries.select(F.col(query_id).alias("q"), F.col(query_vec).cast("array<double>").alias("v")).filter("q IS NOT NULL AND v IS NOT NULL").toArrow()
    shared = vectors.sparkSession.sparkContext.broadcast(held)
    source = vectors.select(F.col(id_col).alias("i"), F.col(vec_col).cast("array<double>").alias("v")).filter("i IS NOT NULL AND v IS NOT NULL")
    types = {name: df.schema[c].dataType.simpleString() for name, df, c in (("q", queries, query_id), ("i", vectors, id_col))}

    def rows_of(column: pa.ChunkedArray) -> np.ndarray:
        c = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)

    def search(batches):
        asked = rows_of(shared.value.column("v"))
        m = len(asked)
        square = (asked * asked).sum(axis=1)
        near = np.full((m, k), np.inf)
        names = np.full((m, k), "", object) if types["i"] == "string" else np.zeros((m, k), np.int64)
        for batch in batches:
            if not batch.num_rows or not m:
                continue
            x, ids = rows_of(batch.column("v")), np.array(batch.column("i").to_pylist(), names.dtype)
            by_id = np.argsort(ids, kind="stable")
            x, ids = x[by_id], ids[by_id]
            own = (x * x).sum(axis=1)
            take = min(len(x), k + SPARE)
            step = queries_at_once(len(x), take, x.shape[1])
            for lo in range(0, m, step):
                at = slice(lo, lo + step)
                dots = asked[at] @ x.T
                rough = own - 2 * dots if metric == "l2" else -dots / np.sqrt(np.maximum(own, 1e-300))
                pick = np.argsort(np.round(rough, 10), axis=1, kind="stable")[:, :take]  # of equal ones those of least id
                apart = x[pick] - asked[at][:, None, :]
                if metric == "l2":
                    exact = (apart * apart).sum(axis=2)
                else:
                    exact = 1 - (x[pick] * asked[at][:, None, :]).sum(axis=2) / np.sqrt(own[pick] * square[at][:, None])
                every, who = np.concatenate([near[at], exact], axis=1), np.concatenate([names[at], ids[pick]], axis=1)
                order = np.argsort(who, axis=1, kind="stable")
                every, who = np.take_along_axis(every, order, axis=1), np.take_along_axis(who, order, axis=1)
                order = np.argsort(every, axis=1, kind="stable")
                near[at], names[at] = np.take_along_axis(every, order, axis=1)[:, :k], np.take_along_axis(who, order, axis=1)[:, :k]
        asked_ids = shared.value.column("q").combine_chunks()
        for lo in range(0, m, OUT_QUERIES):
            q, r = np.nonzero(near[lo : lo + OUT_QUERIES] < np.inf)
            q += lo
            yield pa.RecordBatch.from_arrays([asked_ids.take(pa.array(q)), pa.array(names[q, r].tolist(), batch_type), pa.array(near[q, r])], names=["q", "i", "distance"])

    if types["i"] not in ("bigint", "int", "string"):
        raise ValueError(f"ids of type {types['i']}")
    batch_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[types["i"]]
    out = source.mapInArrow(search, f"q {types['q']}, i {types['i']}, distance double")
    return out.select(F.col("q").alias(query_id), F.col("i").alias(id_col), "distance")


def duplicates(vectors: DataFrame, query: list[float], threshold: float = 0.9, k: int = 5, id_col: str = "id", vec_col: str = "vector", metric: str = "l2") -> DataFrame:
    """Of the ``k`` nearest rows those whose similarity reaches the threshold."""
    near = top_k(vectors, query, k, metric=metric, id_col=id_col, vec_col=vec_col)
    return near.withColumn("similarity", similarity(F.col("distance"))).filter(F.col("similarity") >= threshold)


def without_near_duplicates(incoming: DataFrame, stored: DataFrame, threshold: float = 0.9, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """Incoming rows whose nearest stored row stays under the import rule ``1 - d / 2 >= threshold`` (d squared)."""
    asked = incoming.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query_vector"))
    nearest = top_k_each(stored.select(id_col, vec_col), asked, 1, id_col=id_col, vec_col=vec_col)
    close = nearest.filter(1 - F.col("distance") / 2 >= threshold).select(F.col("query_id").alias(id_col))
    return incoming.join(close, id_col, "left_anti")
