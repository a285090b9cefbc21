"""Connected components of an edge table by alternating large-star and small-star steps.

No step collects links or components to the driver. Each step is written to the shared folder. A hub is never one
group: its minimum comes from a partial aggregation, and the join back to its edges is one that Spark splits when skewed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellum.llm.common import discard, materialise

#: Edges that one local contraction holds.
LOCAL_EDGES = 1 << 20


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the nodes of these edges."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while True:
            jumped = label[label]
            if np.array_equal(jumped, label):
                break
            label = jumped
        keep = label[x] != label[y]
        x, y = x[keep], y[keep]
    return nodes, nodes[label]


def _contract(batches):
    def star(parts):
        a, b = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        node, root = local_roots(a, b)
        keep = node != root
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(root[keep])], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append([batch.column(k).to_numpy() for k in (0, 1)])
        size += batch.num_rows
        if size >= LOCAL_EDGES:
            yield star(held)
            held, size = [], 0
    if held:
        yield star(held)


def _mark(edges: DataFrame) -> tuple[int, int]:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def connected_components(edges: DataFrame, max_steps: int = 60) -> DataFrame:
    """``(node, component)`` for all nodes of ``edges`` (columns ``u``, ``v`` long): the smallest reachable node.

    Loops and edges with a null end are ignored; an empty table gives an empty result.
    """
    edges = edges.select("u", "v").filter("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = materialise(edges.mapInArrow(_contract, "u long, v long").distinct())  # u > v
    before = _mark(edges)
    for _ in range(max_steps):
        if before[0] == 0:
            break
        # large star: what is larger than u goes to the smallest of u and its neighbours
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large)
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, edges = edges, materialise(moved.union(least.select("u", F.col("m").alias("v"))).distinct())
        discard(old, large)
        after = _mark(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components haven't settled in {max_steps} steps")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
