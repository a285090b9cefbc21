"""Many queries: the matrix path gives what the join gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum.operators import vector


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_matrices_give_what_the_join_gives(spark, metric, kind):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[100:140] = x[7]  # more equal rows than are asked for: the least ids win
    rows = spark.createDataFrame([(i, [float(c) for c in v], f"n{i}") for i, v in enumerate(x)], "id long, vector array<double>, name string").withColumn("id", F.col("id").cast(kind)).repartition(5)
    asked = spark.createDataFrame([(i, [float(c) for c in x[i]], i % 3) for i in range(0, 300, 7)], "query_id long, query_vector array<double>, part long")
    one, other, small = (vector.top_k_each(rows, asked, 4, metric, block=b, query_bytes=q) for b, q in ((512, 1 << 26), (0, 1 << 26), (0, 1000)))
    names = ["query_id", "id", "rank", "name", "part"]
    key = lambda df: sorted(tuple(r[n] for n in names) for r in df.collect())
    want = key(one)
    assert len(want) == 4 * 43 and key(other) == want and key(small) == want
    a, b = ({(r.query_id, r["id"]): r.distance for r in df.collect()} for df in (one, other))
    assert all(abs(a[k] - b[k]) < 1e-9 for k in a)


def test_import_of_many(spark):
    x = np.random.default_rng(2).normal(size=(700, 4))
    v = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    stored = spark.createDataFrame([(0, [float(c) for c in x[3]])], "id long, vector array<double>")
    assert vector.without_near_duplicates(v, stored, 1.0).count() == 699


def test_a_step_is_bounded_by_the_numbers_it_holds():
    from tessellum.operators import vector

    for rows, take, dim in [(1, 1, 256), (30, 19, 256), (10_000, 19, 64), (10_000, 13, 1)]:
        step = vector.queries_at_once(rows, take, dim)
        assert step * rows <= vector.CELLS and step * take * dim <= vector.CELLS


def test_many_queries_over_small_batches(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from tessellum.operators import vector

    x = np.random.default_rng(5).normal(size=(700, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<float>").repartition(40)
    asked = v.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {(r.query_id, r.rank): r.id for r in vector.top_k_each(v, asked, 3, block=1).collect()}
    d = ((x[:, None].astype(float) - x[None]) ** 2).sum(axis=2)
    assert got == {(i, k + 1): j for i in range(700) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
