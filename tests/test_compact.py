"""A compaction deals a large part to several tasks."""

from __future__ import annotations

from tessellum.operators import log_table
from tessellum.operators.store import ChunkStore
from tessellum.plans.store_queries import _no_vector


def test_a_large_wing_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    rows = spark.range(4000).selectExpr("concat('i', id) AS id", "sha2(string(id), 512) AS text", "IF(id % 10 = 0, 'small', 'large') AS wing", "'r' AS room")
    store = ChunkStore(spark, f"file://{tmp_path}/s", _no_vector)
    store.add(rows)
    monkeypatch.setattr(log_table, "FILE_BYTES", 100_000)
    store.compact()
    folder = store.log.head()["data"][0]["folder"]
    assert len(list(tmp_path.glob(f"s/data/c={folder}/part=plarge/*.parquet"))) >= 3
    assert store.count() == 4000 and store.read(wings=["small"]).count() == 400
