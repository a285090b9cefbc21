"""Files made of a small table of keys are dealt to as many tasks as their number asks for."""

from __future__ import annotations

from tessellum.plans import source_queries


def test_files_of_one_small_scan_go_to_several_tasks(spark, tmp_path, monkeypatch):
    spark.range(1000).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(source_queries, "TASK_FILES", 50)
    made = source_queries._parts(spark, str(tmp_path), ["x {k}"])
    assert made.rdd.getNumPartitions() == 20 and made.distinct().count() == 1000
