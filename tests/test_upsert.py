"""Ties of keyed merges: of rows that are last alike, the first in the file comes in, however Spark deals them out."""

from __future__ import annotations

from tessellum.plans import registry


def test_upsert_takes_the_first_of_equal_lines(spark, tmp_path):
    orders = [(k, "S") for k in range(1, 40)]
    lines = [(k, n, f"{n}{i}") for i in range(9) for k in range(3, 40, 3) for n in (i % 2 + 1, 2)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_linestatus string").coalesce(1).write.option("parquet.block.size", 1).parquet(f"{tmp_path}/lineitem.parquet")
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = {r.id: r.v for r in registry.queries()["upsert_latest_wins"](spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)
    assert got == {k: "20" if k % 3 == 0 else "S" for k in range(1, 40)}


def test_upsert_by_place(spark):
    from tessellum.operators import ingest

    stored = spark.createDataFrame([(1, "old"), (2, "old")], "id long, v string")
    incoming = spark.createDataFrame([(1, "b", 5, 7), (1, "a", 5, 2), (1, "c", 4, 1)], "id long, v string, n int, at int")
    got = ingest.upsert(stored, incoming, order="n", place="at")
    assert sorted((r.id, r.v) for r in got.collect()) == [(1, "a"), (2, "old")] and "at" not in got.columns


def test_upsert_of_orders_without_a_key_is_that_of_the_sql(spark, tmp_path):
    import duckdb

    for name, lines in (("some", [(3, 1, "a"), (3, 2, "b"), (None, 9, "c")]), ("none", [(4, 1, "a")])):
        d = f"{tmp_path}/{name}"
        spark.createDataFrame([(1, "S"), (3, "S"), (None, "S")], "o_orderkey long, o_orderstatus string").coalesce(1).write.parquet(f"{d}/orders.parquet")
        spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_linestatus string").coalesce(1).write.parquet(f"{d}/lineitem.parquet")
        con = duckdb.connect()
        for t in ("orders", "lineitem"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
        want = con.execute(registry.oracle_sql()["upsert_latest_wins"]).fetchall()
        got = [tuple(r) for r in registry.queries()["upsert_latest_wins"](spark, d).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        assert ((None, "S") in got) == (name == "none")
