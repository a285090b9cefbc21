"""The versioned store, ignore rules and the watch loop."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessellum.operators.store import ChunkStore
from tessellum.sources.scan import ignored, nested_ignored, parse_ignore, scan
from tessellum.streaming.watch import ingest, watch


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, text string, wing string, room string, chunk_index string, extra string")


def test_store_round(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "s"))
    assert s.count() == 0 and s.read().count() == 0
    s.add(_rows(spark, ("a", "one", "w1", "r", "3", "x"), ("b", "two", "w2", None, "bad", "x")))
    assert s.count() == 2
    got = {r.id: r for r in s.read().collect()}
    assert got["a"].chunk_index == 3 and got["b"].chunk_index == 0 and got["b"].room == "" and "extra" not in got["a"]
    s.upsert(_rows(spark, ("b", "new", "w1", "r", "1", ""), ("c", "three", "w3", "r", "1", "")))
    assert {(r.id, r.text, r.wing) for r in s.read().collect()} == {("a", "one", "w1"), ("b", "new", "w1"), ("c", "three", "w3")}
    assert [r.id for r in s.get(limit=1, offset=1).collect()] == ["b"]
    assert s.delete(F.col("id") == "a") == 1 and s.delete(F.col("id") == "a") == 0
    assert s.delete_wing("w3") == 1 and s.count() == 1
    s.restore(2)
    assert s.count() == 3 and s.read().count() == 3
    s.compact()
    assert s.count() == 3 and s.health()["ok"] and s.recover() == s.version()
    before = s.stats()
    assert before["reclaimable"] > 0 and s.vacuum() == before["versions"] - 1 and s.count() == 3 and s.stats()["reclaimable"] == 0
    assert len(s.read(vectors=True).first()["vector"]) == 384


def test_second_writer_fails(spark, tmp_path):
    from tessellum.operators.log_table import ConflictError, LogTable

    t = LogTable(spark, str(tmp_path / "t"), "id string, x int")
    t.commit(spark.createDataFrame([("a", 1)], "id string, x int"), None, "one")
    seen = t.head()
    t.commit(None, spark.createDataFrame([("a",)], "id string"), "two", seen)
    with pytest.raises(ConflictError):
        t._make(seen["data"], [], "three", seen)
    assert t.count() == 0 and t.read(version=1).count() == 1


def test_ignore_rules(spark):
    rules = parse_ignore(["# no", "*.log", "!keep.log", "/top.txt", "out/", "a/**/b.py", "\\#odd"])
    cases = {"x.log": True, "d/x.log": True, "keep.log": False, "top.txt": True, "d/top.txt": False, "out/x.py": True, "d/out/x.py": True, "out": False, "a/b.py": True, "a/c/d/b.py": True, "#odd": True, "fine.py": False}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    got = {r.p: r.v for r in df.select("p", ignored(F.col("p"), rules).alias("v")).collect()}
    assert got == cases
    nested = nested_ignored(F.col("p"), {"": ["*.py"], "d": ["!x.py"]})
    got = {r.p: r.v for r in spark.createDataFrame([("d/x.py",), ("x.py",), ("d/y.py",)], "p string").select("p", nested.alias("v")).collect()}
    assert got == {"d/x.py": False, "x.py": True, "d/y.py": True}


def test_watch(spark, tmp_path):
    root = tmp_path / "src"
    (root / "node_modules").mkdir(parents=True)
    (root / "a.md").write_text("alpha " * 40)
    (root / "b.md").write_text("beta " * 40)
    (root / "node_modules" / "c.md").write_text("gamma " * 40)
    assert {r.relative for r in scan(spark, str(root), [".md"]).collect()} == {"a.md", "b.md"}
    s = ChunkStore(spark, str(tmp_path / "s"))
    seen = []
    run = lambda: watch(spark, str(root), s, "w", [".md"], str(tmp_path / "c"), on_batch=lambda n, c: seen.append(c), available_now=True).awaitTermination(60)
    run()
    assert seen == [{"new": 2}] and {r.source_file for r in s.read().collect()} == {"a.md", "b.md"}
    (root / "b.md").unlink()
    (root / "d.md").write_text("delta " * 40)
    run()
    assert seen[1:] == [{"new": 1, "deleted": 1}] and {r.source_file for r in s.read().collect()} == {"a.md", "d.md"}
    assert ingest(spark, str(root), s, "w", [".md"]) == {}


def test_watch_many_on_commit(spark, tmp_path):
    from tessellum.streaming.watch import ref_folder, state_line, watch_many

    roots = {}
    for wing in ("one", "two"):
        root = tmp_path / wing
        (root / ".git" / "refs" / "heads").mkdir(parents=True)
        (root / ".git" / "refs" / "heads" / "main").write_text("0")
        (root / "a.md").write_text(f"{wing} " * 60)
        roots[wing] = str(root)
    store, said = ChunkStore(spark, str(tmp_path / "s")), []

    def run():
        for q in watch_many(spark, roots, store, [".md"], str(tmp_path / "c"), on_commit=True, log=said.append, available_now=True).values():
            q.awaitTermination(60)

    run()
    assert sorted(said) == ["[one] batch 0: 1 new", "[two] batch 0: 1 new"] and {r.wing for r in store.read().collect()} == {"one", "two"}
    (tmp_path / "one" / "b.md").write_text("later " * 60)
    run()  # no commit, so nothing happens
    (tmp_path / "one" / ".git" / "refs" / "heads" / "next").write_text("1")
    run()
    assert said[2:] == ["[one] batch 1: 1 new"] and store.count() == 3
    assert ref_folder("/x/") == "/x/.git/refs/heads" and state_line("w", 2, {}) == "[w] batch 2: nothing to do"
    with pytest.raises(ValueError):
        watch_many(spark, {"a": "/x", "b": "/x/"}, store, [".md"], "c")
