"""Commits of several writers, dead ones among them, and leases."""

from __future__ import annotations

import threading
import time

import pytest
from pyspark.sql import functions as F

from tessellum.operators import log_table
from tessellum.operators.facts_store import FactStore
from tessellum.operators.lease import Lease, LeaseError
from tessellum.operators.log_table import NOTHING, ConflictError, LogTable
from tessellum.operators.store import ChunkStore


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), "id string, x int")


def _table(spark, tmp_path, **more):
    return LogTable(spark, str(tmp_path / "t"), "id string, x int", **more)


def _held(t, version=None):
    return sorted((r.id, r.x) for r in t.read(version=version).collect())


def test_a_dead_writer_blocks_nobody(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(log_table, "GRACE_S", 0.5)
    t = _table(spark, tmp_path)
    t.commit(_rows(spark, ("a", 1)), None, "one")
    t._write(_rows(spark, ("b", 2)), "dead")  # rows without a version
    (tmp_path / "t" / "log" / "000000000002.json").write_text("")  # a version without content
    began = time.monotonic()
    assert t.commit(_rows(spark, ("c", 3)), None, "next") == 3 and time.monotonic() - began > 0.4
    assert _held(t) == [("a", 1), ("c", 3)] and [r.kind for r in t.versions().orderBy("version").collect()] == ["write", "void", "write"]
    assert t.vacuum(1e9) == 0 and (tmp_path / "t" / "data" / "c=dead").exists()
    t.vacuum(1e9, leftovers=-1)
    assert not (tmp_path / "t" / "data" / "c=dead").exists() and _held(t) == [("a", 1), ("c", 3)]


def test_commits_from_one_version(spark, tmp_path):
    t = _table(spark, tmp_path)
    t.commit(_rows(spark, ("a", 1), ("b", 1), ("c", 1)), None, "start")
    seen = t.head()
    t.commit(_rows(spark, ("a", 2)), _rows(spark, ("a", 0)), "mine", seen)
    t.commit(_rows(spark, ("b", 2)), _rows(spark, ("b", 0)), "other ids follow", seen)
    with pytest.raises(ConflictError):
        t.commit(_rows(spark, ("a", 3)), _rows(spark, ("a", 0)), "same id", seen)
    with pytest.raises(ConflictError):
        t.commit(_rows(spark, ("b", 9)), None, "same id, added", seen)
    assert _held(t) == [("a", 2), ("b", 2), ("c", 1)] and t.head()["version"] == 3
    assert len(list((tmp_path / "t" / "data").glob("c=*"))) == 3  # what failed left nothing
    t.compact()
    assert t.commit(None, _rows(spark, ("c", 0)), "a fold changes no ids", seen) == 5 and _held(t) == [("a", 2), ("b", 2)]
    t.restore(1)
    with pytest.raises(ConflictError):
        t.commit(_rows(spark, ("z", 9)), _rows(spark, ("z", 0)), "restored meanwhile", seen)
    assert _held(t) == [("a", 1), ("b", 1), ("c", 1)] and _held(t, 3) == [("a", 2), ("b", 2), ("c", 1)]


def test_a_fold_keeps_what_came_meanwhile(spark, tmp_path, monkeypatch):
    t = _table(spark, tmp_path)
    t.commit(_rows(spark, ("a", 1), ("b", 1)), None, "start")
    write, done = t._write, []

    def slow(rows, own):
        write(rows, own)
        if not done:
            done.append(1)
            t.commit(_rows(spark, ("b", 2), ("c", 2)), _rows(spark, ("b", 0)), "meanwhile")

    monkeypatch.setattr(t, "_write", slow)
    assert t.compact() == 3 and _held(t) == [("a", 1), ("b", 2), ("c", 2)]
    assert t.vacuum() == 2 and _held(t) == [("a", 1), ("b", 2), ("c", 2)]


@pytest.mark.parametrize("leased", [False, True])
def test_racing_additions_all_land(spark, tmp_path, leased):
    lease = Lease(spark, str(tmp_path / "lease"), settle=0.05) if leased else None
    failed = []

    def write(k):
        try:
            _table(spark, tmp_path, lease=lease).commit(_rows(spark, *[(f"{k}-{i}", k) for i in range(5)]), None, str(k))
        except Exception as e:  # noqa: BLE001
            failed.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    t = _table(spark, tmp_path)
    assert not failed and t.head()["version"] == 4 and len(_held(t)) == 20
    assert all(len(_held(t, v)) == 5 * v for v in range(1, 5))


def test_a_lease_is_held_by_one(spark, tmp_path):
    lease = Lease(spark, str(tmp_path / "l"), seconds=30, settle=0.05, wait=0.4)
    with lease.held(), pytest.raises(LeaseError), lease.held():
        pass
    short = Lease(spark, str(tmp_path / "l"), seconds=0.5, settle=0.05, wait=5)
    dead = short._claim()
    began = time.monotonic()
    with short.held():
        assert time.monotonic() - began > 0.3
    assert not (tmp_path / "l" / dead).exists()
    with pytest.raises(LeaseError), short.held():
        time.sleep(0.6)


def test_facts_and_their_entities_come_together(spark, tmp_path):
    s = FactStore(spark, str(tmp_path / "f"))
    fact = lambda *f: spark.createDataFrame(list(f), "subject string, predicate string, object string, valid_from string, valid_to string")
    s.add(fact(("Ann Lee", "knows", "Bob", "2020-01-01", None)))
    assert s._log.head()["version"] == 1 and s.triples().count() == 1 and {r.id for r in s.entities().collect()} == {"ann_lee", "bob"}
    with pytest.raises(ValueError):
        s.add(fact(("Eve", "knows", "Zed", "2021-01-01", "2020-01-01")))
    assert s.entities().count() == 2
    threads = [threading.Thread(target=s.add, args=(fact(("Ann Lee", "knows", name, "2020-01-01", None)),)) for name in ("Cid", "Dan", "Cid")]
    for x in threads:
        x.start()
    for x in threads:
        x.join()
    assert sorted(r.object for r in s.triples().collect()) == ["bob", "cid", "dan"] and sorted(r.id for r in s.entities().collect()) == ["ann_lee", "bob", "cid", "dan"]
    s.invalidate(F.col("object") == "cid", "2024-01-01")
    assert {r.object: r.valid_to for r in s.triples().collect()} == {"bob": None, "cid": "2024-01-01", "dan": None}


def test_an_upsert_has_one_row_an_id(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "s"), lambda _: F.array(F.lit(1.0)))
    s.upsert(spark.createDataFrame([("a", "old", "w", 1), ("a", "new", "w", 2), ("b", "x", "w", 1), ("b", "x", "w", 1)], "id string, text string, wing string, n int"), order="n")
    assert sorted((r.id, r.text) for r in s.read().collect()) == [("a", "new"), ("b", "x")]
    s.upsert(spark.createDataFrame([("a", "p", "w"), ("a", "q", "w")], "id string, text string, wing string"))
    assert sorted((r.id, r.text) for r in s.read().collect()) == [("a", "q"), ("b", "x")]
    assert s.delete(F.col("id") == "a") == 1 and s.count() == 1 and NOTHING["version"] == 0
