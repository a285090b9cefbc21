"""Backups: snapshots, catalogue, retention, refusals."""

from __future__ import annotations

import pytest

from tessellum.operators.backup import Backups
from tessellum.operators.facts_store import FactStore
from tessellum.operators.store import ChunkStore


def test_backups(spark, tmp_path):
    chunks, facts, backups = ChunkStore(spark, str(tmp_path / "c")), FactStore(spark, str(tmp_path / "f")), Backups(spark, str(tmp_path / "b"))
    assert backups.catalogue().count() == 0 and backups.size_of(str(tmp_path / "none")) == 0
    chunks.add(spark.createDataFrame([("a", "one", "w"), ("b", "two", "w")], "id string, text string, wing string"))
    facts.add(spark.createDataFrame([("X", "likes", "Y")], "subject string, predicate string, object string"))
    with pytest.raises(RuntimeError):
        backups.create(chunks, facts, room_for=lambda needed: needed < 10)
    first = backups.create(chunks, facts)
    names = [backups.create(chunks, kind="scheduled", keep=2) for _ in range(3)]
    rows = backups.catalogue(stale_s=-1.0, oversized=1).collect()
    assert [r["name"] for r in rows] == [names[2], names[1], first] and all(r.stale and r.oversized and r.bytes > 0 for r in rows)
    with pytest.raises(ValueError):
        backups.restore(first, chunks, facts)
    with pytest.raises(ValueError):
        backups.restore("gone", chunks)
    chunks.delete_wing("w")
    other, known = ChunkStore(spark, str(tmp_path / "c2")), FactStore(spark, str(tmp_path / "f2"))
    assert backups.restore(first, other, known) == 2 and other.count() == 2 and known.triples().count() == 1 and known.entities().count() == 2
    assert backups.restore(first, chunks, facts, force=True) == 2 and chunks.count() == 2 and facts.triples().count() == 1
