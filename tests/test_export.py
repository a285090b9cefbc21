"""Exports that lose nothing, and imports that merge."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessellum.operators.facts_store import FactStore
from tessellum.operators.store import CHUNK_COLUMNS, ChunkStore
from tessellum.sources import jsonl


def _vector(text):
    """Two texts are near each other if they start with the same letter."""
    return F.array(F.when(F.left(text, F.lit(1)) == "a", 1.0).otherwise(0.0), F.when(F.left(text, F.lit(1)) == "a", 0.0).otherwise(1.0))


def test_round_trip_and_merge(spark, tmp_path):
    source, facts, path = ChunkStore(spark, str(tmp_path / "a"), _vector), FactStore(spark, str(tmp_path / "f")), str(tmp_path / "out")
    rows = [(str(i), f"{'ab'[i % 2]} text {i}\nwith \"quotes\"", f"w{i % 2}", "note", "Sym", "h > i", 3, 0.5, "manual_v1", 7) for i in range(4)]
    source.add(spark.createDataFrame(rows, "id string, text string, wing string, type string, symbol_name string, heading_path string, heading_level int, compression_ratio float, chunker_strategy string, line_start int"))
    facts.add(spark.createDataFrame([("Ann Lee", "knows", "Bob", "2020-01-01", "s1")], "subject string, predicate string, object string, valid_from string, source_closet string"))
    jsonl.write(path, source.read(vectors=True), jsonl.named(facts.triples(), facts.entities()), filters={"wing": "all"})
    head = json.loads(next(r.value for r in spark.read.text(path).collect() if "export_header" in r.value))
    assert (head["drawer_count"], head["kg_count"], json.loads(head["filters"])) == (4, 1, {"wing": "all"}) and head["exported_at"]

    target, others = ChunkStore(spark, str(tmp_path / "b"), _vector), FactStore(spark, str(tmp_path / "g"))
    assert jsonl.import_into(spark, path, target, others, dry_run=True) == {"imported_drawers": 4, "skipped_duplicates": 0, "imported_triples": 1, "warnings": []} and target.count() == 0
    jsonl.import_into(spark, path, target, others)
    names = [*CHUNK_COLUMNS, "vector"]
    assert target.read(vectors=True).select(names).orderBy("id").collect() == source.read(vectors=True).select(names).orderBy("id").collect()
    assert {r.name for r in others.entities().collect()} == {"Ann Lee", "Bob"} and others.triples().first().source_closet == "s1"
    assert jsonl.import_into(spark, path, target, others)["imported_drawers"] == 4 and target.count() == 4 and others.triples().count() == 1

    # a store that holds something near: only what is unlike it, and what it holds by id, comes
    third = ChunkStore(spark, str(tmp_path / "c"), _vector)
    third.add(spark.createDataFrame([("x", "another", "w"), ("2", "old", "w")], "id string, text string, wing string"))
    third.delete(F.col("id") == "nothing")
    got = jsonl.import_into(spark, path, third, skip_near=0.9, wing="mine")
    assert got["skipped_duplicates"] == 3 and {(r.id, r.wing) for r in third.read().collect()} == {("x", "w"), ("2", "mine")}
    assert third.log.head()["version"] == 2


def test_a_bad_line_writes_nothing(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "s"), _vector)
    for bad in ("{not json", "[1]", "null", '"text"'):
        (tmp_path / "in.jsonl").write_text('{"type": "drawer", "id": "a", "text": "x", "wing": "w"}\n\n' + bad + "\n")
        with pytest.raises(Exception, match="no JSON object"):
            jsonl.import_into(spark, str(tmp_path / "in.jsonl"), store)
        assert store.count() == 0
    (tmp_path / "in.jsonl").write_text('{"type": "drawer", "id": "a", "text": "x", "wing": "w", "drawer_type": "t"}\n{"type": "drawer", "id": "b", "text": ""}\n{"other": 1}\n')
    got = jsonl.import_into(spark, str(tmp_path / "in.jsonl"), store)
    assert got == {"imported_drawers": 1, "skipped_duplicates": 0, "imported_triples": 0, "warnings": ["no header"]}
    row = store.read(vectors=True).first()
    assert (row.type, row.room, row.chunk_index, row.vector) == ("t", "", 0, [0.0, 1.0])
