"""The pipeline's near-dedup finds copies by their fingerprints; the prefix filter adds those that are further apart."""

from __future__ import annotations

import random

import pyarrow as pa

from tessellum.llm import shingle_sets, simhash


def _fp(text):
    h, sizes = shingle_sets.shingle_sets(pa.array([text]), simhash.STAGE_SHINGLE)
    return int(shingle_sets.majority_bits(h, sizes)[0])


def test_fingerprints_alone_link_near_copies(spark, monkeypatch):
    rnd = random.Random(4)
    rows, near = [], []
    for i in range(30):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(600)]
        other = list(words)
        other[rnd.randrange(600)] = "changed"
        a, b = " ".join(words), " ".join(other)
        rows += [(2 * i, a), (2 * i + 1, b)]
        if (_fp(a) ^ _fp(b)).bit_count() <= simhash.STAGE_DISTANCE:
            near.append(2 * i + 1)
    assert len(near) > 10
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {r.doc_id for r in simhash.simhash_stage(spark, docs, "").collect()}
    assert whole == {2 * i for i in range(30)}
    nothing = shingle_sets._shared_shingles
    monkeypatch.setattr(shingle_sets, "_shared_shingles", lambda *a: nothing(*a).limit(0))
    alone = {r.doc_id for r in simhash.simhash_stage(spark, docs, "").collect()}
    assert alone == {k for k, _ in rows} - set(near)


def test_near_fingerprints_of_other_sets_do_not_link(spark):
    sets = spark.createDataFrame([(1, 0b111), (2, 0b111), (3, 0), (4, 0b11111111)], "s long, fp long")
    got = {tuple(sorted((r.u, r.v))) for r in simhash.near_fingerprints(sets).collect()}
    assert got == {(1, 2), (1, 3)}
    same = " ".join(f"a{k}" for k in range(50))
    docs = spark.createDataFrame([(1, same), (2, " ".join(f"b{k}" for k in range(50)))], "id long, text string")
    every = lambda nodes: nodes.select("s").crossJoin(nodes.selectExpr("s AS v")).filter("s < v").selectExpr("s AS u", "v")
    groups = shingle_sets.similar_components(docs, "id", "text", 5, 64, 0.8, every).collect()
    assert {(r.id, r.component_id) for r in groups} == {(1, 1), (2, 2)}
