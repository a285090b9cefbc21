"""The routed form of the language model writes in proportion to its texts, and gives the scores of the broadcast one."""

from __future__ import annotations

import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum.llm import bloom_lm


def test_keys_pack_small():
    import zlib

    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 1 << 63, 200_000, dtype=np.uint64) << np.uint64(1))
    packed = bloom_lm.pack_keys(keys)
    assert np.array_equal(bloom_lm.unpack_keys(packed), keys)
    assert np.array_equal(bloom_lm.unpack_keys(bloom_lm.pack_keys(keys[:1])), keys[:1])
    assert len(zlib.compress(packed, 1)) < 6.5 * len(keys)


def test_runs_ask_once_and_score_alike(spark, monkeypatch):
    monkeypatch.setattr(bloom_lm, "ASKING", 300)
    rnd = random.Random(5)
    texts = [" ".join(f"w{int(rnd.paretovariate(0.5))}" for _ in range(rnd.randrange(80))) for _ in range(300)] + ["", None, "once " * 400]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    training = df.filter("doc_id % 5 <> 3")
    one, other = ({r.doc_id: r for r in bloom_lm.lm_scores(df, training, ["doc_id"], model_bytes=size).collect()} for size in (bloom_lm.MODEL_BYTES, 0))
    assert len(one) == len(other) == len(texts)
    for i, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (other[i].n_tokens, other[i].n_known, other[i].train_tokens)
        assert r.base_score == pytest.approx(other[i].base_score) and r.score == pytest.approx(other[i].score, abs=1e-9)
    shift = 60
    asked = bloom_lm._questions(df, F.col("doc_id") % 5 != 3, True, shift, "text").collect()
    tokens = sum(len((t or "").split()) + 1 for t in texts)
    for kind in (0, 1):
        assert sum(len(r["keys"]) // 8 for r in asked if r.kind == kind) < tokens
        for r in asked:
            assert (bloom_lm.unpack_keys(r["keys"]) >> np.uint64(shift) == r.part).all()
    # marked rows train as a table of their own does
    third = {r.doc_id: r for r in bloom_lm.score_by_runs(df.coalesce(1), F.col("doc_id") % 5 != 3, ["doc_id"]).collect()}
    for i, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (third[i].n_tokens, third[i].n_known, third[i].train_tokens)
        assert r.base_score == pytest.approx(third[i].base_score)


def test_other_rows_at_the_second_reading_are_an_error(spark):
    texts = [(i, f"a{i} b{i} c") for i in range(20)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    turned = df.withColumn("text", F.concat("text", F.udf(lambda: f" {uuid.uuid4()}")()))
    with pytest.raises(Exception, match="gave other rows"):
        bloom_lm.score_by_runs(turned, F.lit(True), ["doc_id"]).collect()
