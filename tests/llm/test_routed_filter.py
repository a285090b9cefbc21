"""The filter that is not broadcast gives the scores of the one that is, false positives and all."""

from __future__ import annotations

import random

import pytest

from tessellum.llm import bloom_lm


def test_scores_do_not_depend_on_the_model_s_size(spark):
    rnd = random.Random(12)
    texts = [" ".join(f"w{rnd.randrange(150)}" for _ in range(rnd.randrange(60))) for _ in range(200)] + ["", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    training = df.filter("doc_id % 4 <> 3")
    one, other = ({r.doc_id: r for r in bloom_lm.lm_scores(df, training, ["doc_id"], model_bytes=size).collect()} for size in (bloom_lm.MODEL_BYTES, 0))
    assert len(one) == len(other) == len(texts)
    for i, r in one.items():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (other[i].n_tokens, other[i].n_known, other[i].train_tokens)
        assert r.base_score == pytest.approx(other[i].base_score) and r.score == pytest.approx(other[i].score, abs=1e-9)
