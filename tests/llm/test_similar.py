"""The pipeline's near-dedup against brute force over all pairs."""

from __future__ import annotations

import random

import pytest

from tessellum.llm import shingle_sets, simhash


def _set(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _alike(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def _texts():
    rnd = random.Random(11)
    common = " ".join(f"c{k}" for k in range(30))
    texts = []
    for i in range(60):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([6, 12, 60, 200]))]
        base = [*words, common] if i % 3 == 0 else words
        texts.append(" ".join(base))
        for _ in range(rnd.randrange(8)):  # copies of copies, each edited a little more
            words = list(words)
            for _ in range(rnd.randrange(1, 4)):
                words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
            texts.append(" ".join([*words, common] if i % 3 == 0 else words).upper())
    return [*texts, "", None, " \n", "one two", "One  two", "one"]


@pytest.mark.parametrize("sample", [0, 20_000])
def test_all_similar_pairs_link(spark, monkeypatch, sample):
    monkeypatch.setattr(shingle_sets, "SAMPLE_DOCS", sample)
    texts = _texts()
    sets = [_set(t) for t in texts]
    up = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if up[i] != up[j] and _alike(sets[i], sets[j]):
                low, high = sorted((up[i], up[j]))
                up = [low if x == high else x for x in up]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in shingle_sets.similar_components(df, "doc_id", "text", 5, 30, 0.8).collect()}
    assert [got[i] for i in range(len(texts))] == up and len(set(up)) < len(texts) - 50


def test_stage_drops_near_copies(spark):
    words = [f"w{k}" for k in range(100)]
    near, far = list(words), list(words)
    near[50] = "other"
    far[20::20] = ["other"] * 4
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (None, " ".join(words))]
    kept = simhash.simhash_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted((r.doc_id or 0) for r in kept) == [0, 1, 3]


def test_profiles_bound_what_sets_have_in_common():
    import numpy as np

    rng = np.random.default_rng(13)
    for n, m, both in [(3, 3, 3), (40, 40, 30), (900, 1000, 850), (5000, 6000, 10), (1, 1, 0), (20_000, 17_000, 16_500)]:
        h = rng.integers(0, 1 << 63, n + m - both, dtype=np.uint64) << np.uint64(1)
        sets = [np.sort(h[:n]), np.sort(h[n - both :])]
        p, q = (np.frombuffer(x, np.uint8) for x in shingle_sets.profiles(np.concatenate(sets), np.array([n, m])))
        assert both <= shingle_sets.most_in_common(p, q) <= min(n, m)
    few = np.arange(3000, dtype=np.uint64)  # all in one range: more than a byte holds
    assert shingle_sets.profiles(few, np.array([3000, 0])) == [b"", bytes(16)]
