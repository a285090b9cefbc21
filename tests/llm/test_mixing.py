"""Soft mixing against plain Python: posteriors, rates, and targets that can't be met."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellum.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _soft(spark, p, n):
    return spark.createDataFrame([(int(k), [float(x) for x in q]) for k, q in zip(n, p, strict=True)], "n long, p array<double>")


def _rates(p, steps):
    """Projected gradient steps, one after another."""
    r = np.ones(len(p))
    for v in steps:
        r = np.maximum(0, r - p @ np.array(v))
    return r


@pytest.mark.parametrize("want", [[0.7, 0.25, 0.05], [0.1, 0.1, 0.8], [1 / 3, 1 / 3, 1 / 3]])
def test_rates_match_targets(spark, want):
    rng = np.random.default_rng(9)
    p, n = rng.dirichlet([0.3, 0.3, 0.3], 2000), rng.integers(1, 500, 2000)
    soft = _soft(spark, p, n)
    fit = mixing.fit_rates(soft, want)
    r = _rates(p, fit.steps)
    assert fit.met and min(r) >= 0
    assert (n * r) @ p / n.sum() == pytest.approx(want, abs=1e-4)
    got = [x.r for x in soft.select(mixing.rate_of(F.col("p"), fit.steps).alias("r")).collect()]
    assert got == pytest.approx(r.tolist())


def _objective(p, n, want, r):
    metric = np.linalg.pinv((n[:, None] * p).T @ p / n.sum(), rcond=1e-6)
    gap = (n * r) @ p / n.sum() - want
    return gap @ metric @ gap


def test_targets_out_of_reach_give_the_nearest_mixture(spark):
    rng = np.random.default_rng(10)
    share = rng.uniform(0.2, 0.6, 500)
    p, n, want = np.stack([share, 1 - share], axis=1), rng.integers(1, 100, 500), np.array([0.9, 0.1])
    fit = mixing.fit_rates(_soft(spark, p, n), want.tolist())
    r = _rates(p, fit.steps)
    assert not fit.met and np.isfinite(r).all() and max(r) < 100 and _objective(p, n, want, r) < 0.5 * _objective(p, n, want, np.ones(500))
    assert fit.gap == pytest.approx(((n * r) @ p / n.sum() - want).tolist(), abs=1e-9)
    # brute force: the nearest mixture by many more steps of the plain kind
    best, metric = np.ones(500), np.linalg.pinv((n[:, None] * p).T @ p / n.sum(), rcond=1e-6)
    for _ in range(20_000):
        best = np.maximum(0, best - p @ (metric @ ((n * best) @ p / n.sum() - want)))
    assert _objective(p, n, want, r) <= 1.4 * _objective(p, n, want, best)


def test_each_step_lowers_the_objective(spark):
    rng = np.random.default_rng(12)
    p, n, want = rng.dirichlet([2, 1, 0.2, 0.2], 300), rng.integers(1, 100, 300), np.array([0.05, 0.05, 0.1, 0.8])
    fit = mixing.fit_rates(_soft(spark, p, n), want.tolist())
    seen = [_objective(p, n, want, _rates(p, fit.steps[:k])) for k in range(len(fit.steps) + 1)]
    assert all(b <= a + 1e-12 for a, b in zip(seen, seen[1:], strict=False))


def _posteriors(texts, domains):
    """Naive Bayes with one bucket for each feature."""
    feats = [[f for w in WORD.findall(t or "") for f in (("w", w), ("e", w[-2:]))] for t in texts]
    names = sorted(set(domains) - {None})
    counts = {d: collections.Counter(f for x, k in zip(feats, domains, strict=True) if k == d for f in x) for d in names}
    rows = collections.Counter(d for d in domains if d)
    out = []
    for x in feats:
        share = min(1.0, mixing.EVIDENCE / max(1, len(x)))
        logits = [math.log(rows[d] / sum(rows.values())) + share * sum(math.log((counts[d][f] + mixing.ALPHA) / (sum(counts[d].values()) + mixing.ALPHA * mixing.BUCKETS)) for f in x) for d in names]
        e = [math.exp(v - max(logits)) for v in logits]
        out.append([v / sum(e) for v in e])
    return names, out


def test_posteriors_are_naive_bayes(spark):
    rnd = random.Random(3)
    sets = {"a/1": "the cat and a dog", "b/0": "der hund!! und || katze", "c/1": "le chat et un chien"}
    texts, domains = [], []
    for i in range(60):
        d = rnd.choice(sorted(sets))
        texts.append(" ".join(rnd.choice(sets[d].split()) for _ in range(rnd.randrange(1, 60))))
        domains.append(d if i % 3 else None)
    texts, domains = [*texts, "", None, "\n \t", "the der le", texts[0]], [*domains, None, None, None, None, None]
    # this few features must not share buckets, or brute force counts otherwise
    words = {w for t in texts for w in WORD.findall(t or "")}
    probes = spark.createDataFrame([(w,) for w in sorted(words)], "w string").select(F.explode(mixing.features(F.array("w"))).alias("b"), "w")
    seen = probes.select("b").distinct().count()
    assert seen == len(words) + len({w[-2:] for w in words})
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labelled = spark.createDataFrame([(i, d) for i, d in enumerate(domains) if d] + [(None, "a/1"), (5, None)], "id long, domain string")
    out, model, fit = mixing.mix(docs, labelled)
    names, want = _posteriors(texts, domains)
    got = {r.doc_id: r for r in out.collect()}
    assert model.domains == names and len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].posterior == pytest.approx(want[i], abs=2e-3) and got[i].n_tokens == len(WORD.findall(t or ""))
    assert got[0].posterior == got[len(texts) - 1].posterior and got[60].posterior == got[61].posterior == pytest.approx(np.exp(model.log_prior).tolist())
    total = sum(r.n_tokens for r in got.values())
    weights = np.array(list(mixing.target_weights(names).values()))
    assert [sum(r.n_tokens * r.rate * r.posterior[d] for r in got.values()) / total - weights[d] / weights.sum() for d in range(len(names))] == pytest.approx(fit.gap, abs=1e-6)


def test_stage_copies_by_rate(spark, tmp_path):
    d = str(tmp_path)
    rows = [(i, "der hund und" if i % 4 == 0 else "the cat and", "de" if i % 4 == 0 else "en", 1) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(0, 400, 3)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    kept = mixing.mixing_stage(spark, spark.read.parquet(f"{d}/documents.parquet"), d)
    assert kept.columns == ["doc_id", "text", "lang", "n"]
    n = {r.lang: r["count"] for r in kept.groupBy("lang").count().collect()}
    assert abs(n["de"] - 200) < 40 and abs(n["en"] - 200) < 40


def test_many_domains_have_rates_and_posteriors(spark):
    docs = spark.createDataFrame([(i, f"w{i % 66} w{i % 66} und") for i in range(198)] + [(198, "")], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, f"d{i % 66:02}") for i in range(132)], "id long, domain string")
    weights = {f"d{k:02}": 2.0 if k % 2 else 1.0 for k in range(66)}
    out, model, fit = mixing.mix(docs, labelled, weights)
    got = out.collect()
    p, n = np.array([r.posterior for r in got]), np.array([r.n_tokens for r in got])
    want = np.array(list(weights.values())) / sum(weights.values())
    r = _rates(p, fit.steps)
    assert model.domains == list(weights) and len(got) == 199 and p.sum(axis=1) == pytest.approx(np.ones(199))
    assert fit.gap == pytest.approx(((n * r) @ p / n.sum() - want).tolist(), abs=1e-9)
    assert fit.met and [x.rate for x in got] == pytest.approx(r.tolist())
