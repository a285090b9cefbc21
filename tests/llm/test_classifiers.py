"""Language ID and toxicity against plain Python: n-grams, counts, posteriors, scores and the fit."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest

from tessellum.llm import chargrams, language_id, toxicity

MASK = (1 << 32) - 1


def _bucket(gram: str, bits: int) -> int:
    h = ord(gram[0])
    for c in gram[1:]:
        h = (h * 0x9E3779B1 + ord(c)) & MASK
    x = h ^ (h >> 15)
    x = (x + len(gram)) * 0x85EBCA6B & MASK
    x = (x ^ (x >> 13)) * 0xC2B2AE35 & MASK
    return x >> (32 - bits)


def _grams(text: str | None, orders, bits):
    t = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    out = collections.Counter()
    for n in orders:
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if n == 1 and g == " " or n > 1 and (g[:2] == "  " or g[-2:] == "  "):
                continue
            out[_bucket(g, bits)] += 1
    return out


TEXTS = ["The  cat!! sat", "", None, "Straße, ÉTÉ -- nuit", "a", "!!", "日本 語 x", "ab" * 60, "x  y\n\nz", "The  cat!! sat"]


@pytest.mark.parametrize("orders, bits", [((1, 2, 3), 16), ((3, 4, 5), 18)])
@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_ngrams(monkeypatch, orders, bits, piece):
    monkeypatch.setattr(chargrams, "PIECE", piece)
    row, bucket, count = chargrams.sparse_counts(TEXTS, orders, bits)
    got = collections.defaultdict(dict)
    for r, b, n in zip(row.tolist(), bucket.tolist(), count.tolist(), strict=True):
        got[r][b] = n
    assert [got[i] for i in range(len(TEXTS))] == [dict(_grams(t, orders, bits)) for t in TEXTS]


def _corpus(seed, n):
    rnd = random.Random(seed)
    words = {"en": "the of and thing that with".split(), "de": "der und nicht schön ein ich".split(), "fr": "le été garçon est une dans".split()}
    return [(lang := rnd.choice(sorted(words)), " ".join(rnd.choice(words[lang]) for _ in range(rnd.randrange(1, 30)))) for _ in range(n)]


def test_language_id_is_naive_bayes(spark):
    rows = _corpus(1, 90)
    texts = [t for _, t in rows] + TEXTS
    langs = [lang if i % 7 else None for i, (lang, _) in enumerate(rows)] + [None] * len(TEXTS)
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")
    model = language_id.train(df)
    counts = {k: sum((_grams(t, language_id.ORDERS, language_id.BITS) for t, lang in zip(texts, langs, strict=True) if lang == k), collections.Counter()) for k in ("de", "en", "fr")}
    prior = collections.Counter(x for x in langs if x)
    got = {r.doc_id: r for r in language_id.predict(df, model, ["doc_id"]).collect()}
    size = 1 << language_id.BITS
    for i, t in enumerate(texts):
        grams = _grams(t, language_id.ORDERS, language_id.BITS)
        total = sum(grams.values())
        like = {k: sum(n * math.log((c[b] + language_id.ALPHA) / (sum(c.values()) + language_id.ALPHA * size)) for b, n in grams.items()) for k, c in counts.items()}
        p0 = {k: math.log(prior[k] / sum(prior.values())) for k in counts}
        best = max(sorted(counts), key=lambda k: like[k] + p0[k])
        z = {k: math.exp(like[k] * min(1.0, language_id.EVIDENCE / max(total, 1)) + p0[k]) for k in counts}
        if any(c.isalpha() for c in t or ""):
            assert got[i].lang_pred == best and got[i].score == pytest.approx(z[best] / sum(z.values()), abs=1e-3)
        else:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)


def test_language_id_on_held_out_texts_and_ties(spark):
    schema = "doc_id long, text string, lang string"
    model = language_id.train(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(_corpus(2, 300))], schema))
    held = _corpus(3, 200)
    got, _ = model.predict([t for _, t in held])
    assert np.mean([a == lang for a, (lang, _) in zip(got, held, strict=True)]) > 0.95
    # languages that are alike in everything: the first by name, repeated rows alike
    tied = language_id.train(spark.createDataFrame([(1, "abc", "y"), (2, "abc", "x"), (None, "abc", "w"), (3, None, "v")], schema))
    assert tied.langs == ["x", "y"] and tied.predict(["abc", "abc", "q"])[0] == ["x"] * 3 and tied.predict(["abc"])[1][0] == pytest.approx(0.5)


def _labelled(seed, n):
    rnd = random.Random(seed)
    plain, bad = "river stone garden letter morning window table".split(), "idiot moron stupid loser".split()
    rows = []
    for i in range(n):
        y = int(rnd.random() < 0.3)
        words = [rnd.choice(plain) for _ in range(rnd.randrange(5, 40))]
        if y:
            words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words), y))
    return rows


def test_toxicity_scores_and_held_out_accuracy(spark):
    rows = _labelled(4, 400)
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, ""), (901, None), (902, "IDIOT!! " * 3)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (4, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert np.mean([(got[i].predicted == y) for i, _, y in rows if i % 2 == 0]) > 0.95 and got[902].predicted == 1
    for i, t in [(i, t) for i, t, _ in rows[:40]] + [(900, ""), (901, None)]:
        margin = model.bias + sum(model.weight[b] for b in _grams(t, toxicity.ORDERS, toxicity.BITS))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-margin)), rel=1e-6)
    assert got[900].score == got[901].score
    # two labels of one id: the larger counts; one class only: every score is the share of toxic labels
    one = toxicity.train(docs, spark.createDataFrame([(1, 0), (1, 1)], "doc_id long, toxic int"))
    assert set(toxicity.score(docs, one, ["doc_id"]).select("score").distinct().toPandas().score.round(9)) == {round(1.5 / 2, 9)}


def test_toxicity_fit_is_the_minimum_of_its_loss():
    rng = np.random.default_rng(6)
    n, m = 120, 12
    row, feature = np.nonzero(rng.random((n, m)) < 0.4)
    ratio = rng.normal(size=m)
    y = (rng.random(n) < 0.5).astype(float)
    weight, bias = toxicity._fit(row, feature, y, ratio, 0.5)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())

    def loss(w, b):
        z = np.bincount(row, weights=ratio[feature] * w[feature], minlength=n) + b
        return (share * (np.logaddexp(0, z) - y * z)).sum() + toxicity.L2 / n / 2 * (w * w).sum()

    w = weight / ratio
    at = loss(w, bias)
    for _ in range(300):
        assert at <= loss(w + rng.normal(size=m) * 0.05, bias + rng.normal() * 0.05) + 1e-6
