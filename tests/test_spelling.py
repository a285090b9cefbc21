"""Correction of spelling against brute force."""

from __future__ import annotations

import random

import pytest

from tessellum.operators.spelling import correct, corrections


def _far(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_corrections(spark, edits):
    rnd = random.Random(edits)
    word = lambda: "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 6)))
    known, asked = {word(): rnd.randint(1, 3) for _ in range(40)}, [*(word() for _ in range(80)), None]
    got = {r.word: r.correction for r in corrections(spark.createDataFrame([(w,) for w in asked], "word string"), spark.createDataFrame(list(known.items()), "word string, count long"), edits).collect()}
    want = {}
    for w in {w for w in asked if w is not None} - set(known):
        near = [(_far(w, k), -n, k) for k, n in known.items() if _far(w, k) <= edits]
        if near:
            want[w] = min(near)[2]
    assert got == want and want


def test_correct(spark):
    words = spark.createDataFrame([("receive", 5), ("letters", 9), ("better", 2), ("letter", 7)], "word string, count long")
    texts = ["I recieve  leters,\n\tbetterr!", "Leters LETERS lett-ers leters.py tiley", "", None, "letter"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, word string")
    got = [r.text for r in correct(docs, "id", words, edits=2).orderBy("id").collect()]
    assert got == ["I receive  letters,\n\tbetter!", texts[1], "", None, "letter"]
    names = spark.createDataFrame([("Leters",)], "name string")
    assert correct(docs, "id", words, known=names).filter("id = 0").first().text == "I recieve  leters,\n\tbetter!"
    talk = spark.createDataFrame([(1, "> a betterr one\nbetterr\n  > betterr\n>\n>x betterr")], "id int, text string")
    assert correct(talk, "id", words, transcript=True).first().text == "> a better one\nbetterr\n  > better\n>\n>x better"
    assert correct(docs.limit(0), "id", words).count() == 0
