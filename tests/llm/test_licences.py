"""Several notices in one paragraph and line."""

from __future__ import annotations

import pytest

from tessellum.llm import licences


@pytest.fixture(scope="module")
def model(spark):
    prose = ["the river runs under the bridge and the work is long", "all the rights of way were reserved seats", "a public library with general books, version two"] * 40
    return licences.train(spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string"))


def test_each_notice_counts(spark, model):
    mit, apache = "Licensed under the MIT License", "Licensed under the Apache License, Version 2.0"
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
    rows = [
        (1, "Licensed under the MIT License or the Apache License, Version 2.0"),
        (2, f"{mit} " + "word " * 100 + mit),
        (3, f"{apache} " + "word " * 12 + apache),
        (4, gpl),
        (5, f"{mit} " + "word " * 9 + apache + " word" * 200),
    ]
    found = licences.scan(spark.createDataFrame(rows, "doc_id long, text string"), model).filter("confirmed").collect()
    got = sorted((r.doc_id, r.family) for r in found)
    assert got == [(1, "apache"), (1, "mit"), (2, "mit"), (2, "mit"), (3, "apache"), (3, "apache"), (4, "gpl"), (5, "apache"), (5, "mit")]
