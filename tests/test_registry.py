"""The registry of names against brute force."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tessellum.operators import registry


@pytest.fixture(scope="module")
def known(spark):
    people = spark.createDataFrame([("Riley", "personal", "daughter", 0), ("Maxwell", "work", "", 1), ("Grace", None, "friend", 2), (" ", "x", "x", 3), ("Ann Lee", "work", "", 4), ("O'Neil", "work", "", 5)], "name string, context string, relationship string, place int")
    aliases = spark.createDataFrame([("Max", "Maxwell"), ("Nobody", "Missing")], "alias string, name string")
    return registry.seeded(people, spark.createDataFrame([("Orchard",), ("riley",)], "name string"), aliases).cache()


def test_seeded(known):
    rows = {(r.kind, r.name): r for r in known.collect()}
    assert set(rows) == {("person", n) for n in ("Riley", "Maxwell", "Max", "Grace", "Ann Lee", "O'Neil")} | {("project", "Orchard"), ("project", "riley")}
    assert rows["person", "Max"].forms == ["Max", "Maxwell"] and rows["person", "Grace"].context == "personal" and rows["person", "Max"].confidence == 1.0


def test_lookup(spark, known):
    asked = [
        ("RILEY", ""), ("max", None), ("Max", "I saw Max and Max said hi"), ("grace", "the grace of it"), ("Grace", "so Grace said it. The grace of God"), ("grace", ""), ("orchard", ""), ("ever", "have you ever"), (None, "x"), ("", None), ("Ann Lee", "with ann lee"), ("Zed", ""),
    ]
    rows = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "type2 int, word string, context string")
    got = [tuple(r)[3:] for r in registry.lookup(rows, known).orderBy("type2").collect()]
    assert got == [
        ("person", 1.0, "onboarding", "Riley", None), ("person", 1.0, "onboarding", "Maxwell", None), ("person", 0.9, "onboarding", "Max", "context_patterns"), ("concept", 0.8, "context_disambiguated", "grace", "context_patterns"),
        ("person", 1.0, "onboarding", "Grace", None), ("person", 1.0, "onboarding", "Grace", None), ("project", 1.0, "onboarding", "Orchard", None), ("unknown", 0.0, "none", "ever", None), ("unknown", 0.0, "none", None, None), ("unknown", 0.0, "none", "", None),
        ("person", 1.0, "onboarding", "Ann Lee", None), ("unknown", 0.0, "none", "Zed", None),
    ]
    assert registry.lookup(rows.limit(0), known).count() == 0 and registry.lookup(rows, known.limit(0)).filter("type <> 'unknown'").count() == 0


TEXTS = ["Riley and ann lee met", "unriley rileys", "İ Riley", "maxwell's", "MAX was here with O'Neil", "the grace of it", "grace told us", "", None, "xmax max_ max-", "Ann  Lee", "naïveRiley Riley", "Rileyé"]


@pytest.mark.parametrize("most_bytes", [1 << 20, 8])
def test_people_in(spark, known, most_bytes):
    texts = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "id int, text string, name string").repartition(3)
    got = sorted((r.id, r.name) for r in registry.people_in(texts, known, ["id"], most_bytes=most_bytes).collect())
    want = set()
    for i, text in enumerate(TEXTS):
        for r in known.filter("kind = 'person'").collect():
            for form in r.forms:
                if text and re.search(rf"\b{re.escape(form)}\b", text, re.I):
                    if form.lower() in registry.COMMON:
                        p, c = (sum(bool(re.search(x.replace("{name}", form.lower()), text.lower())) for x in side) for side in (registry.PERSON, registry.CONCEPT))
                        if p <= c:
                            continue
                    want.add((i, r.name))
    assert got == sorted(want) and (6, "Grace") in want and (5, "Grace") not in want and (4, "Maxwell") in want
    assert registry.people_in(texts.limit(0), known, ["id"]).count() == 0 and registry.people_in(texts, known.limit(0), ["id"]).count() == 0


def test_mentions_and_boost(spark, known):
    texts = spark.createDataFrame([(1, "a\n> Riley: hi\nGrace"), (2, "in /Users/jdoe/x and /Users/other/"), (3, "rileys"), (4, None)], "id int, text string")
    people, users = known.filter("kind = 'person'").select("name"), spark.createDataFrame([("jdoe", "John"), ("other", "Else")], "user string, name string")
    assert sorted(tuple(r) for r in registry.mentions(texts, people, ["id"], users, first_lines=2).collect()) == [(1, "Riley"), (2, "John")]
    rows = spark.createDataFrame([("When did Riley meet Max in May", "riley left"), ("nothing", "x"), ("Riley Riley", None)], "q string, d string")
    got = rows.select(registry.person_names(F.col("q")).alias("n"), registry.name_boost(registry.person_names(F.col("q")), F.col("d")).alias("b")).collect()
    assert [(r.n, r.b) for r in got] == [(["Riley", "Max"], 0.5), ([], 0.0), (["Riley"], 0.0)]


def test_registry_learns(spark, tmp_path, known):
    r = registry.Registry(spark, str(tmp_path / "r"))
    r.seed(spark.createDataFrame([("Riley",)], "name string"), spark.createDataFrame([("Orchard",)], "name string"))
    told = "Alice: hello\nAlice said yes. Hey Alice\nshe left. Riley said Riley: hi hey Riley"
    texts = spark.createDataFrame([(str(i), told) for i in range(3)], "id string, text string")
    assert r.learn(texts, ["she", "hey"], "id") == 1 and r.learn(texts, ["she", "hey"], "id") == 0
    row = r.rows().filter("name = 'Alice'").first()
    assert (row.kind, row.source, row.seen) == ("person", "learned", 9) and row.confidence >= 0.75
    r.confirm("Lyon", "place", 0.8)
    r.seed(spark.createDataFrame([("Alice",)], "name string"))
    asked = spark.createDataFrame([("lyon", ""), ("alice", "")], "word string, context string")
    assert [(x.word, x.type, x.source, x.confidence) for x in registry.lookup(asked, r.rows()).orderBy("word").collect()] == [("alice", "person", "onboarding", 1.0), ("lyon", "place", "wiki", 0.8)]
