"""Layers of recall."""

from __future__ import annotations

from tessellum.operators import layers


def test_story(spark):
    rows = [(f"i{k:02d}", "w", "beta" if k % 2 else "alpha", "word " * 30 if k else "one\ntwo", f"a/f{k}.txt" if k else "", float(k == 7)) for k in range(20)]
    df = spark.createDataFrame(rows, "id string, wing string, room string, text string, source_file string, importance double")
    story = layers.essential_story(df).first().story
    lines = story.split("\n")
    assert lines[:4] == [layers.TITLE, "", "[alpha]", "  - one two"] and "  - " + ("word " * 30).strip() + "  (f7.txt)" in lines
    assert story.count("  - ") == 15 and layers.MORE not in story
    assert story.index("(f7.txt)") < story.index("(f1.txt)")
    short = layers.essential_story(df, budget=200).first().story
    assert short.endswith(layers.MORE) and short.count("  - ") == 2
    assert layers.essential_story(df.filter("false")).first().story == layers.NOTHING
    row = layers.wake_up("I am\n", df.filter("id = 'i00'")).first()
    assert row.text.startswith("I am\n\n## L1") and row.tokens == len(row.text) // 4
    assert [r.id for r in layers.recall(df, room="beta", n=2).collect()] == ["i01", "i03"]
