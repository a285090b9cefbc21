"""Scalar functions, routing, manifests, C# relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators.code import symbol
from tessellum.operators.manifests import ansible_items, csharp_relations, helm_symbol, helm_values, manifest_chunks
from tessellum.operators.routing import file_room


def one(spark, column, value=None):
    return spark.createDataFrame([(value,)], "x string").select(column).first()[0]


def test_scalars(spark):
    x = F.col("x")
    cases = [
        (T.parse_bytes(x), {"1.5 KiB": 1536, "10": 10, "2gb": 2 * 10**9, "-1": None, "x": None}),
        (T.room_name(x), {"My-Project.Api": "my_project_api", "!!": "general"}),
        (T.wing_name(x), {"My App-x!": "my_app_x", "": "project"}),
        (T.sentiment(x), {"It WORKS, love": "positive", "a bug": "negative", "so": "neutral"}),
        (T.session_time(x), {"a\n⏺ 2:41 PM Monday, January 5, 2026": "2026-01-05_241PM", "x": ""}),
        (T.subject_slug(x), {"> cd x\n> ok\n> How do I, parse this?": "How-do-I-parse-this", "none": "session"}),
        (T.entity_id(x), {"O'Neil Smith": "oneil_smith"}),
        (F.concat_ws(",", T.keywords(x, ["the"])), {"the quick parser of brown foxes": "parser,quick,brown"}),
        (T.count_sequence(T.words_of(x), ["a", "b"]), {"a b a b, a B": 3, "ab": 0}),
        (T.phrase_share(T.quoted_phrases(x), F.lit("Some Text here")), {'find "some text" and "none"': 0.5, "x": 0.0}),
    ]
    for column, wants in cases:
        for given, want in wants.items():
            assert one(spark, column, given) == want, given
    assert one(spark, T.format_bytes(F.lit(1536))) == "1.5 KiB" and one(spark, T.format_bytes(F.lit(10))) == "10 B"
    v = one(spark, T.embed(x), "a b a")
    assert len(v) == 384 and abs(sum(c * c for c in v) - 1) < 1e-9
    assert one(spark, T.evidence_recall(F.array(F.lit("a")), F.array(F.lit("a"), F.lit("b")))) == 0.5


def test_file_room(spark):
    rooms = {"backend": ["server", "api layer"], "docs": ["guide"]}
    rows = [("src/api-layer/x.py", ""), ("a/guide.md", ""), ("a/x.py", "guide guide server"), ("a/x.py", "latest testing"), ("x.py", "Server server guide")]
    got = spark.createDataFrame(rows, "p string, c string").select(file_room(F.col("p"), F.col("c"), rooms)).collect()
    assert [r[0] for r in got] == ["backend", "docs", "docs", "general", "backend"]


def test_manifests_and_csharp(spark):
    pod = "apiVersion: v1\nkind: Pod\nmetadata:\n  name: p1\nspec:\n  text: |\n    ---\n    inside\n" + "  x: y\n" * 30
    got = manifest_chunks(spark.createDataFrame([("f", pod + "---\nshort: 1\n---\n" + pod.replace("p1", "p2"))], "path string, text string"), ["path"]).collect()
    assert [(r.chunk_index, r.symbol_name, r.symbol_type) for r in got] == [(0, "Pod/p1", "pod"), (1, "Pod/p2", "pod")]
    cs = "// class Z : Y\npublic sealed class A<T> : Base<Dictionary<string, List<int>>>, IThing where T : new()\n{ }\ninternal interface IB : IA, IC { }\npublic struct S : IEquatable<S> { }\nrecord R(int X) : Parent(X);"
    rows = csharp_relations(spark.createDataFrame([(cs,)], "text string")).collect()
    assert {tuple(r) for r in rows} == {("A", "inherits", "Base"), ("A", "implements", "IThing"), ("IB", "extends", "IA"), ("IB", "extends", "IC"), ("S", "implements", "IEquatable"), ("R", "inherits", "Parent")}


def test_ansible_helm_ruby(spark):
    f = lambda t: spark.createDataFrame([("f", t)], "path string, text string")
    plays = ansible_items(f("---\n- name: 'Set up'\n  hosts: web\n- hosts: db\n  tasks:\n    - name: inner\n"), ["path"]).collect()
    assert [(r.chunk_index, r.symbol_name) for r in plays] == [(0, "Set up"), (1, "db")]
    assert [r.symbol_name for r in ansible_items(f("- name: Install\n- copy: x\n"), ["path"], "task", "nginx").collect()] == ["Install", "nginx"]
    assert ansible_items(f(""), ["path"]).count() == 0
    values = "# about a\na:\n" + "  k: v\n" * 300 + "b:\n" + "  k: v\n" * 300
    assert [r.content[:9] for r in helm_values(f(values), ["path"]).collect()] == ["# about a", "b:\n  k: v"[:9]]
    x = F.col("x")
    assert one(spark, helm_symbol(x), "{{- if .x }}\nkind: Pod\nmetadata:\n  name: p\n") == "Pod/p" and one(spark, helm_symbol(x), "kind: Pod\n  name: {{ .n }}\n") == "Pod"
    assert one(spark, helm_symbol(x, chart=True), 'name: "c"') == "HelmChart/c"
    assert tuple(one(spark, symbol(x, F.lit("ruby")), "  def self.go!\n")) == ("go!", "method")
