"""The tools over small stores; .NET files."""

from __future__ import annotations

import pytest

from tessellum.operators.store import ChunkStore
from tessellum.sources.dotnet import architecture_facts, project_facts, solution_facts
from tessellum.tools import Tools


def test_facts(spark, tmp_path):
    t = Tools(spark, str(tmp_path))
    t.kg_add("Max O'Neil", "works at", "Acme", "2020-01-01", "2024-12-31")
    t.kg_add("Max O'Neil", "works at", "Beta", "2025-01-01")
    t.kg_add("max o'neil", "works at", "beta", "2025-06-01")  # open already
    t.kg_add("Kid", "child of", "Max O'Neil")
    at = lambda d: {r.object for r in t.kg_query("Max O'Neil", d, "outgoing").collect()}
    assert at("2023-06-01") == {"Acme"} and at("2025-06-01") == {"Beta"} and at("2024-12-31") == {"Acme"}
    assert {(r.direction, r.subject) for r in t.kg_query("Max O'Neil").collect()} == {("outgoing", "Max O'Neil"), ("incoming", "Kid")}
    with pytest.raises(ValueError):
        t.kg_add("a", "b", "c", "2025-01-02", "2025-01-01")
    t.kg_invalidate("Kid", "child of", "Max O'Neil", "2026-01-01")
    stats = t.kg_stats().first()
    assert (stats.entities, stats.triples, stats.current_facts, stats.predicates) == (4, 3, 1, "child_of,works_at")
    assert [r.valid_from for r in t.kg_timeline("Kid").collect()] == [None] and t.kg_timeline().count() == 3
    t.facts.add(spark.createDataFrame([("B", "inherits", "A"), ("C", "implements", "B"), ("A", "extends", "C")], "subject string, predicate string, object string"))
    assert {(r.type, r.depth, r.side) for r in t.show_type_dependencies("A", 2).collect()} == {("c", 1, "ancestor"), ("b", 2, "ancestor"), ("b", 1, "descendant"), ("c", 2, "descendant")}


def test_chunks(spark, tmp_path):
    t = Tools(spark, str(tmp_path))
    rows = [("a", "def parse(): read the config file", "w1", "src", "p/a.py", 0, "python", "parse", "function", 1, 1), ("b", "class Loader: loads data\nsecond line", "w1", "src", "p/b.py", 0, "python", "Loader", "class", 5, 6), ("c", "notes on cooking pasta", "w2", "src", "n.md", 0, "", "", "", 0, 0)]
    ChunkStore(spark, f"{tmp_path}/chunks").add(spark.createDataFrame(rows, "id string, text string, wing string, room string, source_file string, chunk_index int, language string, symbol_name string, symbol_type string, line_start int, line_end int"))
    assert t.search("cooking pasta", 1).first().id == "c" and t.search("cooking pasta", 1, wing="w1").first().id != "c"
    assert t.code_search("loads data", language="python", rerank_by="hybrid").first().id == "b"
    assert [r.id for r in t.code_search("anything", symbol_name="LOAD", file_glob="p/*.py").collect()] == ["b"]
    assert [(r.line, r.text) for r in t.read("b.py", 6, 9).collect()] == [(6, "second line")]
    assert t.check_duplicate("notes on cooking pasta").first().id == "c"
    assert t.add_drawer("w2", "kitchen", "notes on cooking pasta") is None
    made = t.add_drawer("w2", "kitchen", "sharpening knives safely")
    assert made and t.list_rooms("w2").count() == 2 and t.delete_drawer(made) == 1
    assert {r.room: r.wings for r in t.find_tunnels("w1").collect()} == {"src": ["w1", "w2"]}
    t.diary_write("Ann", "first entry")
    t.diary_write("Ann", "second entry")
    assert [r.text for r in t.diary_read("ann", 1).collect()] == ["second entry"]
    assert t.delete_wing("w2") == 1 and {r.wing for r in t.list_wings().collect()} == {"w1", "wing_ann"}
    t.facts.add(spark.createDataFrame([("Loader", "inherits", "Base")], "subject string, predicate string, object string"))
    assert [(r.symbol, r.others) for r in t.explain_subsystem("loads data").collect()] == [("loader", ["base"])]


def test_dotnet(spark):
    proj = '<?xml version="1.0"?>\n<Project xmlns="http://x/y" Sdk="S"><PropertyGroup><TargetFrameworks>net8.0; net6.0</TargetFrameworks><OutputType>Exe</OutputType></PropertyGroup><ItemGroup><PackageReference Include="Json" Version="1.2" /><PackageReference Include="Raw" /><ProjectReference Include="..\\Lib\\Lib.Core.csproj" /></ItemGroup></Project>'
    got = {tuple(r) for r in project_facts(spark.createDataFrame([("a/App.csproj", proj), ("a/Bad.csproj", "<Project>")], "path string, text string")).collect()}
    assert got == {("App", "targets_framework", "net8.0"), ("App", "targets_framework", "net6.0"), ("App", "has_output_type", "Exe"), ("App", "depends_on", "Json@1.2"), ("App", "depends_on", "Raw"), ("App", "references_project", "Lib.Core")}
    sln = 'Project("{1}") = "App", "src\\App.csproj", "{2}"\nEndProject\nProject("{3}") = "Folder", "Folder", "{4}"\n'
    assert [tuple(r) for r in solution_facts(spark.createDataFrame([("x/All.sln", sln)], "path string, text string")).collect()] == [("All", "contains_project", "App")]
    types = spark.createDataFrame([("UserRepository", "App.Data", "u.cs"), ("Plain", "", "p.cs")], "type_name string, namespace string, source_file string")
    facts = {tuple(r)[:3] for r in architecture_facts(types, "App", {"repository": ["Repository"]}, [("data", ["*.Data"], [])]).collect()}
    assert facts == {("UserRepository", "is_pattern", "repository"), ("UserRepository", "is_layer", "data"), ("UserRepository", "in_namespace", "App.Data"), ("App.Data", "in_project", "App"), ("UserRepository", "in_project", "App"), ("Plain", "in_project", "App")}
