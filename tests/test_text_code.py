"""Markdown, code, summaries and conversations on small fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.operators import code, conversations, markdown, summary
from tessellum.operators.chunking import chunk_lines, merge_split, split_oversized


def test_merge_and_split():
    assert merge_split(["a" * 50]) == []
    assert merge_split(["a" * 1500, "b" * 998]) == ["a" * 1500 + "\n\n" + "b" * 998]
    assert merge_split(["a" * 1500, "b" * 999]) == ["a" * 1500, "b" * 999]
    assert merge_split(["a" * 3000]) == ["a" * 3000]
    assert [len(x) for x in split_oversized("\n".join(["x" * 1000] * 5))] == [2001, 2001, 1000]
    assert chunk_lines("x" * 60 + "\n\n" + "y" * 60) == ["x" * 60 + "\n\n" + "y" * 60]
    assert chunk_lines("short") == [] and chunk_lines(None) == []


def test_markdown():
    text = "intro " * 20 + "\n# One\n" + "a " * 800 + "\n## API usage\n```mermaid\nx\n```\n" + "b " * 900 + "\n# Next\n| a | b |\n" + "c " * 100
    got = markdown.chunk_markdown(text)
    assert [(c["heading"], c["heading_path"], c["doc_section_type"], c["contains_mermaid"], c["contains_table"]) for c in got] == [
        ("One", "One", "mixed", 0, 0), ("API usage | Next", "One > API usage | Next", "mixed", 1, 1),
    ]
    assert markdown.section_type("Architecture decision") == "decision"


SYMBOL_CASES = [
    ("data class P(val x: Int)", "kotlin", "P", "data_class"), ("fun <T> List<T>.second(): T = this[1]", "kotlin", "second", "function"), ("object { }\ncompanion object {", "kotlin", "", "companion_object"), ("  public sealed class Q : R { }", "csharp", "Q", "class"), ("  public record struct V(int X);", "csharp", "V", "record"),
    ("    public int Size { get; }", "csharp", "Size", "property"), ("type Shape =\n  | Circle", "fsharp", "Shape", "union"), ("let rec inline go x = x", "fsharp", "go", "function"), ("public mustinherit class Low", "vbnet", "Low", "class"), ("Public MustInherit Class Base", "vbnet", "Base", "class"), ("private shared sub Run()", "vbnet", "Run", "method"),
    ("@MainActor final class V {", "swift", "V", "class"), ("class func make() {}", "swift", "make", "function"), ("extension Array where Element: X {", "swift", "Array", "extension"), ('<Window x:Class="App.Views.Main">', "xaml", "Main", "view"), ("namespace App\\Http;", "php", "App\\Http", "namespace"), ("final class K {}", "php", "K", "class"),
    ("@tailrec private[core] def loop(n: Int) = n", "scala", "loop", "function"), ("sealed case class C(x: Int)", "scala", "C", "case_class"), ("extension type Id(int i) {}", "dart", "Id", "extension_type"), ("  const factory P.named(int x)", "dart", "P.named", "constructor"), ("function M.run(x)", "lua", "M.run", "method"), ("Conf = {}", "lua", "Conf", "module"),
    ("  def ok?; end", "ruby", "ok?", "method"), ("int *f(int x) {", "c", "f", "function"), ("enum class E { A };", "cpp", "E", "enum"), ("record R(int x) {}", "java", "R", "record"), ("int size(List<String> x) {", "java", "size", "method"),
]


def test_blocks_of_code(spark):
    ts = "import a\nimport b\n\nimport c\n// one\n// two\nexport function f() {\n  const x = 1\n}\n\nconst y = 2"
    assert _blocks(spark, ts, "typescript") == ["import a\nimport b", "import c\n// one\n// two".split("\n//")[0], "// one\n// two\nexport function f() {\n  const x = 1\n}", "const y = 2"]
    swift = "class A {\n  @Published var n = 0\n  @objc\n  func f() {}\n}"
    assert _blocks(spark, swift, "swift") == ["class A {\n  @Published var n = 0", "@objc\n  func f() {}\n}"]
    rust = "//! doc\n\n#[derive(Debug)]\npub struct S;\n\n// far\n\nfn g() {}"
    assert _blocks(spark, rust, "rust") == ["//! doc", "#[derive(Debug)]\npub struct S;\n\n// far", "fn g() {}"]
    assert _blocks(spark, "[Serializable]\npublic class A { }", "csharp") == ["[Serializable]\npublic class A { }"]
    assert _blocks(spark, 'x = 1\nresource "a" "b" {\n}\n-- y', "hcl") == ["x = 1", 'resource "a" "b" {\n}\n-- y']
    assert _blocks(spark, "local x = 1\n-- about\nlocal function f(a)\nend", "lua") == ["local x = 1", "-- about\nlocal function f(a)\nend"]
    assert _blocks(spark, "x", "python") == [] and _blocks(spark, "def f(): pass", "text") == []


def _chunks(spark, text, lang):
    rows = spark.createDataFrame([("f", text)], "path string, text string")
    return [r.content for r in code.code_chunks(rows, ["path"], lang).orderBy("chunk_index").collect()]


def _blocks(spark, text, lang):
    rows = spark.createDataFrame([(1, text)], f"{code.OWN}row long, text string")
    return [r.block for r in code.code_blocks(rows, F.lit(lang)).orderBy("nth").collect()]


def test_code(spark):
    py = "import os\n\n# about f\ndef f():\n" + "    x = 1\n" * 200 + "\nclass A(Base):\n" + "    y = 2\n" * 200
    chunks = _chunks(spark, py, "python")
    assert len(chunks) == 2 and chunks[0].startswith("import os") and "# about f" in chunks[0] and chunks[1].startswith("class A")
    assert _chunks(spark, "x = 1\n" * 50, "python") == [("x = 1\n" * 50).strip()] and _chunks(spark, None, "python") == []
    cases = [("def f(): pass", "python", "f", "function"), ("class A:\n    def m(self): pass", "python", "A", "class"), ("import x\nexport const y = 1", "typescript", "y", "const"), ("export default class Q {}", "typescript", "Q", "class"), ("import x from 'y'", "tsx", "", "import"), ("func (r *T) Do() {}", "go", "Do", "method"), ("pub(crate) async fn go() {}", "rust", "go", "function"), ("public final class K {}", "java", "K", "class"), ("x", "text", "", ""), *SYMBOL_CASES]
    rows = spark.createDataFrame(cases, "c string, l string, n string, t string").select("n", "t", code.symbol(F.col("c"), F.col("l")).alias("s")).collect()
    assert [(r.s.symbol_name, r.s.symbol_type) for r in rows] == [(r.n, r.t) for r in rows]
    files = spark.createDataFrame([("pkg/a.py", "import os, sys as s\nfrom x.y import z\nfrom . import q\nclass A(B, ABC, metaclass=M):\n  pass\nclass C(Generic[K, V]):\n  pass  # class D(E):\n")], "path string, text string")
    got = {tuple(r) for r in code.python_relations(files).collect()}
    assert got == {("A", "inherits", "B"), ("A", "implements", "ABC"), ("C", "inherits", "Generic"), ("a", "depends_on", "os"), ("a", "depends_on", "sys"), ("a", "depends_on", "x.y")}
    langs = spark.createDataFrame([("a/b.PY", ""), ("run", "#!/usr/bin/env python3\n"), ("d.yaml", "apiVersion: v1\nkind: Pod\n"), ("x.zzz", "")], "p string, c string")
    assert [r[0] for r in langs.select(code.language(F.col("p"), F.col("c"))).collect()] == ["python", "python", "kubernetes", "unknown"]


def test_summary(spark):
    text = "Then Alice met Bob. We decided to use the parser because the old_parser failed badly. Parser parser."
    rows = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id long, text string")
    got = {r.id: r.summary for r in summary.summarise(rows, "id").collect()}
    assert got[1] == '0:ALI+BOB+PAR|parser_alice_bob|"We decided to use the parser because the old_parser ..."|determ|DECISION'
    assert got[2] == got[3] == "0:???|misc"


def test_exchanges(spark):
    lines = ["intro", "> ask me something longer than that", "first", "", "second", "---", "lost", "> short", "> again a question that is long", *[f"l{i}" for i in range(10)]]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos long, line string")
    got = [r.content for r in conversations.exchange_chunks(df).orderBy("pos").collect()]
    assert got == ["> ask me something longer than that\nfirst second", "> again a question that is long\n" + " ".join(f"l{i}" for i in range(8))]
    starts = spark.createDataFrame([(1, 0, "Tool v1"), *[(1, k, "x") for k in range(1, 9)], (1, 9, "Tool v2"), (1, 10, "previous messages")], "doc_id long, pos long, line string")
    assert [r.pos for r in conversations.session_starts(starts, "Tool v", ["previous messages"]).collect()] == [0]
