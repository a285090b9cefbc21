"""Sources and chunkers over files that are made from the driver's tables, with what they must give."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import conversations, dispatch, manifests, markdown, metrics, relations, routing
from tessellum.plans.code_queries import _told, _values
from tessellum.plans.registry import register
from tessellum.plans.views import CHUNKS, chunks, table
from tessellum.sources import chats, dotnet, scan


#: Files that one task makes and reads, about.
TASK_FILES = 10_000


def _parts(spark, sf, texts: list[str], **more):
    """Files made of the keys of parts; the keys, of which one scan task has millions, are dealt out before the texts are made."""
    parts = table(spark, sf, "part")
    tasks = max(spark.sparkContext.defaultParallelism, -(-parts.count() // TASK_FILES))
    return parts.repartition(tasks, "p_partkey").select(F.col("p_partkey").alias("id"), _told(texts, "p_partkey").alias("text"), *[v.alias(k) for k, v in more.items()])


def _expected(rows: list[tuple], names: str, n: int, out: str) -> str:
    """Rows (nth file, values ...) of each part, the key in place of ``{k}``."""
    cols = ", ".join(f"replace({c}, '{{k}}', CAST(p_partkey AS VARCHAR)) AS {c}" if c[0] != "_" else f"{c} AS {c[1:]}" for c in names.split(", "))
    return f"SELECT p_partkey AS id, {cols}{out} FROM part JOIN " + _values(rows, "n, " + names) + f" ON n = p_partkey % {n}"


@register(
    "chat_turns",
    r"WITH t AS (SELECT conv_id, turn, role, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations WHERE role IN ('user', 'assistant')), k AS (SELECT conv_id FROM t WHERE text <> '' GROUP BY conv_id HAVING count(*) > 1) "
    "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY t.turn) - 1 AS turn, role, text FROM t JOIN k USING (conv_id) WHERE text <> ''",
)
def chat_turns(spark, sf):
    """Conversations written in three shapes of exports, and read again."""
    message = F.struct(F.struct(F.col("text").alias("content")).alias("message"), F.col("role").alias("type"))
    event = F.struct(F.lit("event_msg").alias("type"), F.struct(F.when(F.col("role") == "user", "user_message").when(F.col("role") == "assistant", "agent_message").otherwise("other").alias("type"), F.col("text").alias("message")).alias("payload"))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(message).alias("a"), F.to_json(event).alias("b"), F.struct("role", F.col("text").alias("content")).alias("c"))
    files = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "a", "b", "c"))).alias("x"))
    lines = lambda k: F.array_join(F.transform("x", lambda r: r[k]), "\n")
    meta = F.concat(F.lit('{"type": "session_meta"}\n'), lines("b"))
    text = F.when(F.col("conv_id") % 3 == 0, lines("a")).when(F.col("conv_id") % 3 == 1, meta).otherwise(F.to_json(F.transform("x", lambda r: r["c"])))
    return chats.read_turns(files.select("conv_id", text.alias("text")), "conv_id")


_LONG = " ".join(["word"] * 560)
_PAGE = f"# Title {{k}}\n{_LONG}\n## API usage\n```py\nx\n```\n{_LONG}\n# Next\n| a | b |\n{_LONG}\n### Deep\n```mermaid\nx\n```\nshort\n"


@register(
    "markdown_sections",
    _expected([(0, 0, "Title {k}", 1, "Title {k}", "section", 0, 0, 0), (0, 1, "API usage", 2, "Title {k} > API usage", "reference", 0, 1, 0), (0, 2, "Next", 1, "Next", "follow_up", 0, 0, 1), (0, 3, "Deep", 3, "Next > Deep", "section", 1, 1, 0)], "_chunk_index, heading, _heading_level, heading_path, doc_section_type, _contains_mermaid, _contains_code, _contains_table", 1, ""),
)
def markdown_sections(spark, sf):
    page = _PAGE.replace("short\n", _LONG)
    out = markdown.markdown_chunks(_parts(spark, sf, [page]), ["id"])
    return out.select("id", "chunk_index", "heading", "heading_level", "heading_path", "doc_section_type", "contains_mermaid", "contains_code", "contains_table")


_POD = "apiVersion: v1\nkind: Pod\nmetadata:\n  name: p{k}\nspec:\n  text: |\n    ---\n    inside\n" + "  x: y\n" * 30
_CLAIM = "apiVersion: v1\nkind: Service\nspec:\n" + "  x: y\n" * 30


@register("manifest_chunks", _expected([(0, 0, "Pod/p{k}", "pod"), (0, 1, "Service", "service")], "_chunk_index, symbol_name, symbol_type", 1, ""))
def manifest_chunks(spark, sf):
    out = manifests.manifest_chunks(_parts(spark, sf, [_POD + "---\nshort: 1\n---\n" + _CLAIM]), ["id"])
    return out.select("id", "chunk_index", "symbol_name", "symbol_type")


@register("ansible_plays", _expected([(0, 0, "Set up {k}", "ansible_play"), (0, 1, "db", "ansible_play"), (1, 0, "only {k}", "ansible_play")], "_chunk_index, symbol_name, symbol_type", 2, ""))
def ansible_plays(spark, sf):
    out = manifests.ansible_items(_parts(spark, sf, ["---\n- name: 'Set up {k}'\n  hosts: web\n- hosts: db\n  tasks:\n    - name: inner\n", "- hosts: only {k}\n"]), ["id"])
    return out.select("id", "chunk_index", "symbol_name", "symbol_type")


_CHARTS = ["{{- if .x }}\nkind: Pod\nmetadata:\n  name: p{k}\n", "kind: Job\nmetadata:\n  name: {{ .n }}\n", "x: {k}\n"]


@register("helm_symbols", _expected([(0, "Pod/p{k}"), (1, "Job"), (2, "")], "symbol", 3, ""))
def helm_symbols(spark, sf):
    return _parts(spark, sf, _CHARTS).select("id", manifests.helm_symbol(F.col("text")).alias("symbol"))


_CS = ["// class Z : Y\npublic sealed class A{k}<T> : Base<Dictionary<string, List<int>>>, IThing where T : new()\n{ }", "internal interface IB{k} : IA, IC { }", "public struct S{k} : IEquatable<S> { }\nrecord R{k}(int X) : Parent(X);"]
_CS_FACTS = [(0, "A{k}", "inherits", "Base"), (0, "A{k}", "implements", "IThing"), (1, "IB{k}", "extends", "IA"), (1, "IB{k}", "extends", "IC"), (2, "S{k}", "implements", "IEquatable"), (2, "R{k}", "inherits", "Parent")]


@register("csharp_relations", "SELECT subject, predicate, object FROM (" + _expected(_CS_FACTS, "subject, predicate, object", 3, "") + ")")
def csharp_relations(spark, sf):
    return manifests.csharp_relations(_parts(spark, sf, _CS))


_PROJECT = '<?xml version="1.0"?>\n<Project Sdk="x"><PropertyGroup><TargetFrameworks>net8.0;net9.0</TargetFrameworks><OutputType>Exe</OutputType></PropertyGroup><ItemGroup><PackageReference Include="P{k}" Version="1.2" /><ProjectReference Include="..\\Core{k}\\Core{k}.csproj" /></ItemGroup></Project>'
_PROJECT_FACTS = [(0, "App{k}", "targets_framework", "net8.0"), (0, "App{k}", "targets_framework", "net9.0"), (0, "App{k}", "has_output_type", "Exe"), (0, "App{k}", "depends_on", "P{k}@1.2"), (0, "App{k}", "references_project", "Core{k}")]


@register("dotnet_projects", "SELECT subject, predicate, object FROM (" + _expected(_PROJECT_FACTS, "subject, predicate, object", 2, "") + ")")
def dotnet_projects(spark, sf):
    return dotnet.project_facts(_parts(spark, sf, [_PROJECT, "no project {k}"], path=_told(["src/App{k}.csproj"], "p_partkey")))


_SLN = 'Microsoft Visual Studio Solution File\nProject("{F1}") = "A{k}", "src\\A{k}\\A{k}.csproj", "{G}"\nEndProject\nProject("{F2}") = "Folder", "Folder", "{H}"\nEndProject\nProject("{F1}") = "B", "src/B.fsproj", "{I}"\n'


@register("dotnet_solutions", "SELECT subject, predicate, object FROM (" + _expected([(0, "All{k}", "contains_project", "A{k}"), (0, "All{k}", "contains_project", "B")], "subject, predicate, object", 1, "") + ")")
def dotnet_solutions(spark, sf):
    return dotnet.solution_facts(_parts(spark, sf, [_SLN], path=_told(["x/All{k}.sln"], "p_partkey")))


_RULES = ["# no", "*.log", "!keep.log", "/top.txt", "out/", "a/**/b.py", "\\#odd"]
_RULED = [("x{k}.log", 1), ("d/x{k}.log", 1), ("keep.log", 0), ("top.txt", 1), ("d/top.txt", 0), ("out/x{k}.py", 1), ("d/out/x.py", 1), ("out", 0), ("a/b.py", 1), ("a/c{k}/d/b.py", 1), ("#odd", 1), ("fine{k}.py", 0)]


@register("ignore_rules", "SELECT p_partkey AS id, v = 1 AS ignored FROM part JOIN " + _values([(n, v) for n, (_, v) in enumerate(_RULED)], "n, v") + f" ON n = p_partkey % {len(_RULED)}")
def ignore_rules(spark, sf):
    return _parts(spark, sf, [p for p, _ in _RULED]).select("id", scan.ignored(F.col("text"), scan.parse_ignore(_RULES)).alias("ignored"))


_ROOMS = {"backend": ["server", "api layer"], "docs": ["guide"]}
_FILES = [("src/api-layer/x{k}.py", "", "backend"), ("a/guide{k}.md", "guide", "docs"), ("a/x{k}.py", "guide guide server", "docs"), ("a/x{k}.py", "latest testing", "general"), ("x{k}.py", "Server server guide", "backend")]


@register("file_rooms", "SELECT p_partkey AS id, room FROM part JOIN " + _values([(n, x[2]) for n, x in enumerate(_FILES)], "n, room") + f" ON n = p_partkey % {len(_FILES)}")
def file_rooms(spark, sf):
    rows = _parts(spark, sf, [p for p, _, _ in _FILES], content=_told([c for _, c, _ in _FILES], "p_partkey"))
    return rows.select("id", routing.file_room(F.col("text"), F.col("content"), _ROOMS).alias("room"))


_TALK = ["intro", "> ask {k} something longer than that", "first", "", "second", "---", "lost", "> short", "> again a question that is long", *[f"l{i}" for i in range(10)]]


@register("exchange_chunks", _expected([(0, 1, "> ask {k} something longer than that\nfirst second"), (0, 8, "> again a question that is long\n" + " ".join(f"l{i}" for i in range(8)))], "_pos, content", 1, ""))
def exchange_chunks(spark, sf):
    lines = _parts(spark, sf, ["\n".join(_TALK)]).select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return conversations.exchange_chunks(lines, "id").select("id", "pos", "content")


_FS = "module M\ntype A{k}() =\n    inherit Base{k}()\n    interface IThing with\n        member x.Go() = ()\nmodule N =\n    inherit Lost()\ntype B = | X\n  interface IDisposable with"
_VB = "Public Class C{k}\n    Inherits Base\n    Implements IA(Of T), IB\nEnd Class\nInherits Lost\nFriend Interface II{k}\n  inherits IBase\nEnd Interface\nPublic Structure S\n Implements IEq{k}(Of S)\nEnd Structure"
_PY = "class P{k}(Q{k}):\n    pass"
_TYPES = [(0, "A{k}", "inherits", "Base{k}"), (0, "A{k}", "implements", "IThing"), (0, "B", "implements", "IDisposable"), (1, "C{k}", "inherits", "Base"), (1, "C{k}", "implements", "IA"), (1, "C{k}", "implements", "IB"), (1, "II{k}", "extends", "IBase"), (1, "S", "implements", "IEq{k}"), (2, "P{k}", "inherits", "Q{k}"), (3, "A{k}", "inherits", "Base"), (3, "A{k}", "implements", "IThing")]


@register("type_relations", "SELECT DISTINCT subject, predicate, object FROM (" + _expected(_TYPES, "subject, predicate, object", 5, "") + ")")
def type_relations(spark, sf):
    files = _parts(spark, sf, [_FS, _VB, _PY, _CS[0], "type X() =\n  inherit Y()"], path=_told(["{k}.fs", "{k}.vb", "{k}.py", "{k}.cs", "{k}.txt"], "p_partkey"))
    return relations.type_relations(files)


_ROUTED = [
    ("a/A{k}.csproj", "csproj", "project"), ("a/{k}.go", "go", "code"), ("a/{k}.md", "markdown", "prose"), ("k/{k}.yaml", "kubernetes", "kubernetes"), ("c/Chart.yaml", "helm", "helm_chart"), ("c/values-{k}.yml", "helm", "helm_values"), ("c/templates/{k}.yaml", "helm", "helm_template"),
    ("roles/r{k}/tasks/main.yml", "ansible", "ansible_task"), ("roles/r/handlers/{k}.yml", "ansible", "ansible_handler"), ("x/roles/r/vars/{k}.yml", "ansible", "ansible_vars"), ("inventory.ini", "ansible", "ansible_inventory"), ("site{k}.yml", "ansible", "ansible_play"), ("{k}.rb", "ruby", "lines"),
]


@register("file_routes", "SELECT p_partkey AS id, route FROM part JOIN " + _values([(n, x[2]) for n, x in enumerate(_ROUTED)], "n, route") + f" ON n = p_partkey % {len(_ROUTED)}")
def file_routes(spark, sf):
    return _parts(spark, sf, [x[0] for x in _ROUTED]).select("id", dispatch.route(F.col("text"), _told([x[1] for x in _ROUTED], "id")).alias("route"))


_BODY = "    x = 1\n" * 30
_KINDS = [
    ("a/{k}.py", "class A{k}:\n" + _BODY, "python", [("code", "A{k}", "class")]), ("a/{k}.csproj", "<Project>" + "x" * 120 + "</Project>", "xml", [("project", "", "")]), ("k/{k}.yaml", _POD, "kubernetes", [("kubernetes", "Pod/p{k}", "pod")]),
    ("roles/r{k}/vars/m.yml", "a: 1", "ansible", [("ansible_vars", "r{k}", "ansible_vars")]), ("roles/r{k}/tasks/m.yml", "- name: One\n- copy: x\n", "ansible", [("ansible_task", "One", "ansible_task"), ("ansible_task", "r{k}", "ansible_task")]),
    ("c/Chart.yaml", "name: chart{k}\n" + "d: e\n" * 40, "helm", [("helm_chart", "HelmChart/chart{k}", "helm_chart")]), ("{k}.rb", "puts 1\n" * 40, "ruby", [("lines", "", "")]), ("{k}.md", "# H\n" + "w " * 100, "markdown", [("prose", "", "")]), ("{k}.go", "", "go", []),
]


@register("files_chunked", _expected([(n, *r) for n, x in enumerate(_KINDS) for r in x[3]], "route, symbol_name, symbol_type", len(_KINDS), ""))
def files_chunked(spark, sf):
    files = _parts(spark, sf, [x[1] for x in _KINDS], lang=_told([x[2] for x in _KINDS], "p_partkey"), name=_told([x[0] for x in _KINDS], "p_partkey"))
    keyed = files.select(F.concat_ws("|", F.col("id").cast("string"), F.lit("")).alias("k"), "*").select(F.concat("k", F.lit("/"), "name").alias("path"), "text", "lang")
    out = dispatch.chunk_files(keyed, lang=F.col("lang"))
    return out.select(F.regexp_extract("path", r"^(\d+)", 1).cast("long").alias("id"), "route", "symbol_name", "symbol_type")


_TALKS = ["\n".join(["> one {k} is asked here and now", "yes", "", "no", "> two", "a longer reply to the second question", "> three three three three three three"]), "first paragraph that is long enough {k}\n\nshort\n\nsecond paragraph that is long enough", "\n".join(f"line {{k}} number {i}" for i in range(30))]


@register(
    "talk_chunks",
    _expected([(0, 0, "> one {k} is asked here and now\nyes no"), (0, 1, "> two\na longer reply to the second question"), (0, 2, "> three three three three three three"), (1, 0, "first paragraph that is long enough {k}"), (1, 1, "second paragraph that is long enough"), (2, 0, "\n".join(f"line {{k}} number {i}" for i in range(25))), (2, 1, "\n".join(f"line {{k}} number {i}" for i in range(25, 30)))], "_chunk_index, content", 3, ""),
)
def talk_chunks(spark, sf):
    return conversations.talk_chunks(_parts(spark, sf, _TALKS), "id").select("id", "chunk_index", "content")


@register("line_windows", r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), g AS (SELECT doc_id, (k - 1) // 3 AS chunk_index, regexp_replace(array_to_string(x[k:k + 3], chr(10)), '^\s+|\s+$', '', 'g') AS content FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1, 3)) AS k FROM l)) SELECT doc_id, chunk_index, content FROM g WHERE content <> ''")
def line_windows(spark, sf):
    return conversations.line_windows(table(spark, sf, "documents"), size=4, overlap=1).select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


_STAYS = [("kno", 1), ("word", 0), ("top-10", 1), ("CamelCase", 1), ("LOUD", 1), ("file.py", 1), ("alice", 1), ("Maybe", 0)]


@register("spelling", "SELECT p_partkey AS id, v = 1 AS stays, levenshtein(w, 'words') AS apart FROM part JOIN " + _values([(n, v, w) for n, (w, v) in enumerate(_STAYS)], "n, v, w") + f" ON n = p_partkey % {len(_STAYS)}")
def spelling(spark, sf):
    w = F.col("text")
    return _parts(spark, sf, [x for x, _ in _STAYS]).select("id", T.spelling_stays(w, ["alice"]).alias("stays"), F.levenshtein(w, F.lit("words")).cast("long").alias("apart"))


@register(
    "expected_files",
    f"WITH {CHUNKS} SELECT id, string_split(source_file, '/')[-1] = 'file_3.txt' OR ends_with(source_file, 'src1/file_7.txt') AS found, round(n_chars * (1 - 0.3 * (chunk_index / 10.0)), 6) AS fused FROM chunks",
)
def expected_files(spark, sf):
    c = chunks(spark, sf)
    found = T.file_matches(F.replace("source_file", F.lit("/"), F.lit("\\")), F.lit("file_3.txt")) | T.file_matches(F.col("source_file"), F.lit("src1/file_7.txt"))
    return c.select("id", found.alias("found"), F.round(T.fused_distance(F.col("n_chars").cast("double"), F.col("chunk_index") / 10.0), 6).alias("fused"))


@register(
    "recall_any_all",
    "WITH r AS (SELECT o_custkey AS query_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rank FROM orders), e AS (SELECT o_custkey AS query_id, o_orderkey AS item FROM orders WHERE o_orderstatus = 'F') "
    "SELECT query_id, max(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_any, min(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_all FROM e JOIN r USING (query_id, item) GROUP BY query_id",
)
def recall_any_all(spark, sf):
    from pyspark.sql import Window

    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("item"), "o_totalprice", "o_orderstatus")
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("o_totalprice", "item")))
    return metrics.recall_any_all(ranked, o.filter("o_orderstatus = 'F'"), 5)


@register("export_filtered", f"WITH {CHUNKS} SELECT id FROM chunks WHERE chunk_index % 3 <> 2 AND wing = 'src4' AND date >= '2024-01-10'")
def export_filtered(spark, sf):
    from tessellum.sources.jsonl import export_filter

    how = F.element_at(F.array(F.lit("manual_v1"), F.lit("diary_v1"), F.lit("prose_v1")), F.col("chunk_index") % 3 + 1)
    return export_filter(chunks(spark, sf).withColumn("chunker_strategy", how).withColumnRenamed("date", "filed_at"), True, "src4", None, "2024-01-10").select("id")
