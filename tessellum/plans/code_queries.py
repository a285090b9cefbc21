"""Code, names and scalar functions over values of the driver's tables, with what they must give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessellum.functions import text as T
from tessellum.operators import code
from tessellum.plans.registry import register
from tessellum.plans.views import table


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_quoted(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows) + f") v({names})"


def _told(rows: list[str], key: str) -> Column:
    """The row's text by its key, with the key in place of ``{k}``."""
    return F.replace(F.element_at(F.array(*map(F.lit, rows)), (F.col(key) % len(rows)).cast("int") + 1), F.lit("{k}"), F.col(key).cast("string"))


# Files of several languages, as the blocks that they must be cut into.
_FILES = [
    ("python", ["'''about {k}'''", "# one\n# two\ndef f{k}(x):\n    return x\n\n    y = 2", "@cached", "class C{k}(Base):\n    z = 1", "async def g():\n    pass"]),
    ("typescript", ["import a from 'a'\nimport b from 'b'", "// says\nexport function f{k}() {\n  const x = 1\n}", "const y{k} = 2", "describe('x', () => {\n})"]),
    ("rust", ["//! crate {k}\n\nuse std::io;", "#[derive(Debug)]\npub struct S{k};", "impl S{k} {", "/// does\n    pub async fn go(&self) {}\n}"]),
    ("csharp", ["using System;\nnamespace N{k} {", "[Serializable]\n  public class A{k} {", "public int Size => {k};", "public void Run() { }\n}"]),
    ("kotlin", ["package p{k}", "// data\ndata class D{k}(val x: Int)", "fun String.up{k}() = 1"]),
    ("lua", ["local x = {k}", "-- adds\nlocal function add(a)\nend", "M{k} = {}"]),
    ("sql", []),
]


@register(
    "code_blocks",
    "SELECT p_partkey AS id, lang, replace(block, '{k}', CAST(p_partkey AS VARCHAR)) AS block FROM part JOIN " + _values([(n, lang, b) for n, (lang, blocks) in enumerate(_FILES) for b in blocks], "n, lang, block") + f" ON n = p_partkey % {len(_FILES)}",
)
def code_blocks(spark, sf):
    lang = F.element_at(F.array(*[F.lit(x) for x, _ in _FILES]), (F.col("p_partkey") % len(_FILES)).cast("int") + 1)
    # blocks that start inside another's braces follow it without a blank line
    files = table(spark, sf, "part").select(F.col("p_partkey").alias(f"{code.OWN}row"), lang.alias("lang"), _told(["\n\n".join(b) if lang != "csharp" else "\n  ".join(b) for lang, b in _FILES], "p_partkey").alias("text"))
    blocks = code.code_blocks(files, F.col("lang")).join(files.select(f"{code.OWN}row", "lang"), f"{code.OWN}row")
    return blocks.select(F.col(f"{code.OWN}row").alias("id"), "lang", "block")


# A chunk of each language, and the symbol that it must be named after.
_SYMBOLS = [
    ("python", "class A{k}:\n    def m(self): pass", "A{k}", "class"), ("python", "async def f{k}(): pass", "f{k}", "function"), ("typescript", "export default class Q{k} {}", "Q{k}", "class"), ("tsx", "import x from 'y'", "", "import"),
    ("javascript", "import x from 'y'\nexport const z{k} = 1", "z{k}", "const"), ("go", "func (r *T) Do{k}() {}", "Do{k}", "method"), ("go", "type P{k} interface {}", "P{k}", "interface"), ("rust", "pub(crate) trait R{k} {}", "R{k}", "trait"),
    ("java", "public final class K{k} {}", "K{k}", "class"), ("java", "public @interface N{k} {}", "N{k}", "annotation"), ("kotlin", "data class D{k}(val x: Int)", "D{k}", "data_class"), ("kotlin", "fun <T> List<T>.s{k}() = this", "s{k}", "function"),
    ("csharp", "  public record struct V{k}(int X);", "V{k}", "record"), ("csharp", "    public int S{k} { get; }", "S{k}", "property"), ("fsharp", "type U{k} =\n  | A", "U{k}", "union"), ("vbnet", "private shared sub Run{k}()", "Run{k}", "method"),
    ("swift", "@MainActor final class V{k} {", "V{k}", "class"), ("swift", "class func make{k}() {}", "make{k}", "function"), ("xaml", '<Window x:Class="App.Views.M{k}">', "M{k}", "view"), ("php", "final class H{k} {}", "H{k}", "class"),
    ("scala", "sealed case class C{k}(x: Int)", "C{k}", "case_class"), ("dart", "extension type I{k}(int i) {}", "I{k}", "extension_type"), ("lua", "function M.r{k}(x)", "M.r{k}", "method"), ("ruby", "  def ok{k}?; end", "ok{k}?", "method"),
    ("c", "int *f{k}(int x) {", "f{k}", "function"), ("cpp", "enum class E{k} { A };", "E{k}", "enum"), ("markdown", "class X", "", ""),
]


@register(
    "code_symbols",
    "SELECT p_partkey AS id, replace(name, '{k}', CAST(p_partkey AS VARCHAR)) AS symbol_name, kind AS symbol_type FROM part JOIN " + _values([(n, x[2], x[3]) for n, x in enumerate(_SYMBOLS)], "n, name, kind") + f" ON n = p_partkey % {len(_SYMBOLS)}",
)
def code_symbols(spark, sf):
    lang = F.element_at(F.array(*[F.lit(x[0]) for x in _SYMBOLS]), (F.col("p_partkey") % len(_SYMBOLS)).cast("int") + 1)
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.symbol(_told([x[1] for x in _SYMBOLS], "p_partkey"), lang).alias("s"))
    return rows.select("id", "s.*")


_PATHS = [
    ("a/{k}.py", "", "python"), ("a/{k}.TSX", "", "tsx"), ("b/{k}.fsi", "", "fsharp"), ("{k}.sc", "", "scala"), ("x/{k}.tfvars", "", "terraform"), ("run{k}", "#!/usr/bin/env python3\nx", "python"), ("run{k}", "#!/bin/bash\n", "shell"),
    ("d/{k}.yaml", "apiVersion: v1\nkind: Pod\n", "kubernetes"), ("d/{k}.yml", "a: 1\n", "yaml"), ("{k}.zzz", "x", "unknown"), ("noending{k}", "", "unknown"),
]


@register("code_languages", "SELECT p_partkey AS id, lang FROM part JOIN " + _values([(n, x[2]) for n, x in enumerate(_PATHS)], "n, lang") + f" ON n = p_partkey % {len(_PATHS)}")
def code_languages(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), code.language(_told([x[0] for x in _PATHS], "p_partkey"), _told([x[1] for x in _PATHS], "p_partkey")).alias("lang"))


@register(
    "python_relations",
    "SELECT 'A' || p_partkey AS subject, 'inherits' AS predicate, 'B' || p_size AS object FROM part UNION SELECT 'A' || p_partkey, 'implements', 'ABC' FROM part UNION SELECT 'm' || p_partkey, 'depends_on', 'os' FROM part UNION SELECT 'm' || p_partkey, 'depends_on', 'x' || p_size || '.y' FROM part",
)
def python_relations(spark, sf):
    text = F.format_string("import os as o  # import sys\nfrom x%s.y import z\nclass A%s(B%s, ABC, metaclass=M):\n    pass", F.col("p_size").cast("string"), F.col("p_partkey").cast("string"), F.col("p_size").cast("string"))
    return code.python_relations(table(spark, sf, "part").select(F.format_string("pkg/m%s.py", F.col("p_partkey").cast("string")).alias("path"), text.alias("text")))


# ---- scalar functions


@register(
    "names_normalised",
    "SELECT c_custkey AS id, coalesce(nullif(regexp_replace(translate(lower(n), ' -', '__'), '[^a-z0-9_]', '', 'g'), ''), 'project') AS wing, coalesce(nullif(regexp_replace(translate(lower(n), '.- ', '___'), '[^a-z0-9_]', '', 'g'), ''), 'general') AS room, replace(replace(lower(n), ' ', '_'), '''', '') AS entity "
    "FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '#!' WHEN 1 THEN c_name || ' My-App v1.2' WHEN 2 THEN c_mktsegment || '''s É' ELSE c_mktsegment || '.x' END AS n FROM customer)",
)
def names_normalised(spark, sf):
    n = F.expr("CASE c_custkey % 4 WHEN 0 THEN '#!' WHEN 1 THEN concat(c_name, ' My-App v1.2') WHEN 2 THEN concat(c_mktsegment, '\\'s É') ELSE concat(c_mktsegment, '.x') END")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), T.wing_name(n).alias("wing"), T.room_name(n).alias("room"), T.entity_id(n).alias("entity"))


@register(
    "byte_sizes",
    "SELECT id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1024 ** 2 THEN printf('%.1f KiB', n / 1024.0) WHEN n < 1024 ** 3 THEN printf('%.1f MiB', n / 1024.0 ** 2) ELSE printf('%.1f GiB', n / 1024.0 ** 3) END AS shown, n * 3 * 1000 AS parsed FROM (SELECT p_partkey AS id, CAST(p_size AS BIGINT) * p_size * p_partkey * 64 AS n FROM part)",
)
def byte_sizes(spark, sf):
    n = F.expr("cast(p_size AS bigint) * p_size * p_partkey * 64")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.format_bytes(n).alias("shown"), T.parse_bytes(F.concat((n * 3).cast("string"), F.lit(" KB"))).alias("parsed"))


_MOODS = ["I am so proud and happy that it works", "The bug is a crash, broken and stuck", "A success and a failure", "nothing here", "Love, love, love and one error"]


@register("moods", "SELECT event_id, mood FROM events JOIN " + _values([(0, "positive"), (1, "negative"), (2, "neutral"), (3, "neutral"), (4, "neutral")], "n, mood") + " ON n = event_id % 5")
def moods(spark, sf):
    return table(spark, sf, "events").select("event_id", T.sentiment(_told(_MOODS, "event_id")).alias("mood"))


@register(
    "query_keywords",
    "WITH w AS (SELECT item_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w, generate_subscripts(regexp_split_to_array(lower(text), '\\s+'), 1) AS i FROM benchmark), r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS k FROM w WHERE length(w) >= 3 AND w NOT IN ('the', 'and')) "
    "SELECT item_id, coalesce((SELECT string_agg(w, ',' ORDER BY k) FROM r WHERE r.item_id = b.item_id AND k <= 3), '') AS words FROM benchmark b",
)
def query_keywords(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", F.array_join(T.keywords(F.col("text"), ["the", "and"]), ",").alias("words"))


@register(
    "session_times",
    "SELECT event_id, strftime(ts, '%Y-%m-%d_') || replace(strftime(ts, '%-I:%M%p'), ':', '') AS session FROM events",
)
def session_times(spark, sf):
    header = F.concat(F.lit("x\n⏺ "), F.date_format("ts", "h:mm a EEEE, MMMM dd, yyyy"))
    return table(spark, sf, "events").select("event_id", T.session_time(header).alias("session"))


@register(
    "phrase_shares",
    "SELECT c_custkey AS id, round((CAST(contains(lower(c_name), '0001') AS INT) + CAST(contains(lower(c_name), 'customer') AS INT)) / 2.0, 6) AS share, c_custkey % 3 = 0 AND contains(c_name, '00') AS sequence, 2 AS times FROM customer",
)
def phrase_shares(spark, sf):
    phrases = T.quoted_phrases(F.lit('find "CUSTOMER" and "0001" now'))
    words = T.words_of(F.concat(F.lit("Go to "), F.when((F.col("c_custkey") % 3 == 0) & F.contains("c_name", F.lit("00")), F.lit("The Red-House")).otherwise(F.lit("the house red")), F.lit(", go to")))
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.round(T.phrase_share(phrases, F.col("c_name")), 6).alias("share"), T.has_sequence(T.words_of(F.lit("red house")), words).alias("sequence"), T.count_sequence(words, ["go", "to"]).alias("times"))


@register("drift", "SELECT s_suppkey AS id, CASE WHEN b <> 0 THEN round(abs(s_acctbal - b) / b * 100, 6) END AS percent, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 ELSE round(CAST(s_suppkey % 2 AS DOUBLE) / 2 + 0.5, 6) END AS recall FROM (SELECT *, CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_nationkey + 1 END AS b FROM supplier)")
def drift(spark, sf):
    base = F.expr("CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE s_nationkey + 1 END")
    wanted = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.concat(F.lit("b"), (F.col("s_suppkey") % 2).cast("string"))))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.round(T.drift_percent(F.col("s_acctbal"), base), 6).alias("percent"), F.round(T.evidence_recall(F.array(F.lit("a"), F.lit("b1")), wanted), 6).alias("recall"))
