"""Merkle dataset manifest (11): rows as leaves of a tree a group, groups as leaves of the tree above them.

Leaves are digests of a row's fields, made by built-in functions; the texts are read once and nothing of them is shuffled.
Rows are numbered within their group by a range partitioning, whose ties are split by row, and counts a partition. A block of
``width`` consecutive leaves is walked by one task in postorder: a call returns the digest of its subtree, and on the way back
each leaf in it gets the siblings that stand beside the subtree. Blocks are aligned to the tree, so that the digest of a block
is a node of it; these are the leaves of the next, distributed walk, until one a group is left. Paths are then put together
from the top down. A task holds a block; the driver gets counts a partition and the largest number of nodes, never digests.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessellum.llm.common import discard, fold, materialise, table

#: Children of a node, and levels of the tree that a task walks at once.
FANOUT, LEVELS = 2, 8
#: What stands beside a node on its level, before and after it: digests as hex text, one after another.
PATH = "array<struct<before: string, after: string>>"


def digest(fields: list[Column]) -> Column:
    """sha256 (lowercase hex) of the fields in order: ``-`` for null, else bytes in UTF-8, ``:`` and the value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings of its path give."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s["before"], node, s["after"]), 256))


def siblings(path: Column) -> Column:
    """All siblings of a path as one text, leaf to root, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _walk(leaves: list[str], lo: int, span: int, fanout: int, paths: list[list]) -> str:
    """Digest of the node over leaves lo to lo + span (as far as there are any); their siblings in it are appended."""
    if span == 1:
        return leaves[lo]
    part = span // fanout
    starts = range(lo, min(lo + span, len(leaves)), part)
    nodes = [_walk(leaves, k, part, fanout, paths) for k in starts]
    for i, start in enumerate(starts):
        step = {"before": "".join(nodes[:i]), "after": "".join(nodes[i + 1 :])}
        for k in range(start, min(start + part, len(leaves))):
            paths[k].append(step)
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def _span(n: int, fanout: int) -> int:
    """Leaves that a tree of n leaves has room for."""
    span = 1
    while span < n:
        span *= fanout
    return span


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``_at``, the place (from 0) in its group by ``order`` (nulls first), and ``_n``, the group's size.

    Range partitioning; equal rows are split by their place in the input, in the partition that read them.
    """
    salted = materialise(rows.withColumn("_salt", F.monotonically_increasing_id()))
    keys = [group, *order, "_salt"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = salted.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_salt").withColumn("_row", F.monotonically_increasing_id())
    ranged = materialise(ranged.withColumn("_part", F.shiftright("_row", 33)))
    counts = ranged.groupBy(group, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_rows"))
    of_group = Window.partitionBy(group)
    starts = counts.select(
        F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", F.sum("_rows").over(of_group).alias("_n"),
        (F.sum("_rows").over(of_group.orderBy("_part")) - F.col("_rows")).alias("_before"),
    )
    out = ranged.join(starts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    out = materialise(out.withColumn("_at", F.col("_row") - F.col("_first") + F.col("_before")).drop("_row", "_part", "_g", "_p", "_first", "_before"))
    discard(salted, ranged)
    return out


def _blocks(nodes: DataFrame, group: str, keep: list[str], fanout: int, width: int) -> DataFrame:
    """One distributed walk over ``nodes`` (group, _at, _n, _node): each with its path in its block and the block's node."""

    def walk(block: pa.Table) -> pa.Table:
        block = block.sort_by("_at")
        leaves, paths = block.column("_node").to_pylist(), [[] for _ in range(block.num_rows)]
        n = block.column("_n")[0].as_py()
        top = _walk(leaves, 0, min(width, _span(n, fanout)), fanout, paths)
        return block.append_column("_path", pa.array(paths, pa.list_(pa.struct([("before", pa.string()), ("after", pa.string())])))).append_column("_top", pa.array([top] * len(leaves), pa.string()))

    source = nodes.select(group, "_at", "_n", "_node", *keep).withColumn("_block", F.expr(f"_at div {width}"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.groupBy(group, "_block").applyInArrow(walk, f"{types}, _path {PATH}, _top string")


def _climb(nodes: DataFrame, group: str, keep: list[str], fanout: int, width: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(nodes with ``keep`` and their path to the group's root, the roots as (group, _top), tables to discard)."""
    walks = []
    while True:
        done = materialise(_blocks(nodes, group, keep if not walks else [], fanout, width))
        walks.append(done)
        most = done.agg(F.max("_n")).first()[0] or 0
        tops = done.where(F.col("_at") % width == 0).select(group, F.col("_block").alias("_at"), F.ceil(F.col("_n") / width).alias("_n"), F.col("_top").alias("_node"))
        if most <= width:
            break
        nodes = tops
    paths = walks[-1].drop("_top")
    for lower in reversed(walks[:-1]):
        above = paths.select(F.col(group).alias("_g"), F.col("_at").alias("_b"), F.col("_path").alias("_above"))
        joined = lower.drop("_top").join(above, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_block") == F.col("_b")))
        paths = joined.withColumn("_path", F.concat("_path", "_above")).drop("_g", "_b", "_above")
    return paths.select(group, *keep, F.col("_node"), "_path"), tops.select(group, F.col("_node").alias("_top")), walks


def manifest(rows: DataFrame, group: str, order: list[str], leaf: str = "leaf", keep: list[str] | None = None, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """Columns ``group``, ``leaf`` and ``keep`` of ``rows`` with ``path``, ``subroot`` (of the group) and ``root``.

    Leaves of a group ascend by ``order``, then by digest, so equal rows may stand for one another; null is a group of its
    own and comes first, as does a null in ``order``. While several nodes are left, each ``fanout`` consecutive ones become
    the digest of their texts; a lone leaf is a root itself, and groups are the leaves of the tree over them, by bytes of
    their names. ``path`` holds a step a level. No rows, no manifest: an empty result. ``folded(leaf, path)`` gives the root
    for what a manifest says to be there, and another for anything else.
    """
    width = fanout**levels
    given = {c: f"_c{i}" for i, c in enumerate([group, leaf, *(c for c in [*(keep or []), *order] if c not in (group, leaf))])}
    own = rows.select(*[F.col(f"`{c}`").alias(x) for c, x in given.items()])
    g, node = given[group], given[leaf]
    kept = [given[c] for c in (keep or []) if c not in (group, leaf)]
    numbered = _numbered(own, g, [given[c] for c in order if c != group] + [node])
    paths, subroots, low = _climb(numbered.withColumnRenamed(node, "_node"), g, kept, fanout, width)
    subroots = materialise(subroots)

    over = _numbered(subroots.select(F.lit(0).alias("_all"), g, F.col("_top").alias("_node")), "_all", [g])
    upper, roots, high = _climb(over, "_all", [g], fanout, width)
    tops = materialise(upper.join(F.broadcast(roots.select("_all", F.col("_top").alias("_root"))), "_all").select(F.col(g).alias("_g"), F.col("_node").alias("_subroot"), "_root", F.col("_path").alias("_above")))
    out = paths.join(F.broadcast(tops) if _few(tops) else tops, F.col(g).eqNullSafe(F.col("_g")))
    out = out.select(F.col(g).alias(group), F.col("_node").alias(leaf), *[F.col(given[c]).alias(c) for c in (keep or []) if c not in (group, leaf)], F.concat("_path", "_above").alias("path"), F.col("_subroot").alias("subroot"), F.col("_root").alias("root"))
    discard(numbered, subroots, over, *high)
    return out


def _few(groups: DataFrame) -> bool:
    """Whether the roots of all groups, of about 2 KB each, may be broadcast."""
    return groups.limit(4097).count() <= 4096


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; the tree a lang is over its documents
    by doc_id (ties by leaf, null first). Null ids count as not tampered with; a null lang is a group of its own and null
    fields are ``-``; repeated rows are leaves each; an empty table gives an empty result."""
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.coalesce(fold("doc_id", 7) == 0, F.lit(False))
    changed = digest([*fields[:3], fields[3] + F.when(tampered, 1).otherwise(0), fields[4]])
    leaves = docs.select("doc_id", "lang", digest(fields).alias("leaf"), F.when(tampered, changed).alias("_found"))
    proved = manifest(leaves, "lang", ["doc_id"], keep=["doc_id", "_found"])
    root = folded(F.coalesce("_found", "leaf"), F.col("path"))
    return proved.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), root.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


#: The same in DuckDB; the sums of crc32 are made of a table of its 256 remainders.
OP11_SQL = r"""
WITH RECURSIVE bits(b, v, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT b, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8
), crcs AS (SELECT list(v ORDER BY b) AS t FROM bits WHERE k = 8),
fields AS (
  SELECT doc_id, lang, n_chars, text, source,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
                         lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 7 = 0 AS bad
  FROM documents, crcs
), hashed AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS a,
         coalesce(strlen(text) || ':' || text, '-') AS z FROM fields
), leaves AS (
  SELECT doc_id, lang, sha256(a || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || z) AS leaf,
         sha256(a || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || z) AS changed, coalesce(bad, false) AS bad FROM hashed
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaves
), up(lang, k, i, d, n) AS (
  SELECT lang, 0, i, leaf, count(*) OVER (PARTITION BY lang) FROM placed
  UNION ALL
  SELECT lang, k + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM up WHERE n > 1 GROUP BY lang, k, i // 2, n
), subroots AS (
  SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM up WHERE n = 1
), top(k, i, d, n) AS (
  SELECT 0, g, subroot, count(*) OVER () FROM subroots
  UNION ALL
  SELECT k + 1, i // 2, sha256(string_agg(d, '' ORDER BY i)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY k, i // 2, n
), steps AS (
  SELECT p.lang, p.i, u.k, u.d, u.i > (p.i >> u.k) AS behind FROM placed p JOIN (SELECT DISTINCT lang, k FROM up WHERE n > 1) l ON p.lang IS NOT DISTINCT FROM l.lang
  LEFT JOIN up u ON u.lang IS NOT DISTINCT FROM l.lang AND u.k = l.k AND u.i = xor(p.i >> l.k, 1) WHERE u.k IS NOT NULL
  UNION ALL
  SELECT p.lang, p.i, l.k, NULL, NULL FROM placed p JOIN (SELECT lang, k, max(i) AS last FROM up WHERE n > 1 GROUP BY lang, k) l ON p.lang IS NOT DISTINCT FROM l.lang AND (p.i >> l.k) = l.last AND l.last % 2 = 0
  UNION ALL
  SELECT p.lang, p.i, 1000 + t.k, t.d, t.i > (s.g >> t.k) FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  JOIN top t ON t.i = xor(s.g >> t.k, 1) WHERE t.n > 1
  UNION ALL
  SELECT p.lang, p.i, 1000 + l.k, NULL, NULL FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang
  JOIN (SELECT k, max(i) AS last FROM top WHERE n > 1 GROUP BY k) l ON (s.g >> l.k) = l.last AND l.last % 2 = 0
), paths AS (
  SELECT lang, i, string_agg(coalesce(d, ''), '' ORDER BY k) AS proof, list({'d': d, 'behind': behind} ORDER BY k) AS path FROM steps GROUP BY lang, i
), proved AS (
  SELECT p.doc_id, p.leaf, s.subroot, (SELECT d FROM top WHERE n = 1) AS root, sha256(coalesce(t.proof, '')) AS proof_sha256,
         list_reduce(list_prepend({'d': CASE WHEN p.bad THEN p.changed ELSE p.leaf END, 'behind': NULL::BOOLEAN}, coalesce(t.path, [])),
           lambda a, b: {'d': sha256(CASE WHEN b.d IS NULL THEN a.d WHEN b.behind THEN a.d || b.d ELSE b.d || a.d END), 'behind': NULL::BOOLEAN}).d AS folded_root
  FROM placed p JOIN subroots s ON p.lang IS NOT DISTINCT FROM s.lang LEFT JOIN paths t ON t.lang IS NOT DISTINCT FROM p.lang AND t.i = p.i
)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM proved
"""
