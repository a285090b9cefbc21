"""Embedding near-dedup (1): hierarchical navigable small-world graphs, one a shard of a label's vectors.

Equal vectors of a label are one node with a multiplicity. A shard's graph is built once and written; each node asks every
shard of its label, in blocks. The beam of a query that ends in a link widens, and the beams of a block widen until a
recall audit passes: it counts the links of sampled nodes, found by brute force, and planted ones, copies of the shard's
vectors turned away to just over the threshold, so that it never passes for want of links. Past the widest beam the search
is exact. Links have been verified as cosine in double precision. A task folds its links into counts and a spanning forest
batch by batch, and the forests' union gives the components.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm.common import give_back, materialise, table
from tessellum.llm.components import connected_components, local_roots

MIN_COSINE = 0.93
#: Nodes of a shard, and of the block of queries that one task puts to it.
SHARD = 8192
QUERIES = 32768
NEIGHBOURS = 16
BUILD_BEAM = 64
BEAM = 48
#: What a beam grows by, and the widest one; beyond it the whole shard is compared.
WIDEN, WIDEST = 4, 1024
#: Sampled queries and planted links of an audit, and the share of links that the beams must find for them.
AUDIT = 128
AUDIT_RECALL = 0.999
#: Queries that search in step, and links that a task holds before they are folded.
BATCH = 256
HELD_LINKS = 1 << 20


class Graph:
    """Graph over the rows of unit vectors ``x``: row k joins the levels 0 .. level[k]; rows are added in batches that
    double, each searching what stands already."""

    def __init__(self, x: np.ndarray, seed: int = 7):
        self.x = x.astype(np.float32)
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(NEIGHBOURS)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # upper levels first: every entry point stands before it is used
        self.x, self.order = self.x[order], order
        self.tops = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]  # rows below are of the level
        self.links: list[np.ndarray] = []
        for k, size in enumerate(self.tops):
            self.links.append(np.full((size, NEIGHBOURS * (2 if k == 0 else 1)), -1, np.int32))
        for k in range(len(self.tops)):
            self._build(k)

    @classmethod
    def of(cls, x: np.ndarray, order: np.ndarray, tops: list[int], links: np.ndarray) -> Graph:
        """A graph that was built from ``x`` and written."""
        self = cls.__new__(cls)
        self.x, self.order, self.tops, self.links, at = x.astype(np.float32)[order], order, tops, [], 0
        for k, size in enumerate(tops):
            width = NEIGHBOURS * (2 if k == 0 else 1)
            self.links.append(links[at : at + size * width].reshape(size, width))
            at += size * width
        return self

    def _build(self, k: int) -> None:
        size, links = self.tops[k], self.links[k]
        done = min(size, BUILD_BEAM)
        sims = self.x[:done] @ self.x[:done].T
        np.fill_diagonal(sims, -2)
        near = np.argsort(-sims, axis=1, kind="stable")[:, : min(NEIGHBOURS, done - 1)]
        self._attach(k, np.arange(done), near, np.take_along_axis(sims, near, axis=1))
        while done < size:
            new = np.arange(done, min(size, 2 * done, done + 2048))
            found, sims = [], []
            for lo in range(0, len(new), BATCH):
                rows = new[lo : lo + BATCH]
                start = np.zeros((len(rows), 1), np.int64)
                f, s = self._beam(self.x[rows], links[:done], start, BUILD_BEAM)
                found.append(f)
                sims.append(s)
            found, sims = np.concatenate(found), np.concatenate(sims)
            # rows of one batch don't see each other in the graph: their own nearest come beside
            mutual = self.x[new] @ self.x[new].T
            np.fill_diagonal(mutual, -2)
            m = min(NEIGHBOURS, len(new) - 1)
            if m > 0:
                own = np.argpartition(-mutual, m - 1, axis=1)[:, :m]
                found = np.concatenate([found, new[own]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(mutual, own, axis=1)], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")
            self._attach(k, new, np.take_along_axis(found, best, axis=1), np.take_along_axis(sims, best, axis=1))
            done = int(new[-1]) + 1

    def _attach(self, k: int, rows: np.ndarray, near: np.ndarray, sims: np.ndarray) -> None:
        """Link rows to diverse near rows (one closer to a chosen neighbour than to the row is passed over), both ways."""
        links = self.links[k]
        chosen = self._diverse(rows, near, sims, NEIGHBOURS)
        links[rows, : chosen.shape[1]] = chosen
        row, other = np.repeat(rows, chosen.shape[1]), chosen.ravel()
        some = other >= 0
        row, other = row[some], other[some]
        new = ~(links[other] == row[:, None]).any(axis=1)
        row, other = row[new], other[new]
        if not len(row):
            return
        # the nearest new rows of each other one, beside those that it has
        s = np.einsum("nd,nd->n", self.x[row], self.x[other])
        order = np.lexsort((row, -s, other))
        row, other, s = row[order], other[order], s[order]
        target, first, count = np.unique(other, return_index=True, return_counts=True)
        most = links.shape[1]
        nth = np.arange(len(row)) - np.repeat(first, count)
        kept = nth < 2 * most
        wide = np.full((len(target), min(int(count.max()), 2 * most)), -1, np.int64)
        wide[np.repeat(np.arange(len(target)), count)[kept], nth[kept]] = row[kept]
        for lo in range(0, len(target), 1024):
            t = target[lo : lo + 1024]
            every = np.concatenate([links[t], wide[lo : lo + 1024]], axis=1)
            near_s = np.where(every >= 0, np.einsum("td,tmd->tm", self.x[t], self.x[np.maximum(every, 0)]), -3)
            rank = np.argsort(-near_s, axis=1, kind="stable")
            every, near_s = np.take_along_axis(every, rank, axis=1), np.take_along_axis(near_s, rank, axis=1)
            over = (every >= 0).sum(axis=1) > most
            full = np.full((len(t), most), -1, np.int32)
            if (~over).any():
                full[~over] = every[~over][:, :most]
            if over.any():
                got = self._diverse(t[over], every[over], near_s[over], most)
                full[over, : got.shape[1]] = got
            links[t] = full

    def _diverse(self, rows: np.ndarray, near: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of near rows, best first (-1: none), the diverse ones, filled up with the nearest, so that tight groups stay joined."""
        out = np.full((len(rows), most), -1, np.int64)
        for lo in range(0, len(rows), 1024):
            r = rows[lo : lo + 1024]
            ids, s = near[lo : lo + 1024], sims[lo : lo + 1024]
            ok = (ids >= 0) & (ids != r[:, None]) & (s > -2)
            front = np.argsort(~ok, axis=1, kind="stable")[:, : 2 * most]  # usable ones first, in their order
            ids, s, ok = (np.take_along_axis(x, front, axis=1) for x in (ids, s, ok))
            m = ids.shape[1]
            v = self.x[np.maximum(ids, 0)]
            between = np.einsum("rid,rjd->rij", v, v)
            keep = np.zeros(ids.shape, bool)
            for j in range(m):
                closer = (keep & (between[:, j, :] > s[:, j, None])).any(axis=1)
                keep[:, j] = ok[:, j] & ~closer & (keep.sum(axis=1) < most)
            place = np.where(keep, 0, np.where(ok, 1, 2)) * m + np.arange(m)
            order = np.argsort(place, axis=1, kind="stable")[:, :most]
            picked = np.where(np.take_along_axis(ok, order, axis=1), np.take_along_axis(ids, order, axis=1), -1)
            out[lo : lo + 1024, : picked.shape[1]] = picked
        return out

    def _beam(self, q: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step; ids (-1: none) and similarities, best first."""
        n, m = len(q), len(links)
        seen = np.zeros((n, m + 1), bool)
        seen[:, m] = True
        rows = np.arange(n)[:, None]
        start = start.copy()
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -2, np.float32)
        w = min(start.shape[1], beam)
        ids[:, :w] = start[:, :w]
        sims[:, :w] = np.einsum("nd,nwd->nw", q, self.x[start[:, :w]])
        seen[rows, start] = True
        open_ = ids >= 0
        active = np.arange(n)
        while len(active):
            s = np.where(open_[active], sims[active], -3)
            width = min(4, beam)
            pick = np.argpartition(-s, width - 1, axis=1)[:, :width]
            usable = np.take_along_axis(s, pick, axis=1) > -3
            some = usable.any(axis=1)
            active, pick, usable = active[some], pick[some], usable[some]
            if not len(active):
                break
            a = active[:, None]
            open_[a, pick] &= ~usable
            at = np.where(usable, ids[a, pick], 0)
            nxt = np.where(usable[:, :, None], links[at], -1).reshape(len(active), -1)
            nxt = np.where(nxt < 0, m, nxt)
            fresh = ~seen[a, nxt]
            # of repeats in one step the first counts
            order = np.argsort(nxt, axis=1, kind="stable")
            sorted_ = np.take_along_axis(nxt, order, axis=1)
            repeat = np.zeros_like(fresh)
            np.put_along_axis(repeat, order[:, 1:], sorted_[:, 1:] == sorted_[:, :-1], axis=1)
            fresh &= ~repeat
            seen[a, nxt] = True
            r, c = np.nonzero(fresh)
            new_s = np.full(nxt.shape, -2, np.float32)
            new_s[r, c] = np.einsum("nd,nd->n", q[active[r]], self.x[nxt[r, c]])
            all_ids = np.concatenate([ids[active], np.where(fresh, nxt, -1)], axis=1)
            all_s = np.concatenate([sims[active], new_s], axis=1)
            all_open = np.concatenate([open_[active], fresh], axis=1)
            best = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            ids[active], sims[active] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_s, best, axis=1)
            open_[active] = np.take_along_axis(all_open, best, axis=1) & (ids[active] >= 0)
        best = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, best, axis=1), np.take_along_axis(sims, best, axis=1)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the vectors that were given (-1: none) and similarities of the beam, best first."""
        start = np.zeros((len(q), 1), np.int64)
        for k in range(len(self.tops) - 1, 0, -1):
            ids, _ = self._beam(q, self.links[k], start, 4)
            start = np.where(ids[:, :1] >= 0, ids[:, :1], 0)
        ids, sims = self._beam(q, self.links[0], start, beam)
        return np.where(ids >= 0, self.order[ids], -1), sims


def _range_links(graph: Graph, x: np.ndarray, q: np.ndarray, beam: int, least: float):
    """Yield (query, row) of the links that beams find, by cosine in double; a beam that ends in a link widens."""
    margin = least - 1e-4  # single precision inside, double for the verdict
    for lo in range(0, len(q), BATCH):
        rows, width = np.arange(lo, min(len(q), lo + BATCH)), min(beam, len(x))
        while len(rows):
            if width >= len(x) or width > WIDEST:
                for k in range(0, len(rows), 64):  # the whole shard
                    i, j = np.nonzero(q[rows[k : k + 64]] @ x.T >= least)
                    yield rows[k : k + 64][i], j
                break
            ids, sims = graph.search(q[rows].astype(np.float32), width)
            full = sims[:, -1] >= margin
            i, c = np.nonzero((sims >= margin) & (ids >= 0) & ~full[:, None])
            j = ids[i, c]
            ok = np.einsum("nd,nd->n", q[rows[i]], x[j]) >= least
            yield rows[i][ok], j[ok]
            rows, width = rows[full], WIDEN * width


@dataclass
class Audit:
    """Beam that a block ended with, links that its audit knew (planted ones included) and share of them that it found."""

    beam: int = 0
    links: int = 0
    recall: float = 1.0
    planted: int = field(default=0)


def _turned(x: np.ndarray, cosine: float, rng: np.random.Generator) -> np.ndarray:
    """Unit vectors at this cosine from those of ``x``, each in a random direction; in one dimension the same."""
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    size = np.sqrt((side * side).sum(axis=1, keepdims=True))
    out = np.where(size > 1e-9, cosine * x + np.sqrt(1 - cosine**2) * side / np.maximum(size, 1e-9), x)
    return out / np.sqrt((out * out).sum(axis=1, keepdims=True))


def audited_beam(graph: Graph, x: np.ndarray, q: np.ndarray, same: np.ndarray, least: float, seed: int = 7) -> Audit:
    """The beam that finds the links of sampled and planted queries; ``same``: the row of ``x`` that a query is itself, or -1."""
    rng = np.random.default_rng(seed)
    picked = rng.permutation(len(q))[:AUDIT]
    held = rng.permutation(len(x))[:AUDIT]
    cosine = min(1.0, least + 0.1 * (1 - least))
    asked = np.concatenate([q[picked], _turned(x[held], cosine, rng)])
    skip = np.concatenate([same[picked], np.full(len(held), -1)])
    known = set()
    for k in range(0, len(asked), 64):
        i, j = np.nonzero(asked[k : k + 64] @ x.T >= least)
        known |= {(int(a) + k, int(b)) for a, b in zip(i, j, strict=True) if skip[a + k] != b}
    beam = BEAM
    while True:
        found = sum((int(a), int(b)) in known for i, j in _range_links(graph, x, asked, beam, least) for a, b in zip(i, j, strict=True))
        recall = found / len(known) if known else 1.0
        if recall >= AUDIT_RECALL or beam >= len(x) or beam > WIDEST:
            return Audit(beam, len(known), recall, len(held))
        beam *= WIDEN


class Links:
    """Links folded batch by batch: the number of each query, and a spanning forest of all."""

    def __init__(self, queries: np.ndarray, rows: np.ndarray, copies: np.ndarray):
        self.queries, self.rows, self.copies = queries, rows, copies
        self.found = np.zeros(len(queries), np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        u, v = self.queries[i], self.rows[j]
        other = u != v
        self.found += np.bincount(i[other], weights=self.copies[j[other]], minlength=len(self.queries)).astype(np.int64)
        self.held.append((u[other], v[other]))
        self.size += int(other.sum())
        if self.size >= HELD_LINKS:
            self.fold()

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        u, v = (np.concatenate([h[k] for h in self.held] or [np.zeros(0, np.int64)]) for k in (0, 1))
        node, root = local_roots(u, v)
        some = node != root
        self.held, self.size = [(node[some], root[some])], 0
        return self.held[0]


def unit_rows(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that squares of large numbers don't overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


_GRAPH = "node binary, copies binary, v binary, ranked binary, tops binary, links binary"


def _built(node: np.ndarray, copies: np.ndarray, x: np.ndarray) -> dict[str, bytes]:
    graph = Graph(x)
    links = np.concatenate([level.ravel() for level in graph.links])
    parts = {"node": node, "copies": copies, "v": x, "ranked": graph.order.astype(np.int64), "tops": np.array(graph.tops, np.int64), "links": links.astype(np.int32)}
    return {k: v.tobytes() for k, v in parts.items()}


def _read(row: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Graph]:
    node, copies, order, tops = (np.frombuffer(row[k], np.int64) for k in ("node", "copies", "ranked", "tops"))
    x = np.frombuffer(row["v"], np.float64).reshape(len(node), -1)
    return node, copies, x, Graph.of(x, order, tops.tolist(), np.frombuffer(row["links"], np.int32))


def embedding_links(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", group_col: str = "label", least: float = MIN_COSINE, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """``(id, n_links, component_id, kept, audit_recall)``, one row for each row of ``vectors``.

    Linked are rows of equal, non-null group and equal vector length whose cosine is at least ``least``. Vectors that
    are null, empty, zero or hold null or non-finite components link with nothing; rows without an id are left out
    of the links and have a null component. Repeated ids count as rows. ``audit_recall`` is the least share of known links
    that any block's audit found with the beam it used.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(group_col).alias("g"))
    sound = F.col("id").isNotNull() & F.col("g").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    sound &= F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    rows = rows.withColumn("ok", F.coalesce(sound, F.lit(False)))
    # equal vectors have equal keys of 128 bits; -0.0 counts as 0.0
    usable = rows.filter("ok").withColumn("v", F.transform("v", lambda c: c + F.lit(0.0))).withColumns({"dim": F.size("v"), "k1": F.xxhash64("g", "v"), "k2": F.xxhash64(F.lit(1), F.reverse("v"), "g")})
    key = ["g", "dim", "k1", "k2"]
    nodes = materialise(usable.groupBy(*key).agg(F.min("id").alias("node"), F.count("*").alias("copies"), F.first("v").alias("v")))
    per_group = nodes.groupBy("g", "dim").agg(F.count("*").alias("size")).withColumns({"shards": F.ceil(F.col("size") / shard), "blocks": F.ceil(F.col("size") / queries)})
    placed = nodes.join(per_group, ["g", "dim"])

    def build(group: pa.Table) -> pa.Table:
        node = group.column("node").to_numpy()
        order = np.argsort(node, kind="stable")  # an order of its own, so that a task that runs again gives the same rows
        made = _built(node[order], group.column("copies").to_numpy()[order], unit_rows(group.column("v"))[order])
        out = group.select(["g", "dim", "shard"]).slice(0, 1)
        for k, v in made.items():
            out = out.append_column(k, pa.array([v], pa.binary()))
        give_back()
        return out

    kind = vectors.schema[group_col].dataType.simpleString()
    sharded = placed.select("g", "dim", F.pmod(F.xxhash64("node", F.lit(1)), F.col("shards")).alias("shard"), "node", "copies", "v").repartition("g", "dim", "shard")
    graphs = materialise(sharded.groupBy("g", "dim", "shard").applyInArrow(build, f"g {kind}, dim int, shard long, {_GRAPH}"))
    counts = per_group.select("g", "dim", "shards", "blocks")
    graphs = graphs.join(counts, ["g", "dim"]).select("g", "dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), *[x.split()[0] for x in _GRAPH.split(", ")])
    asked = placed.select("g", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"), F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")).alias("block"), "node", "v")

    def link(left: pa.Table, right: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        out = {"node": none, "root": none, "found": none, "recall": np.zeros(0)}
        if left.num_rows and right.num_rows:
            row = {k: left.column(k)[0].as_py() for k in left.schema.names if k in _GRAPH.replace(" binary", "").split(", ")}
            stands, copies, x, graph = _read(row)
            node = right.column("node").to_numpy()
            order = np.argsort(node, kind="stable")
            node, q = node[order], unit_rows(right.column("v"))[order]
            at = np.minimum(np.searchsorted(stands, node), len(stands) - 1)
            audit = audited_beam(graph, x, q, np.where(stands[at] == node, at, -1), least)
            links = Links(node, stands, copies)
            for i, j in _range_links(graph, x, q, audit.beam, least):
                links.add(i, j)
            members, roots = links.fold()
            has = links.found > 0
            first = np.concatenate([node[has], members, node[:1]])
            out = {
                "node": first,
                "root": np.concatenate([node[has], roots, node[:1]]),
                "found": np.concatenate([links.found[has], np.zeros(len(members) + 1, np.int64)]),
                "recall": np.concatenate([np.full(len(first) - 1, np.nan), [audit.recall]]),
            }
            give_back()
        return pa.table({k: pa.array(v, from_pandas=k == "recall") for k, v in out.items()})

    # dealt by all four keys: a group's rows lie together by label already, and would all stay in the label's task
    four = ["g", "dim", "shard", "block"]
    both = graphs.repartition(*four).groupBy(*four).cogroup(asked.repartition(*four).groupBy(*four))
    links = materialise(both.applyInArrow(link, "node long, root long, found long, recall double"))
    recall = links.agg(F.min("recall")).first()[0]
    found = links.groupBy("node").agg(F.sum("found").alias("found"))
    joined = connected_components(links.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "member")
    settled = nodes.select(*key, "node", "copies").join(found, "node", "left").join(joined, F.col("node") == F.col("member"), "left")
    settled = settled.select(*key, (F.coalesce("found", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = usable.select("id", *key).join(settled, key).select("id", "n_links", "component_id")
    alone = rows.filter("NOT ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    return out.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", kept, F.lit(recall).cast("double").alias("audit_recall"))


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: vec_id, n_links, component_id, kept."""
    return embedding_links(table(spark, sf_dir, "embeddings"))
