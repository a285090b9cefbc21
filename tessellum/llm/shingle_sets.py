"""Near copies by verified similarity: all pairs of texts whose sets of word shingles have a Jaccard similarity of at
least a threshold are linked, and no others.

Two sets of such a similarity share one of the first n - ceil(threshold * n) + 1 shingles of each, in any order that all
sets keep; candidates are pairs that share one of these. The order puts shingles that a sample finds often last, so that
common passages make no candidates; it changes costs only. A search by fingerprints may come first (``search``): what it links
isn't looked for again. Pairs whose SimHash fingerprints are over ``distance`` bits apart are dropped (64 drops none), the others are compared by profiles (how many shingles of a set lie in each range of hashes: what two sets have in common is
at most the sum of the smaller numbers), and only those whose profiles allow the similarity are compared shingle by shingle.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessellum.llm.common import blocks, discard, materialise, mix64, utf8, word_hashes
from tessellum.llm.components import connected_components

#: Documents that the sample holds, about, the count in it that makes a shingle common, and common shingles at most.
SAMPLE_DOCS = 10_000
COMMON, MOST_COMMON = 3, 1 << 18
#: Shingles that a task holds before it sends a run.
RUN = 1 << 18
#: Ids that are broadcast to pick the texts to compare, at most; more are joined.
BROADCAST_IDS = 1 << 21
#: Sizes of sets are met in bands, each so many times as large as the one before.
BAND = 1.05
#: Hash ranges of a profile, as powers of two; about half as many as shingles.
LEAST_RANGES, MOST_RANGES = 4, 12
_LANES = np.uint64(0x0101010101010101)


def majority_bits(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """SimHash fingerprints of runs of ``sizes`` (none empty) hashes: the bits that more than half of a run have."""
    at = np.cumsum(sizes) - sizes
    # ones of each bit: byte lanes hold sums of up to 255 hashes
    chunks = -(-sizes // 255)
    chunk_row = np.repeat(np.arange(len(sizes)), chunks)
    begin = at[chunk_row] + 255 * (np.arange(int(chunks.sum())) - np.repeat(np.cumsum(chunks) - chunks, chunks))
    first_chunk = np.cumsum(chunks) - chunks
    result = np.zeros(len(sizes), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _LANES, begin)
        ones = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first_chunk, axis=0)
        majority = 2 * ones > sizes[:, None]
        for byte in range(8):
            result |= majority[:, byte].astype(np.uint64) << np.uint64(8 * byte + bit)
    return result


def shingle_sets(column: pa.Array, words_of_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, size of each row's set); distinct and ascending in a row. A text of fewer words is one shingle."""
    data, offs = utf8(column)
    word, _, _, doc = word_hashes(data, offs)
    n = len(offs) - 1
    counts = np.bincount(doc, minlength=n)
    shingles = np.where(counts > 0, np.maximum(counts - words_of_shingle + 1, 1), 0)
    at = np.cumsum(shingles) - shingles
    first = np.repeat(np.cumsum(counts) - counts, shingles) + np.arange(int(shingles.sum())) - np.repeat(at, shingles)
    width = np.repeat(np.minimum(counts, words_of_shingle), shingles)
    h = word[first]
    for k in range(1, words_of_shingle):
        live = np.flatnonzero(width > k)
        h[live] = mix64(h[live] * np.uint64(0x9E3779B97F4A7C15) + word[first[live] + k])
    owner = np.repeat(np.arange(n), shingles)
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=n)


def _common_shingles(docs: DataFrame, words_of_shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count in the sample) of common shingles, by hash."""
    total = docs.count()
    u = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)

    def count(batches):
        for b in blocks(batches, "t"):
            keys, n = np.unique(shingle_sets(b.column(0), words_of_shingle)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    counted = docs.filter(u < min(1.0, SAMPLE_DOCS / max(1, total))).select("t").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    got = counted.filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "h").limit(MOST_COMMON).toPandas()
    h, n = got.h.to_numpy(np.int64).view(np.uint64), got.n.to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def profiles(h: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """How many shingles of each set lie in each range of hashes, a byte a range; no bytes where a byte doesn't hold one."""
    ends = np.cumsum(sizes)
    out = []
    for end, size in zip(ends.tolist(), sizes.tolist(), strict=True):
        bits = min(MOST_RANGES, max(LEAST_RANGES, (size // 2).bit_length()))
        counts = np.bincount((h[end - size : end] >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        out.append(counts.astype(np.uint8).tobytes() if counts.max() < 256 else b"")
    return out


def most_in_common(p: np.ndarray, q: np.ndarray) -> int:
    """The sum of the smaller numbers of two profiles, in the ranges of the coarser."""
    ranges = min(len(p), len(q))
    p, q = (x if len(x) == ranges else x.reshape(ranges, -1).sum(axis=1, dtype=np.int64) for x in (p, q))
    return int(np.minimum(p, q).sum(dtype=np.int64))


def _described(docs: DataFrame, words_of_shingle: int) -> DataFrame:
    """``(id, s, fp, n, profile)``: digest, fingerprint, size and profile of each row's set."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for b in blocks(batches, "t"):
            h, sizes = shingle_sets(b.column(1), words_of_shingle)
            fp = np.zeros(len(sizes), np.uint64)
            fp[sizes > 0] = majority_bits(h, sizes[sizes > 0])
            marks = [pa.array(x.view(np.int64)) for x in (digests(h, sizes), fp)]
            yield pa.RecordBatch.from_arrays([b.column(0), *marks, pa.array(sizes.astype(np.int64)), pa.array(profiles(h, sizes), pa.binary())], names=["id", "s", "fp", "n", "profile"])

    return docs.select("id", "t").mapInArrow(run, f"id {kind}, s long, fp long, n long, profile binary")


def _shared_shingles(docs: DataFrame, words_of_shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``(key, s)``: the first shingles of sets that two sets and more have among theirs, with the sets' digests.

    Tasks send packed runs cut by hash range, and one task a range sorts them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(common)
    bits = min(16, max(4, int(np.ceil(np.log2(8 * max(1, docs.rdd.getNumPartitions()))))))
    shift = np.uint64(64 - bits)

    def pack(held):
        key, s = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        order = np.lexsort((s, key))
        key, s = key[order], s[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1])
        key, s = key[new], s[new]
        part = key >> shift
        at = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        ends = np.append(at[1:], len(key))
        packed = [pa.array([x[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()) for x in (key, s)]
        return pa.RecordBatch.from_arrays([pa.array(part[at].astype(np.int64)), *packed], names=["part", "keys", "sets"])

    def run(batches):
        known, often = shared.value
        held, size = [], 0
        for b in blocks(batches, "t"):
            h, sizes = shingle_sets(b.column(0), words_of_shingle)
            if not len(h):
                continue
            rank = np.zeros(len(h), np.int64)
            if len(known):
                k = np.minimum(np.searchsorted(known, h), len(known) - 1)
                rank = np.where(known[k] == h, often[k], 0)
            owner = np.repeat(np.arange(len(sizes)), sizes)
            order = np.lexsort((h, rank, owner))
            take = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
            mine = np.arange(len(h)) - (np.cumsum(sizes) - sizes)[owner] < take[owner]
            held.append((h[order][mine], digests(h, sizes)[owner[mine]]))
            size += len(held[-1][0])
            if size >= RUN:
                yield pack(held)
                held, size = [], 0
        if held:
            yield pack(held)

    def merge(group: pa.Table) -> pa.Table:
        key, s = (np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column(c)]) for c in ("keys", "sets"))
        order = np.lexsort((s, key))
        key, s = key[order], s[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (s[1:] != s[:-1])
        key, s = key[new], s[new]
        same = key[1:] == key[:-1]
        many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        return pa.table({"key": pa.array(key[many].view(np.int64)), "s": pa.array(s[many].view(np.int64))})

    return docs.select("t").mapInArrow(run, "part long, keys binary, sets binary").groupBy("part").applyInArrow(merge, "key long, s long")


def digests(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set; 0 for the empty one."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        out[some] = mix64(np.add.reduceat(mix64(h ^ np.uint64(0x5851F42D4C957F2D)), (np.cumsum(sizes) - sizes)[some]) + sizes[some].astype(np.uint64))
    return out


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, words_of_shingle: int, distance: int, similarity: float) -> DataFrame:
    """The pairs (u, v) of digests that pass the fingerprint's distance, the profiles and the exact similarity."""
    a, b = (nodes.select(F.col("s").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "fp", "rep")]) for x in ("u", "v"))
    sized = F.least("n_u", "n_v") >= F.greatest("n_u", "n_v") * similarity - 1e-9
    near = materialise(pairs.join(a, "u").join(b, "v").filter(sized & (F.bit_count(F.col("fp_u").bitwiseXOR(F.col("fp_v"))) <= distance)).select("u", "v", "rep_u", "rep_v", "n_u", "n_v"))

    def possible(batches):
        for x in batches:
            keep = []
            for p, q, n, m in zip(*(x.column(k) for k in ("p_u", "p_v")), *(x.column(k).to_pylist() for k in ("n_u", "n_v")), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint8), np.frombuffer(q.as_buffer(), np.uint8)
                keep.append(not len(p) or not len(q) or most_in_common(p, q) * (1 + similarity) >= similarity * (n + m) - 1e-6)
            yield x.select(["u", "v", "rep_u", "rep_v"]).filter(pa.array(keep, pa.bool_()))

    held = [nodes.select(F.col("s").alias(x), F.col("profile").alias(f"p_{x}")) for x in ("u", "v")]
    kind = nodes.schema["rep"].dataType.simpleString()
    sized_pairs = near
    near = materialise(near.join(held[0], "u").join(held[1], "v").mapInArrow(possible, f"u long, v long, rep_u {kind}, rep_v {kind}"))
    ids = wanted = materialise(near.select(F.col("rep_u").alias("id")).union(near.select("rep_v")).distinct())
    if ids.count() <= BROADCAST_IDS:
        wanted = F.broadcast(ids)

    def sets(batches):
        for x in blocks(batches, "t"):
            h, sizes = shingle_sets(x.column(0), words_of_shingle)
            ends = np.cumsum(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(digests(h, sizes).view(np.int64)), pa.array([h[e - k : e].tobytes() for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.binary())], names=["s", "h"])

    # an id may have rows of several texts: the digest tells which set is meant
    held = materialise(docs.join(wanted, "id", "left_semi").select("t").mapInArrow(sets, "s long, h binary").dropDuplicates(["s"]))

    def compare(batches):
        for x in batches:
            keep = []
            for p, q in zip(x.column(2), x.column(3), strict=True):
                p, q = np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= similarity * (len(p) + len(q) - both) - 1e-9)
            yield x.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    full = near.select("u", "v").join(held.select(F.col("s").alias("u"), F.col("h").alias("h_u")), "u").join(held.select(F.col("s").alias("v"), F.col("h").alias("h_v")), "v")
    links = materialise(full.select("u", "v", "h_u", "h_v").mapInArrow(compare, "u long, v long"))
    discard(sized_pairs, near, ids, held)
    return links


def _least_shared(n: Column, m: Column, similarity: float) -> Column:
    """What two similar sets of these sizes have in common among their first shingles, at least.

    They have ceil(s / (1 + s) * (n + m)) shingles in common; behind the first ones of the set whose first shingles end
    earlier in the common order stand ceil(s * size) - 1 at most, and what it shares before that lies in both prefixes.
    """
    return (n + m) * (similarity / (1 + similarity)) - F.greatest(n, m) * similarity - 1e-6


def _open_pairs(rows: DataFrame, joined: DataFrame, similarity: float) -> DataFrame:
    """``(u, v)`` of sets of different components that may be similar. ``rows``: (key, s, n, size) of shared first shingles.

    In a pair the set of the smaller component asks. Of what it shares with others, the shingles of its fullest buckets may
    be left out, as many as make one less than similar sets of these sizes share: so a set that has little in common with
    a crowd doesn't meet it at all. Sets of a bucket's largest component don't ask in it.
    """
    sizes = joined.groupBy("component").agg(F.count("*").alias("members"))
    of = joined.join(sizes, "component").select(F.col("node").alias("s"), F.col("component").alias("c"), "members")
    rank = Window.partitionBy("s").orderBy(F.desc("size"), "key")
    placed = rows.select("key", "s", "n", F.row_number().over(rank).alias("nth")).join(of, "s", "left")
    group = F.struct(F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("c", "s").alias("c"))
    placed = placed.select("key", "s", "n", "nth", group.alias("group"))
    placed = materialise(placed.withColumn("largest", F.max("group").over(Window.partitionBy("key"))).withColumn("others", F.min("group").over(Window.partitionBy("key")) < F.col("largest")).filter("others").drop("others"))
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(BAND)))
    reach = int(np.ceil(np.log(1 / similarity) / np.log(BAND))) + 1
    asks = placed.filter(F.col("group") < F.col("largest")).select("key", "s", "n", "nth", "group", F.explode(F.array(*[band(F.col("n")) + F.lit(k) for k in range(-reach, reach + 1)])).alias("band"))
    # the least that any size of the band asks for: it falls with the distance of the sizes
    low, high = (F.least(F.greatest(F.pow(F.lit(BAND), F.col("band") + k), F.col("n") * similarity), F.col("n") / similarity) for k in (-0.01, 1.01))
    asks = asks.filter(F.col("nth") >= F.least(_least_shared(F.col("n"), low, similarity), _least_shared(F.col("n"), high, similarity)))
    asks = asks.select("key", "band", *[F.col(x).alias(f"{x}1") for x in ("s", "n", "nth", "group")])
    told = placed.select("key", band(F.col("n")).alias("band"), *[F.col(x).alias(f"{x}2") for x in ("s", "n", "group")])
    sized = F.least("n1", "n2") >= F.greatest("n1", "n2") * similarity - 1e-9
    met = asks.join(told, ["key", "band"]).filter((F.col("group1") < F.col("group2")) & (F.col("group1.c") != F.col("group2.c")) & sized & (F.col("nth1") >= _least_shared(F.col("n1"), F.col("n2"), similarity)))
    return met.select(F.col("s1").alias("u"), F.col("s2").alias("v")).distinct()


def similar_components(docs: DataFrame, id_col: str, text_col: str, words_of_shingle: int, distance: int, similarity: float, search: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``(id, component_id)``, one row for each row with an id: the smallest id that verified links reach.

    ``search`` gives candidates (u, v), digests of sets, from the table of sets (s, fp, ...); they are verified like all others
    and their links come first. Of what they leave apart a round compares the texts of a shared shingle with the one that shares most; a second compares those that are
    still in different components and may be similar, so the components are those of all pairs. Null and empty texts are
    alike; equal sets count as one, however many rows have them.
    """
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    marked = materialise(_described(docs, words_of_shingle))
    nodes = materialise(marked.groupBy("s").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("profile").alias("profile")))
    rows = _shared_shingles(docs, words_of_shingle, similarity, _common_shingles(docs, words_of_shingle)).join(nodes.select("s", "n"), "s")
    bucket = Window.partitionBy("key")
    rows = rows.withColumn("share", F.count("*").over(Window.partitionBy("s")) / F.col("n"))
    rows = materialise(rows.withColumn("size", F.count("*").over(bucket)).withColumn("centre", F.max(F.struct("share", "s")).over(bucket)["s"]).drop("share"))
    first = rows.filter("s <> centre").select(F.col("centre").alias("u"), F.col("s").alias("v")).distinct()
    found = None
    if search:
        found = _verified(search(nodes), docs, nodes, words_of_shingle, distance, similarity)
        linked = connected_components(found)
        for x in ("u", "v"):
            first = first.join(linked.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}")), x, "left")
        first = first.filter(~F.coalesce(F.col("c_u") == F.col("c_v"), F.lit(False))).select("u", "v")
    links = _verified(first, docs, nodes, words_of_shingle, distance, similarity)
    links = found.union(links) if search else links
    more = _verified(_open_pairs(rows, connected_components(links), similarity), docs, nodes, words_of_shingle, distance, similarity)
    joined = connected_components(links.union(more))
    placed = nodes.join(joined, F.col("s") == F.col("node"), "left").select("s", "rep", F.coalesce("component", "s").alias("c"))
    least = placed.groupBy("c").agg(F.min("rep").alias("component_id"))
    return marked.select("id", "s").join(placed.join(least, "c").select("s", "component_id"), "s").select(F.col("id").alias(id_col), "component_id")
