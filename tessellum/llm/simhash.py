"""SimHash near-dedup (4): 64-bit fingerprints, linked by the generalised pigeonhole principle.

If two fingerprints differ in at most t bits and the bits are split into m parts with thresholds that sum to t - m + 1,
they differ in at most the threshold's bits in some part (a threshold of -1 leaves a part out). Correlated bits share a
part, so that what a skewed part loses the others keep, and thresholds are dealt by dynamic programming on the number of
candidates that each part would give.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellum.llm.common import OWN, blocks, materialise, table
from tessellum.llm.components import connected_components
from tessellum.llm.shingle_sets import majority_bits, similar_components

SHINGLE = 3
SEED = 42
DISTANCE = 2
#: Fingerprints of one bucket that are compared pair by pair; fuller buckets are linked through midpoints, in proportion to their size.
HOT_BUCKET = 256
#: The pipeline's stage: words of a shingle, least similarity of shingle sets, and bits that fingerprints of the search's
#: candidates may differ in.
STAGE_SHINGLE, STAGE_SIMILARITY, STAGE_DISTANCE = 5, 0.8, 3
#: Distance that drops no pair of 64-bit fingerprints.
ANY_DISTANCE = 64


def fingerprints(texts: list[bytes | None], words_of_shingle: int = SHINGLE) -> np.ndarray:
    """The uint64 fingerprint of each UTF-8 text; 0 without words."""
    words = [(t or b"").lower().split() for t in texts]  # bytes.lower and bytes.split are those of the contract: ASCII only
    out = np.zeros(len(texts), np.uint64)
    rows = [i for i, w in enumerate(words) if w]
    if not rows:
        return out
    joined = b" ".join(b" ".join(words[i]) for i in rows)
    counts = np.fromiter((len(words[i]) for i in rows), np.int64, len(rows))
    del words
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(joined))
    shingles = np.maximum(counts - words_of_shingle + 1, 1)
    width = np.minimum(counts, words_of_shingle)
    at = np.cumsum(shingles) - shingles  # first shingle of each row
    first = np.repeat(np.cumsum(counts) - counts, shingles) + np.arange(int(shingles.sum())) - np.repeat(at, shingles)
    s, e = starts[first], ends[first + np.repeat(width, shingles) - 1]
    digest = xxhash.xxh64_intdigest
    h = np.empty(len(s), np.uint64)
    for lo in range(0, len(s), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        h[part] = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(s[part].tolist(), e[part].tolist(), strict=True)), np.uint64, len(s[part]))
    out[rows] = majority_bits(h, shingles)
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of_shingle: int = SHINGLE) -> DataFrame:
    """``(id, fp)``, fp a long with the fingerprint's bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in blocks(batches, "t"):
            fp = fingerprints(b.column("t").cast(pa.binary()).to_pylist(), words_of_shingle)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


# ---- plan of the search


def _correlation(fps: DataFrame) -> np.ndarray:
    """Absolute correlations of the 64 bits over all fingerprints."""

    def run(batches):
        sums, n = np.zeros((64, 64)), 0
        for b in batches:
            x = np.unpackbits(b.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            sums += x.T @ x
            n += len(x)
        i, j = np.divmod(np.arange(64 * 64 + 1), 64)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.append(sums.ravel(), n).astype(np.int64))], names=["i", "j", "n"])

    got = fps.select("fp").mapInArrow(run, "i long, j long, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    total = float(got.n[got.i == 64].sum())
    both = np.zeros((64, 64))
    cells = got[got.i < 64]
    both[cells.i, cells.j] = cells.n
    if not total:
        return np.zeros((64, 64))
    p = np.diag(both) / total
    sd = np.sqrt(p * (1 - p))
    with np.errstate(divide="ignore", invalid="ignore"):
        c = np.abs((both / total - np.outer(p, p)) / np.outer(sd, sd))
    c = np.nan_to_num(c, nan=0.0, posinf=0.0)
    c[sd == 0] = c[:, sd == 0] = 1.0  # constant bits tell nothing: together
    np.fill_diagonal(c, 0)
    return c


def group_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Parts of near-equal size; each starts at the most correlated free bit and takes the bits most correlated with it."""
    free, out = set(range(64)), []
    for k in range(parts):
        size = len(free) // (parts - k)
        rest = sorted(free)
        own = [max(rest, key=lambda i: (corr[i, rest].sum(), -i))]
        free.discard(own[0])
        while len(own) < size:
            best = max(sorted(free), key=lambda i: (corr[i, own].sum(), -i))
            own.append(best)
            free.discard(best)
        out.append(sorted(own))
    return out


def deal_thresholds(costs: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds, one a part, that sum to ``total`` at the least cost (dynamic programming over parts and sums)."""
    best = {0: (0.0, [])}
    for cost in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for so_far, (c, chosen) in best.items():
            for t, more in cost.items():
                if so_far + t not in after or c + more < after[so_far + t][0]:
                    after[so_far + t] = (c + more, [*chosen, t])
        best = after
    return best.get(total, (float("inf"), []))


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _key(bits: list[int]) -> Column:
    return F.col("fp").bitwiseAND(F.lit(_mask(bits)).cast("long"))


def plan_search(fps: DataFrame, distance: int = DISTANCE, part_counts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part that is searched: the cheapest of the splits into these numbers of parts."""
    corr = _correlation(fps)
    splits = {m: group_bits(corr, m) for m in part_counts}
    flat = [(m, k, bits) for m, parts in splits.items() for k, bits in enumerate(parts)]
    keys = fps.select(F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _key(bits).alias("key")) for i, (_, _, bits) in enumerate(flat)])).alias("x")).select("x.*")
    sizes = keys.groupBy("part", "key").count().groupBy("part").agg(F.sum("count").alias("n"), F.sum(F.expr("double(count) * (count - 1) / 2")).alias("pairs")).collect()
    pairs, n = {r["part"]: r["pairs"] for r in sizes}, max([r["n"] for r in sizes], default=0)
    found = []
    for m, parts in splits.items():
        costs = []
        for k, bits in enumerate(parts):
            exact = pairs.get(next(i for i, x in enumerate(flat) if x[:2] == (m, k)), 0.0)
            # pairs a bit apart: each bit of the part may differ, as often as by chance
            costs.append({-1: 0.0, 0: n + exact, 1: n * (1 + len(bits)) + exact + max(exact, n * n / 2.0 ** (len(bits) + 1)) * len(bits)})
        cost, chosen = deal_thresholds(costs, distance - m + 1)
        if chosen:
            found.append((cost, [(bits, t) for bits, t in zip(parts, chosen, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def link_fingerprints(fps: DataFrame, plan: list[tuple[list[int], int]], hot_bucket: int = HOT_BUCKET, distance: int = DISTANCE) -> DataFrame:
    """Edges (u, v) between the ``rep`` of fingerprints (distinct ``fp``) that differ in at most ``distance`` bits, for which
    the plan was made; in full buckets in at most two.

    Fingerprints at a distance of at most two share a neighbour a bit away; the edges of full buckets join all
    fingerprints around such a midpoint to the smallest, so they hold the same components as all pairs, and each joins
    two at a distance of at most two.
    """
    index = F.array(*[F.struct(F.lit(i).alias("part"), _key(bits).alias("key")) for i, (bits, _) in enumerate(plan)])
    indexed = fps.select("fp", "rep", F.explode(index).alias("x")).select("fp", "rep", "x.part", "x.key")
    probes = indexed
    near = [(i, bits) for i, (bits, t) in enumerate(plan) if t == 1]
    for i, bits in near:
        flips = F.array(*[F.lit(_mask([b])).cast("long") for b in bits])
        probes = probes.union(fps.select("fp", "rep", F.lit(i).alias("part"), F.explode(F.transform(flips, _key(bits).bitwiseXOR)).alias("key")))
    sizes = probes.groupBy("part", "key").count()  # index and probes: flipped probes of a full bucket's neighbours count
    if near:
        usual, hot = sizes.filter(F.col("count") <= hot_bucket), sizes.filter(F.col("count") > hot_bucket)
    else:
        usual, hot = sizes.filter(F.col("count").between(2, hot_bucket)), sizes.filter(F.col("count") > hot_bucket)
    a = indexed.join(usual.select("part", "key"), ["part", "key"])
    b = probes.select("part", "key", F.col("fp").alias("fp2"), F.col("rep").alias("rep2"))
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2")))
    order = F.col("fp") < F.col("fp2") if not near else F.col("fp") != F.col("fp2")
    pairs = a.join(b, [a["part"] == b["part"], a["key"] == b["key"], order, apart <= distance]).select(F.greatest("rep", "rep2").alias("u"), F.least("rep", "rep2").alias("v"))
    crowded = probes.join(hot.select("part", "key"), ["part", "key"], "left_semi").select("fp", "rep").distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_mask([b])).cast("long") for b in range(64)])
    around = crowded.select("rep", F.explode(F.transform(flips, lambda f: F.col("fp").bitwiseXOR(f))).alias("mid"))
    least = F.min("rep").over(Window.partitionBy("mid"))  # at most 65 fingerprints are a bit from a midpoint
    return pairs.union(around.select(F.col("rep").alias("u"), least.alias("v")).filter("u <> v"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_of_shingle: int = SHINGLE, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """``(id, fingerprint, component_id)``, one row for each row of ``docs``; of other columns nothing is read.

    Null and empty texts, and those of white space, have fingerprint zero and link like others. Rows without an id link
    with nothing and have a null component. Repeated rows stay.
    """
    marked = materialise(fingerprint_table(docs, id_col, text_col, words_of_shingle))
    fps = marked.filter("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("rep"))
    linked = connected_components(link_fingerprints(fps, plan_search(fps), hot_bucket))
    of_fp = fps.join(linked, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    out = marked.join(of_fp, "fp", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, fingerprint, component_id."""
    return simhash_components(table(spark, sf_dir, "documents"))


def near_fingerprints(sets: DataFrame, distance: int = STAGE_DISTANCE) -> DataFrame:
    """``(u, v)``: the ``s`` of sets with equal fingerprints (``fp``), each with the smallest, and of those with near ones."""
    fps = materialise(sets.groupBy("fp").agg(F.min("s").alias("rep")))
    equal = sets.select("s", "fp").join(fps, "fp").filter("s <> rep").select(F.col("rep").alias("u"), F.col("s").alias("v"))
    return equal.union(link_fingerprints(fps, plan_search(fps, distance), distance=distance)).distinct()


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the document with the smallest id stays, one row of it; rows without an id stay.

    SimHash fingerprints of the sets of five-word shingles are searched by the pigeonhole principle, as in the operator; what
    has a similarity of 0.8 and more is linked. A prefix filter finds the similar pairs whose fingerprints are further apart,
    so groups hold all pairs of that similarity. Null, empty and
    blank texts are one group. Of several rows of one id the first by its other columns stays. An empty table stays empty.
    """
    groups = similar_components(docs, "doc_id", "text", STAGE_SHINGLE, ANY_DISTANCE, STAGE_SIMILARITY, near_fingerprints)
    gone = groups.filter("doc_id <> component_id").select("doc_id").distinct()
    with_id = docs.filter("doc_id IS NOT NULL").join(gone, "doc_id", "left_anti")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")], F.xxhash64("text")))
    names = [F.col(f"`{c}`") for c in docs.columns]
    kept = with_id.withColumn(f"{OWN}nth", first).filter(F.col(f"{OWN}nth") == 1).select(*names)
    return kept.union(docs.filter("doc_id IS NULL").select(*names))
