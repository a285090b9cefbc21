"""Toxicity (9): a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm.chargrams import sparse_counts
from tessellum.llm.common import OWN, blocks, fold, segment_sum, table

ORDERS = (3, 4, 5)
BITS = 18
#: Labelled documents of a class to learn from, about (a hash of the id picks them from all labels).
TRAIN_DOCS = 2000
#: N-gram buckets with a weight: those whose share of documents differs most between the classes, in standard errors.
FEATURES = 1 << 14
MIN_Z = 6.0
L2 = 1e-2
STEPS = 800


@dataclass
class ToxicityModel:
    weight: np.ndarray  # of each bucket, the ratio included; 0 for most
    bias: float

    def score(self, texts: list[str | None]) -> np.ndarray:
        row, bucket, _ = sparse_counts(texts, ORDERS, BITS, self.weight != 0)
        margin = segment_sum(self.weight[bucket], row, len(texts)) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -50, 50)))


def _fit(row: np.ndarray, feature: np.ndarray, y: np.ndarray, ratio: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on x = ratio by Nesterov's method; the bias is moved to the classes' true shares."""
    n, m = len(y), len(ratio)
    x = ratio[feature]
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))  # both classes weigh alike
    norm = segment_sum(x * x, row, n).max(initial=1.0) + 1
    step = 4 / norm
    w, b, w0, b0 = np.zeros(m), 0.0, np.zeros(m), 0.0
    for k in range(STEPS):
        t = k / (k + 3)
        v, c = w + t * (w - w0), b + t * (b - b0)
        p = 1 / (1 + np.exp(-np.clip(segment_sum(x * v[feature], row, n) + c, -50, 50)))
        g = (p - y) * share
        w0, b0 = w, b
        w = v - step * (np.bincount(feature, weights=x * g[row], minlength=m) + L2 / n * v)
        b = c - step * g.sum()
    return w * ratio, b + np.log(prior / (1 - prior))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_docs: int = TRAIN_DOCS) -> ToxicityModel:
    """Learn from about ``train_docs`` labelled documents of each class.

    Null ids and labels teach nothing; of several labels of one id the largest counts; without one of the classes every
    score is the share of toxic labels. Of several rows of an id the least text teaches; features that tell the classes equally well
    are taken in order of their buckets.
    """
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg((F.max(label_col) > 0).cast("int").alias("_y"))
    sizes = {r[0]: r[1] for r in marks.groupBy("_y").count().collect()}
    prior = (sizes.get(1, 0) + 0.5) / (sum(sizes.values()) + 1)
    blank = ToxicityModel(np.zeros(1 << BITS), float(np.log(prior / (1 - prior))))
    if len(sizes) < 2:
        return blank
    rate = F.when(F.col("_y") == 1, min(1.0, train_docs / sizes[1])).otherwise(min(1.0, train_docs / sizes[0]))
    picked = marks.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30) < rate)
    # about 2 * train_docs ids and labels at most: safe to broadcast at any size
    sample = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked.withColumnRenamed(id_col, "_id")), "_id")
    # one text an id, however often it comes: the bound holds
    sample = sample.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_text", "_y")

    def count(batches):
        sums = np.zeros((2, 1 << BITS), np.int64)
        for b in blocks(batches, "_text"):
            y = b.column("_y").to_numpy()
            row, bucket, _ = sparse_counts(b.column("_text").to_pylist(), ORDERS, BITS)
            for k in (0, 1):
                sums[k] += np.bincount(bucket[y[row] == k], minlength=1 << BITS)
        at = np.flatnonzero(sums.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["bucket", "n0", "n1"])

    got = sample.mapInArrow(count, "bucket int, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow()
    if not got.num_rows:
        return blank
    bucket, n0, n1 = (got.column(c).to_numpy() for c in ("bucket", "n0", "n1"))
    ratio = np.log((n1 + 1) / (n1.sum() + len(n1))) - np.log((n0 + 1) / (n0.sum() + len(n0)))
    s0, s1 = (max(1.0, min(train_docs, sizes[k])) for k in (0, 1))
    share = np.clip((n0 + n1) / (s0 + s1), 1e-9, 1 - 1e-9)
    z = np.abs(n1 / s1 - n0 / s0) / np.sqrt(share * (1 - share) * (1 / s0 + 1 / s1))
    order = np.lexsort((bucket, -z))[:FEATURES]
    order = order[(z[order] >= MIN_Z) | (np.arange(len(order)) < 64)]
    if not len(order):
        return blank
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket[order]] = np.arange(len(order))

    def rows(batches):
        for b in blocks(batches, "_text"):
            row, at, _ = sparse_counts(b.column("_text").to_pylist(), ORDERS, BITS, place >= 0)
            offs = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offs), pa.array(place[at])), b.column("_y")], names=["f", "y"])

    kept = sample.mapInArrow(rows, "f array<int>, y int").toArrow()
    lists = kept.column("f").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    y = kept.column("y").to_numpy().astype(float)
    weight, bias = _fit(np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy(), y, ratio[order], prior)
    full = np.zeros(1 << BITS)
    full[bucket[order]] = weight
    return ToxicityModel(full, float(bias))


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the two of ``names``; one row for each row; null and empty texts get the bias's score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_text"]

    def run(batches):
        for b in blocks(batches, "_text"):
            s = shared.value.score(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=[*b.schema.names[:-1], "score", "predicted"])

    out = source.mapInArrow(run, ", ".join([*types, "score double", "predicted int"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("score").alias(names[0]), F.col("predicted").alias(names[1]))


def _train_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(fold("doc_id", 5) != 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. Null ids are in neither fold (held_out false); repeated rows stay."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, _train_labels(spark, sf_dir))
    return score(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; columns stay.

    Null and empty texts get the score of a text without features, and stay while toxic labels are the rarer; null ids and
    repeated rows are judged like others.
    """
    names = docs.columns
    judged = score(docs, train(docs, _train_labels(spark, sf_dir)), names, names=(f"{OWN}score", f"{OWN}toxic"))
    return judged.filter(F.col(f"{OWN}toxic") == 0).select(*[F.col(f"`{c}`") for c in names])
