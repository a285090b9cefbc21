"""Document fingerprints (10): consistent weighted sampling of the words of a text, weighted by their counts.

Sample k takes the term with the least a = c exp(-r (t - b + 1)), t = floor(ln(weight) / r + b), where r and c are
gamma(2, 1) and b is uniform, all drawn from a hash of term and k. Two texts take the same (term, t) with a probability
equal to their generalised Jaccard similarity, sum of minima over sum of maxima of the weights.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm.common import mix64, table, utf8, word_hashes

SAMPLES = 64
#: Rows of one contiguous range of ids, about.
RANGE_ROWS = 1024
MAX_RANGES = 10_000
BLOCK_BYTES = 1 << 20
#: (term, weight) rows whose samples are worked out at once.
STEP = 1 << 13


def _uniform(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two float32 arrays in (0, 1] from the halves of 64-bit hashes."""
    scale = np.float32(2.0**-24)
    hi, lo = (h >> np.uint64(40)).astype(np.float32), ((h >> np.uint64(8)) & np.uint64(0xFFFFFF)).astype(np.float32)
    return (hi + np.float32(1)) * scale, (lo + np.float32(1)) * scale


def _samples(term: np.ndarray, weight: np.ndarray, samples: int) -> np.ndarray:
    """(rows, samples) uint64: the bits of a, which sort as a does, above a 32-bit mark of (term, t)."""
    k = np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = np.empty((len(term), samples), np.uint64)
    log_w = np.log(weight.astype(np.float32))
    for lo in range(0, len(term), STEP):
        h1 = mix64(term[lo : lo + STEP, None] + k)
        h2, h3 = mix64(h1 ^ np.uint64(0xD6E8FEB86659FD93)), mix64(h1 + np.uint64(0xA0761D6478BD642F))
        u1, u2 = _uniform(h1)
        u3, u4 = _uniform(h2)
        b, _ = _uniform(h3)
        r, c = -np.log(u1 * u2) + np.float32(1e-30), -np.log(u3 * u4) + np.float32(1e-30)
        t = np.floor(log_w[lo : lo + STEP, None] / r + b)
        a = c * np.exp(-r * (t - b + np.float32(1)))
        mark = mix64(h3 + t.astype(np.int64).view(np.uint64)) & np.uint64(0xFFFFFFFF)
        out[lo : lo + STEP] = (a.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | mark
    return out


def signatures(texts: list[str | None], samples: int = SAMPLES) -> np.ndarray:
    """(texts, samples) uint16; null counts as empty, and all texts without words share one signature."""
    data, offs = utf8(pa.array([t or "" for t in texts], pa.large_string()))
    word, _, _, doc = word_hashes(data, offs)
    order = np.lexsort((word, doc))
    word, doc = word[order], doc[order]
    if len(word):
        at = np.flatnonzero(np.concatenate(([True], (word[1:] != word[:-1]) | (doc[1:] != doc[:-1]))))
        count = np.diff(np.append(at, len(word)))
        word, doc = word[at], doc[at]
        # equal (term, count) rows of all texts are worked out once
        order = np.lexsort((count, word))
        w, c = word[order], count[order]
        new = np.concatenate(([True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])))
        which = np.empty(len(word), np.int64)
        which[order] = np.cumsum(new) - 1
        terms, weights = w[new], c[new]
    best = np.full((len(texts), samples), np.iinfo(np.uint64).max, np.uint64)
    if len(word):
        for lo in range(0, samples, 16):  # by 16 samples, to bound memory
            for first in range(0, len(terms), 1 << 16):
                # terms of one step; the rows that use them stay in the order of documents
                own = np.flatnonzero((which >= first) & (which < first + (1 << 16))) if len(terms) > 1 << 16 else np.arange(len(which))
                if not len(own):
                    continue
                part = slice(first, first + (1 << 16))
                known = _some(terms[part], weights[part], lo, min(16, samples - lo))
                d = doc[own]
                start = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
                least = np.minimum.reduceat(known[which[own] - first], start, axis=0)
                rows = d[start]
                best[rows, lo : lo + 16] = np.minimum(best[rows, lo : lo + 16], least)
    return (best & np.uint64(0xFFFF)).astype(np.uint16)


def _some(term: np.ndarray, weight: np.ndarray, first: int, n: int) -> np.ndarray:
    """Samples first .. first + n - 1."""
    return _samples(term + np.uint64((first * 0x9E3779B97F4A7C15) & ((1 << 64) - 1)), weight, n)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal samples: an unbiased estimate of generalised Jaccard similarity."""
    return (a == b).mean(axis=1)


def _hex(sig: np.ndarray) -> list[str]:
    whole, size = sig.astype(">u2").tobytes().hex(), 4 * sig.shape[1]
    return [whole[i : i + size] for i in range(0, len(whole), size)]


def edited_text(text: str, following: str) -> str:
    """The last floor(n/3) characters replaced by the first as many (or all) of the following text."""
    m = len(text) // 3
    return text[: len(text) - m] + following[:m]


_OUT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _emit(rows: list[tuple], samples: int) -> pa.RecordBatch:
    """rows: (id, text) in order; all but the last are returned, each with the row behind it as the next."""
    texts = [t for _, t in rows]
    edited = [edited_text(t, u) for t, u in zip(texts[:-1], texts[1:], strict=True)]
    own, other = signatures(texts, samples), signatures(edited, samples)
    n = len(rows) - 1
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _ in rows[:-1]], pa.int64()),
            pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(_hex(own[:n]), pa.string()),
            pa.array(_hex(other), pa.string()),
            pa.array(likeness(own[:n], other), pa.float64()),
            pa.array(likeness(own[:n], own[1:]), pa.float64()),
        ],
        names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and its likeness to that and to the next row's.

    The next row is that of the next smaller id (of equal ids: the next text in order; null ids come last); behind the
    last comes the first. Null texts count as empty. A single row is its own next. Every row gives a row; an empty table
    none. Ids are read first, for ranges of about ``range_rows`` ids; then whole texts are shuffled once, by range, and
    the first row of the next range comes along as a guest.
    """
    lowest = -(1 << 63)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(lowest)).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = keyed.count()
    out = f"id long, {_OUT}"
    if not n:
        return docs.sparkSession.createDataFrame([], out).withColumnRenamed("id", id_col)
    ranges = max(1, min(MAX_RANGES, n // range_rows))
    cuts = keyed.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges)], 10 * ranges).alias("q")).first()["q"] if ranges > 1 else []
    bounds = np.unique(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int32))

    # the largest id of each range: at most MAX_RANGES rows
    tops = sorted((r[0], r[1]) for r in keyed.select(range_of("key").alias("r"), "key").groupBy("r").agg(F.max("key")).collect())
    guests = [(tops[k - 1][1], tops[k][0]) for k in range(len(tops))]  # the top of a range visits the next higher; the highest the lowest
    spark = docs.sparkSession
    visits = spark.createDataFrame(guests, "top long, host int")
    dealt = (
        keyed.withColumn("r", range_of("key"))
        .join(F.broadcast(visits), F.col("key") == F.col("top"), "left")
        .select("id", "key", "text", F.explode(F.when(F.col("host").isNull(), F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("guest")))).otherwise(F.array(F.struct(F.col("r").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("r"), F.lit(1).alias("guest"))))).alias("at"))
        .select("id", "key", "text", "at.r", "at.guest")
        .repartition("r")
        .sortWithinPartitions("r", "guest", F.desc("key"), "text")
        .select("id", "text", "r", "guest")
    )

    def run(batches):
        held, size, range_now, closed = [], 0, None, False
        for b in batches:
            for i, text, r, guest in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if r != range_now:
                    held, size, range_now, closed = [], 0, r, False
                if closed:
                    continue
                held.append((i, text))
                size += len(text)
                closed = guest == 1
                if closed or size >= BLOCK_BYTES:
                    if len(held) > 1:
                        yield _emit(held, samples)
                    held, size = [held[-1]], len(held[-1][1])

    return dealt.mapInArrow(run, out).withColumnRenamed("id", id_col)


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    return fingerprint_with_next(table(spark, sf_dir, "documents"))
