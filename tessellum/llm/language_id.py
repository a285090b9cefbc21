"""Language ID (2): multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellum.llm.chargrams import has_letter, sparse_counts
from tessellum.llm.common import OWN, blocks, fold, segment_sum, table

ORDERS = (1, 2, 3)
BITS = 16
#: Documents of a language to learn from, about (a hash of the id picks them from all rows).
TRAIN_DOCS = 4000
#: Bytes of the broadcast matrix at most, so 256 languages at 2**16 buckets.
MATRIX_BYTES = 64 << 20
ALPHA = 0.5
#: The score is the posterior that so many average n-grams of the text give; evidence of whole long texts would make it 0 or 1.
EVIDENCE = 50.0
UNKNOWN = "und"


@dataclass
class LanguageModel:
    langs: list[str]
    log_prob: np.ndarray  # (buckets, languages) float32
    log_prior: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 where there is no letter or nothing was learned."""
        n = len(texts)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n)
        row, bucket, count = sparse_counts(texts, ORDERS, BITS)
        weights = self.log_prob[bucket] * count[:, None].astype(np.float32)
        logits = np.stack([segment_sum(weights[:, k], row, n) for k in range(len(self.langs))], axis=1)
        total = segment_sum(count, row, n)
        best = np.argmax(logits + self.log_prior, axis=1)
        z = logits * np.minimum(1.0, EVIDENCE / np.maximum(total, 1))[:, None] + self.log_prior
        z = np.exp(z - z.max(axis=1, keepdims=True))
        score = z[np.arange(n), best] / z.sum(axis=1)
        letter = has_letter(texts)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letter, strict=True)], np.where(letter, score, 0.0)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Learn from about ``train_docs`` rows of each non-null language (all, where it has fewer); null ids and texts teach nothing.
    Repeated rows count as often as they come; of equally likely languages the first by name is predicted."""
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text_col, lang_col)
    most = MATRIX_BYTES // (4 << BITS)
    sizes = {r[0]: r[1] for r in rows.groupBy(lang_col).count().limit(most + 1).collect()}
    if len(sizes) > most:
        raise ValueError(f"over {most} languages: the log-probability matrix would pass {MATRIX_BYTES} bytes")
    langs = sorted(sizes)
    if not langs:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    rate = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, train_docs / sizes[lang]))])
    at = F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.filter(at < rate[F.col(lang_col)])

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in blocks(batches, text_col):
            texts, names = b.column(1).to_pylist(), np.array(b.column(2).to_pylist(), dtype=object)
            row, bucket, n = sparse_counts(texts, ORDERS, BITS)
            for lang in set(names):
                own = (names == lang)[row]
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket[own], weights=n[own], minlength=1 << BITS)
        for lang, s in sums.items():
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(s[at].astype(np.int64))], names=["lang", "bucket", "n"])

    counts = sample.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = counts.toArrow()
    dense = np.zeros((1 << BITS, len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    if got.num_rows:
        which = got.column("lang").combine_chunks().dictionary_encode()
        column = np.array([place[x] for x in which.dictionary.to_pylist()])[which.indices.to_numpy()]
        dense[got.column("bucket").to_numpy(), column] = got.column("n").to_numpy()
    log_prob = np.log((dense + ALPHA) / (dense.sum(axis=0) + ALPHA * (1 << BITS)))
    prior = np.array([sizes[x] for x in langs], float)
    return LanguageModel(langs, log_prob.astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: LanguageModel, keep: list[str], text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of ``docs`` and the two of ``names``; one row for each row. Only these columns are read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(keep)], F.col(text_col).alias("_text"))
    types = [f"{f.name} {f.dataType.simpleString()}" for f in source.schema if f.name != "_text"]

    def run(batches):
        for b in blocks(batches, "_text"):
            lang, score = shared.value.predict(b.column("_text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    out = source.mapInArrow(run, ", ".join([*types, "lang_pred string", "score double"]))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("lang_pred").alias(names[0]), F.col("score").alias(names[1]))


def _train_fold(docs: DataFrame) -> DataFrame:
    return docs.filter(fold("doc_id", 3) != 1)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Null ids are in neither fold (held_out false); repeated rows stay."""
    docs = table(spark, sf_dir, "documents")
    model = train(_train_fold(docs))
    return predict(docs, model, ["doc_id"]).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


#: Below this score a document counts as of no known language: hardly over what chance gives, so that short clean texts stay.
MIN_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents of no recognisable language go (``und``, or a score under MIN_SCORE); columns stay.

    Null and empty texts, and those without a letter, are ``und`` and go; null ids and repeated rows are judged like others.
    """
    names = docs.columns
    judged = predict(docs, train(_train_fold(docs)), names, names=(f"{OWN}lang", f"{OWN}score"))
    return judged.filter((F.col(f"{OWN}lang") != UNKNOWN) & (F.col(f"{OWN}score") >= MIN_SCORE)).select(*[F.col(f"`{c}`") for c in names])
