"""Corpus pipeline: language ID, toxicity, SimHash near-dedup, mixing, SentencePiece encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm.common import materialise, table
from tessellum.llm.language_id import language_stage
from tessellum.llm.mixing import mixing_stage
from tessellum.llm.sentencepiece_tokens import tokens_stage
from tessellum.llm.simhash import simhash_stage
from tessellum.llm.toxicity import toxicity_stage

#: (name, function): each takes (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", tokens_stage),
]

#: No SQL expresses learned models, SimHash and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
