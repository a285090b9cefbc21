"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessellum.llm.bloom_lm import op3_lm_scores
from tessellum.llm.bpe import op12_byte_bpe
from tessellum.llm.collocations import OP13_SQL, op13_collocations
from tessellum.llm.hnsw import op1_embedding_near_dedup
from tessellum.llm.language_id import op2_language_id
from tessellum.llm.licences import op5_licence_scan
from tessellum.llm.merkle import OP11_SQL, op11_merkle_manifest
from tessellum.llm.mixing import op7_mixing
from tessellum.llm.sentencepiece_tokens import op6_sentencepiece
from tessellum.llm.simhash import op4_simhash_near_dedup
from tessellum.llm.toxicity import op9_toxicity
from tessellum.llm.url_filter import OP8_SQL, op8_url_filter
from tessellum.llm.weighted_sampling import op10_document_fingerprints


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_near_dedup": op1_embedding_near_dedup,
        "op2_language_id": op2_language_id,
        "op3_lm_scores": op3_lm_scores,
        "op4_simhash_near_dedup": op4_simhash_near_dedup,
        "op5_licence_scan": op5_licence_scan,
        "op6_sentencepiece": op6_sentencepiece,
        "op7_mixing": op7_mixing,
        "op8_url_filter": op8_url_filter,
        "op9_toxicity": op9_toxicity,
        "op10_document_fingerprints": op10_document_fingerprints,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_collocations": op13_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_collocations": OP13_SQL}
