"""The operators over their whole tables, and their SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import (
    bpe, edit_embedding, html_text, manifest, mixing, near_dups, pairwise, periodic, quality_rules, secrets, sharding, token_counts, token_files,
)
from tablewright.llm.common import table

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), VOCABULARY)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.query(spark, sf_dir, BYTE_VOCABULARY)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": sharding.query,
    "op2_text_density": html_text.query,
    "op3_min_max_near_dups": near_dups.query,
    "op4_token_counts": op4,
    "op5_adaptive_rules": quality_rules.query,
    "op6_edit_embedding": edit_embedding.query,
    "op7_block_mix": mixing.query,
    "op8_prefix_bpe": op8,
    "op9_trigram_secrets": secrets.query,
    "op10_pairwise_quality": pairwise.query,
    "op11_periodic_runs": periodic.query,
    "op12_merkle_manifest": manifest.query,
    "op13_token_files": op13,
}
#: Further jobs of these operators.
MORE: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_edit_links": edit_embedding.links_query}
ORACLES: dict[str, str] = {
    "op5_adaptive_rules": quality_rules.ORACLE,
    "op9_trigram_secrets": secrets.ORACLE,
    "op11_periodic_runs": periodic.ORACLE,
    "op12_merkle_manifest": manifest.ORACLE,
}
