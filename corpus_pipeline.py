"""From raw documents to token ids: five stages, each over all that the one before kept.

Documents of low quality go; one document of each near-duplicate group stays (five words, a
similarity of 0.8); secrets are masked; sources are mixed to their target weights; texts
become ids.  Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import bpe, mixing, near_dups, pairwise, secrets
from tablewright.llm.common import table, written
from tablewright.llm.queries import VOCABULARY


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose pairwise score, learned from the labels, reaches the limit."""
    return pairwise.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least id of each near-duplicate group."""
    return near_dups.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, its secrets replaced by their kind; ``n_chars`` counted anew."""
    return secrets.mask_secrets(docs, chars="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a second time those it takes twice."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)`` of every document."""
    # The workers keep what they remember through the stages that follow in a session.
    return bpe.encode(docs, VOCABULARY, remembered=80_000)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("mask_secrets", mask_secrets),
    ("mix", mix),
    ("encode", encode),
]
#: The learned scores of the first stage cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
