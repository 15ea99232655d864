"""The corpus pipeline: stages over ``documents``, each written and read again by its runner.

Every stage works on all rows that the one before kept, and all but the last return the columns of
``documents``. All take rows with nulls in any column, empty and very long texts, repeated rows and ids,
and further columns, which they keep; an empty table stays empty. Labels, where a stage needs them, come from the ``labels`` table of the same folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import minhash_forest, quality_knn, secret_ledger, sentencepiece_codec, source_mixing
from quillon.tables import materialize, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Each row is scored by its text alone, so
    rows of one text stay or go together; null and empty texts go. Without labels to learn from, all stay."""
    return quality_knn.keep_good(docs, table(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at similarity 0.8 of word shingles, stays: the one
    with the smallest id. Null and blank texts have no duplicates. Rows without an id stay; of several rows
    with one id, one stays."""
    return minhash_forest.keep_one(docs, similarity=0.8)


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every row stays, null and empty texts as they are."""
    return secret_ledger.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights. A null source
    is a source; null and blank texts have no words and go; rows of a source that are equal in id and size
    are taken alike, whether or not they have an id."""
    return source_mixing.repeat(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, piece_ids, round_trip) of each row of the mix; null text has null
    pieces and a round trip that holds."""
    encoded = sentencepiece_codec.encode(docs.select("doc_id", "source", "text"), check=True)
    return encoded.select("doc_id", "source", "n_pieces", "piece_ids", "round_trip")


STAGES: list[tuple[str, Stage]] = [
    ("quality_knn", classify),
    ("minhash_near_dedup", deduplicate),
    ("secret_scan", scan_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", tokenize),
]

#: The stages train, hash and tokenise in ways SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
