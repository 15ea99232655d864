"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import language_id, minhash_forest, projection_dedup, quality_knn, scaled_sketch, secret_ledger, sentencepiece_codec, source_mixing, suffix_dedup, url_lists
from quillon.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(table(spark, sf_dir, "documents"))


def op2_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets are rounded to a millionth of a word, so that engines agree."""
    mixed = source_mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.withColumn("target", F.round("target", 6))


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.find_secrets(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_held_out(table(spark, sf_dir, "documents"))


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_lists.filter_pages(table(spark, sf_dir, "pages"))


def op8_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprints(table(spark, sf_dir, "documents"))


def op9_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.predict_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_projection_dedup, op3_source_mixing, op4_secret_ledger, op5_suffix_dedup, op6_language_id, op7_url_lists, op8_scaled_sketch, op9_quality_knn, op10_minhash_forest)
}

ORACLES: dict[str, str] = {
    "op2_projection_dedup": projection_dedup.LINKS_SQL,
    "op3_source_mixing": source_mixing.MIX_SQL.replace("SELECT doc_id, size, source_size, target,\n", "SELECT doc_id, size, source_size, round(target, 6) AS target,\n"),
    "op7_url_lists": url_lists.FILTER_SQL,
}
