"""One query per operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.llm import (
    alignment,
    hnsw_links,
    language,
    line_rules,
    mixing,
    order_minhash,
    preferences,
    record_files,
    simhash,
    unigram,
    url_filter,
    weak_quality,
    whitening,
)
from netsift.llm.common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_verdicts(table(spark, sf_dir, "documents"))


def op2_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw_links.linked_vectors(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return unigram.encoded(docs)


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return preferences.preference_records(preferences.turns_of(turns), preferences.neighbour_rejections(turns))


def op6_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = order_minhash.near_duplicate_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copies", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = record_files.write_records(table(spark, sf_dir, "documents"))
    return record_files.read_records(manifest, with_ids=False)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_quality.quality_verdicts(table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_verdicts(table(spark, sf_dir, "documents")).drop("clean_text")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned_documents(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whitened_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_fingerprints(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_language_id, op2_embedding_neardup, op3_sentencepiece, op4_source_mix, op5_preference_format,
        op6_minhash_neardup, op7_token_records, op8_quality_classifier, op9_url_filter, op10_quality_rules,
        op11_token_alignment, op12_whitening, op13_simhash,
    )
    return {f.__name__: f for f in named}
