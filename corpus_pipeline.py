"""The corpus pipeline: quality, language, near duplicates, mixing, token pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from netsift.llm import language, mixing, order_minhash, unigram, weak_quality
from netsift.llm.common import table
from netsift.session import shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier keeps."""
    return weak_quality.good_documents(docs)


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; the model learns from the lang of the documents at hand."""
    return language.identified_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest doc_id."""
    return order_minhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in mixing order, those of a second pass twice."""
    return mixing.mixed_documents(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_pieces, piece_ids, decoded_same."""
    return unigram.encoded(docs.select("doc_id", "source", "text"))


STAGES = [
    ("quality", quality),
    ("languages", languages),
    ("near_duplicates", near_duplicates),
    ("mix", mix),
    ("pieces", pieces),
]

#: The stages learn models and follow hash functions of their own, which SQL has not; tests compare
#: each stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/netsift/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
