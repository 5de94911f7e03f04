"""The corpus pipeline: quality rules, language, near duplicates, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which :func:`run` writes and rereads as the next one's docs.
Filtering stages return the columns of documents, whatever they are called.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.llm import language, packing, quality_rules, shared, signature_tree


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule lets pass.

    A null or empty text has no words and goes. Repeated rows, null keys and further
    columns of any name stay as they are; an empty table gives none.
    """
    verdict = shared.free_name(docs, "failed_rule"), shared.free_name(docs, "kept")
    judged = quality_rules.judge(docs, keep=[*docs.columns], verdict=verdict)
    return judged.where(F.col(verdict[1])).select(*[F.col(f"`{c}`") for c in docs.columns])


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with calibrated confidence; the models learn from the same documents.

    A text without letters goes, so do null and empty ones. Rows of one text are judged
    alike; a null lang is not learned from. An empty table gives none.
    """
    name = shared.free_name(docs, "_text_hash")
    found = shared.written(language.identify(docs, training=F.lit(True), row_key=F.xxhash64("text")), "languages")
    gone = shared.written(found.where("NOT accepted").select(F.col("row_key").alias(name)).distinct(), "gone")
    return shared.without(docs.withColumn(name, F.xxhash64("text")), gone, name).select(
        *[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles and a similarity of 0.8.

    Documents without words stay; of repeated rows with words one stays.
    """
    return signature_tree.one_of_each(docs, words=5, num=80, den=100)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as sequences of 1024 tokens; a null or empty text is its end token, each repeated row is packed."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality),
    ("language_id", languages),
    ("near_duplicates", near_duplicates),
    ("best_fit_packing", packed),
]

# Learned models and tokenizers are not SQL: tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are a written table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return docs
