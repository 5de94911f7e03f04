"""Registered queries of this subpackage, over whole tables, and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.llm import (
    bpe, collocations, conversations, language, neighbour_graph, packing, pages, prefix_trie, quality_classifier,
    quality_rules, signature_tree, spotsigs, statements, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(run):
    QUERIES[run.__name__] = run
    return run


@register
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 85 % of their 4-word shingles in common."""
    return signature_tree.linked(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def _bucket(of: int) -> Column:
    """Fold of a document by the contracts: crc32 of doc_id as text."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(of))


@register
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two of three folds."""
    found = language.identify(_table(spark, sf_dir, "documents"), training=_bucket(3) != 1)
    return found.select("doc_id", (_bucket(3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted")


@register
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and the cascade's verdict on every document."""
    measures = quality_rules.BASE_MEASURES
    found = quality_rules.judge(_table(spark, sf_dir, "documents"), measures=measures)
    base_failed = F.expr("n_words < 20 OR 100 * n_repeat_words > 30 * n_words")
    return found.select("doc_id", *measures, base_failed.alias("base_failed"), "kept", "failed_rule")


@register
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from three of four folds."""
    found = toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), training=_bucket(4) != 2)
    return found.select("doc_id", (_bucket(4) == 2).alias("held_out"), "score", "predicted")


@register
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from four of five folds."""
    found = quality_classifier.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), training=_bucket(5) != 0)
    return found.select("doc_id", (_bucket(5) == 0).alias("held_out"), "score", "predicted")


@register
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@register
def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids and decoded text of every document, as digests."""
    return bpe.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register
def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return spotsigs.edited(_table(spark, sf_dir, "documents"))


@register
def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return pages.extract(_table(spark, sf_dir, "pages"))


@register
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every maximal conversation, rendered."""
    return conversations.render(_table(spark, sf_dir, "conversations"))


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    turns, sizes = prefix_trie.rebuilt(prefix_trie.numbered(prefix_trie.items(_table(spark, sf_dir, "conversations"))))
    return prefix_trie.with_digests(prefix_trie.build(turns, sizes))


ORACLE["op13_prefix_trie"] = statements.PREFIX_TRIE


@register
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 collocations of each language."""
    return collocations.mine(_table(spark, sf_dir, "documents"))


ORACLE["op12_collocations"] = statements.COLLOCATIONS


@register
def op11_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors found for every hundredth one."""
    graph = neighbour_graph.build(_table(spark, sf_dir, "embeddings"))
    asked = graph.points.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return neighbour_graph.search(graph, asked).withColumn("rank", F.col("rank").cast("int")).withColumnRenamed("id", "vec_id")
