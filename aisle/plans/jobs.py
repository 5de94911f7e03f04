"""End-to-end jobs: raw catalogue to a ready index, reusing what is already written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from aisle.functions import fixed_values as fv
from aisle.operators import clean, hierarchy
from aisle.operators.catalog import to_unified
from aisle.operators.enrich import enrich_descriptions
from aisle.operators.ranking import SearchIndex
from aisle.plans import index as tables
from aisle.sources.folders import shared_folder  # noqa: F401 (part of this module's interface)
from aisle.sources.readers import read_catalog, read_processed
from aisle.sources.writers import write_catalog


def prepare_catalog(raw: DataFrame) -> DataFrame:
    """Raw rows to the cleaned, enriched catalogue: one lazy plan."""
    return raw.transform(to_unified).transform(clean.run).transform(enrich_descriptions)


def build(spark: SparkSession, processed: DataFrame, base: str, dim: int = fv.EMBEDDING_DIM) -> SearchIndex:
    """Enrich a processed catalogue, write every index table and the taxonomy export."""
    tables.save(enrich_descriptions(processed), f"{base}/catalog")
    tables.save_vectors(tables.build(tables.load(spark, f"{base}/catalog"), dim), base)
    saved = tables.load_all(spark, base, dim)
    hierarchy.export_json(saved.nodes, f"{base}/taxonomy")
    return saved


def prepare(
    spark: SparkSession, raw_path: str, base: str, fmt: str | None = None,
    dim: int = fv.EMBEDDING_DIM,
) -> SearchIndex:
    """Raw file to a loaded index; tables already written under ``base`` are reused.

    The unified table is landed first: it fixes the row ordinals, and cleaning,
    which looks at a few columns several times, then reads columns, not text files.
    """
    processed_path, unified_path = f"{base}/processed", f"{base}/unified"
    if tables.load(spark, processed_path) is None:
        if tables.load(spark, unified_path) is None:
            write_catalog(to_unified(read_catalog(spark, raw_path, fmt)), unified_path)
        write_catalog(clean.run(tables.load(spark, unified_path)), processed_path)
    if tables.load(spark, f"{base}/index/catalog") is not None:
        saved = tables.load_all(spark, f"{base}/index", dim)
        if saved.loaded() == fv.MODELS:
            return saved
    return build(spark, read_processed(spark, processed_path), f"{base}/index", dim)
