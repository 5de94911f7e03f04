"""Index tables: building, saving, loading, listing."""

from __future__ import annotations

from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv
from aisle.functions import text
from aisle.operators import catalog as products
from aisle.operators import hierarchy, knn
from aisle.operators.encode import encode
from aisle.operators.ranking import SearchIndex
from aisle.schema import FILTER_COLUMNS, ORDINAL

TABLES = {
    "catalog": "catalog",
    "flat": "flat_vectors",
    "enhanced": "enhanced_vectors",
    "nodes": "taxonomy_nodes",
    "leaves": "leaf_vectors",
}
CELL_TABLES = {"flat_cells": "flat", "enhanced_cells": "enhanced"}


def build_flat(catalog: DataFrame, dim: int = fv.EMBEDDING_DIM) -> DataFrame:
    """(product_id, embedding) and the columns that searches filter by, so that a filter needs no join."""
    texts = catalog.select("product_id", *FILTER_COLUMNS, text.combined_text().alias("_text"))
    return encode(texts, "_text", dim=dim).select("product_id", "embedding", *FILTER_COLUMNS)


def build_enhanced(enriched: DataFrame, dim: int = fv.EMBEDDING_DIM) -> DataFrame:
    """As :func:`build_flat`, of the enhanced texts."""
    texts = enriched.select("product_id", *FILTER_COLUMNS, text.enhanced_text().alias("_text"))
    return encode(texts, "_text", dim=dim).select("product_id", "embedding", *FILTER_COLUMNS)


def build_hierarchical(catalog: DataFrame, dim: int = fv.EMBEDDING_DIM) -> tuple[DataFrame, DataFrame]:
    """(nodes with vectors, product leaves with vectors)."""
    nodes = hierarchy.build(catalog)
    named = hierarchy.node_vectors(nodes, dim)
    root = nodes.where(F.col("level") == 0).withColumn("embedding", F.lit(None).cast("array<float>"))
    return named.unionByName(root), hierarchy.leaf_vectors(catalog, dim)


def build(enriched: DataFrame, dim: int = fv.EMBEDDING_DIM) -> SearchIndex:
    """All models' tables as one lazy index over an enriched catalogue.

    The expanded model shares the enhanced vectors.
    """
    nodes, leaves = build_hierarchical(enriched, dim)
    return SearchIndex(
        catalog=enriched, flat=build_flat(enriched, dim), enhanced=build_enhanced(enriched, dim),
        nodes=nodes, leaves=leaves, dim=dim,
    )


def with_cells(
    index: SearchIndex, nlist: int | None = None,
) -> SearchIndex:
    """The index with cell layouts beside its vector tables, for searches that ask for them."""
    changes = {}
    for name, base in CELL_TABLES.items():
        vectors = getattr(index, base)
        if vectors is not None:
            changes[name] = knn.build_cells(vectors, nlist)
    return replace(index, **changes)


def save(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def save_all(index: SearchIndex, base: str, cells: bool = False, nlist: int | None = None) -> None:
    """Write every table of the index under ``base``, on request also the layouts by cell."""
    save(index.catalog, f"{base}/catalog")
    save_vectors(index, base, cells, nlist)


def save_vectors(index: SearchIndex, base: str, cells: bool = False, nlist: int | None = None) -> None:
    """Write the index tables beside a catalogue that is already under ``base``.

    Leaves are laid out in ranges of product type, so that a search that descends
    into few types skips most files, the others in ranges of department and category
    for filtered searches; the id's hash splits a value that is too large for one range.
    The ranges are sampled, and that sample would compute every vector once more: the
    vectors are shuffled by id first, so that it reads what is shuffled.
    """
    for name, where in TABLES.items():
        table = getattr(index, name)
        if table is None or name == "catalog":
            continue
        if name == "leaves":
            table = table.hint("rebalance", "product_id").repartitionByRange("node_id", F.xxhash64("product_id")).sortWithinPartitions("node_id")
        elif name in ("flat", "enhanced"):
            table = table.hint("rebalance", "product_id").repartitionByRange(
                "department", "category", F.xxhash64("product_id")).sortWithinPartitions("department", "category")
        save(table, f"{base}/{where}")
    if cells:
        save_cells(load_all(index.catalog.sparkSession, base, index.dim), base, nlist)


def save_cells(saved: SearchIndex, base: str, nlist: int | None = None) -> None:
    """Add the by-cell layout of each saved vector table.

    Rebalancing by cell keeps small cells in one file and splits large ones,
    instead of one file per task and cell.
    """
    grown = with_cells(saved, nlist)
    for name, base_name in CELL_TABLES.items():
        cells = getattr(grown, name)
        if cells is not None:
            by_cell = cells.vectors.hint("rebalance", "cell")
            save(by_cell, f"{base}/{TABLES[base_name]}_by_cell", "cell")
            save(cells.centroids, f"{base}/{TABLES[base_name]}_centroids")


def save_pages(catalog: DataFrame, base: str, rows: int = products.PAGE_BLOCK) -> None:
    """Write the catalogue in source order and its page index, for pages at any depth."""
    save(catalog.repartitionByRange(ORDINAL).sortWithinPartitions(ORDINAL), f"{base}/pages")
    written = load(catalog.sparkSession, f"{base}/pages")
    save(products.page_blocks(written, rows), f"{base}/page_blocks")


def load_pages(spark: SparkSession, base: str) -> tuple[DataFrame, DataFrame]:
    """(catalogue in source order, its page index), as :func:`save_pages` wrote them."""
    return spark.read.parquet(f"{base}/pages"), spark.read.parquet(f"{base}/page_blocks")


def load_all(spark: SparkSession, base: str, dim: int = fv.EMBEDDING_DIM) -> SearchIndex:
    """The index under ``base``; tables that are absent leave their model unloaded."""
    tables = {name: load(spark, f"{base}/{where}") for name, where in TABLES.items()}
    if tables["catalog"] is None:
        raise ValueError(f"no catalogue under {base}")
    cells = {}
    for name, base_name in CELL_TABLES.items():
        vectors = load(spark, f"{base}/{TABLES[base_name]}_by_cell")
        centroids = load(spark, f"{base}/{TABLES[base_name]}_centroids")
        if vectors is not None and centroids is not None:
            cells[name] = knn.Cells(vectors, centroids)
    return SearchIndex(dim=dim, **tables, **cells)


def stats(index: SearchIndex) -> DataFrame:
    """(table, rows) of every table that is present."""
    parts = [
        table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(where).alias("table"), "rows")
        for name, where in TABLES.items() if (table := getattr(index, name)) is not None
    ]
    listed = parts[0]
    for part in parts[1:]:
        listed = listed.unionByName(part)
    return listed


def list_models(index: SearchIndex) -> DataFrame:
    """(model_id, loaded, vectors) of the four models."""
    spark = index.catalog.sparkSession
    base = {fv.HIERARCHICAL: "leaves", fv.FLAT: "flat", fv.ENHANCED: "enhanced", fv.EXPANDED: "enhanced"}
    counts = stats(index).withColumnRenamed("table", "_table")
    models = spark.createDataFrame(
        [(m, m in index.loaded(), TABLES[base[m]]) for m in fv.MODELS],
        "model_id string, loaded boolean, _table string",
    )
    return models.join(counts, "_table", "left").select(
        "model_id", "loaded", F.coalesce("rows", F.lit(0)).alias("vectors")
    )
