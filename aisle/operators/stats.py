"""Catalogue statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _headline(approximate: bool) -> list:
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    return [
        F.count(F.lit(1)).alias("total_products"),
        distinct("department").alias("departments"),
        distinct("category").alias("categories"),
        distinct("brand").alias("brands"),
        F.round(F.avg("price"), 2).alias("avg_price"),
        F.round(F.avg("rating"), 2).alias("avg_rating"),
    ]


def dataset_stats(catalog: DataFrame, approximate: bool = False) -> DataFrame:
    return catalog.agg(
        *_headline(approximate),
        F.count_if(F.length("description") > 10).alias("products_with_description"),
        F.count_if(F.length("features") > 5).alias("products_with_features"),
    )


def top_values(catalog: DataFrame, column: str, n: int = 10) -> DataFrame:
    counts = catalog.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value"))
    return counts.agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(n)


def product_stats(catalog: DataFrame, n: int = 10, approximate: bool = False) -> DataFrame:
    """The headline numbers with the top departments and brands as (value, count) lists."""
    def top(column: str):
        entries = F.array_sort(
            F.collect_list(F.struct((-F.col("count")).alias("order"), "value", "count"))
        )
        pairs = F.transform(entries, lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count")))
        return top_values(catalog, column, n).agg(pairs).scalar()

    return catalog.agg(*_headline(approximate)).select(
        "*", top("department").alias("department_counts"), top("brand").alias("top_brands")
    )
