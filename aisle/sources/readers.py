"""Scans: raw catalogues, processed catalogues, vectors, query sets."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisle.functions import fixed_values as fv
from aisle.schema import ORDINAL

FORMATS = {".csv": "csv", ".json": "json", ".parquet": "parquet"}
REQUIRED_RAW = ["product_name", "product_category_tree"]


def _format_of(path: str, fmt: str | None) -> str:
    if fmt is None:
        fmt = FORMATS.get(os.path.splitext(path.rstrip("/"))[1].lower(), "csv")
    if fmt not in FORMATS.values():
        raise ValueError(f"unsupported catalogue format {fmt!r}; use one of {sorted(FORMATS.values())}")
    return fmt


def read_catalog(
    spark: SparkSession, path: str, fmt: str | None = None, multi_line: bool = True,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Raw catalogue from a CSV, JSON-lines or Parquet file or directory.

    CSV columns are bound by header name and stay strings; cells that mean
    "missing" become null. ``multi_line`` keeps line breaks inside quoted cells,
    at the price of one task per file: switch it off for large files without them.
    Rows get a source ordinal unless they carry one.
    """
    fmt = _format_of(path, fmt)
    reader = spark.read.schema(schema) if schema is not None else spark.read
    if fmt == "csv":
        raw = (
            reader.option("header", True).option("multiLine", multi_line)
            .option("escape", '"').option("encoding", "UTF-8").csv(path)
        )
        names = [c for c in raw.columns if c != ORDINAL]
        raw = raw.select(
            *[F.when(~F.col(f"`{c}`").isin(fv.NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in names],
            *([F.col(ORDINAL).cast("bigint").alias(ORDINAL)] if ORDINAL in raw.columns else []),
        )
    else:
        raw = reader.option("primitivesAsString", True).json(path) if fmt == "json" else reader.parquet(path)
        # nested cells (a specification object, a tree as an array) become the texts a CSV would hold
        nested = [f.name for f in raw.schema.fields if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
        raw = raw.withColumns({c: F.to_json(f"`{c}`") for c in nested})
    require_columns(raw, REQUIRED_RAW)
    return raw if ORDINAL in raw.columns else numbered(raw)


def numbered(raw: DataFrame) -> DataFrame:
    """Rows of a file scan with a dense ordinal from 0, in the order of file path and place in the file.

    One pass counts the rows of each split of a file (a row per split), a prefix sum over
    the splits gives each its first ordinal, and the rows take theirs by their place in the split.
    However the files are split, the ordinals are the same.
    """
    split = ["_file", "_start"]
    placed = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                        F.monotonically_increasing_id().alias("_id"))
    sizes = placed.groupBy(*split).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy("_all").orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("_all", F.lit(0)).select(  # splits, not rows, are ordered
        *split, (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, split).withColumn(ORDINAL, F.col("_id") + F.col("_shift")).drop(*split, "_id", "_shift")


def require_columns(df: DataFrame, columns: list[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def read_processed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A processed catalogue; null texts read as '' and numbers stay typed."""
    if fmt == "csv":
        df = (
            spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
        )
        typed = {"price": "double", "rating": "double", "reviews_count": "int", ORDINAL: "bigint"}
        df = df.select(*[
            F.col(c).try_cast(typed[c]).alias(c) if c in typed else F.col(c) for c in df.columns
        ])
    else:
        df = spark.read.format(fmt).load(path)
    return df.na.fill("")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_queries(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A query set: query_id, query_type, query, relevant_terms.

    In CSV the terms are one cell, separated by '|'.
    """
    fmt = _format_of(path, fmt)
    if fmt == "csv":
        df = spark.read.option("header", True).option("escape", '"').csv(path)
        df = df.withColumn("relevant_terms", F.split("relevant_terms", r"\|"))
    else:
        df = spark.read.format(fmt).load(path)
    require_columns(df, ["query_id", "query_type", "query", "relevant_terms"])
    return df
