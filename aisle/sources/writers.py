"""Sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.schema import ORDINAL


def write_catalog(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
        ).csv(path)
    else:
        writer.format(fmt).save(path)


def write_vectors(
    df: DataFrame, path: str, partition_by: str | None = None, mode: str = "overwrite"
) -> None:
    """(product_id, embedding) rows, in one directory per cell when asked."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """The evaluation report as JSON rows under path/json and as text under path/text."""
    from aisle.operators.evaluation import format_report

    report.write.mode("overwrite").json(f"{path}/json")
    lines = format_report(report)
    lines.orderBy(ORDINAL).select(F.col("line").alias("value")).coalesce(1).write.mode(
        "overwrite"
    ).text(f"{path}/text")
