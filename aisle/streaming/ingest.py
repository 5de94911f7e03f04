"""Row-wise preparation for catalogue rows that arrive as a stream.

Only steps that look at one row at a time are here; price caps and duplicate
removal compare rows and belong to the batch job over the landed table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from aisle.operators import clean
from aisle.operators.catalog import to_unified
from aisle.operators.enrich import enrich_descriptions


def prepare_rows(raw: DataFrame) -> DataFrame:
    """Unify, clean, drop empty names, fill defaults and enrich: works on batch and stream."""
    return (
        raw.transform(to_unified)
        .transform(clean.clean_text_fields)
        .transform(clean.normalize_ratings)
        .transform(clean.remove_empty)
        .transform(clean.fill_missing)
        .transform(enrich_descriptions)
    )
