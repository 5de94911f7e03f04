"""Quality benchmark: every model and the ensemble over a query set."""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv
from aisle.operators import evaluation, ranking
from aisle.operators.ranking import SearchIndex


def run_benchmarks(
    queries: DataFrame, index: SearchIndex, k: int = 5, models: Sequence[str] | None = None,
    fields: Sequence[str] = evaluation.RELEVANCE_FIELDS,
) -> DataFrame:
    """Macro-averaged metrics per (model, query type), over all queries at once.

    The routed models and the ensemble read the same neighbour tables, found and written once.
    Queries that are not valid have no results and count as failed.
    """
    models = [*index.loaded(), fv.ENSEMBLE] if models is None else list(models)
    single = [m for m in models if m != fv.ENSEMBLE]
    prepared = ranking.prepare(queries, k, dim=index.dim)
    shared = None
    if single and fv.ENSEMBLE in models:
        fetch = max(prepared.fetch, prepared.most * fv.ENSEMBLE_OVERFETCH)
        shared = ranking.shared_hits(prepared, index, index.loaded(), fetch)
    results = ranking.compare_models(queries, index, k, single, prepared, shared=shared) if single else None
    if fv.ENSEMBLE in models:
        voted = ranking.ensemble(queries, index, k, block=prepared.block, shared=shared).drop("votes")
        results = voted if results is None else results.unionByName(voted)
    flagged = evaluation.flag_results(results, queries, fields)
    return evaluation.average(evaluation.query_metrics(flagged, queries, models, k))


def run_timed(
    queries: DataFrame, index: SearchIndex, base: str, k: int = 5, models: Sequence[str] | None = None,
) -> DataFrame:
    """:func:`run_benchmarks` model by model, with the batch time per query in milliseconds.

    Each model's report is written under ``base`` while it is timed.
    """
    spark = queries.sparkSession
    asked = queries.count()
    report = None
    for model in [*index.loaded(), fv.ENSEMBLE] if models is None else models:
        path = f"{base}/{model}"
        started = time.perf_counter()
        run_benchmarks(queries, index, k, [model]).write.mode("overwrite").parquet(path)
        per_query = round((time.perf_counter() - started) * 1000 / max(asked, 1), 2)
        part = spark.read.parquet(path).withColumn("avg_query_time_ms", F.lit(per_query))
        report = part if report is None else report.unionByName(part)
    return report


def spot_check(queries: DataFrame, index: SearchIndex, k: int = 5) -> DataFrame:
    """Top results per model and ensemble with a relevance marker."""
    prepared = ranking.prepare(queries, k, dim=index.dim)
    fetch = max(prepared.fetch, prepared.most * fv.ENSEMBLE_OVERFETCH)
    shared = ranking.shared_hits(prepared, index, index.loaded(), fetch)
    results = ranking.compare_models(queries, index, k, prepared=prepared, shared=shared).unionByName(
        ranking.ensemble(queries, index, k, block=prepared.block, shared=shared).drop("votes")
    )
    flagged = evaluation.flag_results(results, queries)
    return flagged.select(
        "query_id", "model_id", "rank", "product_name", "department", "category", "confidence_score",
        F.when(F.col("flag"), "RELEVANT").otherwise("NOT RELEVANT").alias("marker"),
    )
