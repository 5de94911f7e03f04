"""Relevance flags, ranking metrics and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.schema import ORDINAL

#: The fields a search result carries; pass all five level and name columns to
#: judge results that carry them.
RELEVANCE_FIELDS = ("department", "category", "product_name")
METRICS = ["precision_at_k", "recall_at_k", "mrr", "ndcg", "f1_score"]


def is_relevant(terms: Column, fields: Sequence[str] = RELEVANCE_FIELDS) -> Column:
    """Whether any term occurs in the concatenated lower-case fields."""
    haystack = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))
    return F.exists(terms, lambda t: F.contains(haystack, F.lower(t)))


def flag_results(
    results: DataFrame, queries: DataFrame, fields: Sequence[str] = RELEVANCE_FIELDS,
) -> DataFrame:
    """Results with ``query_type`` and a relevance ``flag``."""
    truth = queries.select("query_id", "query_type", "relevant_terms")
    joined = results.join(truth, "query_id")
    flag = F.coalesce(is_relevant(F.col("relevant_terms"), fields), F.lit(False))
    return joined.withColumn("flag", flag).drop("relevant_terms")


def _ideal_dcg(hits: Column) -> Column:
    ranks = F.when(hits > 0, F.sequence(F.lit(1), hits.cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    return F.aggregate(ranks, F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))


def f1(precision: Column, recall: Column) -> Column:
    total = precision + recall
    return F.when(total == 0, 0.0).otherwise(2 * precision * recall / total)


def measures(k: int, flag: Column, rank: Column) -> list[Column]:
    """Aggregates that all metrics of one query are computed from."""
    top = rank <= k
    return [
        F.count_if(top).alias("retrieved"),
        F.count_if(top & flag).alias("hits"),
        F.min(F.when(flag, rank)).alias("first_hit"),
        F.sum(F.when(top & flag, 1.0 / F.log2(rank + 1.0)).otherwise(0.0)).alias("dcg"),
    ]


def precision_at_k(hits: Column, retrieved: Column) -> Column:
    return F.when(retrieved > 0, hits / retrieved).otherwise(0.0)


def recall_at_k(hits: Column, total_relevant: Column) -> Column:
    return F.when(total_relevant > 0, F.least(hits / total_relevant, F.lit(1.0))).otherwise(0.0)


def mrr(first_hit: Column) -> Column:
    return F.coalesce(1.0 / first_hit, F.lit(0.0))


def ndcg_at_k(dcg: Column, hits: Column) -> Column:
    return F.when(hits > 0, dcg / _ideal_dcg(hits)).otherwise(0.0)


def query_metrics(
    flagged: DataFrame, queries: DataFrame, models: Sequence[str], k: int = 5,
    total_relevant: str | None = None,
) -> DataFrame:
    """One row of metrics per (model, query), queries without results included.

    Without ``total_relevant`` (a column of ``queries``) the relevant total is
    the number of hits, so recall is 1 for any hit: success at k.
    """
    asked = queries.select(
        "query_id", "query_type", *([F.col(total_relevant).alias("_total")] if total_relevant else []),
        F.explode(F.array(*[F.lit(m) for m in models])).alias("model_id"),
    )
    per_query = flagged.groupBy("model_id", "query_id").agg(*measures(k, F.col("flag"), F.col("rank")))
    joined = asked.join(per_query, ["model_id", "query_id"], "left").na.fill(
        {"retrieved": 0, "hits": 0, "dcg": 0.0}
    )
    hits = F.col("hits")
    total = F.col("_total") if total_relevant else hits
    scored = joined.withColumns({
        "_p": precision_at_k(hits, F.col("retrieved")), "_r": recall_at_k(hits, total),
    })
    return scored.select(
        "model_id", "query_type", "query_id",
        F.round("_p", 4).alias("precision_at_k"),
        F.round("_r", 4).alias("recall_at_k"),
        F.round("_r", 4).alias("success_at_k"),
        F.round(mrr(F.col("first_hit")), 4).alias("mrr"),
        F.round(ndcg_at_k(F.col("dcg"), hits), 4).alias("ndcg"),
        F.round(f1(F.col("_p"), F.col("_r")), 4).alias("f1_score"),
    )


def average(per_query: DataFrame) -> DataFrame:
    """Macro-average of the rounded per-query metrics, per model and query type."""
    return per_query.groupBy("model_id", "query_type").agg(
        *[F.round(F.avg(m), 4).alias(m) for m in METRICS]
    )


def format_report(report: DataFrame) -> DataFrame:
    """(_ord, line): the report as a text table, one row per line."""
    time = F.col("avg_query_time_ms") if "avg_query_time_ms" in report.columns else F.lit(None).cast("double")
    numbers = [F.format_string("%6.3f", F.col(m)) for m in METRICS]
    body = report.select(
        F.lit(1).alias("part"), "model_id", "query_type",
        F.concat_ws(
            " ", F.rpad("model_id", 25, " "), F.rpad("query_type", 10, " "), *numbers,
            F.when(time.isNull(), "        -").otherwise(F.format_string("%7.1fms", time)),
        ).alias("line"),
    )
    header = "%-25s %-10s %6s %6s %6s %6s %6s %8s" % ("Model", "Type", "P@K", "R@K", "MRR", "NDCG", "F1", "Time")
    head = ["=" * 90, "EVALUATION REPORT", "=" * 90, header, "-" * 90]
    spark = report.sparkSession
    fixed = [(0, str(i), "", line) for i, line in enumerate(head)] + [(2, "", "", "=" * 90)]
    frame = spark.createDataFrame(fixed, body.schema)
    order = F.struct("part", "model_id", "query_type")
    lines = body.unionByName(frame).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "line"))).alias("l"))
    return lines.select(F.posexplode("l").alias(ORDINAL, "e")).select(ORDINAL, F.col("e.line").alias("line"))
