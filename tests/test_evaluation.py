import math

import pytest

from aisle.operators import evaluation as e

CASES = [
    # flags by rank, k, total relevant, precision, recall
    ([1, 1, 0], 2, 2, 1.0, 1.0),
    ([0, 0, 0], 3, 0, 0.0, 0.0),
    ([1, 0, 1], 3, 2, 0.6667, 1.0),
    ([], 5, 3, 0.0, 0.0),
    ([1, 1, 0], 3, 2, 0.6667, 1.0),
    ([1, 0], 2, 3, 0.5, 0.3333),
    ([0, 1, 0], 3, 1, 0.3333, 1.0),
    ([0, 0, 0, 0, 0, 1], 5, 1, 0.0, 0.0),
]


@pytest.mark.parametrize("flags,k,total,precision,recall", CASES)
def test_metrics(spark, flags, k, total, precision, recall):
    rows = [("m", "q", i, bool(f)) for i, f in enumerate(flags, 1)]
    flagged = spark.createDataFrame(rows, "model_id string, query_id string, rank int, flag boolean")
    asked = spark.createDataFrame([("q", "t", total)], "query_id string, query_type string, total int")
    row = e.query_metrics(flagged, asked, ["m"], k, "total").first()
    first = next((i for i, f in enumerate(flags, 1) if f), None)
    hits = sum(flags[:k])
    ideal = sum(1 / math.log2(i + 1) for i in range(1, hits + 1))
    dcg = sum(f / math.log2(i + 1) for i, f in enumerate(flags[:k], 1))
    assert (row.precision_at_k, row.recall_at_k) == (precision, recall)
    assert row.mrr == round(1 / first, 4) if first else row.mrr == 0
    assert row.ndcg == pytest.approx(dcg / ideal if hits else 0, abs=1e-4)
    success = e.query_metrics(flagged, asked, ["m"], k).first().recall_at_k
    assert success == (1.0 if hits else 0.0)


def test_f1(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1.0, 1.0), (0.0, 0.0), (0.8, 0.6)], "p double, r double")
    got = [x[0] for x in df.select(e.f1(F.col("p"), F.col("r"))).collect()]
    assert got == pytest.approx([1.0, 0.0, 2 * 0.48 / 1.4])


def test_average_is_macro_over_rounded_values(spark, queries):
    flagged = spark.createDataFrame(
        [("m", "q1", 1, True), ("m", "q2", 1, False), ("m", "q2", 2, True)],
        "model_id string, query_id string, rank int, flag boolean",
    )
    report = e.average(e.query_metrics(flagged, queries, ["m"], 5)).collect()
    exact = next(r for r in report if r.query_type == "exact")
    assert (exact.precision_at_k, exact.mrr) == (0.75, 0.75)
    assert {r.query_type for r in report} == {"exact", "semantic", "vague"}


def test_relevance_fields(spark, queries):
    results = spark.createDataFrame(
        [("q1", "Shop", "Footwear", "Running gear", "x")], "query_id string, department string, category string, subcategory string, product_name string"
    )
    assert not e.flag_results(results, queries).first().flag
    wide = ("department", "category", "subcategory", "product_name")
    assert e.flag_results(results, queries, wide).first().flag


def test_report_lines(spark):
    report = spark.createDataFrame(
        [("m1", "exact", 0.5, 1.0, 0.25, 0.3, 0.6667, 12.34)],
        "model_id string, query_type string, precision_at_k double, recall_at_k double, mrr double, ndcg double, f1_score double, avg_query_time_ms double",
    )
    lines = [r.line for r in e.format_report(report).orderBy("_ord").collect()]
    assert lines[0] == "=" * 90 == lines[-1]
    assert lines[5].split() == ["m1", "exact", "0.500", "1.000", "0.250", "0.300", "0.667", "12.3ms"]
