import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.operators import clean, stats


def one(df):
    return df.first()[0]


def test_duplicate_id_removed(catalog):
    again = catalog.where("_ord = 0").withColumn("_ord", F.lit(10).cast("bigint"))
    assert clean.run(catalog.unionByName(again)).count() == 10


def test_first_occurrence_is_kept_id_before_name(spark):
    rows = [(3, "a", "lamp", "x"), (1, "a", "desk", "x"), (2, "b", "desk", "x"), (4, "c", "lamp", "x"), (5, None, None, "x"), (6, "d", None, "x")]
    df = spark.createDataFrame(rows, "_ord bigint, product_id string, product_name string, category string")
    assert sorted(r._ord for r in clean.remove_duplicates(df).collect()) == [1, 4, 5]


def test_a_key_with_a_third_of_all_rows(spark):
    df = spark.range(9000).select(
        F.col("id").alias("_ord"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("product_id"),
        F.concat(F.lit("n"), "id").alias("product_name"), F.lit("c").alias("category"),
    )
    kept = clean.remove_duplicates(df)
    assert kept.count() == 6001 and kept.where("product_id = 'hot'").first()._ord == 0


def test_empty_name_removed(catalog):
    gaps = catalog.withColumn("product_name", F.when(F.col("_ord") == 0, " ab ").otherwise(F.col("product_name")))
    assert clean.run(gaps).count() == 9


def test_rating_capped_and_missing_brand_filled(catalog):
    odd = catalog.withColumn("rating", F.when(F.col("_ord") == 0, 7.0).otherwise(F.col("rating"))).withColumn(
        "brand", F.when(F.col("_ord") != 1, F.col("brand")))
    ready = clean.run(odd)
    assert ready.agg(F.max("rating")).first()[0] == 5.0
    assert ready.where("_ord = 1").first().brand == "Unknown"
    kept_blank = clean.run(odd, blank_is_missing=False)
    assert kept_blank.where("_ord = 1").first().brand == ""


def test_missing_column_is_an_error(catalog):
    with pytest.raises(ValueError, match="department"):
        clean.validate_schema(catalog.drop("department"))


@pytest.mark.parametrize("p", [0.0, 0.5, 0.999, 1.0, 0.3333])
@pytest.mark.parametrize("kind", ["distinct", "hot", "constant", "single"])
def test_percentile_is_exact(spark, p, kind):
    rng = np.random.default_rng(3)
    values = {
        "distinct": rng.normal(size=5000), "constant": np.full(300, 7.5), "single": np.array([4.0]),
        "hot": np.concatenate([np.full(2000, 3.25), rng.integers(0, 9, 4000)]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values], "price double")
    assert one(clean.percentile_exact(df, "price", p)) == pytest.approx(float(np.quantile(values, p)), abs=1e-9)


def test_outliers_are_set_to_the_cap(spark):
    prices = [100.0] * 2000 + [1e9, None]
    df = spark.createDataFrame([(v,) for v in prices], "price double")
    cap = float(np.quantile([p or 0.0 for p in prices], 0.999))
    out = [r.price for r in clean.normalize_prices(df).collect()]
    assert max(out) == pytest.approx(cap) and min(out) == 0.0 and len(out) == 2002


def test_counters_fill_during_the_action(catalog):
    again = catalog.where("_ord = 0").withColumn("_ord", F.lit(10).cast("bigint"))
    ready, counters = clean.run_observed(catalog.unionByName(again))
    assert len(ready.collect()) == 10
    assert {k: c.get["rows"] for k, c in counters.items()} == {"input": 11, "deduplicated": 10, "non_empty": 10}


def test_stats(catalog):
    row = stats.dataset_stats(catalog).first()
    assert (row.total_products, row.departments, row.products_with_features) == (10, 4, 8)
    approx = stats.dataset_stats(catalog, approximate=True).first()
    assert approx.departments == 4
    top = stats.product_stats(catalog, 2).first()
    assert [(e.value, e["count"]) for e in top.department_counts] == [("Electronics", 3), ("Fashion", 3)]


def test_percentile_narrows_in_rounds_without_a_window(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.lognormal(0, 9, 40000), np.full(20000, 2.5), -rng.lognormal(0, 3, 5000)])
    df = spark.createDataFrame([(float(v),) for v in values], "price double")
    for p in (0.001, 0.4, 0.999):
        assert one(clean.percentile_exact(df, "price", p)) == pytest.approx(float(np.quantile(values, p)), rel=1e-12)
    plan = clean.percentile_exact(df, "price", 0.999)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    assert one(clean.percentile_exact(df.where("false"), "price", 0.5)) is None


def test_removal_report_reads_its_input_once(spark, catalog):
    extra = catalog.where("_ord < 3").withColumn("_ord", F.col("_ord") + 100)
    blank = catalog.where("_ord = 0").withColumns({"_ord": F.lit(200).cast("bigint"), "product_id": F.lit("new"), "product_name": F.lit(" x ")})
    df = catalog.unionByName(extra).unionByName(blank)
    assert {r.step: r["rows"] for r in clean.removal_report(df).collect()} == {"input": 14, "deduplicated": 11, "non_empty": 10}
    assert {r.step: r["rows"] for r in clean.removal_report(df.where("false")).collect()} == {"input": 0, "deduplicated": 0, "non_empty": 0}
