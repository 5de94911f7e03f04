"""What the physical plans must and must not contain."""

import pytest

from aisle.operators import catalog as ops
from aisle.operators import clean, enrich, ranking
from aisle.functions import fixed_values as fv


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_pairwise_joins_in_searches(queries, index):
    for df in (
        ranking.search(queries, index, fv.FLAT), ranking.search(queries, index, fv.HIERARCHICAL),
        ranking.ensemble(queries, index),
    ):
        text = plan(df)
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
        assert "WindowGroupLimit" in text


def test_catalogue_is_not_shuffled_for_results(queries, index):
    p = ranking.prepare(queries, 3, dim=64)
    assert "SortMergeJoin" not in plan(ranking.search_flat(p.queries, index, 3, p.block))


def test_text_work_stays_in_the_jvm(catalog):
    text = plan(enrich.enrich_descriptions(clean.clean_text_fields(catalog)))
    assert "Python" not in text and "InArrow" not in text and "InPandas" not in text


def test_filters_reach_the_scan(index):
    text = plan(ops.filter_products(index.catalog, min_price=10, max_price=20).select("product_id"))
    assert "GreaterThanOrEqual(price,10.0)" in text
    assert "ReadSchema: struct<product_id:string,price:double>" in text


def test_duplicates_are_found_on_narrow_rows(spark, index):
    unified = index.catalog.drop("enriched_description")
    text = plan(clean.remove_duplicates(unified))
    narrow = [line for line in text.splitlines() if "FileScan" in line and "description" not in line.split("ReadSchema")[1]]
    assert narrow and "LeftSemi" in text


@pytest.mark.parametrize("name", [
    "to_unified", "clean_run", "enhanced_text", "normalize_queries", "encode", "knn_grouped", "hierarchy_build",
    "search_hierarchical", "search_filtered", "ensemble", "query_metrics", "expand_rules_table", "export_json",
    "export_json_document", "page_indexed", "page", "leaf_products", "children", "removal_report", "price_cap", "prepare_job",
    "validate_schema",
])
def test_registered_query_against_duckdb(spark, sf_dir, name):
    from checks.parity import compare, connect
    from checks.registry import REGISTRY

    status, _, _, note = compare(spark, connect(sf_dir), sf_dir, *REGISTRY[name])
    assert status == "ok", note


def test_every_registered_query_has_a_statement_or_a_reason():
    from checks.registry import REGISTRY

    without = {n for n, (_, sql) in REGISTRY.items() if sql is None}
    assert without == {"knn_ivf"}


def test_only_rows_that_stay_have_their_texts_cleaned(index):
    unified = index.catalog.drop("enriched_description")
    below = clean.run(unified)._jdf.queryExecution().optimizedPlan().toString().split("Join LeftSemi", 1)[1]
    assert "replacement" not in below
