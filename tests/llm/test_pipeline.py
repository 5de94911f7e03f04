"""The pipeline's stages against their operators and brute force."""

import pytest

import corpus_pipeline
from aisle.llm import packing, quality_rules
from tests.llm.test_filters import measures
from tests.llm.test_joins import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_quality_stage(spark, documents):
    kept = corpus_pipeline.quality(spark, documents, SF)
    assert kept.columns == documents.columns
    found = {r.doc_id for r in kept.collect()}
    for r in documents.collect():
        n, _, _, _, repeats = measures(r.text)
        if n < 20 or 100 * repeats > 30 * n:
            assert r.doc_id not in found
    assert found == {r.doc_id for r in quality_rules.judge(documents).where("kept").collect()}


def test_language_stage_keeps_texts(spark, documents):
    kept = corpus_pipeline.languages(spark, documents, SF)
    assert kept.columns == documents.columns and kept.count() >= 0.99 * documents.count()


def test_near_duplicate_stage(spark, documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    wanted = {i for i, (_, component) in brute(rows, 5, 80, 100).items() if i == component}
    kept = corpus_pipeline.near_duplicates(spark, documents, SF)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == wanted


def test_whole_run(spark, documents):
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "language_id", "near_duplicates", "best_fit_packing"]
    assert set(packed.doc_id) <= {r.doc_id for r in documents.collect()} and packed.groupby("sequence_id").length.sum().max() <= packing.LENGTH


def test_stages_take_hard_and_empty_tables(spark, hard, nothing):
    for frame in (hard, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            if name == "best_fit_packing":
                assert out.where("piece = 0").count() == frame.count()
            else:
                assert out.columns == frame.columns and out.count() <= frame.count()


def test_stages_keep_columns_of_any_name(spark, hard):
    names = ["kept", "failed_rule", "_row", "_text_hash", "_row_"]
    frame = hard.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, frame, SF).collect()
        assert rows and all(r[n] == (None if r.doc_id is None else f"{n}{r.doc_id}") for r in rows for n in names)
