"""Dictionaries and rules held by the tasks, the joins beyond that, and ordinals of any split."""

import pytest

from aisle import sources
from aisle.operators import queries as q
from aisle.schema import ORDINAL


@pytest.mark.parametrize("limit", [None, 0])
def test_lemmas_of_repeated_keys(spark, limit):
    rows = [(1, "red hats"), (1, "blue shoes"), (1, "blue shoes"), (2, None), (3, ""), (None, "Shoes shoes xyz"), (4, "hats " * 5000)]
    lexicon = spark.createDataFrame([("hats", "hat"), ("shoes", "shoe"), ("shoes", "zzz"), (None, "x"), ("xyz", None)], "form string, lemma string")
    frame = spark.createDataFrame(rows, "id int, t string")
    found = sorted((r.id or 0, r.t or "", r.lemmatized) for r in q.lemmatize_join(frame, "t", lexicon, "id", limit=limit).collect())
    assert found == sorted([
        (1, "red hats", "red hat"), (1, "blue shoes", "blue shoe"), (1, "blue shoes", "blue shoe"), (2, "", ""), (3, "", ""),
        (0, "Shoes shoes xyz", "Shoes shoe xyz"), (4, "hats " * 5000, " ".join(["hat"] * 5000))])


def test_lemmas_in_place_join_nothing(spark):
    lexicon = spark.createDataFrame([("hats", "hat")], "form string, lemma string")
    plan = q.lemmatize_join(spark.createDataFrame([(1, "hats")], "id int, t string"), "t", lexicon, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan


@pytest.mark.parametrize("limit", [None, 0])
def test_triggers_overlap_and_repeat(spark, limit):
    rules = spark.createDataFrame([(1, "gift", "present"), (2, "if", "maybe"), (3, "gift for", "party"), (4, "", "never"), (5, None, "never"),
                                   (1, "gif", "present"), (6, "ü", "umlaut")], "ord int, trigger string, terms string")
    asked = spark.createDataFrame([(1, "GIFT for mum"), (2, "hat"), (3, ""), (4, None), (5, "Über if")], "query_id int, query string")
    found = {r.query_id: r.expanded for r in q.expand(asked, rules, limit=limit).collect()}
    assert found == {1: "GIFT for mum present maybe party", 2: "hat", 3: "", 4: None, 5: "Über if maybe umlaut"}


def test_empty_dictionaries(spark):
    asked = spark.createDataFrame([(1, "hats")], "query_id int, query string")
    assert q.expand(asked, spark.createDataFrame([], "ord int, trigger string, terms string")).first().expanded == "hats"
    assert q.lemmatize_join(asked, "query", spark.createDataFrame([], "form string, lemma string"), "query_id").first().lemmatized == "hats"


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_ordinals_do_not_depend_on_splits(spark, tmp_path, fmt):
    path = str(tmp_path / "raw")
    rows = spark.range(0, 3000).selectExpr("cast(id as string) product_name", "'A >> B' product_category_tree", "repeat('x', 40) d").repartition(3)
    rows.write.format(fmt).option("header", True).save(path)
    seen = []
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("4k", "32k", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            read = sources.read_catalog(spark, path, fmt, **({"multi_line": False} if fmt == "csv" else {}))
            seen.append(sorted((r[ORDINAL], r.product_name) for r in read.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [i for i, _ in seen[0]] == list(range(3000))
    assert seen[0] == seen[1] == seen[2]
