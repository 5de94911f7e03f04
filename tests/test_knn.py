import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.functions import vectors as v
from aisle.operators import encode, knn


def frame(spark, matrix, name):
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(matrix)]
    return spark.createDataFrame(rows, f"{name} bigint, embedding array<float>")


@pytest.fixture(scope="module")
def matrix():
    return np.random.default_rng(42).normal(size=(10, 384)).astype(np.float32)


@pytest.fixture(scope="module")
def big():
    base = np.random.default_rng(1).normal(size=(400, 16)).astype(np.float32)
    base[100:230] = base[100]  # a third of the rows are copies
    return base


def brute(queries, targets, k):
    d = ((queries[:, None, :].astype(float) - targets[None].astype(float)) ** 2).sum(-1).round(9)
    return {(q, int(t), r + 1) for q in range(len(queries)) for r, t in enumerate(np.lexsort((np.arange(len(targets)), d[q]))[:k])}


def ranks(hits):
    return {(r.query_id, r.target_id, r.rank) for r in hits.collect()}


def test_nearest_to_a_stored_vector_is_itself(spark, matrix):
    targets = frame(spark, matrix, "row_id")
    hits = knn.flat(frame(spark, matrix[3:4], "query_id"), targets, 3, "row_id").orderBy("rank").collect()
    assert len(hits) == 3 and hits[0].target_id == 3 and hits[0].distance == 0.0


def test_unnormalised_vectors_rank_by_l2(spark):
    targets = frame(spark, np.array([[10.0, 0.0], [0.0, 1.5]]), "row_id")
    queries = frame(spark, np.array([[1.0, 0.0]]), "query_id")
    assert knn.flat(queries, targets, 1, "row_id").first().target_id == 1


def test_k_larger_than_the_table(spark, matrix):
    hits = knn.flat(frame(spark, matrix[:2], "query_id"), frame(spark, matrix, "row_id"), 50, "row_id")
    assert hits.count() == 20


def test_broadcast_and_grouped_agree_with_brute_force(spark, big, monkeypatch):
    targets, queries = frame(spark, big, "row_id").repartition(7), frame(spark, big[::9], "query_id")
    expected = brute(big[::9], big, 12)
    assert ranks(knn.flat(queries, targets, 12, "row_id")) == expected
    monkeypatch.setattr(knn, "BLOCK_ROWS", 10)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 60)
    assert knn.query_block(queries) is None
    assert ranks(knn.flat(queries, targets, 12, "row_id")) == expected


def test_deep_results_are_found_in_several_scans(spark, big, monkeypatch):
    targets, queries = frame(spark, big, "row_id"), frame(spark, big[::9], "query_id")
    monkeypatch.setattr(knn, "HELD_ROWS", 120)
    assert ranks(knn.flat(queries, targets, 12, "row_id")) == brute(big[::9], big, 12)
    monkeypatch.setattr(knn, "PUSHED_KEYS", 2)
    cells = knn.build_cells(targets, 8, "row_id")
    assert ranks(knn.ivf(queries, cells, 5, 8, "row_id")) == brute(big[::9], big, 5)


def test_probing_every_cell_is_exact_also_with_a_hot_cell(spark, big, monkeypatch):
    targets, queries = frame(spark, big, "row_id"), frame(spark, big[::9], "query_id")
    cells = knn.build_cells(targets, 8, "row_id")
    assert cells.vectors.count() == 400
    expected = brute(big[::9], big, 5)
    assert ranks(knn.ivf(queries, cells, 5, 8, "row_id")) == expected
    monkeypatch.setattr(knn, "BLOCK_ROWS", 10)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 30)
    assert ranks(knn.ivf(queries, cells, 5, 8, "row_id")) == expected


def test_few_probes_return_a_subset_of_cells(spark, big):
    cells = knn.build_cells(frame(spark, big, "row_id"), 8, "row_id")
    hits = knn.ivf(frame(spark, big[::50], "query_id"), cells, 3, 2, "row_id")
    assert hits.groupBy("query_id").count().where("count = 3").count() == 8


def test_default_cells():
    assert [knn.default_cells(n) for n in (5, 10, 200, 5000)] == [2, 3, 14, 70]


def test_offsets_are_added_per_probe(spark):
    targets = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "c", [1.0, 0.0])], "row_id bigint, key string, embedding array<float>")
    queries = frame(spark, np.array([[1.0, 0.0]]), "query_id")
    probes = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.75)], "query_id bigint, key string, offset double")
    hits = knn.nearest(queries, targets, 5, "row_id", "cosine", probes=probes, key="key").orderBy("rank").collect()
    assert [(h.target_id, h.score) for h in hits] == [(2, 1.75), (1, 1.5)]


def test_empty_tables(spark, matrix):
    targets, queries = frame(spark, matrix, "row_id"), frame(spark, matrix, "query_id")
    assert knn.flat(queries.limit(0), targets, 3, "row_id").count() == 0
    assert knn.flat(queries, targets.limit(0), 3, "row_id").count() == 0


def test_keys_with_quotes(spark):
    targets = spark.createDataFrame([(1, "men's \\ wear", [1.0])], "row_id bigint, key string, embedding array<float>")
    queries = frame(spark, np.array([[1.0]]), "query_id")
    probes = spark.createDataFrame([(0, "men's \\ wear", 0.0)], "query_id bigint, key string, offset double")
    assert knn.nearest(queries, targets, 1, "row_id", "dot", probes=probes, key="key").count() == 1


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    row, zero = df.select(
        v.l2_normalize(F.col("a")).alias("u"), v.cosine(F.col("a"), F.col("b")).alias("c"),
        v.squared_l2(F.col("a"), F.col("b")).alias("d"), v.dot_nonzeros(v.nonzeros(F.col("a")), F.col("b")).alias("n"),
    ).collect()
    assert (row.u, row.c, row.d, row.n) == (pytest.approx([0.6, 0.8]), 0.96, 2.0, 24.0)
    assert (zero.u, zero.c) == ([0.0, 0.0], 0.0)


def test_encoder_is_unit_length_and_stable(spark):
    df = spark.createDataFrame([("a", "Red lamp, red desk"), ("b", "red LAMP red desk!"), ("c", ""), ("d", None)], "id string, t string")
    rows = {r.id: np.array(r.embedding) for r in encode.encode(df, "t", dim=32).collect()}
    assert np.array_equal(rows["a"], rows["b"]) and np.linalg.norm(rows["a"]) == pytest.approx(1, abs=1e-6)
    assert not rows["c"].any() and not rows["d"].any() and len(rows["c"]) == 32


def test_user_model_sees_distinct_texts_in_batches(spark):
    def load():
        def model(texts):
            assert len(texts) <= 4
            return np.array([[len(t), 1.0] for t in texts])
        return model

    df = spark.range(50).select("id", F.concat(F.lit("x"), (F.col("id") % 5).cast("string")).alias("t"))
    for distinct in (True, False):
        out = encode.encode_with(df, "t", load, batch_size=4, normalize=False, distinct=distinct)
        assert [list(r.embedding) for r in out.collect()] == [[2.0, 1.0]] * 50


@pytest.mark.parametrize("scale", [1e-3, 1.0, 1e3, 1e6])
def test_neighbours_of_vectors_of_any_size(spark, scale):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(400, 8)) * scale
    frame = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "product_id bigint, embedding array<double>")
    asked = frame.where("product_id % 40 = 0").withColumnRenamed("product_id", "query_id")
    found = knn.flat(asked, frame, 3).where("rank = 1").collect()
    assert {r.query_id for r in found} == set(range(0, 400, 40))
    assert all(r.query_id == r.target_id for r in found)


def test_vectors_that_are_not_numbers_have_no_neighbours(spark):
    rows = [(1, [0.0, 1.0]), (2, [float("nan"), 0.0]), (3, None), (4, [float("inf"), 0.0]), (5, [0.5, 0.5]), (6, [None, 1.0])]
    frame = spark.createDataFrame(rows, "product_id bigint, embedding array<double>")
    found = knn.flat(frame.withColumnRenamed("product_id", "query_id"), frame, 5).collect()
    assert {(r.query_id, r.target_id) for r in found} == {(1, 1), (1, 5), (5, 1), (5, 5)}


@pytest.mark.parametrize("metric", ["l2", "dot", "cosine"])
def test_many_queries_are_streamed_past_targets_that_stay_in_place(spark, big, monkeypatch, metric):
    big = big * np.linspace(0.1, 30, len(big), dtype=np.float32)[:, None]  # lengths differ, so whole blocks are out of reach
    targets, queries = frame(spark, big, "row_id").repartition(3), frame(spark, big[::2], "query_id")
    expected = ranks(knn.nearest(queries, targets, 7, "row_id", metric))
    monkeypatch.setattr(knn, "BLOCK_ROWS", 30)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 25)
    for places in (10**9, 300):  # one scan, several scans
        monkeypatch.setattr(knn, "STREAMED_PLACES", places)
        found = knn.nearest(queries, targets, 7, "row_id", metric)
        assert ranks(found) == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" not in plan and "Generate" not in plan
        assert plan.count("MapInArrow") == 1 if places == 10**9 else plan.count("MapInArrow") > 1  # target scans


def test_streamed_queries_and_targets_that_are_not_numbers(spark, monkeypatch):
    monkeypatch.setattr(knn, "BLOCK_ROWS", 2)
    rows = [("a", [0.0, 1.0]), ("b", [float("nan"), 0.0]), ("c", None), ("d", [float("inf"), 0.0]), ("e", [0.5, 0.5]), ("f", [None, 1.0])]
    targets = spark.createDataFrame(rows, "product_id string, embedding array<double>")
    found = knn.flat(targets.withColumnRenamed("product_id", "query_id"), targets, 5).collect()
    assert {(r.query_id, r.target_id) for r in found} == {("a", "a"), ("a", "e"), ("e", "a"), ("e", "e")}


def test_recall_of_cells_by_probes(spark, sf_dir):
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    asked = vectors.where("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    exact = knn.flat(asked, vectors, 10, "vec_id").select("query_id", "target_id")
    cells = knn.build_cells(vectors, target_id="vec_id")
    for probes, least in ((None, 0.85), (12, 0.9)):
        near = knn.ivf(asked, cells, 10, *([probes] if probes else []), target_id="vec_id").select("query_id", "target_id")
        assert exact.intersect(near).count() >= least * exact.count()


def test_small_chunks_of_a_group_copy_no_query(spark, big):
    targets = frame(spark, big, "row_id").withColumn("cell", F.lit(0))
    queries = frame(spark, big[::9], "query_id")
    probes = queries.select("query_id", F.lit(0).alias("key"), F.lit(0.0).alias("offset"))
    hits = knn._nearest_grouped(queries, targets, 12, "row_id", "l2", "embedding", probes, "cell", 20)
    assert hits.count() == 12 * len(big[::9])  # one task's lists, not one for each 20 targets
    assert ranks(knn.merge_top_k(hits, 12)) == brute(big[::9], big, 12)


def test_small_blocks_of_streamed_queries_are_no_jobs(spark, big):
    targets, queries = frame(spark, big, "row_id"), frame(spark, big, "query_id")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("streamed", "")
    hits = knn._nearest_streamed(queries, targets, 5, "row_id", "l2", "embedding", block_rows=10)
    spark.sparkContext.setJobGroup("", "")
    assert len(tracker.getJobIdsForGroup("streamed")) < 20  # 40 blocks
    assert ranks(knn.merge_top_k(hits, 5)) == brute(big, big, 5)


def test_encoder_counts_the_buckets_of_the_words_and_hashes_a_word_once(spark, monkeypatch):
    import pandas as pd
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import vector_to_array

    texts = ["a b a", "", None, "Été LAMP lamp-x 9\nÀb", "\u212aelvin \u0130x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    counted = Normalizer(p=2.0, inputCol="_tf", outputCol="_u").transform(encode.bucket_counts(df, "t", 32))
    wanted = {r.id: r.e for r in counted.select("id", vector_to_array("_u", "float32").alias("e")).collect()}
    assert {r.id: r.embedding for r in encode.encode(df, "t", dim=32).collect()} == wanted
    hashed, md5 = [], encode.hashlib.md5
    monkeypatch.setattr(encode.hashlib, "md5", lambda w: hashed.append(w) or md5(w))
    rows = [r for s in encode._unit_vectors(iter([pd.Series(["a b a", "b"]), pd.Series(["a c"])]), 32, True) for r in s]
    assert sorted(hashed) == [b"a", b"b", b"c"] and len(rows) == 3
