import numpy as np
import pytest
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv
from aisle.functions import intent
from aisle.operators import hierarchy, knn, ranking
from aisle.operators.ranking import SearchIndex
from aisle.plans import benchmark, index as tables
from aisle.schema import RESULT_COLUMNS


@pytest.fixture(scope="module")
def routed(queries, index):
    return {m: ranking.search(queries, index, m, 3).cache() for m in fv.MODELS}


@pytest.mark.parametrize("model", fv.MODELS)
def test_ranks_have_no_gaps_and_scores_are_bounded(routed, model):
    rows = routed[model].collect()
    assert rows and routed[model].columns == RESULT_COLUMNS
    for query in {r.query_id for r in rows}:
        mine = sorted((r for r in rows if r.query_id == query), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3]
        assert all(0 <= r.confidence_score <= 1 for r in mine)
        assert [r.confidence_score for r in mine] == sorted((r.confidence_score for r in mine), reverse=True)


def test_obvious_queries(routed):
    top = {(m, r.query_id): r.product_id for m in fv.MODELS for r in routed[m].where("rank = 1").collect()}
    assert top[(fv.FLAT, "q4")] == top[(fv.ENHANCED, "q4")] == top[(fv.HIERARCHICAL, "q4")] == "P009"
    assert top[(fv.FLAT, "q1")] == "P001"
    assert top[(fv.EXPANDED, "q3")] == "P003"


def test_refined_query_is_returned(queries, index):
    p = ranking.prepare(queries, 2, dim=64)
    rows = ranking.search_expanded(p.queries, index, 2).where("query_id = 'q3'").collect()
    assert rows[0].refined_query.startswith("something to watch movies on television tv")


def test_ensemble_of_one_model_keeps_its_order(queries, index):
    p = ranking.prepare(queries.where("query_id in ('q3', 'q4')"), 3, dim=64, overfetch=2)
    alone = ranking.search_flat(p.queries, index, p.fetch, p.block).where("rank <= 3")
    voted = ranking.ensemble(queries.where("query_id in ('q3', 'q4')"), index, 3, {fv.FLAT: 1.0})
    key = lambda df: {(r.query_id, r["rank"]): r.product_id for r in df.collect()}
    assert key(alone) == key(voted)


def test_ensemble_votes_and_missing_models(queries, index):
    votes = {r.votes for r in ranking.ensemble(queries, index, 3).collect()}
    assert max(votes) == 4
    partial = SearchIndex(catalog=index.catalog, flat=index.flat, dim=64)
    assert partial.loaded() == [fv.FLAT]
    assert {r.votes for r in ranking.ensemble(queries, partial, 3).collect()} == {1}
    with pytest.raises(ValueError, match="not loaded"):
        ranking.search(queries, partial, fv.ENHANCED)
    with pytest.raises(ValueError, match="unknown model"):
        ranking.search(queries, partial, "other")


def test_filters_apply_before_the_search(queries, index):
    rows = ranking.search(queries, index, fv.FLAT, 3, filters={"department": "electronics", "min_rating": 4.5}).collect()
    assert {r.product_id for r in rows} == {"P003", "P005"}
    assert all(r.department == "Electronics" for r in rows)


def test_min_confidence(queries, index):
    assert all(r.confidence_score >= 0.3 for r in ranking.search(queries, index, fv.FLAT, 5, min_confidence=0.3).collect())


def test_query_intent(spark):
    asked = ["Men's tee", "girl dress", "gifts for ladies t shirt", "lamp", "womens and mens", "baby boy"]
    df = spark.createDataFrame([(a,) for a in asked], "q string")
    c = intent.query_constraints(F.col("q"))
    rows = df.select(c["gender"].alias("g"), c["wants_tshirt"].alias("t"), c["wants_kids"].alias("k")).collect()
    assert [(r.g, r.t, r.k) for r in rows] == [
        ("men", True, False), ("women", False, True), ("women", True, False), (None, False, False),
        ("men", False, False), ("men", False, True),
    ]


@pytest.mark.parametrize("name,gender,tshirt,kids,expected", [
    ("shirt for women", "men", False, False, 0.5 * 0.35),
    ("shirt for men", "men", False, False, 0.5 * 1.2),
    ("shirt for men and women", "men", False, False, 0.5 * 1.2),
    ("kids shirt for men", "men", False, False, 0.5 * 1.2 * 0.6),
    ("kids shirt for men", "men", False, True, 0.5 * 1.2),
    ("t-shirt bra", None, True, False, 0.5 * 0.3 * 1.15),
    ("polo neck", None, True, False, 0.5 * 1.15),
    ("desk", "women", True, False, 0.5),
])
def test_adjusted_score(spark, name, gender, tshirt, kids, expected):
    df = spark.createDataFrame([(name, gender, tshirt, kids)], "n string, g string, t boolean, k boolean")
    has = intent.result_flags(F.col("n"), F.lit(""), F.lit(""), F.lit(""))
    wants = {"gender": F.col("g"), "wants_tshirt": F.col("t"), "wants_kids": F.col("k")}
    assert df.select(intent.adjusted_score(F.lit(0.5), wants, has)).first()[0] == pytest.approx(expected)


def test_rerank_score(spark):
    df = spark.createDataFrame(
        [(5.0, 1000, 20000.0, "In Stock"), (0.0, 0, 0.0, "Out of Stock"), (None, None, None, None)],
        "rating double, reviews_count int, price double, stock_status string",
    )
    got = [r[0] for r in df.select(ranking.rerank_score(F.lit(1.0))).collect()]
    assert got == pytest.approx([1.0, 0.85 + 0.03 * 0.3 + 0.05 * 0.2, 0.85 + 0.03 * 0.3 + 0.05 * 0.2])


def brute_beam(index, query_vector, decay=0.85, widths=(5, 5, 5, 3)):
    """The taxonomy search of one query, walked node by node."""
    import numpy as np

    nodes = index.nodes.collect()
    products = index.leaves.collect()

    def cosine(a):
        a = np.array(a, dtype=float)
        size = np.linalg.norm(a) * np.linalg.norm(query_vector)
        return max(float(a @ query_vector) / size, 0.0) if size else 0.0

    paths = [("ROOT", [])]
    for width in widths:
        below = []
        for node, scores in paths:
            kids = [(n.node_id, round(cosine(n.embedding), 9)) for n in nodes if n.parent_id == node]
            below += [(k, scores + [s]) for k, s in sorted(kids, key=lambda x: (-x[1], x[0]))[:width]]
        paths = below
    best = {}
    for node, scores in paths:
        for p in products:
            if p.node_id == node:
                total = sum(s * decay ** (4 - i) for i, s in enumerate(scores)) + cosine(p.embedding)
                best[p.product_id] = max(best.get(p.product_id, 0), round(total / 5, 6))
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def test_beam_search_against_a_walk(queries, index):
    import numpy as np

    p = ranking.prepare(queries, 4, dim=64)
    hits = hierarchy.search(p.queries, index.nodes, index.leaves, 4, block=p.block).collect()
    for row in p.queries.collect():
        mine = sorted((h for h in hits if h.query_id == row.query_id), key=lambda h: h["rank"])
        expected = brute_beam(index, np.array(row.embedding, dtype=float))[:4]
        assert [round(h.score, 5) for h in mine] == pytest.approx([round(s, 5) for _, s in expected], abs=2e-5)
        assert [h.target_id for h in mine] == [i for i, _ in expected]


def test_large_query_tables_give_the_same_results(queries, index, routed, monkeypatch):
    from aisle.operators import knn

    monkeypatch.setattr(knn, "BLOCK_ROWS", 2)
    monkeypatch.setattr(knn, "CHUNK_ROWS", 3)
    for model in (fv.HIERARCHICAL, fv.ENHANCED):
        grouped = ranking.search(queries, index, model, 3)
        assert sorted(map(tuple, grouped.collect())) == sorted(map(tuple, routed[model].collect()))


def test_benchmark_covers_queries_without_hits(queries, index):
    report = {(r.model_id, r.query_type): r for r in benchmark.run_benchmarks(queries, index, 3).collect()}
    assert len(report) == 5 * 3
    assert report[(fv.FLAT, "semantic")].mrr == 1.0
    assert report[(fv.FLAT, "vague")].precision_at_k < 1


def test_timed_benchmark(queries, index, tmp_path):
    rows = benchmark.run_timed(queries, index, str(tmp_path), 3, [fv.FLAT]).collect()
    assert {r.query_type for r in rows} == {"exact", "semantic", "vague"}
    assert all(r.model_id == fv.FLAT and r.avg_query_time_ms > 0 for r in rows)


def test_cells_are_used_and_saved_when_large(spark, queries, index, tmp_path):
    tables.save_all(index, str(tmp_path), cells=True, nlist=2)
    saved = tables.load_all(spark, str(tmp_path), 64)
    assert saved.flat_cells is not None and saved.enhanced_cells is not None
    from aisle.operators import knn

    p = ranking.prepare(queries, 3, dim=64)
    everything = knn.ivf(p.queries, saved.flat_cells, 3, 2, block=p.block)
    exact = knn.flat(p.queries, saved.flat, 3, block=p.block)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, exact.collect()))
    assert ranking.search(queries, saved, fv.FLAT, 3).count() > 0


def test_list_models(spark, index, tmp_path):
    rows = {r.model_id: (r.loaded, r.vectors) for r in tables.list_models(index).collect()}
    assert rows == {m: (True, 10) for m in fv.MODELS}
    tables.save(index.catalog, f"{tmp_path}/catalog")
    tables.save(index.flat, f"{tmp_path}/flat_vectors")
    assert tables.load_all(spark, str(tmp_path)).loaded() == [fv.FLAT]
    with pytest.raises(ValueError, match="no catalogue"):
        tables.load_all(spark, f"{tmp_path}/none")


def test_node_ids_are_unique_when_names_hold_colons(spark, catalog):
    rows = [("A:B", "C"), ("A", "B:C"), ("A\\", ":B"), ("A", "C")]
    frame = spark.createDataFrame([(f"P{i}", *r, "S", "T", "n") for i, r in enumerate(rows)],
                                  "product_id string, department string, category string, subcategory string, product_type string, product_name string")
    nodes = hierarchy.build(frame).collect()
    assert len({n.node_id for n in nodes}) == len(nodes)


def test_beam_ranks_by_angle_not_by_length(spark):
    nodes = spark.createDataFrame([
        ("d", "ROOT", 1, [1.0, 0.0]), ("c1", "d", 2, [3.0, 4.0]), ("c2", "d", 2, [1.0, 0.0]),
        ("s1", "c1", 3, [1.0, 0.0]), ("s2", "c2", 3, [1.0, 0.0]), ("t1", "s1", 4, [1.0, 0.0]), ("t2", "s2", 4, [1.0, 0.0]),
    ], "node_id string, parent_id string, level int, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<double>")
    assert [r.key for r in hierarchy.beam(asked, nodes, {1: 1, 2: 1, 3: 1, 4: 1}).collect()] == ["t2"]


def test_blank_queries_and_large_k_are_rejected(spark, index):
    asked = spark.createDataFrame([("a", "  "), ("b", "yoga mat"), ("c", "x" * 600)], "query_id string, query string")
    assert {r.query_id for r in ranking.search(asked, index, fv.FLAT, 3).collect()} == {"b"}
    with pytest.raises(ValueError, match="k must be"):
        ranking.search(asked, index, fv.FLAT, 51)


def test_cells_are_searched_only_on_request(spark, queries, index, tmp_path):
    tables.save_all(index, str(tmp_path), cells=True, nlist=5)
    saved = tables.load_all(spark, str(tmp_path), 64)
    exact = sorted(map(tuple, ranking.search(queries, index, fv.FLAT, 3).collect()))
    assert sorted(map(tuple, ranking.search(queries, saved, fv.FLAT, 3).collect())) == exact
    assert sorted(map(tuple, ranking.search(queries, saved.approximate(5), fv.FLAT, 3).collect())) == exact
    with pytest.raises(ValueError, match="without cells"):
        index.approximate()


def test_each_query_has_its_own_number_of_results(spark, queries, index):
    wanted = queries.withColumn("top_k", F.when(F.col("query_id") == "q1", 2).when(F.col("query_id") == "q3", 4).when(F.col("query_id") == "q4", 900))
    for run in (lambda q, k: ranking.search(q, index, k=k), lambda q, k: ranking.ensemble(q, index, k).drop("votes")):
        rows = {}
        for r in run(wanted, 3).collect():
            rows.setdefault(r.query_id, []).append((r.rank, r.product_id, r.confidence_score))
        for query, k in (("q1", 2), ("q2", 3), ("q3", 4), ("q4", 50)):
            alone = run(queries.where(F.col("query_id") == query), k).orderBy("rank").collect()
            assert sorted(rows.get(query, [])) == [(r.rank, r.product_id, r.confidence_score) for r in alone]


def test_invalid_queries_and_numbers_everywhere(spark, queries, index):
    bad = spark.createDataFrame([("x1", "exact", " ", ["a"]), ("x2", "exact", "w" * 501, ["a"]), ("x3", "exact", None, ["a"])],
                                "query_id string, query_type string, query string, relevant_terms array<string>")
    asked = queries.select(*bad.columns).unionByName(bad)
    for found in (ranking.ensemble(asked, index, 3), ranking.compare_models(asked, index, 3)):
        assert not {r.query_id for r in found.select("query_id").distinct().collect()} & {"x1", "x2", "x3"}
    for k in (0, 51, 200):
        with pytest.raises(ValueError):
            ranking.ensemble(asked, index, k)


def test_benchmark_from_shared_neighbours_equals_models_alone(spark, queries, index):
    from aisle.plans import benchmark

    whole = {tuple(r) for r in benchmark.run_benchmarks(queries, index, 3).collect()}
    alone = set()
    for model in [*index.loaded(), fv.ENSEMBLE]:
        alone |= {tuple(r) for r in benchmark.run_benchmarks(queries, index, 3, [model]).collect()}
    assert whole == alone


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_queries_are_encoded_once(queries):
    asked = queries.withColumn("note", F.lit(None))
    prepared = ranking.prepare(asked, 5, dim=64)
    assert "ArrowEvalPython" not in _plan(prepared.queries)
    assert prepared.queries.count() == len(prepared.block) > 0


@pytest.mark.parametrize("rows", [2_000_000, 0])  # probes broadcast, probes co-grouped
def test_beam_levels_are_scored_where_the_nodes_lie(spark, queries, index, monkeypatch, rows):
    monkeypatch.setattr(knn, "PROBE_ROWS", rows)
    prepared = ranking.prepare(queries, 5, dim=64)
    found = hierarchy.beam(prepared.queries, index.nodes, block=prepared.block)
    assert "Join" not in _plan(found)
    nodes = [r.asDict() for r in index.nodes.where("level > 0").collect()]
    expected = {}
    for q in prepared.queries.collect():
        kept = [("ROOT", [])]
        for level, width in enumerate((5, 5, 5, 3), 1):
            grown = []
            for parent, scores in kept:
                below = [(round(max(0.0, float(np.dot(q.embedding, n["embedding"]) / max(
                    np.linalg.norm(q.embedding) * np.linalg.norm(n["embedding"]), 1e-12))), 9), n["node_id"])
                    for n in nodes if n["level"] == level and n["parent_id"] == parent]
                grown += [(i, [*scores, s]) for s, i in sorted(below, key=lambda x: (-x[0], x[1]))[:width]]
            kept = grown
        expected |= {(q.query_id, i): sum(s * 0.85 ** (5 - n) for n, s in enumerate(scores, 1)) for i, scores in kept}
    got = {(r.query_id, r.key): r.offset for r in found.collect()}
    assert got.keys() == expected.keys() and len(got) > 20
    assert all(abs(got[k] - expected[k]) < 1e-6 for k in got)


def test_children_of_a_probed_key_without_a_vector_count_as_zero(spark):
    asked = spark.createDataFrame([("q", [1.0, 0.0])], "query_id string, embedding array<float>")
    rows = [("a", "p", None), ("b", "p", [1.0, 1.0]), ("c", "p", [0.0, float("nan")]), ("d", "r", [1.0, 0.0])]
    targets = spark.createDataFrame(rows, "node_id string, parent_id string, embedding array<float>")
    probes = spark.createDataFrame([("q", "p", 0.0)], "query_id string, key string, offset double")
    for block in (knn.query_block(asked), knn.query_block(asked, limit=0)):
        found = knn.nearest_per_key(asked, targets, 2, "node_id", probes, "parent_id", "cosine", block=block)
        assert sorted((r.target_id, r.key, r["rank"], round(r.score, 6)) for r in found.collect()) == [
            ("a", "p", 2, 0.0), ("b", "p", 1, 0.707107)]
