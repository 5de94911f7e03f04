import json
import os

import pytest
from pyspark.sql import functions as F

from aisle import sources
from aisle.functions import fixed_values as fv
from aisle.operators import catalog as ops
from aisle.operators import hierarchy, ranking
from aisle.plans import index as tables
from aisle.plans import jobs
from aisle.streaming.ingest import prepare_rows

HEADER = "pid,product_name,product_category_tree,description,product_specifications,retail_price,product_rating,brand\n"
LINES = [
    'A1,Red lamp,"[""Home >> Lamps >> Desk lamps >> LED lamps""]","Bright\nlamp, 5 W","{""Color"": ""red""}","₹1,299",4.5,Lumo',
    'A2,Oak desk,"[""Home >> Desks""]",Solid oak,NA,4999,No rating,',
    'A1,Red lamp again,"[""Home >> Lamps""]",copy,,10,3,Lumo',
    ',Blue shirt,"[""Clothing >> Shirts""]",NULL,,799,4,Weave',
]


@pytest.fixture
def csv_dir(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "products.csv").write_text(HEADER + "\n".join(LINES) + "\n", encoding="utf-8")
    return str(folder)


def test_csv_cells(spark, csv_dir):
    rows = sources.read_catalog(spark, csv_dir).orderBy("_ord").collect()
    assert [r.pid for r in rows] == ["A1", "A2", "A1", None]
    assert rows[0].description == "Bright\nlamp, 5 W" and rows[1].product_specifications is None
    unified = ops.to_unified(sources.read_catalog(spark, csv_dir)).orderBy("_ord").collect()
    assert [r.product_id for r in unified] == ["A1", "A2", "A1", "P00004"]
    assert (unified[0].price, unified[0].color, unified[0].product_type) == (1299.0, "red", "LED lamps")
    assert unified[1].brand == "Unknown" and unified[1].rating == 0.0


def test_nested_json_cells(spark, tmp_path):
    (tmp_path / "x.json").write_text(json.dumps({
        "pid": "1", "product_name": "lamp", "product_category_tree": ["Home >> Lamps"], "price": 12.5,
        "product_specifications": {"product_specification": [{"key": "Color", "value": "red"}, {"key": "W", "value": "5"}]},
    }) + "\n")
    row = ops.to_unified(sources.read_catalog(spark, str(tmp_path / "x.json"))).first()
    assert (row.category, row.color, row.features, row.price) == ("Lamps", "red", "5", 12.5)


def test_bad_sources(spark, tmp_path):
    (tmp_path / "x.csv").write_text("pid,product_name\n1,a\n")
    with pytest.raises(ValueError, match="product_category_tree"):
        sources.read_catalog(spark, str(tmp_path / "x.csv"))
    with pytest.raises(ValueError, match="unsupported"):
        sources.read_catalog(spark, str(tmp_path / "x.csv"), "xml")


def test_raw_to_search_and_reuse(spark, csv_dir, tmp_path):
    base = str(tmp_path / "base")
    index = jobs.prepare(spark, csv_dir, base, dim=64)
    assert index.loaded() == fv.MODELS and index.catalog.count() == 3
    written = os.path.getmtime(f"{base}/index/catalog/_SUCCESS")
    again = jobs.prepare(spark, csv_dir, base, dim=64)
    assert os.path.getmtime(f"{base}/index/catalog/_SUCCESS") == written
    asked = spark.createDataFrame([("q", "red lamp")], "query_id string, query string")
    assert ranking.search(asked, again, k=1).first().product_id == "A1"
    tree = json.loads("".join(r.value for r in spark.read.text(f"{base}/index/taxonomy").collect()))
    assert (tree["name"], tree["level"], tree["count"]) == ("ROOT", 0, 3)
    home = next(d for d in tree["children"] if d["name"] == "Home")
    lamps = next(c for c in home["children"] if c["name"] == "Lamps")
    assert lamps["children"][0]["children"][0] == {"name": "LED lamps", "level": 4, "count": 1, "products": 1}


def test_tree_document_is_a_line_per_node(spark, tmp_path):
    names = ["a", "a!", "a:b", "a\\", 'q"}', "a b", "\U0010ffff", "é"]
    rows = [(f"{i}", "n", names[i % 8], names[i * 3 % 7], names[i * 5 % 6], names[i % 5]) for i in range(400)]
    df = spark.createDataFrame(rows, "product_id string, product_name string, department string, category string, subcategory string, product_type string")
    nodes = hierarchy.build(df)
    hierarchy.export_json(nodes.repartition(13), str(tmp_path / "t"))
    files = sorted(f for f in os.listdir(tmp_path / "t") if f.startswith("part-"))
    text = "".join((tmp_path / "t" / f).read_text("utf-8") for f in files)
    assert len(text.splitlines()) == nodes.count() + 1

    def wanted(parent, level):
        out = {}
        for r in below.get(parent, []):
            more = {"products": r["count"]} if level == 4 else {"children": wanted(r.node_id, level + 1)}
            out[r.name] = {"level": level, "count": r["count"], **more}
        return out

    def found(children):
        assert len({c["name"] for c in children}) == len(children)
        return {c["name"]: {**{k: v for k, v in c.items() if k != "name"}, **(
            {"children": found(c["children"])} if "children" in c else {})} for c in children}

    below = {}
    for r in nodes.collect():
        below.setdefault(r.parent_id, []).append(r)
    tree = json.loads(text)
    assert (tree["name"], tree["count"]) == ("ROOT", 400) and found(tree["children"]) == wanted("ROOT", 1)
    lone = hierarchy.document_lines(nodes.where("level = 0")).orderBy(F.asc_nulls_last("path"))
    assert json.loads("".join(r.line for r in lone.collect())) == {"name": "ROOT", "level": 0, "count": 400, "children": []}
    assert hierarchy.document_lines(nodes.where("false")).count() == 0


def test_leaf_products_of_any_level(spark, catalog):
    nodes = hierarchy.build(catalog)
    got = hierarchy.leaf_products(catalog, nodes.unionByName(nodes)).collect()
    counts = {r.node_id: r["count"] for r in nodes.collect()}
    assert len(got) == len(set(map(tuple, got))) == 50
    for node, n in counts.items():
        assert sum(r.ancestor_id == node for r in got) == n
    assert hierarchy.leaf_products(catalog, nodes.where("false")).count() == 0


def test_blank_levels_default(spark):
    df = spark.createDataFrame([("1", "n", " ", None, "S", "T")], "product_id string, product_name string, department string, category string, subcategory string, product_type string")
    ids = {r.node_id for r in hierarchy.build(df).collect()}
    assert ids == {"ROOT", "dept:Other", "cat:Other:General", "subcat:Other:General:S", "ptype:Other:General:S:T"}
    row = hierarchy.stats(df).first()
    assert (row.total_nodes, row.total_edges, row.products) == (6, 5, 1)


def test_report_files(spark, tmp_path):
    report = spark.createDataFrame(
        [("m", "t", 0.1, 0.2, 0.3, 0.4, 0.5)],
        "model_id string, query_type string, precision_at_k double, recall_at_k double, mrr double, ndcg double, f1_score double",
    )
    sources.write_report(report, str(tmp_path))
    assert spark.read.json(f"{tmp_path}/json").count() == 1
    lines = [r.value for r in spark.read.text(f"{tmp_path}/text").collect()]
    assert lines[1] == "EVALUATION REPORT" and len(lines) == 7
    assert lines[5].endswith(" 0.500         -")  # a report without times


def test_query_sets(spark, queries, tmp_path):
    queries.withColumn("relevant_terms", F.array_join("relevant_terms", "|")).write.option("header", True).csv(f"{tmp_path}/q.csv")
    read = sources.read_queries(spark, f"{tmp_path}/q.csv")
    assert {(r.query_id, tuple(r.relevant_terms)) for r in read.collect()} == {(r.query_id, tuple(r.relevant_terms)) for r in queries.collect()}


def test_pages(catalog):
    rows = ops.page(catalog, 2, 4).collect()
    assert [r._ord for r in rows] == [4, 5, 6, 7] and (rows[0].total, rows[0].total_pages) == (10, 3)
    assert [r._ord for r in ops.page(catalog, 0, 1000).collect()] == list(range(10))
    assert [r._ord for r in ops.page_after(catalog, 7, 4).collect()] == [8, 9]


def test_deep_pages_by_the_page_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ops, "PAGE_GROUP", 3)
    rows = spark.range(3000).where("id % 7 <> 3 AND (id < 900 OR id > 1400)").select(F.col("id").alias("_ord"), F.lit("x").alias("name"))
    tables.save_pages(rows, str(tmp_path), rows=40)
    paged, blocks = tables.load_pages(spark, str(tmp_path))
    for number, size in ((1, 20), (2, 100), (31, 33), (100, 20), (107, 20), (108, 20), (109, 20), (10_000, 100)):
        got, plain = ops.page(paged, number, size, blocks), ops.page(rows, number, size)
        assert got.collect() == plain.collect(), (number, size)
    text = ops.page(paged, 60, 20, blocks)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(_ord" in text
    assert ops.page(rows.where("false"), 1, 5, blocks.where("false")).count() == 0


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from checks import fixtures as fx

    fx.raw_catalog(spark, sf_dir).write.parquet(str(tmp_path / "in"))
    raw = spark.read.parquet(str(tmp_path / "in"))
    stream = prepare_rows(spark.readStream.schema(raw.schema).parquet(str(tmp_path / "in")))
    run = (
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start()
    )
    run.awaitTermination(120)
    key = lambda df: sorted(map(str, df.select("_ord", "product_name", "enriched_description").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(prepare_rows(raw))


def test_shared_folder_comes_from_the_session(spark):
    assert jobs.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_vectors_are_computed_once_though_their_ranges_are_sampled(index, monkeypatch):
    plans = {}
    monkeypatch.setattr(tables, "save", lambda df, path, *_: plans.update({path: df._jdf.queryExecution().optimizedPlan().toString()}))
    tables.save_vectors(index, "x")
    for name in ("flat_vectors", "enhanced_vectors", "leaf_vectors"):
        assert plans[f"x/{name}"].count("Rebalance") == 1 and "RepartitionByExpression" in plans[f"x/{name}"]
