import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from aisle.functions import parsing
from aisle.operators import catalog as ops


def column(spark, values, expr, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r.x for r in df.select("i", expr(F.col("v")).alias("x")).orderBy("i").collect()]


def test_category_levels(spark):
    trees = [
        '["A >> B >> C >> D"]', '["A"]', '["A >> B"]', '["A >> B >> C >> D >> E >> F"]', "A>>B", "", None,
        "  [ 'A >>  B ' ]  ", " >> ",
    ]
    assert column(spark, trees, parsing.category_levels) == [
        ["A", "B", "C", "D"], ["A"] * 4, ["A", "B", "B", "B"], ["A", "B", "C", "D"], ["A>>B"] * 4,
        ["General"] * 4, ["Other", "General", "General", "General"], ["A", "B", "B", "B"],
        [">>"] * 4,
    ]


def test_spec_fields(spark):
    many = ", ".join(f"{{'key': 'k{i}', 'value': 'v{i}'}}" for i in range(12))
    specs = [
        "{'product_specification': [{'key': 'Color', 'value': 'red'}, {'key': 'colour', 'value': 'blue'}, {'value': 'x'}]}",
        '{"Fabric": "silk", "Dimensions": "3 cm", "Finish": "matte", "Washable": true}',
        "[" + many + "]",
        "not a spec", None, "", '{"product_specification"=>[{"key"=>"Color", "value"=>"red"}]}',
        "{'Grade': None, 'Shade': 'teal', 'Kept': 'yes', 'Gone': 'nan'}",
        '{"product_specification": []}',
    ]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(specs)], "i int, s string")
    pairs = df.select("i", parsing.spec_pairs(F.col("s")).alias("p"))
    rows = pairs.select("i", *[c.alias(n) for n, c in parsing.spec_fields(F.col("p")).items()]).orderBy("i").collect()
    got = [(r.features, r.color, r.material, r.size_range) for r in rows]
    empty = ("", "", "", "")
    assert got == [
        ("", "blue", "", ""), ("matte, true", "", "silk", "3 cm"),
        (", ".join(f"v{i}" for i in range(10)), "", "", ""),
        empty, empty, empty, empty, ("yes", "teal", "", ""), empty,
    ]


def test_price_and_rating(spark):
    prices = ["₹1,299", "1299.0", "", None, "nan", " 5 ", "5d", "call us", "1e3"]
    assert column(spark, prices, parsing.price) == [1299.0, 1299.0, 0.0, 0.0, 0.0, 5.0, 0.0, 0.0, 1000.0]
    ratings = ["4.5", "-1", "7", "No rating", None]
    assert column(spark, ratings, parsing.bounded_rating) == [4.5, 0.0, 5.0, 0.0, 0.0]
    assert column(spark, ["12.7", "x", None, "3"], parsing.review_count) == [12, 0, 0, 3]


def test_strict_price_raises(spark):
    with pytest.raises(PySparkException, match="not a price"):
        column(spark, ["call us"], lambda c: parsing.price(c, strict=True))


def test_rating_nan_is_zero(spark):
    assert column(spark, [float("nan"), 3.0], parsing.bounded_rating, "double") == [0.0, 3.0]


def test_product_ids_grow_past_five_digits(spark):
    df = spark.createDataFrame([(0, None), (99_999, None), (123_455_000, None), (7, "X1")], "_ord bigint, pid string")
    got = [r.product_id for r in ops.with_ids(df).collect()]
    assert got == ["P00001", "P100000", "P123455001", "X1"]


def test_first_existing_price_column_wins_even_when_null(spark):
    raw = spark.createDataFrame(
        [(0, "lamp", "A", None, "50")],
        "_ord bigint, product_name string, product_category_tree string, discounted_price string, price string",
    )
    row = ops.to_unified(raw).first()
    assert (row.price, row.rating, row.brand, row.product_id) == (0.0, 0.0, "Unknown", "P00001")
