import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]").appName("aisle-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.conf.set("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


CATALOG = [
    ("P001", "Trail running shoes for men", "Fashion", "Footwear", "Sports shoes", "Running shoes", "light mesh upper", "Mesh, rubber sole", 2999.0, 4.5, 500, "running, footwear", "Blue", "6-11", "Mesh", "Stride"),
    ("P002", "Cotton shirt for women", "Fashion", "Clothing", "Shirts", "Formal shirts", "soft cotton", "Cotton", 899.0, 4.1, 120, "cotton, shirt", "White", "S-XL", "Cotton", "Weave"),
    ("P003", "LED television 55 inch", "Electronics", "Televisions", "Smart tv", "LED tv", "big bright screen", "4K, HDR", 54999.0, 4.6, 900, "television, led", "Black", "55", "Plastic", "Viewit"),
    ("P004", "Bluetooth headphones", "Electronics", "Audio", "Headphones", "Over ear", "noise cancelling", "Bluetooth 5", 4999.0, 4.4, 1200, "audio, bluetooth", "Black", "One", "Plastic", "Sonar"),
    ("P005", "Gaming laptop", "Electronics", "Computers", "Laptops", "Gaming", "fast graphics", "16GB, SSD", 89999.0, 4.7, 340, "laptop, gaming", "Grey", "15", "Metal", "Byte"),
    ("P006", "Kids t-shirt round neck", "Fashion", "Clothing", "T-shirts", "Kids t-shirts", "printed cotton", "Cotton", 399.0, 4.2, 150, "kids, t-shirt", "Red", "4-12", "Cotton", "Weave"),
    ("P007", "Steel kitchen knife", "Home & Garden", "Kitchen", "Knives", "Chef knives", "sharp blade", "Steel", 899.0, 4.3, 210, "kitchen, knife", "Silver", "8", "Steel", "Cutter"),
    ("P008", "Double bed sheet", "Home & Garden", "Bedding", "Bed linen", "Bed sheets", "king size", "Cotton", 1299.0, 4.2, 310, "bed, linen", "Green", "King", "Cotton", "Weave"),
    ("P009", "Yoga mat", "Sports", "Fitness", "Yoga", "Mats", "anti slip", "6 mm", 999.0, 4.5, 640, "yoga, fitness", "Purple", "One", "Foam", "Flex"),
    ("P010", "Cricket bat", "Sports", "Cricket", "Bats", "Willow bats", "hand made", "English willow", 3499.0, 4.4, 180, "cricket, bat", "Brown", "Full", "Willow", "Pitch"),
]
COLUMNS = (
    "product_id product_name department category subcategory product_type description features price "
    "rating reviews_count tags color size_range material brand"
).split()


@pytest.fixture(scope="session")
def catalog(spark):
    rows = [
        (i, *row, "In Stock", row[1].lower() + ", " + row[11], "") for i, row in enumerate(CATALOG)
    ]
    schema = "_ord bigint, " + ", ".join(
        f"{c} {'double' if c in ('price', 'rating') else 'int' if c == 'reviews_count' else 'string'}" for c in COLUMNS
    ) + ", stock_status string, keywords string, enriched_description string"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def index(spark, catalog):
    from aisle.operators.enrich import enrich_descriptions
    from aisle.plans import index as tables

    built = tables.build(enrich_descriptions(catalog), dim=64)
    base = f"{spark.conf.get('spark.checkpoint.dir')}/test-index-{spark.sparkContext.applicationId}"
    tables.save_all(built, base)
    return tables.load_all(spark, base, dim=64)


@pytest.fixture(scope="session")
def queries(spark):
    return spark.createDataFrame(
        [
            ("q1", "exact", "running shoes for men", ["running"]),
            ("q2", "exact", "cotton shirt for women", ["shirt"]),
            ("q3", "vague", "something to watch movies on", ["television"]),
            ("q4", "semantic", "yoga mat", ["yoga"]),
            ("q5", "vague", "zzzz", ["nothing"]),
        ],
        "query_id string, query_type string, query string, relevant_terms array<string>",
    )
