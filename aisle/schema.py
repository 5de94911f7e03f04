"""The catalogue contract."""

from pyspark.sql import types as T

UNIFIED = T.StructType([
    T.StructField("product_id", T.StringType(), False),
    T.StructField("product_name", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("subcategory", T.StringType()),
    T.StructField("product_type", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("features", T.StringType()),
    T.StructField("color", T.StringType()),
    T.StructField("material", T.StringType()),
    T.StructField("size_range", T.StringType()),
    T.StructField("price", T.DoubleType()),
    T.StructField("rating", T.DoubleType()),
    T.StructField("reviews_count", T.IntegerType()),
    T.StructField("tags", T.StringType()),
    T.StructField("brand", T.StringType()),
    T.StructField("stock_status", T.StringType()),
    T.StructField("keywords", T.StringType()),
])
UNIFIED_COLUMNS = UNIFIED.fieldNames()

#: Source order of a row. Spark rows have none, so it travels as a column.
ORDINAL = "_ord"

#: What searches filter by; vector tables carry them.
FILTER_COLUMNS = ["department", "category", "brand", "price", "rating"]

RESULT_COLUMNS = [
    "query_id", "model_id", "rank", "product_id", "product_name", "department",
    "category", "brand", "price", "rating", "reviews_count", "description",
    "confidence_score",
]
