"""Engine inputs derived by Spark from the given tables, every row of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle.operators import clean
from aisle.operators.catalog import to_unified
from aisle.operators.enrich import enrich_descriptions
from aisle.operators.ranking import SearchIndex
from aisle.plans import jobs
from aisle.schema import ORDINAL, UNIFIED_COLUMNS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw catalogue with all the irregular cells a real one has.

    One row per part: name, tree, specification, price and rating texts are
    built from part and lineitem, the description is the document with the
    part's number. Which irregularity a row gets depends on its number.
    """
    part, documents = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(
        F.floor(F.avg("l_quantity")).alias("avg_qty")
    )
    joined = (
        part.join(documents.select("doc_id", "text"), F.col("doc_id") == F.col("p_partkey"), "left")
        .join(sold, F.col("l_partkey") == F.col("p_partkey"), "left")
    )
    # the given files hold one row group each: spread the rows as a real scan would
    spread = joined.repartition(spark.sparkContext.defaultParallelism, "p_partkey")
    return spread.selectExpr(
        f"p_partkey AS {ORDINAL}",
        """CASE WHEN p_partkey % 10 = 3 THEN NULL
                WHEN p_partkey % 10 = 7 THEN CAST(p_partkey - 1 AS STRING)
                ELSE CAST(p_partkey AS STRING) END AS pid""",
        """CASE WHEN p_partkey % 101 = 1 THEN NULL
                WHEN p_partkey % 103 = 1 THEN ' ab '
                ELSE concat(p_name, ' ', lower(replace(p_brand, '#', ' ')), ' size ', p_size,
                            CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN ' for men' WHEN 2 THEN ' womens'
                                               WHEN 3 THEN ' kids' ELSE ' t-shirt' END)
           END AS product_name""",
        """CASE p_partkey % 17
                WHEN 1 THEN concat('["', p_type, '"]')
                WHEN 2 THEN concat('["', p_type, ' >> ', split_part(p_name, ' ', 2), ' >> ', p_brand, ' >> a >> b >> c"]')
                WHEN 3 THEN concat(p_type, '>>', p_brand)
                WHEN 4 THEN ''
                WHEN 5 THEN NULL
                WHEN 6 THEN concat('["Clothing >> ', split_part(p_name, ' ', 2), '"]')
                WHEN 7 THEN concat('["Electronics >> ', split_part(p_name, ' ', 2), ' >> ', p_brand, '"]')
                ELSE concat('["', p_type, ' >> ', split_part(p_name, ' ', 2), ' >> ', p_brand,
                            ' >> size ', p_size div 10, '"]')
           END AS product_category_tree""",
        "text AS description",
        """CASE p_partkey % 6
                WHEN 0 THEN concat('{"product_specification":[{"key":"Color","value":"', split_part(p_name, ' ', 1),
                    '"},{"key":"Fabric","value":"', lower(p_type), '"},{"key":"Finish","value":" matte "},',
                    '{"key":"Colour","value":"deep ', split_part(p_name, ' ', 1), '"},{"value":"no key"},',
                    '{"key":"Size","value":"', p_size, ' cm"},{"key":"Grade","value":"nan"}]}')
                WHEN 1 THEN concat('{"shade":"', split_part(p_name, ' ', 1), '","Weight":"', p_size, ' kg","material":"steel"}')
                WHEN 2 THEN concat('[', concat_ws(',', transform(sequence(1, 12),
                    i -> concat('{"key":"k', i, '","value":"feature ', i, ' of ', p_size, '"}'))), ']')
                WHEN 3 THEN 'not a specification'
                WHEN 4 THEN NULL
                ELSE concat('{"product_specification"=>[{"key"=>"Color", "value"=>"', p_brand, '"}]}')
           END AS product_specifications""",
        """CASE p_partkey % 13 WHEN 0 THEN '' WHEN 1 THEN 'call us' WHEN 2 THEN CAST(p_size AS STRING)
                ELSE concat('₹', format_number(p_retailprice * p_size, 1)) END AS retail_price""",
        """CASE p_partkey % 19 WHEN 0 THEN 'No rating available' WHEN 1 THEN '7' WHEN 2 THEN '-1' WHEN 3 THEN NULL
                ELSE CAST(avg_qty / 10 AS STRING) END AS product_rating""",
        "CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_brand END AS brand",
    )


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_unified(raw_catalog(spark, sf_dir))


def landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`unified`, written once per session as the preparation job lands it."""
    path = folder(spark, sf_dir, "unified")
    if path not in _WRITTEN:
        unified(spark, sf_dir).write.mode("overwrite").parquet(path)
        _WRITTEN.add(path)
    return spark.read.parquet(path)


def clean_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cleaned catalogue with review counts and stock from the orders' lines."""
    ready = clean.run(landed(spark, sf_dir))
    sold = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias(ORDINAL)).agg(
        F.count(F.lit(1)).alias("_reviews"),
        F.max(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("_open"),
    )
    joined = ready.join(sold, ORDINAL, "left")
    return joined.withColumns({
        "reviews_count": F.coalesce(F.col("_reviews"), F.lit(0)).cast("int"),
        "stock_status": F.when(F.col("_open") == 1, "In Stock").otherwise("Out of Stock"),
    }).select(ORDINAL, *UNIFIED_COLUMNS)


_WRITTEN: set[str] = set()


def folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """This session's place for ``name`` in the shared folder."""
    return f"{jobs.shared_folder(spark)}/aisle-{spark.sparkContext.applicationId}/{sf_dir.strip('/').replace('/', '-')}/{name}"


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`clean_catalog`, written once per session and read back."""
    path = folder(spark, sf_dir, "cleaned")
    if path not in _WRITTEN:
        clean_catalog(spark, sf_dir).write.mode("overwrite").parquet(path)
        _WRITTEN.add(path)
    return spark.read.parquet(path)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`query_set`, written once per session and read back: filters on it do not reach the parts."""
    path = folder(spark, sf_dir, "queries")
    if path not in _WRITTEN:
        query_set(spark, sf_dir).write.mode("overwrite").parquet(path)
        _WRITTEN.add(path)
    return spark.read.parquet(path)


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query set from all part names: exact, semantic (noun), vague (trigger phrase), intent."""
    names = table(spark, sf_dir, "part").select("p_name").distinct().selectExpr(
        "p_name", "split_part(p_name, ' ', 2) AS noun"
    )
    exact = names.selectExpr(
        "concat('e-', p_name) AS query_id", "'exact' AS query_type", "p_name AS query",
        "array(p_name) AS relevant_terms",
    )
    nouns = names.select("noun").distinct()
    semantic = nouns.selectExpr(
        "concat('s-', noun)", "'semantic'", "noun", "array(noun)",
    )
    vague = nouns.selectExpr(
        "concat('v-', noun)", "'vague'",
        """concat('something to ', CASE length(noun) % 4 WHEN 0 THEN 'watch movies' WHEN 1 THEN 'cook food'
                  WHEN 2 THEN 'carry laptop' ELSE 'stay warm' END, ' with a ', noun)""",
        "array(noun)",
    )
    intent = names.selectExpr(
        "concat('i-', p_name)", "'intent'",
        """concat(CASE length(p_name) % 5 WHEN 0 THEN 'mens ' WHEN 1 THEN 'womens ' WHEN 2 THEN 'boy ' WHEN 3 THEN '' ELSE 'girl ' END,
                  p_name, CASE length(p_name) % 3 WHEN 0 THEN ' t-shirt' ELSE '' END)""",
        "array(noun, 'zzz')",
    )
    return exact.union(semantic).union(vague).union(intent)


_INDEXES: dict[str, SearchIndex] = {}


def search_index(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index over the derived catalogue, written once per session to the shared folder."""
    base = folder(spark, sf_dir, "index")
    if base not in _INDEXES:
        _INDEXES[base] = jobs.build(spark, cleaned(spark, sf_dir), base)
    return _INDEXES[base]


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return enrich_descriptions(cleaned(spark, sf_dir))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def vector_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored vector as a query."""
    return vectors(spark, sf_dir).select(F.col("vec_id").alias("query_id"), "embedding", "label")

