"""Registered queries: what runs on Spark, and the statement it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aisle import sources
from aisle.functions import fixed_values as fv
from aisle.functions import intent, parsing, text, vectors
from aisle.operators import (
    catalog, clean, encode, enrich, evaluation, hierarchy, knn, queries as queries_ops, ranking, stats,
)
from aisle.plans import benchmark, index as index_tables, jobs
from aisle.schema import ORDINAL, RESULT_COLUMNS, UNIFIED_COLUMNS
from checks import fixtures as fx
from checks import oracle as o

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Query, str | None]] = {}

UNIFIED_LIST = ", ".join([ORDINAL, *UNIFIED_COLUMNS])


def register(name: str, statement: str | None = None):
    def add(run: Query) -> Query:
        REGISTRY[name] = (run, None if statement is None else o.sql(statement))
        return run
    return add


# --- sources and sinks --------------------------------------------------------
def _round_trip(fmt: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fx.folder(spark, sf_dir, f"raw.{fmt}")
        sources.write_catalog(fx.raw_catalog(spark, sf_dir), path, fmt)
        raw = sources.read_catalog(spark, path).withColumn(ORDINAL, F.col(ORDINAL).cast("bigint"))
        return catalog.to_unified(raw)
    return run


register("read_catalog_csv", f"SELECT {UNIFIED_LIST} FROM unified_csv")(_round_trip("csv"))
register("read_catalog_json", f"SELECT {UNIFIED_LIST} FROM unified")(_round_trip("json"))
register("read_catalog_parquet", f"SELECT {UNIFIED_LIST} FROM unified")(_round_trip("parquet"))


def _processed(fmt: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = fx.folder(spark, sf_dir, f"processed-{fmt}")
        gaps = fx.cleaned(spark, sf_dir).withColumn("color", F.nullif("color", F.lit("")))
        sources.write_catalog(gaps, path, fmt)
        return sources.read_processed(spark, path, fmt)
    return run


register("read_processed", f"SELECT {UNIFIED_LIST} FROM cleaned")(_processed("parquet"))
register("read_processed_csv", f"SELECT {UNIFIED_LIST} FROM cleaned")(_processed("csv"))


@register("read_vectors", """
SELECT vec_id, label, len(embedding) AS dim, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x)), 6) AS total
FROM embeddings""")
def read_vectors(spark, sf_dir):
    path = fx.folder(spark, sf_dir, "vectors")
    sources.write_vectors(fx.vectors(spark, sf_dir), path, partition_by="label")
    total = F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return sources.read_vectors(spark, path).select(
        "vec_id", "label", F.size("embedding").alias("dim"), F.round(total, 6).alias("total")
    )


@register("read_queries", """
SELECT query_id, query_type, query, array_to_string(relevant_terms, '|') AS terms FROM queries""")
def read_queries(spark, sf_dir):
    path = fx.folder(spark, sf_dir, "queries.json")
    fx.queries(spark, sf_dir).write.mode("overwrite").json(path)
    return sources.read_queries(spark, path).select(
        "query_id", "query_type", "query", F.array_join("relevant_terms", "|").alias("terms")
    )


# --- raw to unified -----------------------------------------------------------
@register("to_unified", f"SELECT {UNIFIED_LIST} FROM unified")
def to_unified(spark, sf_dir):
    return fx.unified(spark, sf_dir)


@register("with_ids", f"SELECT _ord, product_id FROM unified")
def with_ids(spark, sf_dir):
    return catalog.with_ids(fx.raw_catalog(spark, sf_dir)).select(ORDINAL, "product_id")


@register("parse_category_tree", f"""
SELECT _ord, array_to_string({o.level_names('product_category_tree')}, '|') AS levels FROM raw""")
def parse_category_tree(spark, sf_dir):
    levels = parsing.category_levels(F.col("product_category_tree"))
    return fx.raw_catalog(spark, sf_dir).select(ORDINAL, F.array_join(levels, "|").alias("levels"))


@register("parse_specs", "SELECT _ord, features, color, material, size_range FROM unified")
def parse_specs(spark, sf_dir):
    pairs = fx.raw_catalog(spark, sf_dir).select(
        ORDINAL, parsing.spec_pairs(F.col("product_specifications")).alias("pairs")
    )
    return pairs.select(ORDINAL, *[c.alias(n) for n, c in parsing.spec_fields(F.col("pairs")).items()])


@register("parse_price", f"SELECT _ord, {o.price('retail_price')} AS price FROM raw")
def parse_price(spark, sf_dir):
    return fx.raw_catalog(spark, sf_dir).select(ORDINAL, parsing.price(F.col("retail_price")).alias("price"))


@register("parse_rating", f"SELECT _ord, coalesce({o.number('product_rating')}, 0.0::DOUBLE) AS rating FROM raw")
def parse_rating(spark, sf_dir):
    return fx.raw_catalog(spark, sf_dir).select(
        ORDINAL, F.coalesce(parsing.number(F.col("product_rating")), F.lit(0.0)).alias("rating")
    )


@register("make_tags", "SELECT _ord, tags FROM unified")
def make_tags(spark, sf_dir):
    levels = parsing.category_levels(F.col("product_category_tree"))
    return fx.raw_catalog(spark, sf_dir).select(
        ORDINAL, F.array_join(parsing.tag_words(levels), ", ").alias("tags")
    )


@register("coerce", f"""
SELECT _ord, {o.price('retail_price')} AS price, {o.rating('product_rating')} AS rating,
  coalesce(TRY_CAST(trunc({o.number('product_rating')}) AS INTEGER), 0) AS reviews_count FROM raw""")
def coerce(spark, sf_dir):
    raw = fx.raw_catalog(spark, sf_dir).select(
        ORDINAL, F.col("pid").alias("product_id"), "product_name", F.col("retail_price").alias("price"),
        F.col("product_rating").alias("rating"), F.col("product_rating").alias("reviews_count"),
    )
    return catalog.coerce(raw).select(ORDINAL, "price", "rating", "reviews_count")


# --- cleaning -----------------------------------------------------------------
@register("clean_text", f"""
SELECT 'page' AS kind, page_id AS id, {o.clean_text('html')} AS cleaned FROM pages
UNION ALL SELECT 'document', doc_id, {o.clean_text('text')} FROM documents""")
def clean_text(spark, sf_dir):
    pages = fx.table(spark, sf_dir, "pages").select(
        F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.clean_text(F.col("html")).alias("cleaned")
    )
    documents = fx.table(spark, sf_dir, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.clean_text(F.col("text")).alias("cleaned")
    )
    return pages.unionByName(documents)


@register("strip_boilerplate", f"""
SELECT doc_id, {o.strip_boilerplate(o.clean_text("'Buy ' || source || ' online. ' || text || ' Free shipping. COD'"))} AS stripped FROM documents""")
def strip_boilerplate(spark, sf_dir):
    ad = F.concat(F.lit("Buy "), "source", F.lit(" online. "), "text", F.lit(" Free shipping. COD"))
    return fx.table(spark, sf_dir, "documents").select(
        "doc_id", text.strip_boilerplate(text.clean_text(ad)).alias("stripped")
    )


@register("clean_text_fields", f"SELECT {UNIFIED_LIST} FROM texts_cleaned")
def clean_text_fields(spark, sf_dir):
    return clean.clean_text_fields(fx.landed(spark, sf_dir))


@register("price_cap", "SELECT round(quantile_cont(value, 0.999), 6) AS price_cap FROM events")
def price_cap(spark, sf_dir):
    prices = fx.table(spark, sf_dir, "events").select(F.col("value").alias("price"))
    return clean.price_cap(prices).select(F.round("price_cap", 6).alias("price_cap"))


@register("normalize_prices", """
SELECT event_id, round(CASE WHEN cap > 0 AND value > cap * 0.25 THEN cap ELSE value END, 6) AS price
FROM events, (SELECT quantile_cont(value, 0.9) AS cap FROM events)""")
def normalize_prices(spark, sf_dir):
    prices = fx.table(spark, sf_dir, "events").select("event_id", F.col("value").alias("price"))
    return clean.normalize_prices(prices, 0.25, 0.9).select("event_id", F.round("price", 6).alias("price"))


@register("normalize_ratings", f"SELECT _ord, {o.rating('product_rating')} AS rating FROM raw")
def normalize_ratings(spark, sf_dir):
    raw = fx.raw_catalog(spark, sf_dir).select(ORDINAL, F.col("product_rating").alias("rating"))
    return clean.normalize_ratings(raw)


@register("fill_missing", f"""
SELECT _ord, {o._FILLED} FROM (SELECT _ord, nullif(department, 'SMALL') AS department, category, subcategory, product_type, description, features,
  CASE WHEN brand = 'Brand#3' THEN 'nan' WHEN brand = 'Brand#4' THEN '' ELSE brand END AS brand, color, material, size_range, tags, keywords, stock_status FROM unified)""".replace(
    "{o._FILLED}", o._FILLED))
def fill_missing(spark, sf_dir):
    gaps = fx.unified(spark, sf_dir).withColumns({
        "department": F.nullif("department", F.lit("SMALL")),
        "brand": F.when(F.col("brand") == "Brand#3", "nan").when(F.col("brand") == "Brand#4", "").otherwise(F.col("brand")),
    })
    return clean.fill_missing(gaps).select(ORDINAL, *fv.FILL_DEFAULTS)


@register("remove_duplicates", """
SELECT doc_id, source, lang FROM (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1)
QUALIFY row_number() OVER (PARTITION BY source, lang || n_chars ORDER BY doc_id) = 1""")
def remove_duplicates(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias(ORDINAL), F.md5("text").alias("product_id"), F.col("source").alias("product_name"),
        F.concat("lang", "n_chars").alias("category"), "lang",
    )
    return clean.remove_duplicates(rows).select(
        F.col(ORDINAL).alias("doc_id"), F.col("product_name").alias("source"), "lang"
    )


@register("remove_empty", "SELECT _ord, product_name FROM unified WHERE length(trim(product_name)) > 2")
def remove_empty(spark, sf_dir):
    return clean.remove_empty(fx.unified(spark, sf_dir)).select(ORDINAL, "product_name")


@register("clean_run", f"SELECT {UNIFIED_LIST} FROM ready")
def clean_run(spark, sf_dir):
    return clean.run(fx.landed(spark, sf_dir))


@register("validate_schema", f"SELECT {UNIFIED_LIST} FROM unified")
def validate_schema(spark, sf_dir):
    return clean.validate_schema(fx.landed(spark, sf_dir))


@register("removal_report", """
SELECT 'input' AS step, count(*) AS rows FROM raw UNION ALL SELECT 'deduplicated', count(*) FROM unique_rows
UNION ALL SELECT 'non_empty', count(*) FROM named_rows""")
def removal_report(spark, sf_dir):
    return clean.removal_report(fx.landed(spark, sf_dir))


# --- text and enrichment ------------------------------------------------------
@register("combined_text", f"SELECT product_id, {o.combined_text()} AS combined FROM cleaned")
def combined_text(spark, sf_dir):
    return fx.cleaned(spark, sf_dir).select("product_id", text.combined_text().alias("combined"))


@register("enhanced_text", f"SELECT product_id, {o.enhanced_text()} AS enhanced FROM enriched")
def enhanced_text(spark, sf_dir):
    return fx.enriched(spark, sf_dir).select("product_id", text.enhanced_text().alias("enhanced"))


@register("leaf_text", f"SELECT product_id, {o.LEAF_TEXT} AS leaf FROM cleaned")
def leaf_text(spark, sf_dir):
    return fx.cleaned(spark, sf_dir).select("product_id", text.leaf_text().alias("leaf"))


@register("slot_lookups", "SELECT product_id, use_case, occasion, target_audience FROM slots")
def slot_lookups(spark, sf_dir):
    return enrich.slot_lookups(fx.cleaned(spark, sf_dir)).select(
        "product_id", "use_case", "occasion", "target_audience"
    )


_SLOTS = ["features_text", "color_text", "material_text", "size_text", "price_text", "tags_text", "rating_text"]


@register("slot_text", f"SELECT product_id, {', '.join(_SLOTS)} FROM slots")
def slot_text(spark, sf_dir):
    return enrich.slot_text(fx.cleaned(spark, sf_dir)).select("product_id", *_SLOTS)


@register("enrich_descriptions", "SELECT product_id, enriched_description FROM enriched")
def enrich_descriptions(spark, sf_dir):
    return fx.enriched(spark, sf_dir).select("product_id", "enriched_description")


@register("length_stats", f"""
SELECT count(*) AS products, round(avg(len({o.tokens('enriched_description')})), 4) AS avg_words FROM enriched""")
def length_stats(spark, sf_dir):
    return enrich.length_stats(fx.enriched(spark, sf_dir))


_STOP = o.words(fv.ENGLISH_STOPWORDS + fv.EXTRA_STOPWORDS)
_LEXICON = "SELECT DISTINCT w AS form, w[1:length(w) - 2] AS lemma FROM words WHERE w LIKE '%es' AND length(w) > 3"


def _special(x: str) -> str:
    out = f"regexp_replace({x}, {o.q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + o.UNICODE_SPACE + ']')}, ' ', 'g')"
    return f"trim(regexp_replace({out}, {o.q('[' + o.UNICODE_SPACE + ']+')}, ' ', 'g'))"


def _mapped(x: str) -> str:
    m = o.mapping(fv.CODE_MIXED_WORDS)
    return f"array_to_string(list_transform({o.tokens(f'lower({x})')}, lambda t: coalesce({m}[t], t)), ' ')"


def _unstopped(x: str) -> str:
    return f"array_to_string(list_filter({o.tokens(x)}, lambda t: NOT list_contains({_STOP}, t)), ' ')"


o.CTES["words"] = f"SELECT DISTINCT unnest({o.tokens(_special('lower(text)'))}) AS w FROM conversations"
o.CTES["lexicon"] = _LEXICON
o.CTES["turns"] = "SELECT conv_id || '-' || turn AS id, text || ' kapde sasta the tshirt!' AS text FROM conversations"


def _lexicon(spark, sf_dir) -> DataFrame:
    """(form, lemma) for every distinct conversation word that ends in -es."""
    talk = fx.table(spark, sf_dir, "conversations")
    forms = talk.select(F.explode(text.tokens(text.remove_special_chars(F.lower("text")))).alias("form")).distinct()
    plural = forms.where(F.col("form").endswith("es") & (F.length("form") > 3))
    return plural.select("form", F.expr("left(form, length(form) - 2)").alias("lemma"))


def _turns(spark, sf_dir) -> DataFrame:
    return fx.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("id"),
        F.concat("text", F.lit(" kapde sasta the tshirt!")).alias("text"),
    )


@register("normalize_product_text", f"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(html), '<[^>]+>', ' ', 'g'),
  {o.q('https?://[^' + o.UNICODE_SPACE + ']+')}, '', 'g'), {o.q('[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}_' + o.UNICODE_SPACE + '.,;:!?₹$%-]')}, ' ', 'g'),
  {o.q('[' + o.UNICODE_SPACE + ']+')}, ' ', 'g')) AS normalized FROM pages""")
def normalize_product_text(spark, sf_dir):
    return fx.table(spark, sf_dir, "pages").select(
        "page_id", text.normalize_product_text(F.col("html")).alias("normalized")
    )


@register("remove_special_chars", f"SELECT id, {_special('text')} AS plain FROM turns")
def remove_special_chars(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", text.remove_special_chars(F.col("text")).alias("plain"))


@register("remove_stopwords", f"SELECT id, {_unstopped('text')} AS kept FROM turns")
def remove_stopwords(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", text.remove_stopwords(F.col("text")).alias("kept"))


@register("map_words", f"SELECT id, {_mapped('text')} AS mapped FROM turns")
def map_words(spark, sf_dir):
    return _turns(spark, sf_dir).select("id", text.map_words(F.col("text")).alias("mapped"))


@register("lemmatize_join", f"""
SELECT id, coalesce(string_agg(coalesce(lemma, w), ' ' ORDER BY pos), '') AS lemmatized
FROM (SELECT id, unnest({o.tokens('text')}) AS w, generate_subscripts({o.tokens('text')}, 1) AS pos FROM turns)
LEFT JOIN lexicon ON form = w GROUP BY id""")
def lemmatize_join(spark, sf_dir):
    return queries_ops.lemmatize_join(_turns(spark, sf_dir), "text", _lexicon(spark, sf_dir), "id").drop("text")


o.CTES["plain_turns"] = f"SELECT id, {_unstopped(_special(_mapped('trim(text)')))} AS text FROM turns"


@register("normalize_queries", f"""
SELECT t.id AS query_id, coalesce(string_agg(coalesce(lemma, w), ' ' ORDER BY pos), '') AS normalized
FROM turns t LEFT JOIN (SELECT id, unnest({o.tokens('text')}) AS w, generate_subscripts({o.tokens('text')}, 1) AS pos FROM plain_turns) p ON p.id = t.id
LEFT JOIN lexicon ON form = w GROUP BY t.id""")
def normalize_queries(spark, sf_dir):
    asked = _turns(spark, sf_dir).withColumnRenamed("id", "query_id")
    done = queries_ops.normalize_queries(asked, "text", lexicon=_lexicon(spark, sf_dir))
    return done.select("query_id", "normalized")


# --- lookups and statistics ---------------------------------------------------
@register("filter_products", f"""
SELECT {UNIFIED_LIST} FROM cleaned WHERE lower(department) = 'clothing' AND lower(brand) <> '' AND price >= 5000 AND price <= 30000""")
def filter_products(spark, sf_dir):
    return catalog.filter_products(
        fx.cleaned(spark, sf_dir), department="CLOTHING", brand="", min_price=5000, max_price=30000
    )


@register("get_product", f"SELECT {UNIFIED_LIST} FROM unified WHERE product_id = '6' ORDER BY _ord LIMIT 1")
def get_product(spark, sf_dir):
    return catalog.get_product(fx.unified(spark, sf_dir), "6")


@register("get_products", f"""
SELECT {UNIFIED_LIST} FROM unified WHERE product_id IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity > 49)
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY _ord) = 1""")
def get_products(spark, sf_dir):
    ids = fx.table(spark, sf_dir, "lineitem").where(F.col("l_quantity") > 49).select(
        F.col("l_partkey").cast("string").alias("product_id")
    )
    return catalog.get_products(fx.unified(spark, sf_dir), ids)


@register("page", """
SELECT product_id, product_name, 3 AS page, 20 AS per_page, (SELECT count(*) FROM cleaned) AS total,
  CAST(ceil((SELECT count(*) FROM cleaned) / 20) AS BIGINT) AS total_pages FROM cleaned ORDER BY _ord LIMIT 20 OFFSET 40""")
def page(spark, sf_dir):
    return catalog.page(fx.cleaned(spark, sf_dir), 3, 20).select(
        "product_id", "product_name", "page", "per_page", "total", "total_pages"
    )


@register("page_indexed", """
SELECT _ord, product_id, 7 AS page, 17 AS per_page, (SELECT count(*) FROM cleaned) AS total FROM cleaned ORDER BY _ord LIMIT 17 OFFSET 102""")
def page_indexed(spark, sf_dir):
    base = fx.folder(spark, sf_dir, "paged")
    index_tables.save_pages(fx.cleaned(spark, sf_dir), base)
    rows, blocks = index_tables.load_pages(spark, base)
    return catalog.page(rows, 7, 17, blocks).select(ORDINAL, "product_id", "page", "per_page", "total")


@register("page_after", "SELECT _ord, product_id FROM cleaned WHERE _ord > 100 ORDER BY _ord LIMIT 20")
def page_after(spark, sf_dir):
    return catalog.page_after(fx.cleaned(spark, sf_dir), 100, 20).select(ORDINAL, "product_id")


_STATS = """count(*) AS total_products, count(DISTINCT department) AS departments, count(DISTINCT category) AS categories,
  count(DISTINCT brand) AS brands, round(avg(price), 2) AS avg_price, round(avg(rating), 2) AS avg_rating"""


@register("dataset_stats", f"""
SELECT {_STATS}, count(*) FILTER (WHERE length(description) > 10) AS products_with_description,
  count(*) FILTER (WHERE length(features) > 5) AS products_with_features FROM cleaned""")
def dataset_stats(spark, sf_dir):
    return stats.dataset_stats(fx.cleaned(spark, sf_dir))


def _top(column: str) -> str:
    return f"""(SELECT string_agg({column} || '=' || n, ';' ORDER BY n DESC, {column}) FROM
      (SELECT {column}, count(*) AS n FROM cleaned GROUP BY 1 ORDER BY n DESC, {column} LIMIT 10))"""


@register("product_stats", f"SELECT {_STATS}, {_top('department')} AS department_counts, {_top('brand')} AS top_brands FROM cleaned")
def product_stats(spark, sf_dir):
    table = stats.product_stats(fx.cleaned(spark, sf_dir))

    def flat(c):
        return F.array_join(F.transform(c, lambda e: F.concat_ws("=", e["value"], e["count"])), ";")

    return table.withColumns({"department_counts": flat("department_counts"), "top_brands": flat("top_brands")})


@register("top_values", "SELECT brand AS value, count(*) AS count FROM cleaned GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_values(spark, sf_dir):
    return stats.top_values(fx.cleaned(spark, sf_dir), "brand")


# --- vectors ------------------------------------------------------------------
def _entries(df: DataFrame, key: str, digits: int = 6) -> DataFrame:
    entry = F.explode(vectors.nonzeros(F.col("embedding"))).alias("e")
    return df.select(F.col(key).alias("id"), entry).select(
        "id", F.col("e.i").cast("bigint").alias("bucket"), F.round("e.x", digits).alias("weight")
    )


@register("encode", "SELECT id, b AS bucket, round(w, 6) AS weight FROM flat_vec")
def encode_texts(spark, sf_dir):
    return _entries(index_tables.build_flat(fx.cleaned(spark, sf_dir)), "product_id")


o.CTES["doc_vec"] = o.postings("documents", "doc_id", "text")


@register("encode_documents", "SELECT id, b AS bucket, round(w, 6) AS weight FROM doc_vec")
def encode_documents(spark, sf_dir):
    return _entries(encode.encode(fx.table(spark, sf_dir, "documents"), "text"), "doc_id")


@register("encode_idf", f"""
SELECT id, b AS bucket, round(CAST(CAST(x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS FLOAT) AS DOUBLE), 5) AS weight FROM (
  SELECT id, b, c * ln((1.0::DOUBLE + n) / (1.0::DOUBLE + count(*) OVER (PARTITION BY b))) AS x
  FROM (SELECT doc_id AS id, CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {o.DIM} AS b, CAST(count(*) AS DOUBLE) AS c
        FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS t FROM documents) WHERE t <> '' GROUP BY 1, 2),
       (SELECT count(*) AS n FROM documents)) WHERE x > 0""")
def encode_idf(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents")
    weighted = encode.encode(documents, "text", idf=encode.fit_idf(documents, "text"))
    return _entries(weighted, "doc_id", 5)


@register("l2_normalize", """
SELECT vec_id, round(list_sum(list_transform(v, lambda x: CAST(CAST(x * 3 / sqrt(9 * list_dot_product(v, v)) AS FLOAT) AS DOUBLE))), 5) AS total FROM emb""")
def l2_normalize(spark, sf_dir):
    tripled = fx.vectors(spark, sf_dir).withColumn("embedding", F.transform("embedding", lambda x: x.cast("double") * 3))
    unit = vectors.l2_normalize(F.col("embedding"))
    total = F.aggregate(F.transform(unit, lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return tripled.select("vec_id", F.round(total, 5).alias("total"))


@register("cosine", """
SELECT a.vec_id, round(greatest(0.0::DOUBLE, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))), 6) AS similarity
FROM emb a JOIN emb b ON b.vec_id = a.vec_id + 1""")
def cosine(spark, sf_dir):
    given = fx.vectors(spark, sf_dir)
    following = given.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    similarity = vectors.cosine(F.col("embedding"), F.col("other"))
    return given.join(following, "vec_id").select("vec_id", F.round(similarity, 6).alias("similarity"))


_HITS = "SELECT query_id, target_id, rank, round(distance, 6) AS distance, round(confidence, 6) AS confidence FROM emb_hits"


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"distance": F.round("distance", 6), "confidence": F.round("confidence", 6)})


@register("knn_flat", _HITS)
def knn_flat(spark, sf_dir):
    return _rounded(knn.flat(fx.vector_queries(spark, sf_dir), fx.vectors(spark, sf_dir), 10, "vec_id"))


@register("knn_grouped", _HITS)
def knn_grouped(spark, sf_dir):
    """The path for probing query tables too large to broadcast, on the same input: all probe one key."""
    asked, given = fx.vector_queries(spark, sf_dir), fx.vectors(spark, sf_dir).withColumn("cell", F.lit(0))
    probes = asked.select("query_id", F.lit(0).alias("key"), F.lit(0.0).alias("offset"))
    hits = knn._nearest_grouped(asked, given, 10, "vec_id", "l2", "embedding", probes, "cell", 200)
    return _rounded(knn.with_confidence(knn.merge_top_k(hits, 10)))


@register("knn_streamed", _HITS)
def knn_streamed(spark, sf_dir):
    """The path for query tables too large to broadcast at once, on the same input: many blocks, one target scan."""
    asked, given = fx.vector_queries(spark, sf_dir), fx.vectors(spark, sf_dir)
    hits = knn._nearest_streamed(asked, given, 10, "vec_id", "l2", "embedding", block_rows=100)
    return _rounded(knn.with_confidence(knn.merge_top_k(hits, 10)))


@register("knn_ivf")
def knn_ivf(spark, sf_dir):
    cells = knn.build_cells(fx.vectors(spark, sf_dir), target_id="vec_id")
    return _rounded(knn.ivf(fx.vector_queries(spark, sf_dir), cells, 10, target_id="vec_id"))


@register("knn_ivf_all_cells", _HITS)
def knn_ivf_all_cells(spark, sf_dir):
    """Probing every cell is exact."""
    cells = knn.build_cells(fx.vectors(spark, sf_dir), 20, target_id="vec_id")
    return _rounded(knn.ivf(fx.vector_queries(spark, sf_dir), cells, 10, 20, "vec_id"))


# --- taxonomy -----------------------------------------------------------------
@register("hierarchy_build", "SELECT node_id, parent_id, level, name, count FROM nodes")
def hierarchy_build(spark, sf_dir):
    return hierarchy.build(fx.cleaned(spark, sf_dir))


@register("hierarchy_stats", """
SELECT (SELECT count(*) FROM nodes) + (SELECT count(DISTINCT product_id) FROM paths) AS total_nodes,
  (SELECT count(*) FROM nodes WHERE level > 0) + (SELECT count(*) FROM (SELECT DISTINCT product_id, node_4 FROM paths)) AS total_edges,
  count(*) FILTER (WHERE level = 1) AS departments, count(*) FILTER (WHERE level = 2) AS categories,
  count(*) FILTER (WHERE level = 3) AS subcategories, count(*) FILTER (WHERE level = 4) AS product_types,
  (SELECT count(DISTINCT product_id) FROM paths) AS products FROM nodes""")
def hierarchy_stats(spark, sf_dir):
    return hierarchy.stats(fx.cleaned(spark, sf_dir))


@register("nodes_at_level", "SELECT node_id, name, count FROM nodes WHERE level = 3")
def nodes_at_level(spark, sf_dir):
    nodes = hierarchy.build(fx.cleaned(spark, sf_dir))
    return hierarchy.nodes_at_level(nodes, 3).select("node_id", "name", "count")


@register("children", """
SELECT parent_id, node_id, level, name, count FROM nodes WHERE parent_id IN (SELECT node_id FROM nodes WHERE level = 2)""")
def children(spark, sf_dir):
    nodes = hierarchy.build(fx.cleaned(spark, sf_dir))
    return hierarchy.children(nodes, hierarchy.nodes_at_level(nodes, 2))


@register("edges", "SELECT parent_id, node_id AS child_id FROM nodes WHERE level > 0")
def edges(spark, sf_dir):
    return hierarchy.edges(hierarchy.build(fx.cleaned(spark, sf_dir)))


@register("leaf_products", """
SELECT node_1 AS ancestor_id, product_id FROM paths UNION ALL SELECT node_3, product_id FROM paths""")
def leaf_products(spark, sf_dir):
    ready = fx.cleaned(spark, sf_dir)
    ancestors = hierarchy.build(ready).where(F.col("level").isin(1, 3))
    return hierarchy.leaf_products(ready, ancestors)


_TREE = """
SELECT {child} AS parent_id, string_agg('{{"name":"' || name || '","level":{level},"count":' || count || {inner} || '}}', ',' ORDER BY name) AS body
FROM nodes {join} WHERE level = {level} GROUP BY 1"""
o.CTES["tree_4"] = _TREE.format(child="parent_id", level=4, inner="',\"products\":' || count", join="")
for _l in (3, 2):
    o.CTES[f"tree_{_l}"] = _TREE.format(
        child="nodes.parent_id", level=_l, inner="',\"children\":[' || body || ']'",
        join=f"JOIN tree_{_l + 1} t ON t.parent_id = nodes.node_id")


@register("export_json", """
SELECT name AS department, '{"name":"' || name || '","level":1,"count":' || count || ',"children":[' || body || ']}' AS json
FROM nodes JOIN tree_2 t ON t.parent_id = node_id WHERE level = 1""")
def export_json(spark, sf_dir):
    return hierarchy.subtrees(hierarchy.build(fx.cleaned(spark, sf_dir)))


@register("export_json_document", """
SELECT CASE WHEN level = 0 OR first THEN '' ELSE repeat(']}', 4 - level) || ',' END || '{"name":"' || name || '","level":' || level
  || ',"count":' || count || CASE WHEN level = 4 THEN ',"products":' || count || '}' ELSE ',"children":[' END AS value
FROM (SELECT *, node_id = arg_min(node_id, node_id || ':') OVER (PARTITION BY parent_id) AS first FROM nodes)
UNION ALL SELECT ']}]}]}]}'""")
def export_json_document(spark, sf_dir):
    path = fx.folder(spark, sf_dir, "taxonomy")
    hierarchy.export_json(hierarchy.build(fx.cleaned(spark, sf_dir)), path)
    return spark.read.text(path)


# --- index --------------------------------------------------------------------
@register("index_stats", """
SELECT 'catalog' AS "table", count(*) AS rows FROM cleaned UNION ALL SELECT 'flat_vectors', count(*) FROM cleaned
UNION ALL SELECT 'enhanced_vectors', count(*) FROM cleaned UNION ALL SELECT 'taxonomy_nodes', count(*) FROM nodes
UNION ALL SELECT 'leaf_vectors', count(*) FROM cleaned""")
def index_stats(spark, sf_dir):
    return index_tables.stats(fx.search_index(spark, sf_dir))


@register("prepare_job", """
SELECT 'catalog' AS "table", count(*) AS rows FROM ready UNION ALL SELECT 'flat_vectors', count(*) FROM ready
UNION ALL SELECT 'enhanced_vectors', count(*) FROM ready UNION ALL SELECT 'taxonomy_nodes', count(*) FROM nodes
UNION ALL SELECT 'leaf_vectors', count(*) FROM ready""")
def prepare_job(spark, sf_dir):
    raw, base = fx.folder(spark, sf_dir, "job-raw"), fx.folder(spark, sf_dir, "job")
    sources.write_catalog(fx.raw_catalog(spark, sf_dir), raw)
    return index_tables.stats(jobs.prepare(spark, raw, base, "parquet"))


@register("list_models", f"""
SELECT unnest({o.words(fv.MODELS)}) AS model_id, true AS loaded, (SELECT count(*) FROM cleaned) AS vectors""")
def list_models(spark, sf_dir):
    return index_tables.list_models(fx.search_index(spark, sf_dir))


# --- query table --------------------------------------------------------------
@register("validate", """
SELECT conv_id || '-' || turn AS query_id, CASE WHEN trim(query) = '' THEN 'empty query'
  WHEN length(trim(query)) > 500 THEN 'query longer than 500 characters' END AS reason, CAST(least(greatest(turn * 20, 1), 50) AS BIGINT) AS top_k
FROM (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '  ' ELSE text END AS query FROM conversations)""")
def validate(spark, sf_dir):
    asked = fx.table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", "conv_id", "turn").alias("query_id"), "turn",
        F.when(F.col("role") == "system", "  ").otherwise(F.col("text")).alias("query"),
    )
    return queries_ops.validate(asked, F.col("turn") * 20).select("query_id", "reason", "top_k")


@register("query_constraints", "SELECT query_id, gender, wants_tshirt, wants_kids, constrained FROM wants")
def query_constraints(spark, sf_dir):
    asked = queries_ops.with_constraints(fx.queries(spark, sf_dir))
    return asked.select("query_id", "gender", "wants_tshirt", "wants_kids", "constrained")


@register("result_flags", f"SELECT product_id, {o.flags(o.RESULT_TEXT)} FROM cleaned")
def result_flags(spark, sf_dir):
    fields = [F.col(c) for c in ("product_name", "department", "category", "description")]
    return fx.cleaned(spark, sf_dir).select(
        "product_id", *[c.alias(n) for n, c in intent.result_flags(*fields).items()]
    )


@register("expand", "SELECT query_id, refined_query AS expanded FROM expanded")
def expand(spark, sf_dir):
    return queries_ops.expand(fx.queries(spark, sf_dir)).select("query_id", "expanded")


def _rules(spark, sf_dir) -> DataFrame:
    """(ord, trigger, terms): a noun expands to the adjectives it is sold with."""
    names = fx.table(spark, sf_dir, "part").selectExpr(
        "split_part(p_name, ' ', 2) AS trigger", "split_part(p_name, ' ', 1) AS adjective"
    )
    rules = names.groupBy("trigger").agg(F.array_join(F.array_sort(F.collect_set("adjective")), " ").alias("terms"))
    return rules.withColumn("ord", F.col("trigger"))


@register("expand_rules_table", """
SELECT query_id, CASE WHEN terms IS NULL THEN query ELSE query || ' ' || terms END AS expanded FROM queries LEFT JOIN (
  SELECT query_id, string_agg(terms, ' ' ORDER BY trigger) AS terms FROM queries JOIN (
    SELECT split_part(p_name, ' ', 2) AS trigger, string_agg(DISTINCT split_part(p_name, ' ', 1), ' ' ORDER BY split_part(p_name, ' ', 1)) AS terms
    FROM part GROUP BY 1) ON contains(lower(query), trigger) GROUP BY 1) USING (query_id)""")
def expand_rules_table(spark, sf_dir):
    return queries_ops.expand(fx.queries(spark, sf_dir), _rules(spark, sf_dir)).select("query_id", "expanded")


def _rewrites(spark, sf_dir) -> DataFrame:
    """Rewrites for the part names that were rewritten: colour words spelt out, some failed."""
    names = fx.table(spark, sf_dir, "part").select("p_name").distinct()
    return names.selectExpr(
        "p_name AS query",
        "CASE WHEN p_name LIKE 'red%' THEN concat('crimson ', p_name) WHEN p_name LIKE 'old%' THEN ' ' END AS refined",
    )


@register("refine", """
SELECT query_id, CASE WHEN query LIKE 'red%' AND query_type = 'exact' THEN 'crimson ' || query
   WHEN EXISTS (SELECT 1 FROM names WHERE p_name = query AND query LIKE 'red%') THEN 'crimson ' || query ELSE refined_query END AS refined_query FROM expanded""")
def refine(spark, sf_dir):
    return queries_ops.refine(fx.queries(spark, sf_dir), _rewrites(spark, sf_dir)).select("query_id", "refined_query")


# --- search -------------------------------------------------------------------
_RESULTS = ", ".join(RESULT_COLUMNS)


def _prepared(spark, sf_dir):
    p = ranking.prepare(fx.queries(spark, sf_dir), 5)
    return fx.search_index(spark, sf_dir), p.queries, p.fetch, p.block


@register("search_hierarchical", f"SELECT {_RESULTS} FROM r1")
def search_hierarchical(spark, sf_dir):
    index, encoded, fetch, block = _prepared(spark, sf_dir)
    return ranking.search_hierarchical(encoded, index, fetch, block)


@register("search_flat", f"SELECT {_RESULTS} FROM r2")
def search_flat(spark, sf_dir):
    index, encoded, fetch, block = _prepared(spark, sf_dir)
    return ranking.search_flat(encoded, index, fetch, block)


@register("search_enhanced", f"SELECT {_RESULTS} FROM r3")
def search_enhanced(spark, sf_dir):
    index, encoded, fetch, block = _prepared(spark, sf_dir)
    return ranking.search_enhanced(encoded, index, fetch, block)


@register("search_expanded", f"SELECT {_RESULTS}, refined_query FROM r4 JOIN (SELECT query_id, refined_query FROM expanded) USING (query_id)")
def search_expanded(spark, sf_dir):
    index, encoded, fetch, block = _prepared(spark, sf_dir)
    return ranking.search_expanded(encoded, index, fetch).select(*RESULT_COLUMNS, "refined_query")


@register("rerank_score", f"""
SELECT product_id, round({o.RERANK.replace('confidence', '0.5')}, 6) AS score FROM cleaned""")
def rerank_score(spark, sf_dir):
    return fx.cleaned(spark, sf_dir).select(
        "product_id", F.round(ranking.rerank_score(F.lit(0.5)), 6).alias("score")
    )


@register("confidence_band", """
SELECT query_id, rank, CASE WHEN confidence_score >= 0.7 THEN 'high' WHEN confidence_score >= 0.4 THEN 'mid' ELSE 'low' END AS band FROM r2""")
def confidence_band(spark, sf_dir):
    results = search_flat(spark, sf_dir)
    return results.select("query_id", "rank", ranking.confidence_band(F.col("confidence_score")).alias("band"))


@register("adjust_score", f"SELECT query_id, rank, product_id, round(adjusted, 6) AS adjusted FROM ({o.adjusted('r3')})")
def adjust_score(spark, sf_dir):
    index, encoded, fetch, block = _prepared(spark, sf_dir)
    results = ranking.search_enhanced(encoded, index, fetch, block)
    adjusted = ranking._with_adjusted(results, encoded, None)
    return adjusted.select("query_id", "rank", "product_id", F.round("_adjusted", 6).alias("adjusted"))


@register("search", f"SELECT {_RESULTS} FROM routed WHERE model_id = '{fv.ENHANCED}'")
def search(spark, sf_dir):
    return ranking.search(fx.queries(spark, sf_dir), fx.search_index(spark, sf_dir))


@register("search_min_confidence", f"SELECT {_RESULTS} FROM routed WHERE model_id = '{fv.FLAT}' AND confidence_score >= 0.4")
def search_min_confidence(spark, sf_dir):
    return ranking.search(fx.queries(spark, sf_dir), fx.search_index(spark, sf_dir), fv.FLAT, min_confidence=0.4)


o.CTES["kept_products"] = "SELECT product_id FROM cleaned WHERE lower(department) = 'clothing' AND rating >= 2.0 AND price <= 30000"
o.CTES["filtered_hits"] = o.neighbours("q_vec", "flat_vec", 40, 5).replace(
    "(SELECT product_id FROM cleaned) c", "(SELECT product_id FROM kept_products) c")
o.CTES["filtered_results"] = o.flat_results("filtered_hits")


@register("search_filtered", f"""
SELECT query_id, model_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN constrained THEN -adjusted ELSE 0 END, rank) AS INTEGER) AS rank,
  product_id, product_name, department, category, brand, price, rating, reviews_count, description,
  CASE WHEN constrained THEN round(adjusted, 4) ELSE confidence_score END AS confidence_score
FROM ({o.adjusted('filtered_results')}) AS a QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN constrained THEN -adjusted ELSE 0 END, a.rank) <= 5""")
def search_filtered(spark, sf_dir):
    return ranking.search(
        fx.queries(spark, sf_dir), fx.search_index(spark, sf_dir), fv.FLAT,
        filters={"department": "clothing", "min_rating": 2.0, "max_price": 30000},
    )


@register("compare_models", f"SELECT {_RESULTS} FROM routed")
def compare_models(spark, sf_dir):
    return ranking.compare_models(fx.queries(spark, sf_dir), fx.search_index(spark, sf_dir))


@register("ensemble", f"SELECT {_RESULTS}, votes FROM voted")
def ensemble(spark, sf_dir):
    return ranking.ensemble(fx.queries(spark, sf_dir), fx.search_index(spark, sf_dir))


@register("ensemble_validated", f"SELECT {_RESULTS}, votes FROM voted")
def ensemble_validated(spark, sf_dir):
    """Blank and over-long queries among the others have no results and change none."""
    asked = fx.queries(spark, sf_dir)
    blank = asked.withColumns({"query_id": F.concat(F.lit("blank-"), "query_id"), "query": F.lit("  ")})
    long = asked.withColumns({"query_id": F.concat(F.lit("long-"), "query_id"), "query": F.repeat(F.lit("word "), F.lit(120))})
    return ranking.ensemble(asked.unionByName(blank).unionByName(long), fx.search_index(spark, sf_dir))


# --- evaluation ---------------------------------------------------------------
@register("spot_check", """
SELECT query_id, model_id, rank, product_name, department, category, confidence_score,
  CASE WHEN flag THEN 'RELEVANT' ELSE 'NOT RELEVANT' END AS marker FROM judged""")
def spot_check(spark, sf_dir):
    return benchmark.spot_check(fx.queries(spark, sf_dir), fx.search_index(spark, sf_dir))


@register("flag_results", f"SELECT query_id, query_type, rank, product_id, flag FROM judged WHERE model_id = '{fv.ENSEMBLE}'")
def flag_results(spark, sf_dir):
    flagged = evaluation.flag_results(ensemble(spark, sf_dir), fx.queries(spark, sf_dir))
    return flagged.select("query_id", "query_type", "rank", "product_id", "flag")


o.CTES["emb_judged"] = "SELECT 'knn' AS model_id, query_id, rank, query_label = target_label AS flag FROM emb_hits WHERE query_id <> target_id AND query_id >= 0"
o.CTES["emb_asked"] = "SELECT 'knn' AS model_id, vec_id AS query_id, 'label ' || label AS query_type FROM emb"


@register("query_metrics", o.metrics("emb_judged", "emb_asked", 10))
def query_metrics(spark, sf_dir):
    """Neighbours other than the query itself, relevant when their label is the query's."""
    asked = fx.vector_queries(spark, sf_dir).withColumn("query_type", F.concat(F.lit("label "), "label"))
    labels = fx.vectors(spark, sf_dir).select(F.col("vec_id").alias("target_id"), F.col("label").alias("target_label"))
    hits = knn.flat(asked, fx.vectors(spark, sf_dir), 10, "vec_id").join(labels, "target_id")
    flagged = hits.join(asked.select("query_id", "label"), "query_id").where("query_id <> target_id").select(
        F.lit("knn").alias("model_id"), "query_id", "rank", (F.col("label") == F.col("target_label")).alias("flag")
    )
    return evaluation.query_metrics(flagged, asked, ["knn"], 10)


@register("run_benchmarks", "SELECT * FROM report")
def run_benchmarks(spark, sf_dir):
    return benchmark.run_benchmarks(fx.queries(spark, sf_dir), fx.search_index(spark, sf_dir))


@register("write_report", "SELECT * FROM report")
def write_report(spark, sf_dir):
    path, report = fx.folder(spark, sf_dir, "report"), run_benchmarks(spark, sf_dir)
    sources.write_report(report, path)
    return spark.read.schema(report.schema).json(f"{path}/json")


_FIXED3 = " || ' ' || ".join(
    f"lpad(CAST(CAST(round(CAST({m} AS DECIMAL(9, 4)), 3) AS DECIMAL(9, 3)) AS VARCHAR), 6, ' ')" for m in evaluation.METRICS)


@register("format_report", f"""
SELECT CAST(row_number() OVER (ORDER BY part, a, b) - 1 AS INTEGER) AS _ord, line FROM (
  SELECT 0 AS part, '0' AS a, '' AS b, repeat('=', 90) AS line UNION ALL SELECT 0, '1', '', 'EVALUATION REPORT'
  UNION ALL SELECT 0, '2', '', repeat('=', 90)
  UNION ALL SELECT 0, '3', '', rpad('Model', 25, ' ') || ' ' || rpad('Type', 10, ' ') || '    P@K    R@K    MRR   NDCG     F1     Time'
  UNION ALL SELECT 0, '4', '', repeat('-', 90) UNION ALL SELECT 2, '', '', repeat('=', 90)
  UNION ALL SELECT 1, model_id, query_type, rpad(model_id, 25, ' ') || ' ' || rpad(query_type, 10, ' ') || ' ' || {_FIXED3} || '         -'
  FROM report)""")
def format_report(spark, sf_dir):
    return evaluation.format_report(run_benchmarks(spark, sf_dir))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ensemble(spark, sf_dir)
