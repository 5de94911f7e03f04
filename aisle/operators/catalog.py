"""Raw to unified catalogue, and the lookups users run on it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from aisle.functions import fixed_values as fv
from aisle.functions import parsing
from aisle.schema import ORDINAL, UNIFIED, UNIFIED_COLUMNS

#: Ordinals in a block of the page index, and blocks in a group of its prefix sums.
PAGE_BLOCK, PAGE_GROUP = 10_000, 1_000


def to_unified(raw: DataFrame, strict_prices: bool = False) -> DataFrame:
    """The fixed catalogue columns (plus the ordinal) from whichever raw columns exist.

    Which price and rating column is used depends on the raw schema, not on the
    row: the first existing one wins.
    """
    def first_of(names: list[str]) -> str | None:
        return next((n for n in names if n in raw.columns), None)

    def optional(name: str, default: str):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in raw.columns else F.lit(default)

    price_column, rating_column = first_of(fv.PRICE_COLUMNS), first_of(fv.RATING_COLUMNS)
    pid = F.col("pid") if "pid" in raw.columns else F.lit(None).cast("string")
    specs = (
        F.col("product_specifications").cast("string")
        if "product_specifications" in raw.columns else F.lit(None).cast("string")
    )
    parsed = raw.select(
        F.col(ORDINAL),
        parsing.product_id(pid, F.col(ORDINAL)).alias("product_id"),
        F.coalesce(F.col("product_name").cast("string"), F.lit("Unknown Product")).alias("product_name"),
        parsing.category_levels(F.col("product_category_tree").cast("string")).alias("_levels"),
        optional("description", "").alias("description"),
        parsing.spec_pairs(specs).alias("_specs"),
        (parsing.price(F.col(price_column), strict_prices) if price_column else F.lit(0.0)).alias("price"),
        (F.coalesce(parsing.number(F.col(rating_column)), F.lit(0.0)) if rating_column else F.lit(0.0)).alias("rating"),
        optional("brand", "Unknown").alias("brand"),
    )
    levels, specs = F.col("_levels"), parsing.spec_fields(F.col("_specs"))
    fields = parsed.select(
        "*",
        *[levels[i].alias(n) for i, n in enumerate(["department", "category", "subcategory", "product_type"])],
        *[c.alias(n) for n, c in specs.items()],
        F.array_join(parsing.tag_words(levels), ", ").alias("tags"),
        F.lit(0).alias("reviews_count"),
        F.lit("In Stock").alias("stock_status"),
    ).withColumn("keywords", F.concat(F.lower("product_name"), F.lit(", "), F.col("tags")))
    return fields.select(ORDINAL, *UNIFIED_COLUMNS)


def with_ids(df: DataFrame, pid: str = "pid") -> DataFrame:
    """product_id from ``pid``, or synthesised from the ordinal where it is null."""
    source = F.col(pid) if pid in df.columns else F.lit(None).cast("string")
    return df.withColumn("product_id", parsing.product_id(source, F.col(ORDINAL)))


def coerce(df: DataFrame) -> DataFrame:
    """Records of any origin to the catalogue's types, with its defaults."""
    converters = {
        "price": parsing.price, "rating": parsing.bounded_rating, "reviews_count": parsing.review_count,
    }

    def field(f: T.StructField):
        if f.name not in df.columns:
            default = {"price": 0.0, "rating": 0.0, "reviews_count": 0, "stock_status": "In Stock"}
            return F.lit(default.get(f.name, "")).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        return (converters[f.name](c) if f.name in converters else c.cast(f.dataType)).alias(f.name)

    extra = [c for c in df.columns if c not in UNIFIED_COLUMNS]
    return df.select(*extra, *[field(f) for f in UNIFIED.fields])


def filter_products(
    catalog: DataFrame, department: str | None = None, category: str | None = None,
    brand: str | None = None, min_price: float | None = None, max_price: float | None = None,
    min_rating: float | None = None,
) -> DataFrame:
    """Equality ignoring case on the names, bounds on price and rating; blank means no filter."""
    for name, value in {"department": department, "category": category, "brand": brand}.items():
        if value:
            catalog = catalog.where(F.lower(name) == F.lower(F.lit(value)))
    for name, low, high in (("price", min_price, max_price), ("rating", min_rating, None)):
        if low is not None:
            catalog = catalog.where(F.col(name) >= float(low))
        if high is not None:
            catalog = catalog.where(F.col(name) <= float(high))
    return catalog


def get_product(catalog: DataFrame, product_id: str) -> DataFrame:
    return catalog.where(F.col("product_id") == product_id).orderBy(ORDINAL).limit(1)


def get_products(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """The first product of each requested id."""
    found = catalog.join(ids.select("product_id").distinct(), "product_id", "left_semi")
    rows = F.struct(*catalog.columns)
    first = found.groupBy("product_id").agg(F.min_by(rows, F.col(ORDINAL)).alias("_row"))
    return first.select("_row.*")


def page_blocks(catalog: DataFrame, rows: int = PAGE_BLOCK) -> DataFrame:
    """(block, first, last, rows, before) per run of ``rows`` ordinals: its rows and the rows before it.

    Ordinals may have gaps. The prefix sums run within groups of ``PAGE_GROUP`` blocks,
    then over the groups, so one task orders the N / (rows x PAGE_GROUP) groups only.
    """
    counted = catalog.groupBy(F.floor(F.col(ORDINAL) / rows).alias("block")).agg(
        F.min(ORDINAL).alias("first"), F.max(ORDINAL).alias("last"), F.count(F.lit(1)).alias("rows"),
    ).withColumn("_group", F.floor(F.col("block") / PAGE_GROUP))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    groups = counted.groupBy("_group").agg(F.sum("rows").alias("_n")).select(
        "_group", F.coalesce(F.sum("_n").over(earlier(Window.orderBy("_group"))), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("rows").over(earlier(Window.partitionBy("_group").orderBy("block"))), F.lit(0))
    placed = counted.withColumn("_inside", inside).join(groups, "_group")
    return placed.select("block", "first", "last", "rows", (F.col("_base") + F.col("_inside")).alias("before"))


def page(catalog: DataFrame, page: int = 1, per_page: int = 20, blocks: DataFrame | None = None) -> DataFrame:
    """One page of at most 100 rows in source order, with the totals on every row; ``per_page`` tells the size used.

    With ``blocks``, a written :func:`page_blocks` of the same catalogue, the page reads only
    the ordinals of the blocks it lies in, however deep it is; a catalogue laid out by
    ordinal (``plans.index.save_pages``) then opens only their files.
    """
    number, size = max(int(page), 1), max(1, min(int(per_page), 100))
    skipped = (number - 1) * size
    if blocks is None:
        total = catalog.agg(F.count(F.lit(1))).scalar()
        rows = catalog.orderBy(ORDINAL).offset(skipped).limit(size)
    else:
        met = blocks.where((F.col("before") < skipped + size) & (F.col("before") + F.col("rows") > skipped))
        low, high, before = met.agg(F.min("first"), F.max("last"), F.min("before")).first()
        total = blocks.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
        found = catalog.where("false") if low is None else catalog.where(F.col(ORDINAL).between(low, high))
        rows = found.orderBy(ORDINAL).offset(0 if low is None else skipped - before).limit(size)
    return rows.select(
        "*",
        F.lit(number).alias("page"),
        F.lit(size).alias("per_page"),
        total.alias("total"),
        F.ceil(total / size).alias("total_pages"),
    )


def page_after(catalog: DataFrame, last_ordinal: int, per_page: int = 20) -> DataFrame:
    """The page behind a known row: a pushed-down filter, so depth costs nothing."""
    size = max(1, min(int(per_page), 100))
    return catalog.where(F.col(ORDINAL) > last_ordinal).orderBy(ORDINAL).limit(size)
