"""Catalogue cleaning: one lazy plan from unified to ready rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv
from aisle.functions import text
from aisle.functions.parsing import bounded_rating
from aisle.schema import ORDINAL

#: Ranks that one narrowing round of the price percentile looks at, and the number of rounds.
GRID, ROUNDS = 2000, 3


def clean_text_fields(df: DataFrame, pattern: str | None = None) -> DataFrame:
    """Markup, links and non-ASCII out of the text columns; sales phrases out of the long ones."""
    present = [c for c in fv.CLEAN_COLUMNS if c in df.columns]
    df = df.withColumns({c: text.clean_text(F.col(c)) for c in present})
    long_texts = [c for c in ("description", "features") if c in df.columns]
    return df.withColumns({c: text.strip_boilerplate(F.col(c), pattern) for c in long_texts})


def _narrowed(values: DataFrame, within: Column) -> Column:
    """One round: a smaller range around the wanted order statistics, as a scalar (low, high, position).

    ``within`` is the previous round's. The rows below the range are counted
    exactly, the ones inside give a sketch of evenly spaced ranks; the new range ends one
    rank step outside the wanted places, which is more than the sketch's error. Small
    ranges stay as they are.
    """
    v, inside = F.col("v"), (F.col("v") >= F.col("w.low")) & (F.col("v") <= F.col("w.high"))
    steps = [i / GRID for i in range(GRID + 1)]
    seen = values.select("v", within.alias("w")).groupBy("w").agg(
        F.count_if(v < F.col("w.low")).alias("below"), F.count_if(inside).alias("n"),
        F.percentile_approx(F.when(inside, v), steps, 10 * GRID).alias("marks"),
    )
    place = F.floor("w.position") - F.col("below")

    def mark(index: Column) -> Column:
        return F.get("marks", F.least(F.greatest(index, F.lit(0)), F.lit(GRID)).cast("int"))

    low = mark(F.floor(place * GRID / F.col("n")) - 1)
    high = mark(F.ceil((place + 1) * GRID / F.col("n")) + 1)
    many = F.col("n") >= 10 * GRID
    return seen.select(F.struct(
        F.when(many, low).otherwise(F.col("w.low")).alias("low"),
        F.when(many, high).otherwise(F.col("w.high")).alias("high"), F.col("w.position").alias("position"),
    )).scalar()


def percentile_exact(df: DataFrame, column: str, p: float) -> DataFrame:
    """One row: the exact, linearly interpolated percentile of a non-null column.

    The built-in exact percentile holds every distinct value in one task, and a window
    over all values sorts them in one. Here rounds of aggregates narrow a range around the
    two order statistics: rows below it are counted, the ones inside give the sketch for
    the next round. Each of the ROUNDS leaves about 4/GRID of the rows, so of 10^12 rows
    some thousands of different values remain; these, with their counts, are one array.
    Without values the percentile is null.
    """
    values = df.select(F.col(column).cast("double").alias("v")).where(F.col("v").isNotNull())
    first = values.agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n"))
    position = (F.col("n") - 1) * F.lit(float(p))
    target = first.select(F.struct("low", "high", position.alias("position"))).scalar()
    for _ in range(ROUNDS):
        target = _narrowed(values, target)
    # everything below the range falls into the null group
    held = (
        values.select("v", target.alias("w")).where(F.col("v") <= F.col("w.high"))
        .groupBy(F.when(F.col("v") >= F.col("w.low"), F.col("v")).alias("v")).agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("copies"))), F.lit(0)).alias("below"),
            F.array_sort(F.collect_list(F.when(F.col("v").isNotNull(), F.struct("v", "copies")))).alias("values"))
    )
    held = held.select("below", "values", target["position"].alias("position"))
    none = F.lit(None).cast("double")

    def step(state: Column, entry: Column) -> Column:
        seen = state["seen"] + entry["copies"]

        def reached(name: str, index: Column) -> Column:
            return F.coalesce(state[name], F.when(index < seen, entry["v"])).alias(name)

        place = F.col("position")
        return F.struct(seen.alias("seen"), reached("first", F.floor(place)), reached("second", F.ceil(place)))

    start = F.struct(F.col("below").alias("seen"), none.alias("first"), none.alias("second"))
    ends = held.select("position", F.aggregate("values", start, step).alias("at"))
    weight = F.col("position") - F.floor("position")
    return ends.select((F.col("at.first") + (F.col("at.second") - F.col("at.first")) * weight).alias("percentile"))


def price_cap(df: DataFrame, p: float = 0.999) -> DataFrame:
    """One row, one column: the price percentile above which outliers are judged."""
    filled = df.select(F.coalesce(F.col("price").cast("double"), F.lit(0.0)).alias("price"))
    return percentile_exact(filled, "price", p).select(F.col("percentile").alias("price_cap"))


def normalize_prices(df: DataFrame, factor: float = 3.0, p: float = 0.999, cap: Column | None = None) -> DataFrame:
    """Prices beyond ``factor`` times the percentile cap, by default that of ``df``, are set to the cap."""
    price = F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    cap = price_cap(df, p).scalar() if cap is None else cap
    return df.withColumn("price", F.when((cap > 0) & (price > cap * factor), cap).otherwise(price))


def normalize_ratings(df: DataFrame) -> DataFrame:
    return df.withColumn("rating", bounded_rating(F.col("rating")))


def _groups(df: DataFrame) -> DataFrame:
    """One row per (product_name, category) that stays: its first ordinal and the rows it stands for."""
    keys = df.select(ORDINAL, "product_id", "product_name", "category")
    per_id = keys.groupBy("product_id").agg(
        F.min(F.struct(ORDINAL, "product_name", "category")).alias("first"), F.count(F.lit(1)).alias("rows")
    )
    return per_id.groupBy("first.product_name", "first.category").agg(
        F.min(f"first.{ORDINAL}").alias(ORDINAL), F.sum("rows").alias("rows")
    )


def _survivors(df: DataFrame) -> DataFrame:
    return _groups(df).select(ORDINAL)


def remove_duplicates(df: DataFrame) -> DataFrame:
    """Keep the first row per product_id, then the first per (product_name, category).

    The survivors are chosen on four narrow columns with map-side combined
    aggregates, so a key with a huge number of copies arrives as one row per
    map task; the wide rows move once, for the semi join.
    """
    return df.join(_survivors(df), ORDINAL, "left_semi")


def remove_empty(df: DataFrame) -> DataFrame:
    return df.where(F.length(F.trim("product_name")) > 2)


def fill_missing(df: DataFrame, blank_is_missing: bool = True) -> DataFrame:
    """Defaults for null and 'nan' texts, and for '' where the default is a word."""
    filled = {}
    for name, default in fv.FILL_DEFAULTS.items():
        if name in df.columns:
            c = F.col(name)
            missing = c.isNull() | (c == "nan")
            if blank_is_missing and default:
                missing = missing | (c == "")
            filled[name] = F.when(missing, default).otherwise(c)
    return df.withColumns(filled)


def validate_schema(df: DataFrame) -> DataFrame:
    missing = [c for c in ("product_id", "product_name", "department", "category") if c not in df.columns]
    if missing:
        raise ValueError(f"schema validation failed, missing columns: {missing}")
    return df


def run(df: DataFrame, pattern: str | None = None, blank_is_missing: bool = True) -> DataFrame:
    """clean → prices → ratings → duplicates → empty names → defaults → check.

    Duplicates are told by cleaned names, but only the rows that stay have their texts
    cleaned: cleaning looks at one row at a time. The price cap is that of all rows.
    """
    return (
        df.join(_survivors(clean_text_fields(df, pattern)), ORDINAL, "left_semi")
        .transform(clean_text_fields, pattern)
        .transform(normalize_prices, cap=price_cap(df).scalar())
        .transform(normalize_ratings)
        .transform(remove_empty)
        .transform(fill_missing, blank_is_missing)
        .transform(validate_schema)
    )


def run_observed(
    df: DataFrame, pattern: str | None = None, blank_is_missing: bool = True
) -> tuple[DataFrame, dict[str, Observation]]:
    """:func:`run` with a row counter around each step that drops rows.

    The counters fill while the first action runs, without a pass of their own.
    """
    counters = {name: Observation(name) for name in ("input", "deduplicated", "non_empty")}

    def counted(frame: DataFrame, name: str) -> DataFrame:
        return frame.observe(counters[name], F.count(F.lit(1)).alias("rows"))

    cleaned = clean_text_fields(df, pattern).transform(normalize_prices).transform(normalize_ratings)
    unique = counted(cleaned, "input").join(_survivors(cleaned), ORDINAL, "left_semi")
    named = remove_empty(counted(unique, "deduplicated"))
    ready = counted(named, "non_empty").transform(fill_missing, blank_is_missing)
    return validate_schema(ready), counters


def removal_report(df: DataFrame, pattern: str | None = None) -> DataFrame:
    """Rows left after each step that drops rows, as a table (step, rows), from one pass over the input.

    The groups of duplicates know how many rows they stand for, so the input is their sum.
    """
    groups = _groups(clean_text_fields(df, pattern))
    counts = groups.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("input"), F.count(F.lit(1)).alias("deduplicated"),
        F.count_if(F.length(F.trim("product_name")) > 2).alias("non_empty"),
    )
    return counts.unpivot([], ["input", "deduplicated", "non_empty"], "step", "rows")
