"""Raw cell texts to typed catalogue values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv

WHITESPACE = " \t\n\r\f\x0b"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

_SPEC_WRAPPED = "struct<product_specification: array<struct<key: string, value: string>>>"
_SPEC_LIST = "array<struct<key: string, value: string>>"
_SPEC_FLAT = "map<string, string>"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def number(c: Column) -> Column:
    """Double for a plain decimal literal, null for anything else.

    The pattern keeps out the suffixed forms ('5d') that a SQL cast accepts.
    """
    text = strip(c.cast("string"))
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def product_id(pid: Column, ordinal: Column) -> Column:
    """The source id, or P00001, P00002, … from the row's ordinal."""
    n = (ordinal + 1).cast("string")
    width = F.greatest(F.length(n), F.lit(5))
    return F.coalesce(pid.cast("string"), F.concat(F.lit("P"), F.lpad(n, width, "0")))


def category_levels(tree: Column) -> Column:
    """'["A >> B"]' to [A, B, B, B]: four levels, padded with the deepest one."""
    inner = F.btrim(strip(tree), F.lit("[]\"' "))
    parts = F.filter(F.transform(F.split(inner, fv.TREE_SEPARATOR), strip), lambda p: p != "")
    deepest = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit("General"))
    levels = F.slice(F.concat(parts, F.array_repeat(deepest, fv.TREE_LEVELS)), 1, fv.TREE_LEVELS)
    missing = F.array(*[F.lit(v) for v in fv.TREE_MISSING])
    return F.when(tree.isNull(), missing).otherwise(levels)


def spec_pairs(spec: Column) -> Column:
    """Key/value pairs of a specification text: wrapped list, bare list or flat object."""
    text = F.regexp_replace(strip(spec), r"([:\[,]\s*)None\b", "$1null")
    text = F.regexp_replace(text, r"([:\[,]\s*)True\b", "$1true")
    text = F.regexp_replace(text, r"([:\[,]\s*)False\b", "$1false")
    flat = F.transform(
        F.map_entries(F.from_json(text, _SPEC_FLAT)),
        lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")),
    )
    pairs = F.coalesce(
        F.from_json(text, _SPEC_WRAPPED)["product_specification"],
        F.when(text.startswith("["), F.from_json(text, _SPEC_LIST)),
        flat,
    )
    tidy = F.transform(
        pairs,
        lambda p: F.struct(
            F.lower(strip(F.coalesce(p["key"], F.lit("")))).alias("key"),
            strip(F.coalesce(p["value"], F.lit(""))).alias("value"),
        ),
    )
    return F.filter(
        tidy, lambda p: (p["key"] != "") & (p["value"] != "") & (F.lower(p["value"]) != "nan")
    )


def spec_fields(pairs: Column) -> dict[str, Column]:
    """features, color, material, size_range out of :func:`spec_pairs`."""
    routed = fv.COLOR_KEYS + fv.MATERIAL_KEYS + fv.SIZE_KEYS

    def last(keys: list[str]) -> Column:
        hits = F.filter(pairs, lambda p: p["key"].isin(keys))
        return F.coalesce(F.try_element_at(hits, F.lit(-1))["value"], F.lit(""))

    others = F.slice(F.filter(pairs, lambda p: ~p["key"].isin(routed)), 1, fv.MAX_FEATURES)
    return {
        "features": F.coalesce(
            F.array_join(F.transform(others, lambda p: p["value"]), ", "), F.lit("")
        ),
        "color": last(fv.COLOR_KEYS),
        "material": last(fv.MATERIAL_KEYS),
        "size_range": last(fv.SIZE_KEYS),
    }


def price(c: Column, strict: bool = False) -> Column:
    """'₹1,299' to 1299.0; blank to 0.0; junk to 0.0, or an error when strict."""
    text = strip(F.regexp_replace(c.cast("string"), f"[,{fv.CURRENCY}]", ""))
    blank = text.isNull() | text.isin("", "nan")
    value = number(text)
    if strict:
        junk = F.raise_error(F.concat(F.lit("not a price: "), text)).cast("double")
        return F.when(blank, 0.0).when(value.isNull(), junk).otherwise(value)
    return F.when(blank, 0.0).otherwise(F.coalesce(value, F.lit(0.0)))


def bounded_rating(c: Column) -> Column:
    """A rating clipped to 0–5; missing or non-numeric is 0."""
    value = F.coalesce(number(c), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(5.0), value))


def review_count(c: Column) -> Column:
    """Whole reviews ("12.7" counts as 12); missing or non-numeric is 0."""
    return F.coalesce(number(c).try_cast("int"), F.lit(0))


def tag_words(levels: Column) -> Column:
    """Distinct lower-case words longer than two letters over all levels, sorted."""
    words = F.flatten(F.transform(levels, lambda v: F.split(F.lower(v), r"\s+")))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) > 2)))
