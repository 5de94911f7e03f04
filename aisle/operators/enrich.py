"""Template enrichment of product descriptions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv
from aisle.functions.text import constant, word_count


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lookup(table: Mapping[str, str], *keys: Column) -> Column:
    """The value of the first key present in the table, else its default."""
    entries = {k: v for k, v in table.items() if k != "default"}
    pairs = constant(entries, "map<string, string>")
    return F.coalesce(*[F.try_element_at(pairs, k) for k in keys], F.lit(table["default"]))


def slot_lookups(df: DataFrame) -> DataFrame:
    """Use case, occasion and audience by category, else department, else default."""
    keys = (_text("category"), _text("department"))
    return df.withColumns({
        "use_case": lookup(fv.USE_CASES, *keys),
        "occasion": lookup(fv.OCCASIONS, *keys),
        "target_audience": lookup(fv.AUDIENCES, *keys),
    })


def slot_text(df: DataFrame) -> DataFrame:
    """The optional phrases: present field in a phrase, absent field as its fallback."""
    t = fv.SLOT_TEXTS

    def phrase(name: str, slot: str, missing: str = "") -> Column:
        before, after = t[slot].split("%s")
        value = _text(name)
        return F.when(value != "", F.concat(F.lit(before), value, F.lit(after))).otherwise(missing)

    features, price = _text("features"), F.coalesce(F.col("price").cast("double"), F.lit(0.0))
    return df.withColumns({
        "features_text": F.when(features != "", features).otherwise(t["features_missing"]),
        "color_text": phrase("color", "color"),
        "material_text": phrase("material", "material", t["material_missing"]),
        "size_text": phrase("size_range", "size"),
        "description_text": _text("description"),
        "price_text": F.when(
            price != 0, F.concat(F.lit(fv.CURRENCY), F.format_number(price, 0))
        ).otherwise(t["price_missing"]),
        "tags_text": phrase("tags", "tags"),
        "specs_text": F.lit(""),
        "value_proposition": F.lit(t["value_proposition"]),
        "rating_text": F.coalesce(F.col("rating").cast("double"), F.lit(0.0)).cast("string"),
    })


def _fill(template: str) -> Column:
    """A template with {slots} as one concat of literals and columns."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{"):
            slot = piece[1:-1]
            parts.append(_text("rating_text" if slot == "rating" else slot))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def template_key(templates: Mapping[str, str] | None = None) -> Column:
    """The first template whose name occurs in department + category."""
    names = [k for k in (templates or fv.TEMPLATES) if k != "default"]
    haystack = F.lower(F.concat(_text("department"), F.lit(" "), _text("category")))
    chosen = F.when(F.contains(haystack, F.lit(names[0].lower())), names[0])
    for name in names[1:]:
        chosen = chosen.when(F.contains(haystack, F.lit(name.lower())), name)
    return chosen.otherwise("default")


def enrich_descriptions(df: DataFrame, templates: Mapping[str, str] | None = None) -> DataFrame:
    """Add ``enriched_description``: a filled template, padded when it is short."""
    templates = templates or fv.TEMPLATES
    slots = slot_text(slot_lookups(df)).withColumn("_template", template_key(templates))
    body = F.when(F.lit(False), "")
    for name, template in templates.items():
        body = body.when(F.col("_template") == name, _fill(template))
    filled = slots.withColumn("_body", body)
    padded = F.when(
        word_count(F.col("_body")) < fv.MIN_WORDS, F.concat("_body", _fill(fv.PADDING_TEMPLATE))
    ).otherwise(F.col("_body"))
    return filled.withColumn("enriched_description", F.trim(padded)).select(*[
        c for c in df.columns if c != "enriched_description"
    ], "enriched_description")


def length_stats(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count(F.lit(1)).alias("products"),
        F.round(F.avg(word_count(F.col("enriched_description"))), 4).alias("avg_words"),
    )
