"""Shopper intent: what a query asks for, what a result is about, how scores move."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aisle.functions import fixed_values as fv


def query_constraints(query: Column) -> dict[str, Column]:
    q = F.lower(F.trim(query))
    gender = F.when(q.rlike(fv.QUERY_MEN), "men").when(q.rlike(fv.QUERY_WOMEN), "women")
    return {
        "gender": gender,
        "wants_tshirt": q.rlike(fv.QUERY_TSHIRT),
        "wants_kids": q.rlike(fv.KIDS),
    }


def is_constrained(gender: Column, wants_tshirt: Column) -> Column:
    return gender.isNotNull() | wants_tshirt


def result_flags(name: Column, department: Column, category: Column, description: Column) -> dict[str, Column]:
    blank = F.lit("")
    text = F.lower(F.concat_ws(
        " ", *[F.coalesce(c, blank) for c in (name, department, category, description)]
    ))
    return {
        "has_men": text.rlike(fv.RESULT_MEN),
        "has_women": text.rlike(fv.RESULT_WOMEN),
        "has_kids": text.rlike(fv.KIDS),
        "has_tshirt": text.rlike(fv.RESULT_TSHIRT),
        "has_bra": text.rlike(fv.RESULT_BRA),
    }


def adjusted_score(
    score: Column, wants: dict[str, Column], has: dict[str, Column],
    factors: dict[str, float] | None = None,
) -> Column:
    """Score times the factors of its intent matches and mismatches, kept in [0, 1]."""
    f = fv.INTENT_FACTORS if factors is None else factors
    gender = F.coalesce(wants["gender"], F.lit(""))
    own = F.when(gender == "men", has["has_men"]).when(gender == "women", has["has_women"])
    other = F.when(gender == "men", has["has_women"]).when(gender == "women", has["has_men"])
    gender_factor = (
        F.when(other & ~own, f["wrong_gender"]).when(own, f["right_gender"]).otherwise(1.0)
    )
    kids_factor = F.when(
        gender.isin("men", "women") & has["has_kids"] & ~wants["wants_kids"], f["unwanted_kids"]
    ).otherwise(1.0)
    bra_factor = F.when(wants["wants_tshirt"] & has["has_bra"], f["unwanted_bra"]).otherwise(1.0)
    shirt_factor = F.when(wants["wants_tshirt"] & has["has_tshirt"], f["wanted_tshirt"]).otherwise(1.0)
    adjusted = score * gender_factor * kids_factor * bra_factor * shirt_factor
    return F.greatest(F.lit(0.0), F.least(adjusted, F.lit(1.0)))
