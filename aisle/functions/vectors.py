"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores are compared at this precision, so that two summation orders of the
#: same numbers rank alike and ties fall to the explicit tie-break.
SCORE_DIGITS = 9


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def nonzeros(a: Column) -> Column:
    """(i, x) entries of a vector: few for a short query under a hashed encoder."""
    entries = F.transform(a, lambda x, i: F.struct(i.alias("i"), x.cast("double").alias("x")))
    return F.filter(entries, lambda e: e["x"] != 0)


def dot_nonzeros(entries: Column, b: Column) -> Column:
    """Dot product that visits only the left side's non-zero positions."""
    return F.aggregate(
        entries, F.lit(0.0), lambda acc, e: acc + e["x"] * F.get(b, e["i"]).cast("double")
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column) -> Column:
    """Unit vector; the zero vector stays zero."""
    size = norm(a)
    return F.when(size == 0, a.cast("array<float>")).otherwise(
        F.transform(a, lambda x: (x.cast("double") / size).cast("float"))
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity floored at 0; 0 when either side is the zero vector."""
    sizes = norm(a) * norm(b)
    value = F.when(sizes == 0, 0.0).otherwise(dot(a, b) / sizes)
    return F.round(F.greatest(F.lit(0.0), value), SCORE_DIGITS)


def squared_l2(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.round(F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v), SCORE_DIGITS)


def confidence(squared_distance: Column) -> Column:
    """Squared L2 of unit vectors to [0, 1]; there it is the clamped cosine."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - squared_distance / 2.0))
