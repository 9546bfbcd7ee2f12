"""Vector arithmetic on array columns, and score scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, p: acc + p)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(F.lit(0.0))


def squared_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(
        a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    )
    return F.aggregate(squares, F.lit(0.0), lambda acc, p: acc + p)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_distance(a, b))


def l2_normalise(a: Column) -> Column:
    """Unit-length copy; an all-zero vector stays as it is."""
    length = norm(a)
    return F.when(length > 0, F.transform(a, lambda x: x.cast("double") / length)).otherwise(
        a.cast("array<double>")
    )


def scaled_cosine(score: Column) -> Column:
    """Cosine from [-1, 1] to [0, 1]."""
    return (F.lit(1.0) + score) / F.lit(2.0)


def scaled_inner_product(score: Column) -> Column:
    """Inner product from the real line to (0, 1)."""
    return F.lit(0.5) + F.atan(score) / F.lit(math.pi)


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two id arrays as sets; two empty arrays give 0."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))
