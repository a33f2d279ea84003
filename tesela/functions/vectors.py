"""Vector expressions. All of them stay in the JVM and take arrays of float or double; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where the lengths differ."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.when(F.size(a) == F.size(b), F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1, so that a cosine is an inner product; null for a zero vector."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for zero vectors (they have no direction)."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - cosine(a, b)


def link_similarity(distance: Column) -> Column:
    """Similarity of the relation graph: 1 - d."""
    return F.lit(1.0) - distance


def map_similarity(distance: Column) -> Column:
    """Similarity of the score map: 1 - d/2, at least 0."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - distance / 2)


def cosine_or_zero(a: Column, b: Column) -> Column:
    """Cosine where a zero norm counts as 1, so that zero vectors are at similarity 0."""

    def safe(n: Column) -> Column:
        return F.when(n == 0, 1.0).otherwise(n)

    return dot(a, b) / (safe(norm(a)) * safe(norm(b)))
