"""Vector checks and cosine as column expressions (FEA2, JON1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has_dimension(vector: Column, dim: int) -> Column:
    return F.coalesce(F.size(vector) == dim, F.lit(False))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector has length zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def best_class(probabilities: Column) -> Column:
    """0-based position of the largest probability; the first one on ties."""
    return F.array_position(probabilities, F.array_max(probabilities)) - 1
