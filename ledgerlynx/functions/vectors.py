"""Vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(
        a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 for missing, empty or zero vectors."""
    scale = norm(a) * norm(b)
    return F.coalesce(F.when(scale > 0, dot(a, b) / scale), F.lit(0.0))


def hash_vector(text: Column) -> Column:
    """Eight values in [0, 1] taken from the bytes of a digest of the lowered text.

    A placeholder without any notion of meaning: equal texts give equal vectors.
    """
    digest = F.md5(F.lower(text))
    return F.array(*[
        F.conv(F.substring(digest, 1 + 2 * i, 2), 16, 10).cast("double") / F.lit(255.0)
        for i in range(8)
    ])
