"""Vector functions as column expressions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null if either vector is all zero."""
    return F.try_divide(dot(a, b), F.nullif(norm(a) * norm(b), F.lit(0.0)))


def squared_distance(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def similarity_from_product(score: Column) -> Column:
    """Inner product to [0, 1]: tanh above zero, sigmoid below."""
    value = F.when(score >= 0, F.tanh(score)).otherwise(1 / (1 + F.exp(-score)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def similarity_from_distance(distance: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.exp(-distance)))


def signature(vector: Column, planes: int, dimension: int, signs: Column) -> Column:
    """Random-hyperplane signature; the first plane gives the highest bit.

    signs: array of planes * dimension values of +1 and -1.
    """
    product = lambda p: F.aggregate(
        F.zip_with(vector, F.slice(signs, p * dimension + 1, dimension), lambda x, s: x.cast("double") * s), F.lit(0.0), lambda s, v: s + v
    )
    bits = F.transform(F.sequence(F.lit(0), F.lit(planes - 1)), lambda p: F.when(product(p) > 0, F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda s, b: s * 2 + b)


def plane_signs(planes: int, dimension: int) -> Column:
    """Plane signs by an arithmetic rule, the same in every engine and every run."""
    return F.transform(F.sequence(F.lit(0), F.lit(planes * dimension - 1)), lambda i: F.when((i * 7919 + (i * i) % 104729) % 1000 < 500, F.lit(1.0)).otherwise(F.lit(-1.0)))
