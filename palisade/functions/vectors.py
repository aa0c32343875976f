"""Vector expressions on array columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, length_a: Column | None = None, length_b: Column | None = None) -> Column:
    """(1 - cos) / 2, and 0 where either vector has no length. Lengths may be given where many rows share a vector."""
    lengths = (length(a) if length_a is None else length_a) * (length(b) if length_b is None else length_b)
    return F.when(lengths == 0, 0.0).otherwise((1.0 - dot(a, b) / lengths) / 2.0)


def finite(values: Column) -> Column:
    """NaN -> 0, +inf -> 1, -inf -> 0."""
    inf = F.lit(float("inf"))
    return F.transform(
        values,
        lambda x: F.when(x.isNull() | F.isnan(x) | (x == -inf), 0.0).when(x == inf, 1.0).otherwise(x),
    )
