"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """The sum of products, in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays as it is. Vector and norm are lambda variables, or each component would make them again."""

    def divided(v: Column, n: Column) -> Column:
        return F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: x.cast("double")))

    def unit(v: Column) -> Column:
        return F.transform(F.array(norm(v)), lambda n: divided(v, n))[0]

    return F.transform(F.array(a), unit)[0]


def cosine(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def dual(text_vector: Column, image_vector: Column) -> Column:
    """Both vectors in one, again of unit length."""
    return normalized(F.concat(F.transform(text_vector, lambda x: x.cast("double")), F.transform(image_vector, lambda x: x.cast("double"))))


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, side: Column) -> Column:
    value = degrees + minutes / 60 + seconds / 3600
    return F.when(side.isin("S", "W"), -value).otherwise(value)
