"""Vector expressions; arithmetic is in double precision."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also where the body uses it for every element of an array."""
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(vector: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    return let(F.sqrt(dot(vector, vector)), lambda n: F.transform(vector, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def int8_codes(vector: Column) -> Column:
    """Scalar quantisation: each component as a step of 1/127 of the vector's largest."""
    top = lambda v: F.array_max(F.transform(v, lambda x: F.abs(x.cast("double"))))
    codes = lambda v: let(top(v), lambda t: F.transform(v, lambda x: F.round(x.cast("double") / F.when(t == 0, 1.0).otherwise(t) * 127).cast("tinyint")))
    return let(vector, codes)
