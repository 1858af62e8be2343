"""Vector arithmetic over array columns, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product over the shorter length."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    products = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def normalise(v: Column | str) -> Column:
    """Unit length, so similarity is a plain dot product; a zero vector is left alone."""
    v = F.col(v) if isinstance(v, str) else v
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: (x / F.when(length == 0, F.lit(1.0)).otherwise(length)).cast("float"))
