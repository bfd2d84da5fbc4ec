"""Vector expressions over ``array<float>``; sums run in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from msgscreen.functions.bind import bind


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda total, x: total + x,
    )


def l2_norm(v: Column) -> Column:
    return F.sqrt(
        F.aggregate(v, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    )


def l2_normalise(v: Column) -> Column:
    """Unit vector of ``v``; the zero vector stays as it is."""
    return bind(
        l2_norm(v),
        lambda norm: F.when(norm == 0, v).otherwise(
            F.transform(v, lambda x: (x.cast("double") / norm).cast("float"))
        ),
    )
