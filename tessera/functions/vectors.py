"""Vectors as arrays: sums run in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def l2_normalized(v: Column, length: Column) -> Column:
    """The vector divided by its length; a zero vector stays."""
    return F.when(length == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / length))
