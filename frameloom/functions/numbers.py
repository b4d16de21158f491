"""Numbers of whatever came as text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column, default: float | None = 0.0) -> Column:
    """A value as a double; what is none, or null, is the default."""
    return F.coalesce(value.try_cast("double"), F.lit(default).cast("double"))


def whole(value: Column) -> Column:
    """A whole number of a text or number: fractions of numbers are cut off toward zero, while a text with a fraction is none."""
    return value.try_cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a over b, and 0 where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0)) != 0, a / b).otherwise(0.0)
