"""Numbers as the queries' SQL gives them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(c: Column, places: int) -> Column:
    """The nearest number of so many places, halves away from zero, of the double as it is; Spark's own rounding takes the
    shortest decimal that names the double, which can lie on a half where the double lies below."""
    return F.round(c * 10.0**places) / 10.0**places


def ratio(a: Column, b: Column) -> Column:
    """a / b of counts; not a number where both are 0."""
    return F.when(b == 0, F.lit(float("nan"))).otherwise(a / F.nullif(b, F.lit(0)))
