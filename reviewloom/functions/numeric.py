"""Shares and ratings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 when the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def rating_label(rating: Column) -> Column:
    """4 and up is positive, exactly 3 neutral, anything else negative; null or not a number is null."""
    value = rating.try_cast("double")
    return F.when(value >= 4, "positive").when(value == 3, "neutral").when(value.isNotNull(), "negative")
