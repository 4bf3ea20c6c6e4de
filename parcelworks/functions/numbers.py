"""Numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_or_col(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def half_even(value: Column, digits: int = 0) -> Column:
    """Banker's rounding, the rounding used for every published ratio.

    As ``round_even`` in the SQL twins, it rounds the number times a power of ten: 0.5015 is 501.49999999999994 thousandths and becomes 0.501.
    ``bround`` takes the shortest decimal text of the number instead, a tie here.
    """
    value, power = value.cast("double"), 10.0**digits
    return F.when(F.abs(value * power) == float("inf"), value).otherwise(F.rint(value * power) / power)


def r6(value: Column) -> Column:
    """Half-even rounding to six digits; ``+ 0.0`` folds negative zero."""
    return F.bround(value.cast("double"), 6) + F.lit(0.0)


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, lit_or_col(low)), lit_or_col(high))


def lenient_double(value: Column) -> Column:
    """Text to double; empty, missing or unreadable text is 0."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")).try_cast("double"), F.lit(0.0))


def lenient_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(F.nullif(F.trim(value), F.lit("")).try_cast("double").cast("int"), F.lit(default))


def count_where(condition: Column) -> Column:
    return F.sum(F.when(condition, F.lit(1)).otherwise(F.lit(0))).cast("bigint")
