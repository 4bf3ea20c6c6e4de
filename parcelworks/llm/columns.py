"""Column helpers shared by the native operators."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"\x20\x09-\x0D"
WORD_GAP = f"[{SPACES}]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row, also where the body uses it for every array entry."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def words(text: Column, gap: str = WORD_GAP) -> Column:
    """Non-empty pieces between the gaps; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), gap), lambda w: w != "")


def count_of(text: Column, members: str) -> Column:
    """How many characters of the text are in the class ``[members]``."""
    return F.length(F.regexp_replace(text, f"[^{members}]+", ""))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)
