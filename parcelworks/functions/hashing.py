"""Deterministic draws: pure functions of (seed, key), equal on every retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, key: Column) -> Column:
    """32 hex digits ordering the keys pseudo-randomly under ``seed``."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def draw01(seed: int, key: Column) -> Column:
    """Uniform value in [0, 1) for ``key`` under ``seed``."""
    return F.conv(F.substring(draw_key(seed, key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
