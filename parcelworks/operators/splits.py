"""Train/val/test assignment: exact sizes under a seeded order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.operators.ordering import rank_by_draw

VALID = ("train", "val", "test")


def _label(train_n: Column, val_n: Column) -> Column:
    rank = F.col("rank0")
    return F.when(rank < train_n, "train").when(rank < train_n + val_n, "val").otherwise("test")


def split_assign_round(units: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Half-even rounded sizes; validation is trimmed so that both fit."""
    total = F.col("total")
    train_n = F.bround(total * F.lit(train)).cast("bigint")
    val_n = F.least(F.bround(total * F.lit(val)).cast("bigint"), F.greatest(total - train_n, F.lit(0)))
    ranked = rank_by_draw(units, seed, key)
    return ranked.withColumn("split", _label(train_n, val_n)).drop("rank0", "total")


def split_assign_floor(units: DataFrame, key: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Truncated sizes; what is left over is test."""
    total = F.col("total")
    ranked = rank_by_draw(units, seed, key)
    sized = _label(F.floor(total * F.lit(train)), F.floor(total * F.lit(val)))
    return ranked.withColumn("split", sized).drop("rank0", "total")


def split_by_unit(rows: DataFrame, unit: str, **sizes) -> DataFrame:
    """Assign on the distinct units (images), then give every row its unit's split."""
    units = split_assign_round(rows.select(unit).distinct(), unit, **sizes)
    return rows.join(units, unit)


def split_train_val(rows: DataFrame, key: str, masked: DataFrame, train: float = 0.8, seed: int = 42) -> DataFrame:
    """floor(train * n) train, the rest val; rows without a mask are dropped afterwards."""
    ranked = rank_by_draw(rows, seed, key)
    named = ranked.withColumn("split", F.when(F.col("rank0") < F.floor(F.col("total") * F.lit(train)), "train").otherwise("val"))
    return named.drop("rank0", "total").join(masked, key, "left_semi")


def split_test_fraction(rows: DataFrame, key: str, fraction: float = 0.15, seed: int = 42) -> DataFrame:
    ranked = rank_by_draw(rows, seed, key)
    test_n = F.floor(F.col("total") * F.lit(fraction))
    return ranked.withColumn("split", F.when(F.col("rank0") < test_n, "test").otherwise("train")).drop("rank0", "total")


def spatial_block_split(tiles: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """Left, middle and right area of an image."""
    place = (F.col("x0") + F.col("tile_width") / 2.0) / F.col("width")
    return tiles.withColumn("split", F.when(place < train, "train").when(place < train + val, "val").otherwise("test"))


def split_join(rows: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """Keep a row's own valid split, otherwise take the assigned one."""
    own = F.lower(F.trim("split"))
    joined = rows.join(assigned.select(key, F.col("split").alias("_assigned")), key, "left")
    return joined.withColumn("split", F.when(own.isin(*VALID), own).otherwise(F.col("_assigned"))).drop("_assigned")


def split_by_unit_of(rows: DataFrame, units: DataFrame, unit: str, **sizes) -> DataFrame:
    """Like ``split_by_unit`` with the full unit list given (units without rows still count)."""
    return rows.join(split_assign_round(units, unit, **sizes), unit)
