"""Window starts along one axis, as array Columns (no shuffle, no join)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelworks.functions.numbers import lit_or_col


def starts_snapped(length: Column, tile: int, stride: int) -> Column:
    """0, stride, ... while a full tile fits, plus a last start flush with the end."""
    last = F.greatest(length - F.lit(tile), F.lit(0)).cast("int")
    return F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))


def starts_ceil(length: Column, tile: int, stride: int, smallest: int = 100) -> Column:
    """ceil(length/stride) starts; a remnant below ``smallest`` is moved back."""
    count = F.ceil(length / F.lit(float(stride))).cast("int")

    def place(index: Column) -> Column:
        start = index * F.lit(stride)
        size = F.least(length, start + F.lit(tile)) - start
        short = (size < tile) & (size < smallest)
        return F.when(short, F.greatest(F.lit(0), F.least(length, start + F.lit(tile)) - F.lit(tile))).otherwise(start).cast("int")

    return F.transform(F.sequence(F.lit(0), count - 1), place)


def starts_full_only(length: Column, tile: int) -> Column:
    """Only complete tiles, stride = tile; empty when none fits."""
    count = F.floor(length / F.lit(tile)).cast("int")
    return F.when(
        count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i * F.lit(tile))
    ).otherwise(F.array().cast("array<int>"))


def starts_inference(length: Column, tile: int, overlap: int) -> Column:
    """ceil((length-overlap)/(tile-overlap)) starts, the last pulled back inside."""
    step = tile - overlap
    count = F.greatest(F.ceil((length - F.lit(overlap)) / F.lit(float(step))), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.when(i * step + tile > length, F.greatest(length - F.lit(tile), F.lit(0)))
        .otherwise(i * F.lit(step))
        .cast("int"),
    )


def starts_overlap_split(length: Column, tile: int, overlap: int) -> Column:
    """Whole strides plus one for a remainder, the last pulled back inside."""
    step = tile - overlap
    whole = F.floor((length - F.lit(overlap)) / F.lit(step))
    count = F.greatest(whole + F.when((length - F.lit(overlap)) % step != 0, 1).otherwise(0), F.lit(1)).cast("int")
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.greatest(F.least(i * F.lit(step), length - F.lit(tile)), F.lit(0)).cast("int"),
    )


def starts_halo(length: Column, sample: int, bound: int) -> Column:
    """Block starts from -bound in steps of the block core; empty cores are left out."""
    starts = F.sequence(F.lit(-bound), (length - F.lit(1)).cast("int"), F.lit(sample))
    return F.filter(starts, lambda s: s + F.lit(bound) < length)


def covering(starts: Column, tile: int, position: Column) -> Column:
    """The starts whose window covers ``position``."""
    return F.filter(starts, lambda s: (s <= position) & (position < s + F.lit(tile)))


def explode_grid(df, xs: Column, ys: Column):
    """One row per (y0, x0) start pair, row-major index in ``window_index``."""
    return (
        df.withColumn("_xs", xs)
        .withColumn("_ys", ys)
        .withColumn("_nx", F.size("_xs"))
        .select("*", F.posexplode_outer("_ys").alias("row", "y0"))
        .select("*", F.posexplode_outer("_xs").alias("col", "x0"))
        .withColumn("window_index", F.col("row") * F.col("_nx") + F.col("col"))
        .drop("_xs", "_ys", "_nx")
        .filter(F.col("x0").isNotNull() & F.col("y0").isNotNull())
    )


def window_size(length: Column, start: Column, tile) -> Column:
    return F.least(lit_or_col(tile), length - start).cast("int")
