"""Patch buckets, types, filters, top-k selections and weighted sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions.hashing import draw01, draw_key
from parcelworks.functions.numbers import lenient_int
from parcelworks.operators.ordering import cumulative_by_id, rank_by_range

# Sampling weight per bucket, in tenths so that sums stay exact.
BUCKET_WEIGHT_TENTHS = {
    "boundary_rich": 30,
    "low_fg": 15,
    "mid_fg": 10,
    "high_fg": 7,
    "very_high_fg": 4,
    "near_background": 3,
}
DEFAULT_WEIGHT_TENTHS = 10


def bucket_of(
    fg: Column,
    boundary: Column,
    ignore: Column,
    *,
    drop_above: float = 0.5,
    rich_above: float = 0.005,
    near_background: float = 0.01,
    low: float = 0.10,
    high: float = 0.70,
    very_high: float = 0.95,
) -> Column:
    foreground = (
        F.when(fg < near_background, "near_background")
        .when(fg < low, "low_fg")
        .when(fg < high, "mid_fg")
        .when(fg < very_high, "high_fg")
        .otherwise("very_high_fg")
    )
    return F.when(ignore > drop_above, "drop").when(boundary > rich_above, "boundary_rich").otherwise(foreground)


def with_bucket(samples: DataFrame) -> DataFrame:
    return samples.withColumn("bucket", bucket_of(F.col("fg_ratio"), F.col("boundary_ratio"), F.col("ignore_ratio")))


def patch_type_of(interior: Column, boundary: Column, ignore: Column) -> Column:
    return (
        F.when(ignore >= 1.0, "ignored")
        .when(boundary > 0, "boundary")
        .when(interior > 0, "interior")
        .otherwise("background")
    )


def keep_patches(
    patches: DataFrame, *, max_ignore: float = 0.5, keep_empty: bool = False, background_share: float = 0.2, seed: int = 42, binary: bool = False
) -> DataFrame:
    """Usable patches: labelled ones always, background by a draw on the patch name."""
    kind = F.col("patch_type")
    if keep_empty:
        background = F.lit(True)
    elif binary:
        background = F.lit(False)
    else:
        background = draw01(seed, F.col("patch_name")) < background_share
    wanted = kind.isin("boundary", "interior") | ((kind == "background") & background)
    return patches.filter((F.col("ignore_ratio") <= max_ignore) & wanted)


def split_filter(rows: DataFrame, split: str = "all", *, train_only: bool = False) -> DataFrame:
    wanted = split.strip().lower()
    out = rows if wanted in ("", "all") else rows.filter(F.lower("split") == wanted)
    return out.filter(lenient_int(F.col("use_for_train").cast("string"), 1) == 1) if train_only else out


def country_window_filter(rows: DataFrame, countries: str = "all", window: str = "both") -> DataFrame:
    """Countries: ``all`` or a comma list; window: window_a, window_b, both or all."""
    season = window.strip().lower()
    if season not in {"window_a", "window_b", "both", "all"}:
        raise ValueError("window must be window_a, window_b, both or all")
    named = [c.strip().lower() for c in countries.split(",") if c.strip()]
    out = rows
    if named and named != ["all"]:
        out = out.filter(F.lower("country").isin(named))
    return out if season in ("both", "all") else out.filter(F.col("season_window") == season)


def countries_normalize(lists: DataFrame, column: str) -> DataFrame:
    parts = lists.select(F.explode(F.split(column, ",")).alias("part"))
    return parts.select(F.trim("part").alias("country")).filter(F.col("country") != "")


def clamp_limit(limit: int) -> int:
    """Bounds of a preview page (fixed values); for the edge that takes a limit from a user."""
    return max(1, min(int(limit), 50))


def select_random(rows: DataFrame, key: str, limit: int = 8, seed: int = 42) -> DataFrame:
    """First ``limit`` rows of the seeded order (a distributed top-k, no full sort)."""
    return rows.orderBy(draw_key(seed, F.col(key)), key).limit(limit)


def select_top(rows: DataFrame, measure: str, key: str, limit: int = 8, descending: bool = True) -> DataFrame:
    measured = F.col(measure).desc() if descending else F.col(measure).asc()
    return rows.orderBy(measured, key).limit(limit)


def select_low_foreground(rows: DataFrame, key: str, limit: int = 8, ceiling: float = 0.15) -> DataFrame:
    low = rows.filter((F.col("fg_ratio") > 0) & (F.col("fg_ratio") <= ceiling))
    return select_top(low, "fg_ratio", key, limit, descending=False)


def max_samples(rows: DataFrame, key: str, count: int, seed: int | None = 42) -> DataFrame:
    """Seeded shuffle then the first ``count``; ``seed=None`` takes the first by key. 0 keeps all."""
    if count <= 0:
        return rows
    return rows.orderBy(key).limit(count) if seed is None else rows.orderBy(draw_key(seed, F.col(key)), key).limit(count)


def select_eval_rows(rows: DataFrame, key: str, count: int, seed: int = 42) -> DataFrame:
    """Test rows when there are any, otherwise all rows; shuffled, first ``count``.

    Both candidate lists are top-k results, so the choice between them is made on at
    most ``2 * count`` rows.
    """
    is_test = F.lower("split") == "test"
    flagged = rows.withColumn("_test", F.coalesce(is_test, F.lit(False)))
    tests = max_samples(flagged.filter("_test"), key, count, seed)
    others = max_samples(flagged, key, count, seed)
    fallback = others.join(tests.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")
    return tests.unionByName(fallback).drop("_test")


def quantile_pick(rows: DataFrame, measure: str, key: str, count: int) -> DataFrame:
    """``count`` rows evenly spaced in the order of ``measure``."""
    if count <= 0:
        return rows.limit(0)
    ranked = rank_by_range(rows, [F.col(measure), F.col(key)])
    if count == 1:
        return ranked.filter(F.col("rank0") == F.floor(F.col("total") / 2)).drop("rank0", "total")
    last = F.col("total") - 1
    spots = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.bround(i * last / F.lit(count - 1.0)).cast("bigint"))
    return ranked.filter((F.col("total") <= count) | F.array_contains(spots, F.col("rank0"))).drop("rank0", "total")


def bucket_weight(bucket: Column) -> Column:
    weight = F.lit(DEFAULT_WEIGHT_TENTHS)
    for name, tenths in BUCKET_WEIGHT_TENTHS.items():
        weight = F.when(bucket == name, F.lit(tenths)).otherwise(weight)
    return weight.cast("bigint")


def sampling_interval_join(weighted: DataFrame, draws: DataFrame, cell: int = 1024) -> DataFrame:
    """Each draw position joins the row whose [cum_before, cum) interval holds it.

    Both sides are cut into cells of the cumulative axis, so the range join is an
    equi-join plus a filter and no cell can hold more than ``cell`` intervals.
    """
    intervals = weighted.withColumn(
        "_slot", F.explode(F.sequence(F.floor(F.col("cum_before") / cell), F.floor((F.col("cum") - 1) / cell)))
    )
    placed = draws.withColumn("_slot", F.floor(F.col("position") / cell))
    hit = (F.col("position") >= F.col("cum_before")) & (F.col("position") < F.col("cum"))
    return placed.join(intervals, "_slot").filter(hit).drop("_slot")


def weighted_sample(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """n draws with replacement, probability proportional to the bucket weight."""
    usable = rows.filter(F.col("use_for_train") == 1)
    weighted = cumulative_by_id(usable.withColumn("weight", bucket_weight(F.col("bucket"))), key, F.col("weight"))
    # one draw per usable row: the draw is a pure function of the row key
    draws = weighted.select(F.col(key).alias("draw_id"), (draw01(seed, F.col(key)) * F.col("total")).alias("position"))
    return sampling_interval_join(weighted.select(key, "bucket", "weight", "cum_before", "cum"), draws)
