"""Catalogues, listings and index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions import paths as P
from parcelworks.functions.numbers import lenient_double, lenient_int


def scan_files(listing: DataFrame, path: str = "path", suffixes=P.IMAGE_SUFFIXES, skip_masks: bool = True) -> DataFrame:
    """Listing rows with a wanted suffix; mask-like stems are left out."""
    wanted = P.suffix(F.col(path)).isin(*suffixes)
    if skip_masks:
        wanted = wanted & ~P.looks_like_mask(P.stem(F.col(path)))
    return listing.filter(wanted)


def detect_dataset_type(listing: DataFrame, dataset: str, path: str = "path") -> DataFrame:
    """tif beats image beats unknown, one aggregate per dataset."""
    end = P.suffix(F.col(path))
    level = F.when(end.isin(*P.TIF_SUFFIXES), 2).when(end.isin(*P.PHOTO_SUFFIXES), 1).otherwise(0)
    best = listing.groupBy(dataset).agg(F.max(level).alias("_level"))
    named = F.when(F.col("_level") == 2, "tif").when(F.col("_level") == 1, "image").otherwise("unknown")
    return best.select(dataset, named.alias("dataset_type"))


def normalize_manifest(raw: DataFrame, root: str) -> DataFrame:
    """Manifest rows with defaults; an unusable split becomes NULL (see ``split_join``)."""
    image = P.resolve(root, F.col("image_path"))
    split = F.lower(F.trim(F.coalesce(F.col("split"), F.lit(""))))
    filled = lambda name: F.nullif(F.col(name), F.lit(""))
    return raw.select(
        F.coalesce(filled("sample_id"), P.stem(image)).alias("sample_id"),
        image.alias("image_path"),
        P.resolve(root, F.col("mask_path")).alias("mask_path"),
        F.when(split.isin("train", "val", "test"), split).alias("split"),
        F.coalesce(filled("country"), P.first_part(root, image)).alias("country"),
    )


def normalize_patch_index(raw: DataFrame, root: str, bucket) -> DataFrame:
    """Any patch index (all text) to the unified sample index, unreadable numbers as 0."""
    number = lambda name: lenient_double(F.col(name))
    whole = lambda name: lenient_int(F.col(name))
    filled = lambda name: F.nullif(F.col(name), F.lit(""))
    name = F.coalesce(filled("patch_name"), filled("patch_id"), P.stem(F.col("image_path")))
    return raw.select(
        name.alias("sample_id"),
        F.coalesce(F.col("source_tif"), F.lit("")).alias("source_tif"),
        F.coalesce(F.col("split"), F.lit("")).alias("split"),
        *(whole(c).alias(c) for c in ("x", "y", "width", "height")),
        P.resolve(root, F.col("image_path")).alias("image_path"),
        number("cropland_ratio").alias("fg_ratio"),
        number("boundary_ratio").alias("boundary_ratio"),
        number("ignore_ratio").alias("ignore_ratio"),
        bucket(number("cropland_ratio"), number("boundary_ratio"), number("ignore_ratio")).alias("bucket"),
        F.lit(1).alias("use_for_train"),
        F.coalesce(F.col("patch_type"), F.lit("")).alias("note"),
    )


def image_catalog(images: DataFrame, split: Column | None = None) -> DataFrame:
    """Catalogue rows with bounds and pixel size from the affine transform."""
    a, b, c, d, e, f = (F.col(n) for n in "abcdef")
    right = c + a * F.col("width") + b * F.col("height")
    bottom = f + d * F.col("width") + e * F.col("height")
    return images.select(
        "image_id", "image_name", "width", "height", "band_count", "dtype", "crs",
        F.to_json(F.array(a, b, c, d, e, f)).alias("transform"),
        c.alias("bounds_left"), bottom.alias("bounds_bottom"), right.alias("bounds_right"), f.alias("bounds_top"),
        F.coalesce(F.col("nodata").cast("string"), F.lit("")).alias("nodata"),
        F.abs(a).alias("res_x"), F.abs(e).alias("res_y"),
        *([split.alias("split")] if split is not None else []),
    )


def label_catalog(features: DataFrame, layer: str, kind: Column, columns: str, crs: str) -> DataFrame:
    """Feature count and geometry-type histogram per layer.

    Types are counted first, so the JSON is built from one row per (layer, type).
    """
    counted = features.groupBy(layer, kind.alias("kind")).agg(F.count("*").alias("n"))
    folded = counted.groupBy(layer).agg(
        F.sum("n").alias("feature_count"),
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n"))))).alias("geometry_types"),
    )
    return folded.select(layer, "feature_count", F.lit(crs).alias("crs"), F.lit(columns).alias("columns"), "geometry_types")


def missing_paths(index: DataFrame, listing: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Sample ids whose image or mask is not in the listing; only the first ``limit`` if one is given."""
    files = listing.select("path").distinct()
    no_image = index.join(files, index["image_path"] == files["path"], "left_anti").select(key)
    no_mask = index.join(files, index["mask_path"] == files["path"], "left_anti").select(key)
    missing = no_image.union(no_mask).distinct()
    return missing if limit is None else missing.orderBy(key).limit(limit)


def resolve_patch_file(index: DataFrame, listing: DataFrame, stem: str = "patch_name") -> DataFrame:
    """Fill an empty path with the file of that stem, suffixes in priority order."""
    rank = F.array_position(F.array(*(F.lit(s) for s in P.IMAGE_SUFFIXES)), P.suffix(F.col("path")))
    found = (
        listing.withColumn("_rank", rank)
        .filter(F.col("_rank") > 0)
        .groupBy(P.stem(F.col("path")).alias("_stem"))
        .agg(F.min(F.struct("_rank", "path"))["path"].alias("_found"))
    )
    joined = index.join(found, index[stem] == found["_stem"], "left")
    filled = F.coalesce(F.nullif(F.col("image_path"), F.lit("")), F.col("_found"), F.lit(""))
    return joined.withColumn("image_path", filled).drop("_stem", "_found")


def image_mask_join(images: DataFrame, masks: DataFrame) -> DataFrame:
    """Images to the last mask of the same normalised stem.

    Masks are reduced to one per stem before the join; the size of that table decides
    (by the broadcast threshold) whether it is sent to every task or shuffled.
    """
    last = masks.groupBy(P.normalized_stem(F.col("stem")).alias("join_stem")).agg(F.max("path").alias("mask_path"))
    keyed = images.withColumn("join_stem", P.normalized_stem(F.col("stem")))
    return keyed.join(last, "join_stem")


def summarize_index(rows: DataFrame) -> DataFrame:
    """Total and counts by bucket, split and country in one pass."""
    grouped = rows.groupingSets([["bucket"], ["split"], ["country"], []], "bucket", "split", "country").agg(
        F.count("*").alias("n"), F.grouping_id().alias("_set")
    )
    dimension = F.when(F.col("_set") == 3, "bucket").when(F.col("_set") == 5, "split").when(F.col("_set") == 6, "country").otherwise("count")
    value = F.when(F.col("_set") == 3, F.col("bucket")).when(F.col("_set") == 5, F.col("split")).when(F.col("_set") == 6, F.col("country"))
    return grouped.select(dimension.alias("dimension"), F.coalesce(value, F.lit("")).alias("value"), "n")
