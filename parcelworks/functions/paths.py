"""File names and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File suffixes and mask stem endings that the data layout uses.
IMAGE_SUFFIXES = (".tif", ".tiff", ".png", ".jpg", ".jpeg")
TIF_SUFFIXES = (".tif", ".tiff")
PHOTO_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
MASK_ENDINGS = ("_mask", "_label", "_labels", "_semantic", "_semantic_3class", "_semantic_2class")
MASK_LIKE = ("_mask", "_label", "_labels")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[A-Za-z0-9]+$", "")


def normalized_stem(stem_col: Column) -> Column:
    return F.regexp_replace(F.lower(stem_col), f"({'|'.join(MASK_ENDINGS)})$", "")


def looks_like_mask(stem_col: Column) -> Column:
    return F.lower(stem_col).rlike(f"({'|'.join(MASK_LIKE)})$")


def resolve(root: str, path: Column) -> Column:
    """Absolute paths stay; others are put under ``root``; empty becomes NULL."""
    given = F.nullif(F.trim(path), F.lit(""))
    return F.when(given.startswith("/"), given).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), given))


def first_part(root: str, path: Column) -> Column:
    """First folder below ``root``; ``unknown`` for files directly in it or outside."""
    base = root.rstrip("/") + "/"
    inside = F.substring(path, len(base) + 1, 1 << 20)
    return F.when(path.startswith(base) & inside.contains("/"), F.split_part(inside, F.lit("/"), F.lit(1))).otherwise("unknown")


def is_within(path: Column, root: str) -> Column:
    """True when ``path`` has no parent step left and lies under ``root``."""
    return path.startswith(root.rstrip("/") + "/") & ~F.concat(path, F.lit("/")).contains("/../")


def safe_name(value: Column, limit: int | None = None) -> Column:
    cleaned = F.regexp_replace(value, r"[^\p{L}\p{N}_-]", "_")
    if limit is None:
        return cleaned
    short = F.concat(F.substring(cleaned, 1, limit - 9), F.lit("_"), F.substring(F.md5(value), 1, 8))  # a cut name stays unique
    return F.when(F.length(cleaned) <= limit, cleaned).otherwise(short)


def window_name(stem_col: Column, x: Column, y: Column) -> Column:
    return F.format_string("%s_x%06d_y%06d", stem_col, x, y)


def tile_name(stem_col: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_%04d_%04d", stem_col, row, col)
