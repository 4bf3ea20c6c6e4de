"""Detections: size tests, label merging, overlap pairs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions import bbox as B
from parcelworks.functions.bbox import Box
from parcelworks.functions.numbers import lit_or_col
from parcelworks.operators.annotations import label_to_map, label_to_pixels
from parcelworks.operators.ordering import rank_within


def prompt_sized(box: Box, width, height, *, min_area: float = 0.005, min_side: float = 0.05, max_area: float | None = 0.55) -> Column:
    """Area share and short-side share of the image within the limits."""
    wide, tall = lit_or_col(width), lit_or_col(height)
    share = box.area / F.greatest(wide * tall, F.lit(1)).cast("double")
    short = F.least(box.width, box.height) / F.greatest(F.least(wide, tall), F.lit(1)).cast("double")
    good = (share >= min_area) & (short >= min_side)
    return good if max_area is None else good & (share <= max_area)


def prompt_size_filter(boxes: DataFrame, width, height, **limits) -> DataFrame:
    return boxes.filter(prompt_sized(Box.of(), width, height, **limits))


def detections_json(detections: DataFrame, group: str = "image_id", key: str = "det_id", *, chunk: int) -> DataFrame:
    """Boxes rounded to whole pixels with size and score, as JSON lists per image.

    Parts are ranges of the unique key, so one image with very many boxes becomes
    several bounded lists; the running id goes on across them.
    """
    numbered = rank_within(detections, group, key)
    whole = {c: F.bround(F.col(c), 0).cast("int") for c in ("x1", "y1", "x2", "y2")}
    item = F.struct(
        (F.col("rank0") + 1).alias("id"),
        F.array(*whole.values()).alias("bbox"),
        (whole["x2"] - whole["x1"]).alias("width"),
        (whole["y2"] - whole["y1"]).alias("height"),
        F.col("score"),
    )
    parts = numbered.groupBy(group, F.floor(F.col(key) / chunk).alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col("rank0"), item.alias("item")))).alias("_l"))
    return parts.select(group, "part", F.size("_l").cast("bigint").alias("num_detections"), F.to_json(F.transform("_l", lambda e: e["item"])).alias("detections"))


def group_labels_by_source(lines: DataFrame) -> DataFrame:
    """Tiles and usable label lines per source raster (``name_row_col.txt``).

    Counted per file first: the distinct tile count then needs no second shuffle of lines.
    """
    usable = F.size(F.split(F.trim("line"), r"\s+")) >= 5
    per_file = lines.groupBy("label_file").agg(F.sum(usable.cast("bigint")).alias("n"))
    source = F.regexp_replace(F.regexp_replace("label_file", r"\.txt$", ""), r"_[^_]*_[^_]*$", "")
    return per_file.groupBy(source.alias("source")).agg(F.count("*").alias("tiles"), F.sum("n").alias("detections"))


def label_tile_text_join(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """Tiles to the label rows of the file with the same stem; tiles without one are skipped."""
    named = labels.withColumn("tile_name", F.regexp_replace("label_file", r"\.txt$", ""))
    return tiles.join(named.hint("merge"), "tile_name")


def labels_to_geo(joined: DataFrame) -> DataFrame:
    """Map box when the raster has a CRS, otherwise the pixel box."""
    c = [F.col(n) for n in ("cx", "cy", "w", "h")]
    on_map = label_to_map(*c, F.col("west"), F.col("south"), F.col("east"), F.col("north"))
    pixel = label_to_pixels(*c, F.col("x0"), F.col("y0"), F.col("tile_width"), F.col("tile_height"))
    pick = lambda a, b: F.when(F.col("has_crs"), a).otherwise(b)
    merged = Box(pick(on_map.x1, pixel.x1), pick(on_map.y1, pixel.y1), pick(on_map.x2, pixel.x2), pick(on_map.y2, pixel.y2))
    return joined.select("*", *merged.columns(), F.when(F.col("has_crs"), "map").otherwise("pixel").alias("source"))


def detection_filter(detections: DataFrame, predicate: Column) -> DataFrame:
    """Keep the rows a caller-supplied Column accepts."""
    return detections.filter(predicate)


def score_threshold(detections: DataFrame, score: str, threshold: float) -> DataFrame:
    return detections.filter(F.col(score) >= threshold)


def best_per_prompt(masks: DataFrame, prompt: str, score: str, key: str) -> DataFrame:
    """Highest score per prompt, lowest key on a tie; one aggregate with map-side combine."""
    best = F.max_by(F.struct(*[c for c in masks.columns if c != prompt]), F.struct(F.col(score), -F.col(key)))
    return masks.groupBy(prompt).agg(best.alias("_b")).select(prompt, "_b.*")


# ---- overlap candidates without all-pairs --------------------------------------------

def size_level(box: Box) -> Column:
    """Power-of-two level of the longer side: at level L the box spans at most 2 x 2 cells."""
    return F.ceil(F.log2(F.greatest(box.width, box.height, F.lit(2.0**-20)))).cast("int")


def levels_for(min_iou: float) -> int:
    """IoU >= t needs sides within a factor t, so levels differ by at most this many."""
    return math.ceil(math.log2(1.0 / min_iou))


def with_cells(boxes: DataFrame, min_iou: float) -> DataFrame:
    """One row per (level, cell_x, cell_y) the box covers, at its own and the next coarser levels.

    Any two boxes with IoU >= ``min_iou`` share a cell, and a box covers at most four cells a level.
    """
    box = Box.of()
    own = size_level(box)
    leveled = boxes.withColumn("_own", own).withColumn("level", F.explode(F.sequence(F.col("_own"), F.col("_own") + levels_for(min_iou))))
    side = F.pow(F.lit(2.0), F.col("level"))
    span = lambda low, high: F.sequence(F.floor(low / side), F.floor(high / side))
    return leveled.withColumn("cell_x", F.explode(span(box.x1, box.x2))).withColumn("cell_y", F.explode(span(box.y1, box.y2)))


def bbox_iou_join(boxes: DataFrame, group: list[str], key: str, min_iou: float) -> DataFrame:
    """Pairs (id_a < id_b) within a group whose IoU reaches ``min_iou``, each once.

    A pair is reported only from the cell that holds the upper left corner of the common
    part, at the coarser of the two levels.
    """
    celled = with_cells(boxes.select(*group, key, "x1", "y1", "x2", "y2"), min_iou)
    place = [*group, "level", "cell_x", "cell_y"]
    a = celled.select(*place, *(F.col(c).alias(f"a_{c}") for c in (key, "x1", "y1", "x2", "y2", "_own")))
    b = celled.select(*place, *(F.col(c).alias(f"b_{c}") for c in (key, "x1", "y1", "x2", "y2", "_own")))
    left, right = Box.of("a_"), Box.of("b_")
    side = F.pow(F.lit(2.0), F.col("level"))
    here = (F.floor(F.greatest(left.x1, right.x1) / side) == F.col("cell_x")) & (F.floor(F.greatest(left.y1, right.y1) / side) == F.col("cell_y"))
    level = F.greatest("a__own", "b__own") == F.col("level")
    overlap = B.iou_exact(left, right)
    pairs = a.join(b, place).filter((F.col(f"a_{key}") < F.col(f"b_{key}")) & level & here)
    return pairs.select(*group, F.col(f"a_{key}").alias("id_a"), F.col(f"b_{key}").alias("id_b"), overlap.alias("iou")).filter(F.col("iou") >= min_iou)
