"""The given tables and the raster, vector and detection layers derived from them.

Every layer is a projection of one whole table (or a join of two), so it grows with
the data. Rasters are generated as scanlines (one row per image row).
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from parcelworks.functions.scanline import explode_runs
from parcelworks.session import spread

BLOCK = 64  # scanlines of an image that stay together in ``blocks``
PIXELS = 1 << 22  # pixels computed at a time


def opened(lines: DataFrame, *keep: str) -> DataFrame:
    """One row per pixel of every scanline. Values follow as plain columns, which Spark compiles; a function over an array is interpreted."""
    return lines.select(*keep, F.explode_outer(F.sequence(F.lit(0), F.col("width") - 1)).alias("x"))


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = str(folder).rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def images(self) -> DataFrame:
        """Image catalogue from ``supplier``."""
        key, nation = F.col("s_suppkey"), F.col("s_nationkey")
        return self.raw("supplier").select(
            key.alias("image_id"),
            F.concat(F.lit("img_"), key.cast("string"), F.when(key % 5 == 0, ".png").otherwise(".tif")).alias("image_name"),
            (96 + (key * 37) % 48).cast("int").alias("width"),
            (80 + (key * 53) % 48).cast("int").alias("height"),
            F.lit(3).alias("band_count"),
            F.lit("uint8").alias("dtype"),
            F.lit("EPSG:4326").alias("crs"),
            F.lit(0.5).alias("a"),
            F.lit(0.0).alias("b"),
            (100 + nation * 64).cast("double").alias("c"),
            F.lit(0.0).alias("d"),
            F.lit(-0.5).alias("e"),
            (40 + nation).cast("double").alias("f"),
            F.when(key % 3 != 0, F.lit(0)).alias("nodata"),
        )

    @cached_property
    def lines(self) -> DataFrame:
        """One short row per scanline, spread by (image_id, y): row-wise steps then need no shuffle."""
        rows = self.images.select("image_id", "width", "height", "nodata", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("y"))
        return spread(rows, "image_id", "y")

    @cached_property
    def blocks(self) -> DataFrame:
        """The same scanlines spread by image and block of rows, for steps that sum over an image: most of a sum is then made before the shuffle."""
        return self.blocks_of(self.images)

    @staticmethod
    def blocks_of(images: DataFrame) -> DataFrame:
        rows = images.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
        return spread(rows.withColumn("_block", F.floor(F.col("y") / BLOCK)), "image_id", "_block").drop("_block")

    @cached_property
    def mask_rows(self) -> DataFrame:
        """Semantic mask scanlines (0 background, 1 interior, 2 boundary, 255 ignore)."""
        return self.masked(self.lines.drop("nodata"))

    @staticmethod
    def mask_class(x: Column) -> Column:
        image, y = F.col("image_id"), F.col("y")
        striped = (F.floor(x / F.lit(12)) + 3 * F.floor(y / F.lit(10)) + image) % 3 == 0
        return (
            F.when((x * 31 + y * 17 + image * 7) % 89 == 0, F.lit(255))
            .when(striped, F.lit(0))
            .when((x % 12 == 0) | (y % 10 == 0), F.lit(2))
            .otherwise(F.lit(1))
        )

    @cached_property
    def mask_blocks(self) -> DataFrame:
        """The same mask scanlines by image and block of rows, for steps that look at the rows above and below."""
        return self.masked(self.blocks.drop("nodata"))

    @staticmethod
    def masked(lines: DataFrame) -> DataFrame:
        """Adds ``cls``, the values of ``mask_class`` along each scanline, computed for a batch of scanlines at a time."""
        keep = lines.columns
        image_at, width_at, y_at = (keep.index(c) for c in ("image_id", "width", "y"))

        def run(batches):
            for whole in batches:
                sums = np.cumsum(whole.column(width_at).to_numpy().astype(np.int64))
                for n in range(int(sums[-1]) // PIXELS + 1 if len(whole) else 0):
                    low, high = np.searchsorted(sums, [n * PIXELS, (n + 1) * PIXELS])
                    batch = whole.slice(int(low), int(high - low)) if n < sums[-1] // PIXELS else whole.slice(int(low))
                    wide = batch.column(width_at).to_numpy().astype(np.int64)
                    begin = np.cumsum(wide) - wide
                    x = np.arange(wide.sum()) - np.repeat(begin, wide)
                    known = np.repeat(batch.column(image_at).is_valid().to_numpy(zero_copy_only=False), wide)
                    image = np.repeat(batch.column(image_at).fill_null(0).to_numpy(), wide)
                    y = np.repeat(batch.column(y_at).to_numpy().astype(np.int64), wide)
                    ignored = ((x * 31 + y * 17 + image * 7) % 89 == 0) & known
                    striped = ((x // 12 + 3 * (y // 10) + image) % 3 == 0) & known
                    cls = np.where(ignored, 255, np.where(striped, 0, np.where((x % 12 == 0) | (y % 10 == 0), 2, 1))).astype(np.int32)
                    offsets = pa.array(np.append(begin, len(x)).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(cls))], [*keep, "cls"])

        return lines.mapInArrow(run, StructType([*lines.schema.fields, StructField("cls", ArrayType(IntegerType(), False))]))

    @cached_property
    def mask_pixels(self) -> DataFrame:
        return opened(self.blocks, "image_id", "y").withColumn("cls", self.mask_class(F.col("x")))

    @cached_property
    def mask_runs(self) -> DataFrame:
        return explode_runs(self.mask_blocks).select("image_id", "y", "x_start", "x_end", "cls")

    @cached_property
    def rgb_rows(self) -> DataFrame:
        """Three-band scanlines in uint8 range, with some nodata and black pixels."""
        return self.coloured(self.lines)

    @staticmethod
    def coloured(lines: DataFrame) -> DataFrame:
        return lines.withColumn("bands", F.transform(F.sequence(F.lit(0), F.col("width") - 1), Tables.rgb_pixel))

    @staticmethod
    def rgb_pixel(x: Column) -> Column:
        image, y = F.col("image_id"), F.col("y")
        dark = (x + y + image) % 23 == 0
        return F.array(
            F.when(dark, 0).otherwise((x * 7 + y * 3 + image) % 256).cast("int"),
            F.when(dark, 0).otherwise((x * 5 + y * 11 + image * 2) % 256).cast("int"),
            F.when(dark, 0).otherwise((x + y * 2 + image * 3) % 200).cast("int"),
        )

    @cached_property
    def rgb_pixels(self) -> DataFrame:
        return self.coloured(self.blocks).select("image_id", "nodata", "y", F.posexplode_outer("bands").alias("x", "bands"))

    @staticmethod
    def rgb_pixels_of(blocks: DataFrame, *keep: str) -> DataFrame:
        return opened(blocks, "image_id", *keep, "y").withColumn("bands", Tables.rgb_pixel(F.col("x")))

    @cached_property
    def band_pixels(self) -> DataFrame:
        """64-band pixels from ``embeddings``."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("pixel_id"), F.col("label").alias("image_id"), F.col("embedding").alias("bands")
        )

    @cached_property
    def patches(self) -> DataFrame:
        key, total = F.col("p_partkey"), (F.col("p_size") * 20).cast("bigint")
        base = self.raw("part").select(
            key.alias("patch_id"),
            F.concat(F.lit("img_"), (key % 10).cast("string"), F.lit(".tif")).alias("source_tif"),
            total.alias("n_total"),
            ((key * 13) % total).alias("n_ignore"),
        )
        valid, key = F.col("n_total") - F.col("n_ignore"), F.col("patch_id")
        return base.select(
            "*",
            F.floor(valid * ((key * 7) % 12) / F.lit(11.0)).cast("bigint").alias("n_interior"),
            F.when(key % 4 == 0, F.floor(valid / F.lit(23.0))).otherwise(F.lit(0)).cast("bigint").alias("n_boundary"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        doc, chars = F.col("doc_id"), F.col("n_chars")
        return self.raw("documents").select(
            doc.alias("sample_id"),
            F.col("source").alias("source_dataset"),
            F.col("lang").alias("country"),
            F.when(doc % 2 == 0, "window_a").otherwise("window_b").alias("season_window"),
            ((chars % 1000).cast("double") / 1000.0).alias("fg_ratio"),
            ((chars % 37).cast("double") / 5000.0).alias("boundary_ratio"),
            ((chars % 11).cast("double") / 18.0).alias("ignore_ratio"),
            F.when(doc % 13 == 0, 0).otherwise(1).alias("use_for_train"),
            F.when(doc % 7 == 0, "TEST").when(doc % 7 == 1, "Val").when(doc % 7 == 2, "").otherwise("train").alias("split"),
        )

    @cached_property
    def detections(self) -> DataFrame:
        key = F.col("o_orderkey")
        x1, y1 = (key * 7919) % 160, (key * 104729) % 160
        return self.raw("orders").select(
            key.alias("det_id"),
            F.col("o_custkey").alias("image_id"),
            F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2).alias("class_id"),
            x1.cast("double").alias("x1"),
            y1.cast("double").alias("y1"),
            (x1 + 24 + (key * 31) % 64).cast("double").alias("x2"),
            (y1 + 24 + (key * 37) % 64).cast("double").alias("y2"),
            (F.col("o_totalprice") / 500000.0).alias("score"),
        )

    @cached_property
    def instance_runs(self) -> DataFrame:
        """Slanted instance masks as runs, one mask per detection."""
        det, y = F.col("det_id"), F.col("y")
        rows = spread(self.detections, "det_id").select(
            "image_id", F.col("det_id").alias("mask_id"), "det_id", "score", "x1", "x2", "y1",
            F.explode(F.sequence(F.col("y1").cast("int"), F.col("y2").cast("int") - 1)).alias("y"),
        )
        return rows.select(
            "image_id", "mask_id", "score", "y",
            (F.col("x1").cast("int") + (y - F.col("y1").cast("int")) % 5).alias("x_start"),
            (F.col("x2").cast("int") - 1 - (det % 4).cast("int")).alias("x_end"),
        )

    @cached_property
    def features(self) -> DataFrame:
        """Polygon layer: closed four-sided rings in pixel units."""
        key = F.col("c_custkey")
        base = spread(self.raw("customer"), "c_custkey").select(
            key.alias("feature_id"),
            F.col("c_nationkey").alias("layer_id"),
            F.col("c_mktsegment").alias("land_type"),
            (key % 10).alias("image_id"),
            ((8 + (key * 29) % 64).cast("double") + 0.25).alias("x0"),
            ((6 + (key * 43) % 48).cast("double") + 0.25).alias("y0"),
            (10 + (key * 11) % 20).cast("double").alias("w"),
            (9 + (key * 17) % 16).cast("double").alias("h"),
            (key % 4).cast("double").alias("s"),
        )
        x0, y0, w, h, s = (F.col(n) for n in ("x0", "y0", "w", "h", "s"))
        corners = [(x0, y0), (x0 + w, y0 + s), (x0 + w - s, y0 + h), (x0 - s, y0 + h - s), (x0, y0)]
        ring = F.array(*(F.struct(px.alias("x"), py.alias("y")) for px, py in corners))
        return base.select("feature_id", "layer_id", "land_type", "image_id", ring.alias("ring"))

    @cached_property
    def truth_pred(self) -> DataFrame:
        return self.raw("labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("truth"), F.col("toxic").alias("pred"))

    @cached_property
    def mask_pairs(self) -> DataFrame:
        """Per-pixel truth and prediction; the prediction is the mask shifted by a rule."""
        shifted = F.when((F.col("x") + 2 * F.col("y") + F.col("image_id")) % 7 == 0, (F.col("cls") + 1) % 3).otherwise(F.col("cls") % 3)
        return self.mask_pixels.select("image_id", F.col("cls").alias("truth"), shifted.cast("int").alias("pred"))

    @cached_property
    def epochs(self) -> DataFrame:
        """Training log rows from ``events``: one run per user, one epoch per event."""
        key = F.col("event_id")
        return self.raw("events").select(
            F.col("user_id").alias("run_id"),
            key.alias("epoch"),
            (F.col("value") / 500.0).alias("val_loss"),
            (((key * 11) % 23).cast("double") / 23.0).alias("val_boundary_f1"),
            ((key * 7) % 32 + 1).alias("batch"),
        )

    @cached_property
    def job_events(self) -> DataFrame:
        kind = F.col("event_type")
        return self.raw("events").select(
            F.col("user_id").alias("job_id"),
            F.col("event_id").alias("seq"),
            F.col("ts").alias("event_time"),
            F.when(kind == "signup", "queued").when(kind == "purchase", "completed").when(kind == "error", "failed").otherwise("running").alias("status"),
            "value",
            F.concat(F.lit("log "), F.col("props")).alias("line"),
        )

    @cached_property
    def paths(self) -> DataFrame:
        page = F.col("page_id")
        tail = F.when(page % 4 == 0, "_mask").when(page % 4 == 1, "_Label").when(page % 4 == 2, "_semantic_3class").otherwise("")
        return self.raw("pages").select(
            "page_id",
            "url",
            F.concat(F.lit("field_"), F.floor(page / 4.0).cast("string"), tail).alias("stem"),
            F.when(page % 3 == 0, ".tif").when(page % 3 == 1, ".png").otherwise(".txt").alias("suffix"),
        )
