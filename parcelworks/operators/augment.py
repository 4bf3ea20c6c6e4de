"""Augmentation as pure functions of (seed, sample, operation)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions.numbers import clamp
from parcelworks.operators.ordering import rank_by_id
from parcelworks.session import spread


def op_draw(seed: Column, op: str) -> Column:
    """Uniform [0, 1) for one operation of one sample."""
    return F.conv(F.substring(F.md5(F.concat(seed.cast("string"), F.lit(f":{op}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def two_digits(value: Column) -> Column:
    cents = F.bround(value * 100, 0).cast("int")
    return F.concat(F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def augment_plan(
    samples: DataFrame, key: str, seed: int = 42, scale: float = 0.15, brightness: float = 0.12, contrast: float = 0.12, noise: float = 0.02
) -> DataFrame:
    """Which transforms a sample gets: seed + 101 * index decides every draw."""
    ranked = rank_by_id(samples.select(key), key)
    planned = ranked.withColumn("sample_seed", (F.lit(seed) + 101 * F.col("rank0")).cast("bigint"))
    draw = lambda op: op_draw(F.col("sample_seed"), op)
    factor = lambda op, amount: F.lit(1.0) + (draw(op) * 2.0 - 1.0) * amount
    planned = planned.select(
        key, "sample_seed", (draw("hflip") < 0.5).alias("hflip"), (draw("vflip") < 0.5).alias("vflip"), F.floor(draw("rotate90") * 4).cast("int").alias("turns"),
        factor("scale", scale).alias("scale"), factor("brightness", brightness).alias("brightness"), factor("contrast", contrast).alias("contrast"), F.lit(noise).alias("noise"),
    )
    named = lambda name, c: F.concat(F.lit(f"{name}="), two_digits(F.col(c)))
    applied = F.concat_ws(
        ", ", F.when(F.col("hflip"), "hflip"), F.when(F.col("vflip"), "vflip"), F.when(F.col("turns") > 0, F.concat(F.lit("rotate90x"), F.col("turns").cast("string"))),
        named("scale", "scale"), named("brightness", "brightness"), named("contrast", "contrast"),
    )
    return planned.withColumn("applied", applied)


def flip_rotate(pixels: DataFrame, hflip: Column, vflip: Column, turns: Column) -> DataFrame:
    """New (y, x) of every pixel after flips and counter-clockwise quarter turns.

    ``pixels`` carries width and height of its image; image and mask pixels move alike.
    """
    x = F.when(hflip, F.col("width") - 1 - F.col("x")).otherwise(F.col("x"))
    y = F.when(vflip, F.col("height") - 1 - F.col("y")).otherwise(F.col("y"))
    moved = pixels.withColumn("_x", x).withColumn("_y", y)
    x, y, right, bottom = F.col("_x"), F.col("_y"), F.col("width") - 1, F.col("height") - 1
    new_y = F.when(turns == 1, right - x).when(turns == 2, bottom - y).when(turns == 3, x).otherwise(y)
    new_x = F.when(turns == 1, y).when(turns == 2, right - x).when(turns == 3, bottom - y).otherwise(x)
    return moved.withColumn("y", new_y).withColumn("x", new_x).drop("_x", "_y")


def scale_rows(rows: DataFrame, factor: Column, value: str = "cls", fill: int = 255) -> DataFrame:
    """Scale about the centre at constant size: crop when enlarged, pad with ``fill`` when reduced.

    Nearest pixels for image and mask. A source scanline knows the target rows it feeds;
    padding rows are given out by the first scanline. No join, no shuffle.
    """
    sized = rows.withColumn("_f", factor)
    for size in ("width", "height"):
        new = F.greatest(F.bround(F.col(size) * F.col("_f"), 0), F.lit(1.0)).cast("int")
        sized = sized.withColumn(f"_new_{size}", new)
        crop = -F.greatest(F.floor((F.col(f"_new_{size}") - F.col(size)) / 2), F.lit(0))
        paste = F.floor((F.col(size) - F.col(f"_new_{size}")) / 2)
        sized = sized.withColumn(f"_shift_{size}", F.when(F.col("_f") >= 1.0, crop).otherwise(paste).cast("int"))

    def source(i: Column, size: str) -> Column:
        position = i - F.col(f"_shift_{size}")
        inside = (position >= 0) & (position < F.col(f"_new_{size}"))
        return F.when(inside, F.least(F.floor((position + 0.5) * F.col(size) / F.col(f"_new_{size}")), F.col(size) - 1).cast("int"))

    none = F.array().cast("array<int>")
    new_h, shift, height = F.col("_new_height"), F.col("_shift_height"), F.col("height")
    near = F.floor(F.col("y") * new_h / height).cast("int") + shift
    low, high = F.greatest(near - 1, F.lit(0)), F.least(near + F.ceil(new_h / height).cast("int") + 1, height - 1)
    fed = F.when(low <= high, F.filter(F.sequence(low, F.greatest(low, high)), lambda i: source(i, "height") == F.col("y"))).otherwise(none)
    bottom = shift + new_h
    above = F.when(shift > 0, F.sequence(F.lit(0), F.greatest(shift - 1, F.lit(0)))).otherwise(none)
    below = F.when(bottom < height, F.sequence(F.least(bottom, height - 1), height - 1)).otherwise(none)
    given = F.when(F.col("y") == 0, F.concat(above, below)).otherwise(none)
    targets = F.concat(
        F.transform(fed, lambda i: F.struct(i.alias("row"), F.lit(False).alias("pad"))), F.transform(given, lambda i: F.struct(i.alias("row"), F.lit(True).alias("pad")))
    )
    opened = sized.withColumn("_targets", targets).filter(F.size("_targets") > 0).withColumn("_t", F.explode_outer("_targets"))
    ready = opened.select(*(F.col("_t.row").alias(c) if c == "y" else F.col(c) for c in rows.columns), "_new_width", "_shift_width", F.col("_t.pad").alias("_pad"))
    names, at, wide_at = rows.columns, rows.columns.index(value), rows.columns.index("width")

    def pick(batches):
        for batch in batches:
            width, new, shift = (batch.column(n).to_numpy().astype(np.int64) for n in (wide_at, len(names), len(names) + 1))
            pad = batch.column(len(names) + 2).to_numpy(zero_copy_only=False)
            values, size = batch.column(at).flatten(), pc.fill_null(pc.list_value_length(batch.column(at)), 0).to_numpy().astype(np.int64)
            row = np.repeat(np.arange(len(batch)), width)
            begin = np.cumsum(width) - width
            position = np.arange(len(row)) - begin[row] - shift[row]
            source = np.minimum(np.floor((position + 0.5) * width[row] / new[row]).astype(np.int64), width[row] - 1)
            inside = (position >= 0) & (position < new[row]) & ~pad[row] & (source < size[row])
            found = values.take(pa.array((np.cumsum(size) - size)[row] + source, mask=~inside)).fill_null(fill)
            columns = list(batch.columns[: len(names)])
            columns[at] = pa.ListArray.from_arrays(pa.array(np.append(begin, len(row)).astype(np.int32)), found)
            yield pa.RecordBatch.from_arrays(columns, names)

    return ready.mapInArrow(pick, rows.schema)


def photometric(lines: DataFrame, opened, brightness: Column, contrast: Column, noise: float, seed: int) -> DataFrame:
    """Brightness factor, contrast about the image's mean grey, Gaussian noise, clip to [0, 255].

    ``lines``: scanlines (image_id, y, ...); ``opened(lines, *keep)`` gives their pixels (image_id, keep, y, x, bands of three values). The mean of an
    image is joined to its scanlines, which are then opened again, so no pixel is shuffled;
    the noise is a Box-Muller value of hashed uniforms, so retries repeat it exactly.
    Bands are plain columns on the way, which keeps the arithmetic in generated code.
    """
    byte = lambda v: clamp(v, 0.0, 255.0)
    names = ("_b1", "_b2", "_b3")
    lit = lambda rows, *keep: opened(rows, *keep).select("image_id", *keep, "y", "x", *(byte(F.element_at("bands", i + 1) * brightness).alias(n) for i, n in enumerate(names)))
    grey = F.lit(0.299) * F.col("_b1") + F.lit(0.587) * F.col("_b2") + F.lit(0.114) * F.col("_b3")
    means = lit(lines).groupBy("image_id").agg(F.bround(F.avg(grey), 6).alias("_mean"))
    known = spread(lines.join(means.hint("merge"), "image_id"), "image_id", "y")  # scanlines are generated: no broadcast
    place = F.concat_ws(":", F.lit(str(seed)), F.col("image_id").cast("string"), F.col("y").cast("string"), F.col("x").cast("string"))
    hashed = lit(known, "_mean").withColumn("_h", F.md5(place))
    part = lambda i: (F.conv(F.substring("_h", 8 * i + 1, 8), 16, 10).cast("double") + 1.0) / 4294967297.0
    normal = F.sqrt(F.lit(-2.0) * F.log(part(0))) * F.cos(part(1) * 6.283185307179586) * (noise * 255.0)
    noisy = hashed.withColumn("_z", normal)
    mean = F.col("_mean")
    return noisy.select("image_id", "y", "x", F.array(*(byte(byte((F.col(n) - mean) * contrast + mean) + F.col("_z")) for n in names)).alias("bands"))
