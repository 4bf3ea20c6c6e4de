"""Tile grids, footprints, patch cutting and tile merging."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions import affine, grid as G, paths as P, projection as PJ
from parcelworks.operators.sweeps import changes, key_codes
from parcelworks.session import spread

PIXELS = 1 << 18  # tile pixels merged at a time
MISSING = np.iinfo(np.int64).min


def tile_grid(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Row-major windows with a snapped last start; size is cut at small images."""
    stride = tile - 2 * overlap
    grid = G.explode_grid(images, G.starts_snapped(F.col("width"), tile, stride), G.starts_snapped(F.col("height"), tile, stride))
    return _sized(grid, tile)


def _sized(grid: DataFrame, tile: int) -> DataFrame:
    return grid.withColumn("tile_width", G.window_size(F.col("width"), F.col("x0"), tile)).withColumn(
        "tile_height", G.window_size(F.col("height"), F.col("y0"), tile)
    )


def min_patch_filter(windows: DataFrame, smallest: int) -> DataFrame:
    return windows.filter((F.col("tile_width") >= smallest) & (F.col("tile_height") >= smallest))


def tile_count(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Windows per image from the start arrays alone."""
    stride = tile - 2 * overlap
    count = F.size(G.starts_snapped(F.col("width"), tile, stride)) * F.size(G.starts_snapped(F.col("height"), tile, stride))
    return images.select("image_id", count.cast("bigint").alias("windows"))


def total_tiles(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    counted = tile_count(images, tile, overlap).agg(F.coalesce(F.sum("windows"), F.lit(0)).alias("n"))
    return counted.select(F.greatest(F.col("n"), F.lit(1)).cast("bigint").alias("total"))


def tile_grid_ceil(images: DataFrame, tile: int, overlap: int, smallest: int = 100) -> DataFrame:
    stride = tile - 2 * overlap
    starts = lambda side: G.starts_ceil(F.col(side), tile, stride, smallest)
    return _sized(G.explode_grid(images, starts("width"), starts("height")), tile)


def tile_grid_inference(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    starts = lambda side: G.starts_inference(F.col(side), tile, overlap)
    return _sized(G.explode_grid(images, starts("width"), starts("height")), tile)


def tile_grid_overlap_split(images: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Constant tile size; each tile carries the origin of its own transform."""
    starts = lambda side: G.starts_overlap_split(F.col(side), tile, overlap)
    grid = _sized(G.explode_grid(images, starts("width"), starts("height")), tile)
    west, north = F.col("c") + F.col("x0") * F.col("a"), F.col("f") + F.col("y0") * F.col("e")
    return grid.withColumn("origin_x", west).withColumn("origin_y", north)


def tile_grid_halo(images: DataFrame, sample: int, bound: int) -> DataFrame:
    """Blocks with a halo of ``bound``; the centre that is written is clipped to the raster."""
    starts = lambda side: G.starts_halo(F.col(side), sample, bound)
    grid = G.explode_grid(images, starts("width"), starts("height"))
    core = lambda start, side: F.least(F.lit(sample), F.col(side) - (F.col(start) + bound)).cast("int")
    return (
        grid.withColumn("block_size", F.lit(sample + 2 * bound))
        .withColumn("core_x", (F.col("x0") + bound).cast("int"))
        .withColumn("core_y", (F.col("y0") + bound).cast("int"))
        .withColumn("core_width", core("x0", "width"))
        .withColumn("core_height", core("y0", "height"))
    )


def tile_grid_metric(images: DataFrame, tile_units: float, buffer_units: float) -> DataFrame:
    """Tiles measured in map units: pixels = units / resolution; the buffer widens both sides."""
    side = lambda units, res: F.greatest(F.floor(F.lit(units) / F.abs(F.col(res))), F.lit(1)).cast("int")
    sized = images.withColumn("step_x", side(tile_units, "a")).withColumn("step_y", side(tile_units, "e"))
    sized = sized.withColumn("pad_x", side(buffer_units, "a")).withColumn("pad_y", side(buffer_units, "e"))
    starts = lambda length, step: F.sequence(F.lit(0), F.col(length) - 1, F.col(step))
    tiled = G.explode_grid(sized, starts("width", "step_x"), starts("height", "step_y"))
    low = lambda start, pad: F.greatest(F.col(start) - F.col(pad), F.lit(0))
    high = lambda start, step, pad, length: F.least(F.col(start) + F.col(step) + F.col(pad), F.col(length))
    return (
        tiled.withColumn("left", low("x0", "pad_x"))
        .withColumn("top", low("y0", "pad_y"))
        .withColumn("right", high("x0", "step_x", "pad_x", "width"))
        .withColumn("bottom", high("y0", "step_y", "pad_y", "height"))
    )


def tile_catalog(images: DataFrame, tile: int, stride: int) -> DataFrame:
    """Plain grid with tile names and map bounds, for label merging."""
    starts = lambda side: F.sequence(F.lit(0), F.col(side) - 1, F.lit(stride))
    grid = _sized(G.explode_grid(images, starts("width"), starts("height")), tile)
    named = grid.withColumn("tile_name", P.tile_name(P.stem(F.col("image_name")), F.col("row"), F.col("col")))
    return with_footprint(named)


def with_footprint(tiles: DataFrame) -> DataFrame:
    """Map bounds and transform origin of each tile."""
    west, north = affine.forward(F.col("x0"), F.col("y0"))
    east, south = affine.forward(F.col("x0") + F.col("tile_width"), F.col("y0") + F.col("tile_height"))
    return (
        tiles.withColumn("west", F.least(west, east))
        .withColumn("south", F.least(north, south))
        .withColumn("east", F.greatest(west, east))
        .withColumn("north", F.greatest(north, south))
        .withColumn("origin_x", west)
        .withColumn("origin_y", north)
    )


def tiles_covering(boxes: DataFrame, zoom: int) -> DataFrame:
    """Web tiles that cover (west, south, east, north) boxes."""
    x0, y0 = PJ.slippy_tile(F.col("west"), F.col("north"), zoom)
    x1, y1 = PJ.slippy_tile(F.col("east"), F.col("south"), zoom)
    span = lambda low, high: F.sequence(F.floor(low), F.greatest(F.ceil(high) - 1, F.floor(low)))
    return boxes.withColumn("tile_x", F.explode(span(x0, x1))).withColumn("tile_y", F.explode(span(y0, y1)))


# ---- patches from scanlines ---------------------------------------------------------

def window_rows(rows: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Each scanline beside every window that covers it: arithmetic only, no join.

    ``rows`` has (image_id, width, height, y, cls). The covering windows follow from the
    raster size, so pixels are never exploded and nothing is shuffled here.
    """
    stride = tile - 2 * overlap
    down = G.covering(G.starts_snapped(F.col("height"), tile, stride), tile, F.col("y"))
    across = G.starts_snapped(F.col("width"), tile, stride)
    opened = rows.withColumn("y0", F.explode(down)).withColumn("x0", F.explode(across))
    opened = _sized(opened, tile)
    return opened.withColumn("part", F.slice("cls", F.col("x0") + 1, F.col("tile_width"))).drop("cls")


def cut_patches(rows: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Patch arrays, one row per window (bounded by the tile size)."""
    pieces = window_rows(rows, tile, overlap)
    gathered = pieces.groupBy("image_id", "y0", "x0", "tile_width", "tile_height").agg(
        F.array_sort(F.collect_list(F.struct("y", "part"))).alias("_rows")
    )
    return gathered.withColumn("patch", F.transform("_rows", lambda r: r["part"])).drop("_rows")


def patch_counts(rows: DataFrame, tile: int, overlap: int) -> DataFrame:
    """Class counts per window. The counts of a scanline's windows are differences of running counts, so a pixel is looked at once for each
    class, however many windows cover it; windows are summed before and after the shuffle."""
    stride = tile - 2 * overlap
    down = G.covering(G.starts_snapped(F.col("height"), tile, stride), tile, F.col("y"))
    across = G.starts_snapped(F.col("width"), tile, stride)
    classes = {"n_background": 0, "n_interior": 1, "n_boundary": 2, "n_ignore": 255}
    names = [*classes, "n_total"]
    placed = rows.select("image_id", "width", "height", down.cast("array<int>").alias("_down"), across.cast("array<int>").alias("_across"), "cls")

    def run(batches):
        for batch in batches:
            values, lengths = batch.column(5).flatten(), pc.fill_null(pc.list_value_length(batch.column(5)), 0).to_numpy().astype(np.int64)
            begin = np.cumsum(lengths) - lengths
            plain = pc.fill_null(values.cast(pa.int64()), -1).to_numpy()
            x0, wide = batch.column(4).flatten().to_numpy().astype(np.int64), pc.list_value_length(batch.column(4)).to_numpy()
            row = np.repeat(np.arange(len(batch)), wide)
            first = np.minimum(begin[row] + x0, begin[row] + lengths[row])
            last = np.minimum(first + tile, begin[row] + lengths[row])
            running = lambda hit: np.append(0, np.cumsum(hit))
            counts = [(c := running(plain == v))[last] - c[first] for v in classes.values()] + [last - first]
            at = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(3)).to_numpy())
            y0 = batch.column(3).flatten().to_numpy()
            # every window of the scanline across, for each one down
            per, start = wide[at], (np.cumsum(wide) - wide)[at]
            pick = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(start, per)
            taken = batch.select(range(3)).take(pa.array(row[pick]))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.repeat(y0, per)), pa.array(x0[pick].astype(np.int32)), *(pa.array(c[pick].astype(np.int64)) for c in counts)], [*taken.schema.names, "y0", "x0", *names])

    kinds = dict(placed.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("image_id", "width", "height")) + ", y0 int, x0 int, " + ", ".join(f"{c} bigint" for c in names)
    pieces = _sized(placed.mapInArrow(run, schema), tile).drop("width", "height")
    return pieces.groupBy("image_id", "y0", "x0", "tile_width", "tile_height").agg(*(F.sum(n).alias(n) for n in names))


def pixel_patch_counts(pixels: DataFrame, tile: int, overlap: int) -> DataFrame:
    """``patch_counts`` of pixel rows (image_id, width, height, y, x, cls): pixels are counted in cells that every window holds or leaves whole.

    Windows begin and end at multiples of a step, but for the last one across and down, which a cell is cut at.
    """
    stride = tile - 2 * overlap
    step = math.gcd(tile, stride)
    classes = {"n_background": 0, "n_interior": 1, "n_boundary": 2, "n_ignore": 255}
    names = [*classes, "n_total"]
    sides = (("x", "width"), ("y", "height"))
    of_class = [F.count(F.when(F.col("cls") == v, 1)).alias(n) for n, v in classes.items()]
    place = [c for at, size in sides for c in (F.floor(F.col(at) / step).alias(f"_{at}"), (F.col(at) >= F.col(size) - tile).alias(f"_{at}_last"))]
    cells = pixels.groupBy("image_id", "width", "height", *place).agg(*of_class, F.count("*").alias("n_total"))

    def windows(at: str, size: str) -> Column:
        begin = F.col(f"_{at}") * step
        within = lambda s: F.when(s % step == 0, (begin >= s) & (begin < s + tile)).otherwise(F.col(f"_{at}_last"))
        return F.explode(F.filter(G.starts_snapped(F.col(size), tile, stride), within))

    opened = _sized(cells.withColumn("y0", windows("y", "height")).withColumn("x0", windows("x", "width")), tile)
    return opened.groupBy("image_id", "y0", "x0", "tile_width", "tile_height").agg(*(F.sum(n).alias(n) for n in names))


def patch_ratios(counts: DataFrame, digits: int = 8) -> DataFrame:
    """Shares of the valid pixels; ignore is a share of all pixels."""
    valid = F.greatest(F.col("n_total") - F.col("n_ignore"), F.lit(1)).cast("double")
    share = lambda name: F.col(name) / valid
    r = lambda value: F.bround(value, digits)
    return (
        counts.withColumn("interior_ratio", r(share("n_interior")))
        .withColumn("boundary_ratio", r(share("n_boundary")))
        .withColumn("background_ratio", r(share("n_background")))
        .withColumn("cropland_ratio", r(share("n_interior") + share("n_boundary")))
        .withColumn("ignore_ratio", r(F.col("n_ignore") / F.col("n_total").cast("double")))
    )


def ignore_overlay(mask_rows: DataFrame, band_rows: DataFrame, black: Column | float | None = 0.0) -> DataFrame:
    """Set the mask to 255 where the image pixel is invalid (scanline join on image and row)."""
    from parcelworks.operators.raster import invalid_pixel

    bands = band_rows.select("image_id", "y", "bands", "nodata")
    joined = mask_rows.join(bands.hint("merge"), ["image_id", "y"])
    masked = F.zip_with("cls", "bands", lambda v, p: F.when(invalid_pixel(p, F.col("nodata"), black), F.lit(255)).otherwise(v))
    return joined.withColumn("cls", masked).drop("bands", "nodata")


def ignored(cls: Column, bands: list[Column], nodata: Column, black: Column | float | None = 0.0) -> Column:
    """The class of a pixel, 255 where its bands are invalid."""
    from parcelworks.operators.raster import invalid_bands

    return F.when(invalid_bands(bands, nodata, black), F.lit(255)).otherwise(cls)


def merge_tiles_core(tiles: DataFrame, overlap: int) -> DataFrame:
    """Tile mask scanlines to one image: cores overwrite, overlap bands only fill zeros.

    ``tiles`` has one row per (image, tile, y): image_id, width, tile_index, row, col, n_rows, n_cols,
    x0, y0, tile_width, tile_height, y, vals. Per pixel the last core tile decides;
    where it wrote 0 (or none exists) the first non-zero overlap value after it is taken.
    The pieces of a scanline come one after the other, in the order of the tiles, and many scanlines are merged at a time.
    """
    half = overlap // 2
    side = lambda cond: F.when(cond, F.lit(half)).otherwise(F.lit(0))
    top, bottom = side(F.col("row") > 0), side(F.col("row") < F.col("n_rows") - 1)
    left, right = side(F.col("col") > 0), side(F.col("col") < F.col("n_cols") - 1)
    core_row = (F.col("y") >= F.col("y0") + top) & (F.col("y") < F.col("y0") + F.col("tile_height") - bottom)
    numbers = {
        "_width": F.col("width"), "_x0": F.col("x0"), "_w": F.col("tile_width"),
        "_from": F.when(core_row, F.col("x0") + left).otherwise(F.lit(1 << 30)), "_to": F.when(core_row, F.col("x0") + F.col("tile_width") - right).otherwise(F.lit(-1)),
    }
    prepared = tiles.select("image_id", "y", F.col("tile_index").alias("_t"), *(c.cast("bigint").alias(n) for n, c in numbers.items()), "vals")
    placed = spread(prepared.dropna(subset=["_width", "_x0", "_w", "vals"]), "image_id", "y").sortWithinPartitions("image_id", "y", "_t")

    def merged(rows):
        line = key_codes(rows.columns[:2])
        first = changes(line)
        line = np.searchsorted(first, np.arange(len(line)), side="right") - 1
        width, x0, w, low, high = (rows.column(k).to_numpy() for k in range(3, 8))
        column = rows.column(8)
        size = np.minimum(column.value_lengths().to_numpy(), w).astype(np.int64)
        source = np.cumsum(column.value_lengths().to_numpy().astype(np.int64)) - column.value_lengths().to_numpy()
        values = pc.fill_null(column.flatten().cast(pa.int64()), MISSING).to_numpy()
        wide = width[first]
        begin = np.cumsum(wide) - wide
        found = np.zeros(int(wide.sum()), np.int64)
        nth = np.arange(len(line)) - first[line]
        by_turn = np.argsort(nth, kind="stable")  # the first piece of every scanline, then the second ones, ...
        for some in np.split(by_turn, changes(nth[by_turn])[1:]):
            row = np.repeat(some, size[some])
            local = np.arange(len(row)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
            x = x0[row] + local
            inside = (x >= 0) & (x < width[row])
            row, local, x = row[inside], local[inside], x[inside]
            at = begin[line[row]] + x
            take = ((x >= low[row]) & (x < high[row])) | (found[at] == 0)
            found[at[take]] = values[(source[row] + local)[take]]
        cls = pa.array(found, mask=found == MISSING).cast(pa.int32())
        offsets = pa.array(np.append(begin, len(found)).astype(np.int32))
        return pa.RecordBatch.from_arrays([*rows.select(["image_id", "y"]).take(pa.array(first)).columns, pa.ListArray.from_arrays(offsets, cls)], ["image_id", "y", "cls"])

    def run(batches):
        held = None
        for batch in batches:
            size = batch.column(8).value_lengths().to_numpy().astype(np.int64)
            place = (np.cumsum(size) - size) // PIXELS
            for first, last in zip(edges := changes(place), [*edges[1:], len(batch)], strict=True) if len(batch) else ():
                part = batch.slice(int(first), int(last - first))
                part = part if held is None else pa.concat_batches([held, part])
                last_line = int(changes(key_codes(part.columns[:2]))[-1])
                if last_line:
                    yield merged(part.slice(0, last_line))
                held = part.slice(last_line)
        if held is not None:
            yield merged(held)

    kinds = dict(tiles.dtypes)
    return placed.mapInArrow(run, f"image_id {kinds['image_id']}, y {kinds['y']}, cls array<int>")
