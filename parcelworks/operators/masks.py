"""Masks as runs: areas, overlaps, unions, painting, morphology, run-length form.

A run is one row ``(image_id, y, x_start, x_end, ...)`` with inclusive ends. Row work is
cut into cells of ``CELL`` columns, so no task ever pairs a whole row or a whole image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from parcelworks.functions.scanline import explode_runs, run_starts, runs
from parcelworks.operators.ordering import rank_within
from parcelworks.operators.sweeps import changes, key_codes, swept
from parcelworks.session import spread

CELL = 64
LINE = ["image_id", "y"]


def length() -> Column:
    return F.col("x_end") - F.col("x_start") + 1


def with_columns_cells(df: DataFrame, low: str = "x_start", high: str = "x_end") -> DataFrame:
    """One row per column cell that the run touches."""
    return df.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(low) / CELL), F.floor(F.col(high) / CELL))))


# ---- per mask -----------------------------------------------------------------------

def mask_area_bbox(mask_runs: DataFrame, key: list[str], masks: DataFrame | None = None, size: tuple[Column, Column] | None = None) -> DataFrame:
    """Area and inclusive bounding box per mask; masks without pixels get zeros."""
    found = mask_runs.groupBy(*key).agg(
        F.sum(length()).cast("bigint").alias("area"),
        F.min("x_start").alias("x1"), F.min("y").alias("y1"), F.max("x_end").alias("x2"), F.max("y").alias("y2"),
    )
    if masks is None:
        return found
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    full = masks.join(found, key, "left")
    return full.select(*masks.columns, *(zero(c) for c in ("area", "x1", "y1", "x2", "y2")))


def mask_size_filter(mask_runs: DataFrame, key: list[str], smallest: int = 0, largest: int | None = None) -> DataFrame:
    """Masks with an area in [smallest, largest]."""
    sized = mask_area_bbox(mask_runs, key)
    kept = F.col("area") >= smallest
    return sized.filter(kept if largest is None else kept & (F.col("area") <= largest))


def bbox_per_value(value_runs: DataFrame, value: str) -> DataFrame:
    """One box per distinct non-zero raster value, numbered in value order."""
    boxes = mask_area_bbox(value_runs.filter(F.col(value) != 0), ["image_id", value]).drop("area")
    return rank_within(boxes, "image_id", value).withColumn("id", F.col("rank0") + 1).drop("rank0")


# ---- sweeps over one raster row ------------------------------------------------------

def sweep(segments: DataFrame, need: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Maximal runs covered by at least ``need`` segments, per (image_id, y).

    Starts and ends are summed per position, first in the task that holds the segments; a row then has at most one event per column.
    ``keep`` names columns that are constant per image.
    """
    return swept(segments.select("image_id", *keep, "y", "x_start", "x_end").withColumn("_d", F.lit(1)), ["image_id"], keep, need)


def semantic_union(mask_runs: DataFrame) -> DataFrame:
    """Pixels of any mask, as disjoint maximal runs."""
    return sweep(mask_runs)


def paint(mask_runs: DataFrame, value: str, highest: bool = True) -> DataFrame:
    """Visible value per segment when masks are painted over each other.

    The winner is the largest (or smallest) value. Segments end where a run ends and at the borders of cells.
    """
    named = packets(mask_runs.select(*LINE, "x_start", "x_end", F.col(value).alias("mask_id")), nulls=True)
    return paint_packets(named.withColumnRenamed("mask_id", value), value, highest)


def paint_packets(packed: DataFrame, value: str, highest: bool = True) -> DataFrame:
    """``paint`` of packets (image_id, value, _band, _cell, _runs).

    They come by cell and value, so those painted later win; some cells are painted at a time. A cell of very many packets is painted in parts on
    the same pixels: masks are neither paired nor gathered.
    """
    import numpy as np
    import pyarrow as pa

    order = F.col(value).asc_nulls_first() if highest else F.col(value).desc_nulls_first()
    placed = spread(packed.select(*PACKET, value, "_runs"), *PACKET).sortWithinPartitions(*PACKET, order)
    size = CELL * CELL

    def painted(part, before):
        """Keys of the cells of a part, their pixels (row of the value, -1 for none), where segments end, and the values; ``before`` is the first cell so far."""
        first = changes(key_codes(part.columns[:1]), *(part.column(c).to_numpy() for c in PACKET[1:]))
        group = np.searchsorted(first, np.arange(len(part)), side="right") - 1
        pixels, cuts, values = np.full(len(first) * size, -1, np.int32), np.zeros(len(first) * size + 1, bool), part.column(value)
        if before is not None:
            pixels[:size], cuts[:size] = np.where(before[1] < 0, -1, before[1] + len(part)), before[2]
            values = pa.concat_arrays([values, before[3]])
        column = part.column("_runs")
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(part) + 1, column.offset * 4)
        line, low, high = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 3).astype(np.int64).T
        row = np.repeat(np.arange(len(part)), np.diff(offsets) // 3)
        start = group[row] * size + line * CELL + low
        length = high - low + 1
        cuts[start] = True
        cuts[(start + length)[high < CELL - 1]] = True
        at = np.arange(length.sum()) + np.repeat(start - (np.cumsum(length) - length), length)
        pixels[at] = np.repeat(row, length)  # of equal places the last one stays
        return part.select(PACKET).take(pa.array(first)), pixels, cuts[:-1], values

    def segments(keys, pixels, cuts, values):
        fresh = cuts.copy()
        fresh[::CELL] = True
        fresh[1:] |= pixels[1:] != pixels[:-1]
        begin = np.flatnonzero(fresh)
        stop = np.append(begin[1:], len(pixels))
        hit = pixels[begin] >= 0
        begin, stop = begin[hit], stop[hit]
        cell, place = begin // size, begin % size
        y = keys.column("_band").to_numpy()[cell] * CELL + place // CELL
        left = keys.column("_cell").to_numpy()[cell] * CELL + place % CELL
        columns = [keys.column("image_id").take(pa.array(cell)), pa.array(y).cast(y_kind), pa.array(left.astype(np.int32)), pa.array((left + stop - begin - 1).astype(np.int32)), values.take(pa.array(pixels[begin]))]
        return pa.RecordBatch.from_arrays(columns, ["image_id", "y", "x_start", "x_end", value])

    def run(batches):
        held = None  # the last cell so far: its key, pixels, ends and values
        for batch in batches:
            for at in range(0, len(batch), PAINTED):
                part = batch.slice(at, PAINTED)
                if held is not None and held[0].to_pylist() != part.slice(0, 1).select(PACKET).to_pylist():
                    yield segments(*held)
                    held = None
                keys, pixels, cuts, values = painted(part, held)
                last = len(keys) - 1
                if last:
                    yield segments(keys.slice(0, last), pixels[: last * size], cuts[: last * size], values)
                used, codes = np.unique(pixels[last * size :], return_inverse=True)
                none = int(used[0] < 0)
                held = keys.slice(last), (codes - none).astype(np.int32), cuts[last * size :].copy(), values.take(pa.array(used[none:]))
        if held is not None:
            yield segments(*held)

    kinds = dict(packed.dtypes)
    y_kind = pa.int32()
    return placed.mapInArrow(run, f"image_id {kinds['image_id']}, y int, x_start int, x_end int, {value} {kinds[value]}")


def paint_order_unique_area(mask_runs: DataFrame, masks: DataFrame, smallest: int = 0, largest: int | None = None) -> DataFrame:
    """Labels n - rank by descending area; smaller masks are painted later.

    ``masks`` holds (image_id, mask_id, area, n, rank0). Size limits only skip painting.
    """
    wanted = F.col("area") >= smallest
    if largest is not None:
        wanted = wanted & (F.col("area") <= largest)
    labels = masks.filter(wanted).select("image_id", "mask_id", (F.col("n") - F.col("rank0")).alias("value"))
    return paint_packets(labelled_packets(mask_runs, labels), "value", highest=False)


def labelled_packets(mask_runs: DataFrame, labels: DataFrame) -> DataFrame:
    """Packets of the masks in ``labels`` (image_id, mask_id, value): runs are packed where they are made, packets meet the values."""
    return packets(mask_runs).join(labels.hint("merge"), ["image_id", "mask_id"])  # runs are generated: no broadcast


def tile_grid_full_only(images: DataFrame, labelled: DataFrame, tile: int) -> DataFrame:
    """Complete tiles that hold labelled pixels, numbered in row-major order per image."""
    from parcelworks.functions import grid as G

    grid = G.explode_grid(images, G.starts_full_only(F.col("width"), tile), G.starts_full_only(F.col("height"), tile))
    hit = labelled.select(
        "image_id", F.floor(F.col("y") / tile).cast("int").alias("row"),
        F.explode(F.sequence(F.floor(F.col("x_start") / tile).cast("int"), F.floor(F.col("x_end") / tile).cast("int"))).alias("col"),
    ).distinct()
    return rank_within(grid.join(hit, ["image_id", "row", "col"], "left_semi"), "image_id", "window_index")


# ---- overlaps -----------------------------------------------------------------------

SHIFT = 6  # packets cover CELL rows by CELL columns
PACKET = ["image_id", "_band", "_cell"]
PAINTED = 1 << 9  # packets painted at a time


def packets(mask_runs: DataFrame, nulls: bool = False) -> DataFrame:
    """Runs of a mask by cells of CELL rows and columns, three bytes for each: (image_id, mask_id, _band, _cell, box in the cell, _runs).

    A task packs the rows as they come, so a mask may have several packets in a cell. What is shuffled are packets instead of runs.
    Rows with a null meet nothing and are left out, but ``nulls`` keeps null images and masks.
    """
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            image, mask = batch.column(0), batch.column(1)
            y, start, end = (batch.column(n).to_numpy().astype(np.int64) for n in (2, 3, 4))
            codes = key_codes([image, mask])
            row = np.flatnonzero(end >= start)
            wide = (end[row] >> SHIFT) - (start[row] >> SHIFT) + 1
            at = np.repeat(row, wide)
            if not len(at):
                continue
            cell = (start[at] >> SHIFT) + np.arange(len(at)) - np.repeat(np.cumsum(wide) - wide, wide)
            band = y[at] >> SHIFT
            order = np.lexsort((cell, band, codes[at]))
            at, cell, band = at[order], cell[order], band[order]
            fresh = (np.diff(codes[at]) != 0) | (np.diff(band) != 0) | (np.diff(cell) != 0)
            first = np.concatenate([[0], np.flatnonzero(fresh) + 1])
            low = np.maximum(start[at] - (cell << SHIFT), 0).astype(np.uint8)
            high = np.minimum(end[at] - (cell << SHIFT), CELL - 1).astype(np.uint8)
            line = (y[at] - (band << SHIFT)).astype(np.uint8)
            content = np.stack([line, low, high], axis=1)
            offsets = np.append(first * 3, content.size).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(content))])
            box = [f.reduceat(v, first).astype(np.int16) for f, v in ((np.minimum, line), (np.maximum, line), (np.minimum, low), (np.maximum, high))]
            keep = pa.array(at[first])
            yield pa.RecordBatch.from_arrays([image.take(keep), mask.take(keep), pa.array(band[first]), pa.array(cell[first]), *map(pa.array, box), binary], names)

    names = ["image_id", "mask_id", "_band", "_cell", "_y1", "_y2", "_x1", "_x2", "_runs"]
    kinds = dict(mask_runs.dtypes)
    schema = f"image_id {kinds['image_id']}, mask_id {kinds['mask_id']}, _band bigint, _cell bigint, _y1 smallint, _y2 smallint, _x1 smallint, _x2 smallint, _runs binary"
    return mask_runs.select("image_id", "mask_id", "y", "x_start", "x_end").dropna(subset=["y", "x_start", "x_end"] if nulls else None).mapInArrow(run, schema)


def _shared_length(left: DataFrame, right: DataFrame, a: str, b: str, ordered: bool) -> DataFrame:
    """Common pixels per (image_id, a, b) over two tables of packets."""
    import numpy as np
    import pyarrow as pa

    side = lambda df, name, p: df.select(*PACKET, F.col("mask_id").alias(name), *(F.col(c).alias(f"{p}{c}") for c in ("_y1", "_y2", "_x1", "_x2", "_runs")))
    near = (F.col("a_y1") <= F.col("b_y2")) & (F.col("b_y1") <= F.col("a_y2")) & (F.col("a_x1") <= F.col("b_x2")) & (F.col("b_x1") <= F.col("a_x2"))
    met = side(left, a, "a").join(side(right, b, "b").hint("merge"), PACKET).filter(near & (F.col(a) < F.col(b)) if ordered else near)

    def opened_runs(column: pa.BinaryArray) -> tuple:
        """Pair, line, start and end of all runs; pairs are counted from 0."""
        offsets = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, column.offset * 4)
        content = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].reshape(-1, 3).astype(np.int64)
        pair = np.repeat(np.arange(len(column)), np.diff(offsets) // 3)
        return (pair << SHIFT) + content[:, 0], pair, content[:, 1], content[:, 2]

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            line, pair, low, high = opened_runs(batch.column(3))
            others, _, other_low, other_high = opened_runs(batch.column(4))
            order = np.argsort(others, kind="stable")
            others, other_low, other_high = others[order], other_low[order], other_high[order]
            first, last = np.searchsorted(others, line), np.searchsorted(others, line, side="right")
            count = last - first  # runs of the other mask in the same line, mostly one
            at = np.repeat(np.arange(len(line)), count)
            to = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
            common = np.maximum(np.minimum(high[at], other_high[to]) - np.maximum(low[at], other_low[to]) + 1, 0)
            sums = np.bincount(pair[at], common, len(batch)).astype(np.int64)
            hit = pa.array(np.flatnonzero(sums))
            yield pa.RecordBatch.from_arrays([*(batch.column(n).take(hit) for n in range(3)), pa.array(sums[sums > 0])], ["image_id", a, b, "common"])

    kinds = dict(met.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("image_id", a, b)) + ", common bigint"
    parts = met.select("image_id", a, b, "a_runs", "b_runs").mapInArrow(run, schema)
    return parts.groupBy("image_id", a, b).agg(F.sum("common").cast("bigint").alias("common"))


def mask_areas(mask_runs: DataFrame) -> DataFrame:
    return mask_runs.groupBy("image_id", "mask_id").agg(F.sum(length()).alias("area"))


def _measured(shared: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """IoU and coverages of pairs with their ``common`` pixels; ``first`` and ``second`` hold (image_id, mask_id, area)."""
    size = lambda areas, name, alias: areas.select("image_id", F.col("mask_id").alias(name), F.col("area").alias(alias))
    sized = shared.join(size(first, "id_a", "area_a"), ["image_id", "id_a"]).join(size(second, "id_b", "area_b"), ["image_id", "id_b"])
    floor1 = lambda c: F.greatest(c, F.lit(1)).cast("double")
    return sized.select(
        "image_id", "id_a", "id_b", "common",
        (F.col("common") / floor1(F.col("area_a") + F.col("area_b") - F.col("common"))).alias("iou"),
        (F.col("common") / floor1(F.least("area_a", "area_b"))).alias("smaller_coverage"),
        (F.col("common") / floor1(F.col("area_b"))).alias("second_coverage"),
    )


def mask_overlap_join(first: DataFrame, second: DataFrame | None = None) -> DataFrame:
    """IoU, share of the smaller and share of the second mask for every overlapping pair."""
    one = second is None
    other = first if one else second
    shared = _shared_length(packets(first), packets(other), "id_a", "id_b", one)
    return _measured(shared, mask_areas(first), mask_areas(other))


def best_of_equal(mask_runs: DataFrame, rank: DataFrame) -> DataFrame:
    """(image_id, mask_id, area) of the best of every set of equal masks of an image; ``rank`` has mask_id and rank.

    In greedy suppression a copy never outlives its best: what is kept beats both or neither, and the best itself beats its copies. So a
    pile of copies costs one row for each, not its square. Masks are compared by 128 bits over their runs, their area and number of runs.
    """
    line = ["y", "x_start", "x_end"]
    prints = mask_runs.groupBy("image_id", "mask_id").agg(
        F.bit_xor(F.xxhash64(*line)).alias("_h"), F.bit_xor(F.xxhash64(F.lit("second"), *line)).alias("_g"), F.count("*").alias("_n"), F.sum(length()).alias("area")
    )
    best = prints.join(rank, "mask_id").groupBy("image_id", "_h", "_g", "_n", "area").agg(F.max_by("mask_id", "rank").alias("mask_id"))
    return best.select("image_id", "mask_id", "area")


def fold_equal(mask_runs: DataFrame, rank: DataFrame) -> DataFrame:
    """Runs of the best of every set of equal masks."""
    return mask_runs.join(best_of_equal(mask_runs, rank).select("image_id", "mask_id"), ["image_id", "mask_id"], "left_semi")


def folded_overlaps(mask_runs: DataFrame, best: DataFrame) -> DataFrame:
    """``mask_overlap_join`` of the masks in ``best`` (written by the caller): the runs themselves are neither written nor shuffled."""
    kept = packets(mask_runs).join(best.select("image_id", "mask_id"), ["image_id", "mask_id"], "left_semi")
    return _measured(_shared_length(kept, kept, "id_a", "id_b", True), best, best)


def unrepeated(first: DataFrame, second: DataFrame, kept: DataFrame | None = None, iou: float = 0.45, smaller: float = 0.75, covered: float = 0.65) -> DataFrame:
    """(image_id, mask_id) of the second-pass masks, or of those in ``kept``, that repeat no first-pass mask."""
    areas, parts = mask_areas(second), packets(second)
    if kept is not None:
        areas, parts = (df.join(kept, ["image_id", "mask_id"], "left_semi") for df in (areas, parts))
    pairs = _measured(_shared_length(packets(first), parts, "id_a", "id_b", False), mask_areas(first), areas)
    repeated = pairs.filter((F.col("iou") >= iou) | (F.col("smaller_coverage") >= smaller) | (F.col("second_coverage") >= covered))
    return areas.select("image_id", "mask_id").join(repeated.select("image_id", F.col("id_b").alias("mask_id")), ["image_id", "mask_id"], "left_anti")


def cross_pass_anti_join(first: DataFrame, second: DataFrame, iou: float = 0.45, smaller: float = 0.75, covered: float = 0.65) -> DataFrame:
    """Runs of the second-pass masks that repeat no first-pass mask."""
    return second.join(unrepeated(first, second, None, iou, smaller, covered), ["image_id", "mask_id"], "left_semi")


def boxes_to_runs(boxes: DataFrame, keep: list[str]) -> DataFrame:
    """Half-open whole-pixel boxes as runs."""
    whole = {c: F.floor(F.greatest(F.col(c), F.lit(0.0))).cast("int") for c in ("x1", "y1", "x2", "y2")}
    usable = boxes.select(*keep, *(e.alias(c) for c, e in whole.items())).filter("x2 > x1 AND y2 > y1")
    lines = usable.withColumn("y", F.explode(F.sequence(F.col("y1"), F.col("y2") - 1)))
    return lines.select(*keep, "y", F.col("x1").alias("x_start"), (F.col("x2") - 1).alias("x_end"))


def proposal_semi_join(mask_runs: DataFrame, proposals: DataFrame, share: float = 0.30) -> DataFrame:
    """Masks with enough area inside the union of their image's proposal boxes.

    Images without proposals pass through. The union is disjoint, so shared lengths add up.
    """
    union = sweep(boxes_to_runs(proposals, ["image_id"])).withColumn("mask_id", F.lit(0).cast("bigint"))
    areas = mask_runs.groupBy("image_id", "mask_id").agg(F.sum(length()).alias("area"))
    inside = _shared_length(packets(mask_runs), packets(union), "mask_id", "_u", False).select("image_id", "mask_id", "common")
    scored = areas.join(inside, ["image_id", "mask_id"], "left").join(
        proposals.select("image_id").distinct().withColumn("_has", F.lit(True)), "image_id", "left"
    )
    ratio = F.coalesce(F.col("common"), F.lit(0)) / F.col("area")
    return scored.filter(F.col("_has").isNull() | (ratio >= share)).select("image_id", "mask_id", "area")


# ---- morphology ---------------------------------------------------------------------

def erode(mask_runs: DataFrame, kernel: int = 3) -> DataFrame:
    """k x k box erosion of maximal runs (with width, height); outside the raster nothing erodes.

    Horizontally a run shrinks. Vertically a pixel stays when all rows of the window cover
    it: each run covers its k rows and a sweep asks for full coverage.
    """
    r = kernel // 2
    start = F.when(F.col("x_start") == 0, 0).otherwise(F.col("x_start") + r)
    end = F.when(F.col("x_end") == F.col("width") - 1, F.col("x_end")).otherwise(F.col("x_end") - r)
    shrunk = mask_runs.select("image_id", "y", "width", "height", start.cast("int").alias("x_start"), end.cast("int").alias("x_end")).filter("x_start <= x_end")
    return swept(shrunk.withColumn("_d", F.lit(1)), ["image_id"], ["width", "height"], reach=r)


def dilate(mask_runs: DataFrame, kernel: int = 3) -> DataFrame:
    r = kernel // 2
    grown = mask_runs.select(
        "image_id", "y", "width", "height", F.greatest(F.col("x_start") - r, F.lit(0)).cast("int").alias("x_start"), F.least(F.col("x_end") + r, F.col("width") - 1).cast("int").alias("x_end")
    )
    low, high = F.greatest(F.col("y") - r, F.lit(0)), F.least(F.col("y") + r, F.col("height") - 1)
    offered = grown.withColumn("_ty", F.explode(F.sequence(low, high))).drop("y").withColumnRenamed("_ty", "y")
    return sweep(offered, 1, ("width", "height"))


def opened(mask_runs: DataFrame, kernel: int = 3) -> DataFrame:
    return dilate(erode(mask_runs, kernel), kernel)


def closed(mask_runs: DataFrame, kernel: int = 3) -> DataFrame:
    return erode(dilate(mask_runs, kernel), kernel)


def run_difference(left: DataFrame, right: DataFrame, keys: list[str] = LINE) -> DataFrame:
    """Pixels of ``left`` not in ``right``; both disjoint per key. Left counts 1, right takes 2 away."""
    columns = [*keys, "x_start", "x_end"]
    signed = left.select(*columns, F.lit(1).alias("_d")).union(right.select(*columns, F.lit(-2).alias("_d")))
    return swept(signed, [k for k in keys if k != "y"], need=1, exactly=True).select(*columns)


def binary_runs(mask_rows: DataFrame, classes: list[int]) -> DataFrame:
    """Maximal foreground runs of the given classes, found inside each scanline."""
    return explode_runs(mask_rows.select("image_id", "y", "width", "height", "cls"), classes=classes).drop("cls")


def extract_boundary(field_runs: DataFrame) -> DataFrame:
    """Field pixels that a 3 x 3 erosion removes."""
    return run_difference(field_runs, erode(field_runs, 3))


def field_area_ratio(mask_rows: DataFrame) -> DataFrame:
    """Share of field pixels and of their boundary pixels per image."""
    field = binary_runs(mask_rows, [1, 2])
    pixels = lambda df, name: df.groupBy("image_id").agg(F.sum(length()).alias(name))
    total = mask_rows.groupBy("image_id").agg(F.sum(F.size("cls")).alias("_total"))
    joined = total.join(pixels(field, "_f"), "image_id", "left").join(pixels(extract_boundary(field), "_b"), "image_id", "left")
    share = lambda c, n: (F.coalesce(F.col(c), F.lit(0)) / F.greatest(F.col("_total"), F.lit(1))).alias(n)
    return joined.select("image_id", share("_f", "field_area_ratio"), share("_b", "boundary_area_ratio"))


# ---- run-length form ----------------------------------------------------------------

def rle_encode(mask_rows: DataFrame) -> DataFrame:
    """(start, value, length) of the row-major run-length form, one row per run.

    Runs are found inside each scanline. Only the first and last run of a row can join a
    neighbouring row, so one small record per row decides that, ordered within its image.
    """
    start_list = mask_rows.select("image_id", "y", "width", "cls", run_starts(F.col("cls")).alias("_s"))
    lined = start_list.select("image_id", "y", "width", runs(F.col("cls"), F.col("_s")).alias("_r"))
    heads = lined.select(
        "image_id", "y", "width", F.get("_r", F.lit(0)).alias("_head"), F.element_at("_r", -1)["cls"].alias("_tail_cls"), F.size("_r").alias("_n")
    )
    rows_up = W.partitionBy("image_id").orderBy("y")
    joins = F.coalesce(F.lag("_tail_cls").over(rows_up) == F.col("_head.cls"), F.lit(False))
    heads = heads.withColumn("_joins", joins)
    line_start = F.col("y").cast("bigint") * F.col("width")
    fresh = F.when(~F.col("_joins"), line_start).when(F.col("_n") > 1, line_start + F.col("_head.x_end") + 1)
    rows_down = W.partitionBy("image_id").orderBy(F.col("y").desc()).rowsBetween(W.unboundedPreceding, -1)
    heads = heads.withColumn("_fresh", fresh)
    # the next run start below this row: the closest row further down that begins one
    below = F.last("_fresh", ignorenulls=True).over(rows_down)
    last_row = F.max("y").over(W.partitionBy("image_id"))
    heads = heads.select("image_id", "y", "_joins", F.coalesce(below, (last_row + 1).cast("bigint") * F.col("width")).alias("_next"))
    opened_ = lined.join(heads, ["image_id", "y"]).select("image_id", "y", "width", "_joins", "_next", F.size("_r").alias("_n"), F.posexplode_outer("_r").alias("_i", "_q"))
    begun = opened_.filter(~((F.col("_i") == 0) & F.col("_joins")))
    start = F.col("y").cast("bigint") * F.col("width") + F.col("_q.x_start")
    stop = F.when(F.col("_i") == F.col("_n") - 1, F.col("_next")).otherwise(F.col("y").cast("bigint") * F.col("width") + F.col("_q.x_end") + 1)
    return begun.select("image_id", start.alias("start"), F.col("_q.cls").alias("value"), (stop - start).alias("length"))
