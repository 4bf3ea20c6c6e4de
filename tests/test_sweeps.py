"""Sweeps by packets: what they return, and that neither segments nor events are shuffled or ordered one by one."""

import random

import pytest

from parcelworks.functions.scanline import explode_runs
from parcelworks.operators import masks as M, vector as V
from parcelworks.sources.tables import Tables, opened

RUN = "image_id long, y int, x_start int, x_end int"


@pytest.fixture
def small_batches(spark, monkeypatch):
    from parcelworks.operators import sweeps

    monkeypatch.setattr(sweeps, "LIMIT", 64)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def segments(seed, images=(None, 1, 2), n=900):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        x = rng.randint(-20, 60)
        out.append((rng.choice(images), rng.randint(-70, 140), x, x + rng.randint(0, 15)))
    return out


def pixels(rows):
    return [(i, y, x) for i, y, a, b in rows for x in range(a, b + 1)]


def maximal(cells):
    return sorted(((i, y, x) for i, y, x in cells if (i, y, x - 1) not in cells), key=repr), sorted(((i, y, x) for i, y, x in cells if (i, y, x + 1) not in cells), key=repr)


def ends(found):
    return sorted(((r.image_id, r.y, r.x_start) for r in found), key=repr), sorted(((r.image_id, r.y, r.x_end) for r in found), key=repr)


@pytest.mark.parametrize("need", [1, 3])
def test_sweep_against_counting(spark, small_batches, need):
    rows = segments(need)
    counts = {}
    for p in pixels(rows):
        counts[p] = counts.get(p, 0) + 1
    found = M.sweep(spark.createDataFrame(rows, RUN).repartition(5), need).collect()
    assert ends(found) == maximal({p for p, n in counts.items() if n >= need})


def test_difference_against_sets(spark, small_batches):
    left, right = (M.sweep(spark.createDataFrame(segments(s), RUN)) for s in (7, 8))
    cells = set(pixels(segments(7))) - set(pixels(segments(8)))
    assert ends(M.run_difference(left, right).collect()) == maximal(cells)


def test_erosion_against_windows(spark, small_batches):
    width, height, r = 30, 150, 2
    cells = {(i, y, x) for i, y, x in pixels(segments(9, n=2600)) if 0 <= x < width and 0 <= y < height}
    begin, end = maximal(cells)
    spans = [(*b, e[2], width, height) for b, e in zip(sorted(begin, key=lambda p: (p[0] or 0, p[1], p[2])), sorted(end, key=lambda p: (p[0] or 0, p[1], p[2])))]
    runs = spark.createDataFrame(spans, RUN + ", width int, height int")
    kept = {(i, y, x) for i, y, x in cells if all((i, v, u) in cells for v in range(max(y - r, 0), min(y + r, height - 1) + 1) for u in range(max(x - r, 0), min(x + r, width - 1) + 1))}
    assert kept and ends(M.erode(runs, 2 * r + 1).collect()) == maximal(kept)


def test_events_travel_as_packets(spark):
    """Before, every event of a run was shuffled, sorted and put through three windows; the sorts of a task grew with the raster."""
    runs = spark.createDataFrame([(1, 0, 0, 5, 20, 20)], RUN + ", width int, height int")
    for swept in (M.erode(runs), M.opened(runs), M.run_difference(runs, runs)):
        plan = swept._jdf.queryExecution().executedPlan().toString()
        assert "_events" in plan and "Window" not in plan


def test_runs_of_odd_scanlines(spark):
    """Nulls end no run, empty and missing scanlines have none."""
    rows = spark.createDataFrame([(1, [1, 1, 2, None, 2, 2, 3]), (2, []), (3, None), (4, [None, 5]), (5, [7])], "image_id long, cls array<int>")
    found = sorted((r.image_id, r.x_start, r.x_end, r.cls) for r in explode_runs(rows).filter("image_id <> 4").collect())
    assert found == [(1, 0, 1, 1), (1, 2, 5, 2), (1, 6, 6, 3), (5, 0, 0, 7)]
    assert [(r.x_start, r.x_end, r.cls) for r in explode_runs(rows).filter("image_id = 4").collect()] == [(0, 1, None)]
    assert sorted((r.image_id, r.x_start, r.x_end) for r in explode_runs(rows, classes=[2, 7]).collect()) == [(1, 2, 5), (5, 0, 0)]


def test_mask_scanlines_follow_the_rule(spark, monkeypatch):
    """Scanlines computed in batches hold the values of the column rule, for null and negative images too."""
    from parcelworks.sources import tables

    monkeypatch.setattr(tables, "PIXELS", 1000)
    lines = spark.createDataFrame([(i, 90 + (i or 0) % 7, y) for i in (None, -5, 0, 3, 88) for y in range(40)], "image_id long, width int, y int")
    by_rule = opened(lines, "image_id", "y").withColumn("cls", Tables.mask_class(tables.F.col("x")))
    found = {(r.image_id, r.y, x): v for r in Tables.masked(lines).collect() for x, v in enumerate(r.cls)}
    assert found == {(r.image_id, r.y, r.x): r.cls for r in by_rule.collect()}


def test_band_is_one_run_for_an_edge_and_row(spark):
    """Before, every cell near an edge was a row of its own."""
    ring = [{"x": 3.25, "y": 2.25}, {"x": 40.5, "y": 4.0}, {"x": 33.0, "y": 18.5}, {"x": 3.25, "y": 2.25}]
    features = spark.createDataFrame([(1, ring, 38, 19)], "image_id long, ring array<struct<x: double, y: double>>, width int, height int")
    band = V.boundary_band(features, ["image_id"], 1.5).collect()
    assert len(band) <= 3 * 19

    def away(px, py, a, b):
        t = max(0.0, min(1.0, ((px - a["x"]) * (b["x"] - a["x"]) + (py - a["y"]) * (b["y"] - a["y"])) / ((b["x"] - a["x"]) ** 2 + (b["y"] - a["y"]) ** 2)))
        return ((px - a["x"] - t * (b["x"] - a["x"])) ** 2 + (py - a["y"] - t * (b["y"] - a["y"])) ** 2) ** 0.5

    found = {(r.y, x) for r in band for x in range(r.x_start, r.x_end + 1)}
    steps = [k / 40 for k in range(41)]
    for y in range(19):
        for x in range(38):
            least = min(away(x + u, y + v, a, b) for a, b in zip(ring, ring[1:]) for u, v in [(s, t) for s in steps for t in (0, 1)] + [(t, s) for s in steps for t in (0, 1)])
            if abs(least - 1.5) > 0.03:
                assert ((y, x) in found) == (least <= 1.5), (y, x, least)


@pytest.mark.parametrize("reach", [0, 1])
def test_regions_of_many_blocks(spark, small_batches, reach):
    """Labelled against a flood fill, across blocks and null images; before, every block was a pandas group of its own."""
    from parcelworks.operators import components as C

    rng = random.Random(reach)
    cells = {(i, y, x) for i in (None, 1, 2) for y in range(-70, 140) for x in range(24) if rng.random() < 0.55}
    begin, end = maximal(cells)
    place = lambda p: (p[0] or 0, p[1], p[2])
    runs = spark.createDataFrame([(*b, e[2]) for b, e in zip(sorted(begin, key=place), sorted(end, key=place))], RUN)
    labelled = C.connected_components(runs.filter("image_id IS NOT NULL"), 8 if reach else 4)
    found = {(r.image_id, r.y, x): r.region for r in labelled.collect() for x in range(r.x_start, r.x_end + 1)}
    assert set(found) == {c for c in cells if c[0] is not None}
    todo = set(found)
    while todo:
        region, stack = set(), [todo.pop()]
        while stack:
            i, y, x = stack.pop()
            region.add((i, y, x))
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    n = (i, y + dy, x + dx)
                    if n in todo and (reach or dx * dy == 0):
                        todo.remove(n)
                        stack.append(n)
        assert len({found[c] for c in region}) == 1
    assert len({(c[0], v) for c, v in found.items()}) > 20
    assert "FlatMapGroups" not in C._block_labels(runs, ["image_id"], reach)._jdf.queryExecution().toString()


def test_many_regions_are_traced_at_once(spark, small_batches):
    """Rings against the cells: closed, around the right area, parted or joined at corners; before, each region was a loop over dictionaries."""
    diagonal = [(1, 5, 0, 0, 1), (1, 5, 1, 2, 3), (1, 6, 70, 0, 4), (1, 6, 71, 0, 0), (1, 6, 71, 2, 2), (1, 6, 71, 4, 4), (1, 6, 72, 0, 4)]
    many = [(2, k, y, 3 * k, 3 * k + 1) for k in range(200) for y in range(k % 5 + 1)]
    runs = spark.createDataFrame(diagonal + many, "image_id long, region long, y int, x_start int, x_end int")

    def rings(connectivity):
        out = {}
        for r in V.vectorize(runs, connectivity).orderBy("image_id", "region", "ring_index").collect():
            out.setdefault((r.image_id, r.region), []).append([(p.x, p.y) for p in r.ring])
        return out

    parted, joined = rings(4), rings(8)
    assert parted[1, 5] == [[(0, 0), (2, 0), (2, 1), (0, 1), (0, 0)], [(2, 1), (4, 1), (4, 2), (2, 2), (2, 1)]]
    assert joined[1, 5] == [[(0, 0), (2, 0), (2, 1), (4, 1), (4, 2), (2, 2), (2, 1), (0, 1), (0, 0)]]
    outer, *inner = parted[1, 6]
    assert outer == [(0, 70), (5, 70), (5, 73), (0, 73), (0, 70)] and [r[0] for r in inner] == [(1, 71), (3, 71)] and all(len(r) == 5 for r in inner)
    for k in range(200):
        assert parted[2, k] == joined[2, k] == [[(3 * k, 0), (3 * k + 2, 0), (3 * k + 2, k % 5 + 1), (3 * k, k % 5 + 1), (3 * k, 0)]]
    assert "_runs" in V.vectorize(runs)._jdf.queryExecution().toString()


def test_pixel_work_is_compiled(spark):
    """band_stats and ignore_overlay looked at every pixel through functions over arrays, which Spark interprets; build_patches joined arrays of bands."""
    import __spark_entry__ as entry

    for name, banned in (("band_stats", ("forall", "exists(", "transform(")), ("ignore_overlay", ("forall", "exists(", "transform(", "Join")), ("build_patches", ("forall", "exists(", "zip_with"))):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert not [w for w in banned if w in plan], name


def test_window_counts_against_pixels(spark):
    from parcelworks.operators import tiling
    from parcelworks.sources import tables

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rng = random.Random(3)
    rows = [(i, w, h, y, [rng.choice([0, 1, 2, 255, None, 9]) for _ in range(w)]) for i, w, h in ((1, 100, 70), (2, 30, 20), (None, 49, 48)) for y in range(h)]
    lines = spark.createDataFrame(rows, "image_id long, width int, height int, y int, cls array<int>")
    found = tiling.patch_counts(lines, 48, 8).collect()
    pixels = lines.select("image_id", "width", "height", "y", tables.F.posexplode("cls").alias("x", "cls"))
    assert sorted(map(repr, tiling.pixel_patch_counts(pixels, 48, 8).select(*found[0].__fields__).collect())) == sorted(map(repr, found))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    windows = {(r.image_id, r.x0, r.y0) for r in tiling.tile_grid(lines.select("image_id", "width", "height").distinct(), 48, 8).collect()}
    assert {(r.image_id, r.x0, r.y0) for r in found} == windows
    for r in found:
        seen = [v for i, w, h, y, cls in rows if i == r.image_id and r.y0 <= y < r.y0 + 48 for v in cls[r.x0 : r.x0 + 48]]
        assert [r.n_background, r.n_interior, r.n_boundary, r.n_ignore, r.n_total] == [*(seen.count(v) for v in (0, 1, 2, 255)), len(seen)]


def test_scaling_in_batches(spark, small_batches):
    """Scanlines of several sizes and factors against a plain loop, with nulls and padding; before, every pixel went through interpreted functions."""
    from parcelworks.operators import augment
    from parcelworks.operators.augment import F

    rng = random.Random(2)
    rows = [(i, 11 + i, 9 + i, y, [rng.choice([0, 1, None, 7]) for _ in range(11 + i)], f) for i, f in ((1, 0.6), (2, 1.0), (3, 1.7), (4, 0.05)) for y in range(9 + i)]
    lines = spark.createDataFrame(rows, "image_id long, width int, height int, y int, cls array<int>, f double")
    scaled = augment.scale_rows(lines, F.col("f"))
    assert "_new_width" in scaled._jdf.queryExecution().toString() and "coalesce(get" not in scaled._jdf.queryExecution().optimizedPlan().toString()
    found = {(r.image_id, r.y): list(r.cls) for r in scaled.collect()}
    image = {(r[0], r[3]): r[4] for r in rows}

    def source(i, size, f):
        new = max(round(size * f), 1)
        shift = -max((new - size) // 2, 0) if f >= 1 else (size - new) // 2
        at = i - shift
        return min(int((at + 0.5) * size / new), size - 1) if 0 <= at < new else None

    for i, w, h, y, _, f in rows:
        sy = source(y, h, f)
        want = [255 if sy is None or (sx := source(x, w, f)) is None or image[i, sy][sx] is None else image[i, sy][sx] for x in range(w)]
        assert found[i, y] == want, (i, y)
    assert len(found) == len(rows)
