"""Round 3, fourth part: shapes by bands, crowns by packets."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.operators import crowns as CR, masks as M, raster as RA, shape as S, vector as V
from test_shapes import convex, filled, perimeter, runs_of


def test_region_shape_over_bands(spark):
    """Regions of several bands of 64 rows: closed and open holes at, over and along the seams; no pixel is a row."""
    rng = np.random.default_rng(8)
    closed = np.ones((200, 9), bool)
    closed[62:66, 3:6] = False
    closed[127, 2] = closed[128, 3] = closed[100, 4] = False
    leak = closed.copy()
    leak[66:140, 3] = leak[140, 0:3] = False
    masks = [closed, leak, rng.random((150, 12)) < 0.8, rng.random((70, 7)) < 0.6]
    rows = [r for k, m in enumerate(masks) for r in runs_of(3, k, m, 20 * k, 40)]
    labelled = spark.createDataFrame(rows, "image_id long, region long, y int, x_start int, x_end int").repartition(5)
    out = S.region_shape(labelled)
    found = {r.region: r for r in out.collect()}
    for k, m in enumerate(masks):
        m = m[m.any(1).argmax() : len(m) - m[::-1].any(1).argmax(), m.any(0).argmax() : m.shape[1] - m[:, ::-1].any(0).argmax()]
        r = found[k]
        assert (r.area, r.filled_area) == (m.sum(), filled(m)), k
        assert r.perimeter == pytest.approx(perimeter(m)), k
    assert found[3].convex_area == convex(masks[3])
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_convex_areas_of_many():
    """Many regions at a time give what one at a time gives, with rows missing."""
    rng = np.random.default_rng(3)
    parts = []
    for k in range(60):
        y = np.sort(rng.choice(200, rng.integers(1, 90), replace=False)) - 50
        low = rng.integers(-40, 40, len(y))
        parts.append((np.full(len(y), k), y, low, low + rng.integers(0, 60, len(y))))
    many = S.convex_areas(*(np.concatenate(c) for c in zip(*parts)))
    assert many.tolist() == [S.hull_measures(y, lo, hi)[0] for _, y, lo, hi in parts]


def test_stitch_of_split_pieces(spark):
    """Pieces whose rows lie in many tasks and batches, chains over several tiles, a mask without an image; what is joined are packets."""
    rng = np.random.default_rng(4)
    masks = {k: (int(rng.integers(0, 60)), int(rng.integers(0, 60)), int(rng.integers(5, 50)), int(rng.integers(5, 50))) for k in range(40)}
    rows = [(None if k == 7 else k, k, 0.5, y, x0, x0 + w) for k, (x0, y0, w, h) in masks.items() for y in range(y0, y0 + h + 1)]
    runs = spark.createDataFrame(rows, "image_id long, mask_id long, score double, y int, x_start int, x_end int").repartition(9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = CR.stitch(CR.cut_at_tiles(runs, 16), 16, 0.5)
        assert "_events" in out._jdf.queryExecution().toString()
        found = out.collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    x0, y0, w, h = masks[7]
    assert {r.pieces for r in found if r.image_id is None} == {1}  # nothing meets without an image
    assert sum(r.x_end - r.x_start + 1 for r in found if r.image_id is None) == (w + 1) * (h + 1)
    for k, (x0, y0, w, h) in masks.items():
        if k == 7:
            continue
        own = [r for r in found if r.image_id == k]
        tiles = lambda a, b: range(a // 16, b // 16 + 1)
        assert {r.crown.asDict()["tile_x"] for r in own} == {x0 // 16} and {r.crown.tile_y for r in own} == {y0 // 16}
        assert {r.pieces for r in own} == {len(tiles(x0, x0 + w)) * len(tiles(y0, y0 + h))}
        assert {(r.y, r.x_start, r.x_end) for r in own} == {(y, x0, x0 + w) for y in range(y0, y0 + h + 1)}


def test_sweep_keeps_plain_columns(spark):
    """A kept column that is never null: what is held back of a batch fits the next one."""
    rows = [(k % 2, k % 5, 3 * k, 3 * k + 2) for k in range(400)]
    runs = spark.createDataFrame(rows, "image_id long, y int, x_start int, x_end int").withColumn("width", F.lit(2000)).repartition(20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        out = M.sweep(runs, keep=("width",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sum(r.x_end - r.x_start + 1 for r in out) == 1200 and {r.width for r in out} == {2000}


def test_simplify_many_rings(spark):
    """All rings at a time as one at a time: teeth, ties, equal points, an open line; a missing ring stays missing."""

    def halve(points, limit):
        keep = np.zeros(len(points), bool)
        keep[[0, -1]] = True
        todo = [(0, len(points) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a > 1:
                d, rel = points[b] - points[a], points[a + 1 : b] - points[a]
                base = np.hypot(*d)
                away = np.abs(d[0] * rel[:, 1] - d[1] * rel[:, 0]) / base if base > 0 else np.hypot(*rel.T)
                k = int(np.argmax(away))
                if away[k] > limit:
                    keep[a + 1 + k] = True
                    todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return points[keep]

    rng = np.random.default_rng(6)
    rings = [np.cumsum(rng.integers(-2, 3, (int(rng.integers(1, 120)), 2)), 0).astype(float) for _ in range(50)]
    rings += [np.array([(k % 5, k // 2) for k in range(200)], float), np.zeros((4, 2)), np.array([(0, 0), (5, 0), (5, 5), (0, 5), (0, 0)], float)]
    limits = [float(rng.choice([0.0, 0.3, 1.0, 4.0])) for _ in rings]
    rows = [(k, t, [tuple(map(float, p)) for p in r]) for k, (r, t) in enumerate(zip(rings, limits))] + [(99, 1.0, None)]
    layer = spark.createDataFrame(rows, "k long, t double, ring array<struct<x:double,y:double>>")
    found = {r.k: r.ring for r in V.simplify_layer(layer, F.col("t")).collect()}
    for k, (p, t) in enumerate(zip(rings, limits)):
        far = int(np.argmax(np.hypot(*(p - p[0]).T)))
        want = np.vstack([halve(p[: far + 1], t)[:-1], halve(p[far:], t)])
        assert [tuple(q) for q in found[k]] == [tuple(q) for q in want], k
    assert found[99] is None


def test_halo_map_packs_lines(spark):
    """Large blocks cut into several packets, lines in many tasks, floats, a missing image: no group is started for each block."""
    rng = np.random.default_rng(9)
    images = {None: rng.random((90, 70)), 5: rng.random((33, 131))}
    rows = [(i, y, m.shape[1], m.shape[0], m[y].tolist()) for i, m in images.items() for y in range(len(m))]
    lines = spark.createDataFrame(rows, "image_id long, y int, width int, height int, v array<double>").repartition(7)

    def right_and_below(block):
        p = np.pad(block, ((0, 1), (0, 1)))
        return p[1:, :-1] + p[:-1, 1:]

    out = RA.halo_map(lines, right_and_below, values="v", sample=48, bound=8, out="double")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    found = {(r.image_id, r.y): r.v for r in out.collect()}
    assert found == {(i, y): right_and_below(m)[y].tolist() for i, m in images.items() for y in range(len(m))}


def test_filter_in_front_of_a_join(spark):
    """The filter of near duplicates loses no row that is asked for, of either sign, and leaves out most others; nothing asked, nothing left."""
    from parcelworks.llm import neardup

    hashes = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 20000)
    rows = spark.createDataFrame([(int(h),) for h in hashes], "c long")
    asked = [int(h) for h in hashes[:500]]
    found = {r.c for r in neardup.may_be_asked(rows, "c", spark.createDataFrame([(h,) for h in [*asked, None]], "code long"), "code").collect()}
    assert found >= set(asked) and len(found) < 4000
    assert neardup.may_be_asked(rows, "c", spark.createDataFrame([], "code long"), "code").count() == 0
