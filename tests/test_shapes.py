"""Region shapes, edge proposals, halo blocks, crown seams and score ranges against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelworks.operators import crowns as CR, greedy as G, raster as RA, shape as S


def runs_of(image, region, mask, y0=0, x0=0):
    out = []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(int), [0]])))
        out += [(image, region, y + y0, int(a) + x0, int(b) - 1 + x0) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return out


def perimeter(mask):
    """Border pixels weighted by their neighbours, as image libraries do it."""
    p = np.pad(mask, 2)
    inner = p & np.roll(p, 1, 0) & np.roll(p, -1, 0) & np.roll(p, 1, 1) & np.roll(p, -1, 1)
    border = (p & ~inner).astype(int)
    total = sum(w * np.roll(border, (dy, dx), (0, 1)) for dy in (-1, 0, 1) for dx in (-1, 0, 1) for w in [(1, 2, 10)[abs(dy) + abs(dx)]])
    weight = {**dict.fromkeys([5, 7, 15, 17, 25, 27], 1.0), **dict.fromkeys([21, 33], 2**0.5), **dict.fromkeys([13, 23], (1 + 2**0.5) / 2)}
    return sum(weight.get(int(v), 0.0) for v in total[border == 1])


def filled(mask):
    outside = np.pad(~mask, 1, constant_values=True)
    reach = np.zeros_like(outside)
    reach[0, :] = True
    while True:
        grown = np.zeros_like(reach)
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                grown |= np.roll(reach, (dy, dx), (0, 1))
        grown &= outside
        if (grown == reach).all():
            return int((~reach[1:-1, 1:-1]).sum())
        reach = grown


def convex(mask):
    """Pixels inside every half-plane that holds all side midpoints; lines through pairs of them."""
    ys, xs = np.nonzero(mask)
    pts = np.unique(np.concatenate([np.stack([ys + a, xs + b], 1) for a, b in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))]), axis=0)
    yy, xx = np.mgrid[0 : mask.shape[0], 0 : mask.shape[1]]
    ok = np.ones(mask.shape, bool)
    for p in pts:
        for q in pts:
            d = q - p
            side = d[0] * (pts[:, 1] - p[1]) - d[1] * (pts[:, 0] - p[0])
            if (d != 0).any() and side.min() >= -1e-9:
                ok &= d[0] * (xx - p[1]) - d[1] * (yy - p[0]) >= -1e-9
    return int(ok.sum())


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(5)
    out = [np.ones((1, 1), bool), np.ones((1, 6), bool), np.ones((5, 1), bool), np.eye(6, dtype=bool), np.ones((7, 7), bool)]
    ring = np.ones((9, 9), bool)
    ring[2:7, 2:7] = False
    leak = ring.copy()
    leak[0, 0] = leak[1, 1] = False
    return out + [ring, leak] + [rng.random((8, 9)) < p for p in (0.3, 0.5, 0.7, 0.9)]


def test_region_shape(spark, blobs):
    rows = [r for k, m in enumerate(blobs) for r in runs_of(3, k, m, 11 * k, 5)]
    labelled = spark.createDataFrame(rows, "image_id long, region long, y int, x_start int, x_end int").repartition(3)
    found = {r.region: r for r in S.region_shape(labelled).collect()}
    assert len(found) == len(blobs)
    for k, m in enumerate(blobs):
        r = found[k]
        assert r.area == m.sum()
        assert r.perimeter == pytest.approx(perimeter(m)), k
        assert r.filled_area == filled(m[np.ix_(m.any(1).nonzero()[0].min() + np.arange(np.ptp(m.any(1).nonzero()[0]) + 1), m.any(0).nonzero()[0].min() + np.arange(np.ptp(m.any(0).nonzero()[0]) + 1))]), k
        assert r.convex_area == convex(m), k
        assert r.solidity == pytest.approx(r.area / r.convex_area)


def test_smallest_rectangle():
    """A tilted square: the rectangle along its sides, not the upright one."""
    y, x = np.mgrid[0:41, 0:41]
    rows = [(int(r), c[0], c[-1]) for r in range(41) if len(c := np.flatnonzero(np.abs(y[r] - 20) + np.abs(x[r] - 20) <= 20))]
    ys, lo, hi = (np.array(v) for v in zip(*rows, strict=True))
    _, outline, area, cx, cy, angle = S.hull_measures(ys, lo, hi)
    assert (outline, round(area, 6), round(cx, 6), round(cy, 6), round(angle, 6)) == (800.0, 800.0, 20.0, 20.0, 45.0)


def test_proposal_candidates(spark):
    """A hollow box, a line at the raster's border, a single pixel."""
    mask = np.zeros((40, 50), bool)
    mask[5:15, 6:26] = True
    mask[6:14, 7:25] = False
    mask[0, 30:50] = True
    mask[30, 30] = True
    edges = spark.createDataFrame([(i, y, a, b) for i, _, y, a, b in runs_of(1, 0, mask)], "image_id long, y int, x_start int, x_end int")
    sizes = spark.createDataFrame([(1, 50, 40)], "image_id long, width int, height int")
    found = {(r.x1, r.y1, r.x2, r.y2): r for r in S.proposal_candidates(edges, sizes).collect()}
    assert set(found) == {(6, 5, 26, 15), (30, 0, 50, 1), (30, 30, 31, 31)}
    for (x1, y1, x2, y2), r in found.items():
        frame = np.zeros_like(mask)
        frame[max(y1 - 1, 0) : y2 + 1, max(x1 - 1, 0) : x2 + 1] = True
        frame[y1 + 1 : y2 - 1, x1 + 1 : x2 - 1] = False
        assert r.edge_density == pytest.approx((mask & frame).sum() / frame.sum())
        side = (x2 - x1 - 1) * (y2 - y1 - 1)
        share = 1.0 if side else 0.0
        assert r.score == pytest.approx(0.55 * share + 0.35 * r.edge_density + 0.10 * min(1, side / 20))
    assert S.proposal_candidates(edges.where("false"), sizes).count() == 0


@pytest.mark.parametrize(("sample", "bound"), [(16, 3), (64, 2), (7, 5), (200, 8)])
def test_halo_map(spark, sample, bound):
    """A 5 x 5 window gives the same with every cut into blocks."""
    rng = np.random.default_rng(1)
    images = {1: rng.integers(0, 99, (37, 61)), 2: rng.integers(0, 99, (16, 16))}
    rows = [(i, y, m.shape[1], m.shape[0], m[y].tolist()) for i, m in images.items() for y in range(len(m))]
    lines = spark.createDataFrame(rows, "image_id long, y int, width int, height int, cls array<int>").repartition(3)

    def window(block):
        p = np.pad(block, 2)
        return sum(p[dy : dy + block.shape[0], dx : dx + block.shape[1]] for dy in range(5) for dx in range(5))

    found = {(r.image_id, r.y): r.cls for r in RA.halo_map(lines, window, sample=sample, bound=bound).collect()}
    assert found == {(i, y): window(m)[y].tolist() for i, m in images.items() for y in range(len(m))}


def test_halo_map_bands_and_nodata(spark):
    """Blocks of nodata are not computed; bands reach the function."""
    data = np.zeros((20, 30, 3), int)
    data[:10, :10] = 5
    rows = [(1, y, 30, 20, data[y].tolist()) for y in range(20)]
    lines = spark.createDataFrame(rows, "image_id long, y int, width int, height int, cls array<array<int>>")
    found = {r.y: r.cls for r in RA.halo_map(lines, lambda b: b.sum(2) + 1, sample=10, bound=2, nodata=0).collect()}
    want = np.zeros((20, 30), int)
    seen = np.zeros((20, 30), bool)
    for by in range(2):
        for bx in range(3):
            if data[max(0, by * 10 - 2) : by * 10 + 12, max(0, bx * 10 - 2) : bx * 10 + 12].any():
                seen[by * 10 : by * 10 + 10, bx * 10 : bx * 10 + 10] = True
    want[seen] = (data.sum(2) + 1)[seen]
    assert [found[y] for y in range(20)] == want.tolist()


def test_stitch_restores_masks(spark):
    """Masks cut at tile borders come back whole, also over corners and many tiles; their tips agree in a fifth of the seam only."""
    rng = np.random.default_rng(2)
    masks = {}
    for k in range(4):
        m = np.zeros((50, 200), bool)
        y, x = np.mgrid[0:50, 0:200]
        m |= (y - 25) ** 2 / (12 + k) ** 2 + (x - 100) ** 2 / (30 + 15 * k) ** 2 <= 1
        masks[k] = m
    rows = [(k, k, float(rng.random()), y, a, b) for k, m in masks.items() for _, _, y, a, b in runs_of(0, 0, m)]
    score = {k: s for k, _, s, *_ in rows}
    runs = spark.createDataFrame([(i, m, score[i], y, a, b) for i, m, _, y, a, b in rows], "image_id long, mask_id long, score double, y int, x_start int, x_end int")
    out = CR.stitch(CR.cut_at_tiles(runs, 16), 16, 0.2).collect()
    assert len({r.crown for r in out}) == 4
    assert {(r.image_id, r.y, r.x_start, r.x_end) for r in out} == {(i, y, a, b) for i, _, _, y, a, b in rows}
    assert {(r.image_id, r.score) for r in out} == set(score.items())


def test_seam_needs_agreement(spark):
    """Two masks that touch a seam in different rows stay apart."""
    rows = [(1, 0, 0, 5, 0.9, y, 10, 15) for y in range(0, 6)] + [(1, 1, 0, 6, 0.8, y, 0, 4) for y in range(5, 12)]
    tiles = spark.createDataFrame(rows, "image_id long, tile_x long, tile_y long, mask_id long, score double, y int, x_start int, x_end int")
    assert len({r.crown for r in CR.stitch(tiles, 16, 0.5).collect()}) == 2
    assert len({r.crown for r in CR.stitch(tiles, 16, 0.05).collect()}) == 1


def test_crown_clean(spark):
    """Of two that overlap the surer one stays, unsure ones go, straight outlines keep four corners."""
    rows = [(1, 1, 0.9, 1, y, 0, 19) for y in range(10)] + [(1, 2, 0.8, 1, y, 0, 17) for y in range(10)] + [(1, 3, 0.4, 1, y, 50, 60) for y in range(10)] + [(2, 4, 0.6, 1, y, 0, 3) for y in range(4)]
    crowns = spark.createDataFrame(rows, "image_id long, mask_id long, score double, pieces long, y int, x_start int, x_end int")
    out = {r.mask_id: r.ring for r in CR.outlines(CR.clean(crowns)).collect()}
    assert set(out) == {1, 4} and all(len(ring) == 5 for ring in out.values())


def test_equal_masks_fold(spark):
    """5,000 copies of a mask, two of another, one that differs in a pixel: the best of each set is left, and suppression is as without folding."""
    from parcelworks.operators import masks as M

    rows = [(1, k, 0.5 + (k * 37 % 5000) / 1e5, y, 3, 9) for k in range(5000) for y in range(3)] + [(1, 9000 + k, 0.9, y, 40, 50) for k in range(2) for y in range(3)]
    rows += [(1, 9500, 0.1, y, 3, 9 + (y == 0)) for y in range(3)] + [(2, 9600, 0.1, y, 3, 9) for y in range(3)]
    runs = spark.createDataFrame([(i, m, s, 1, y, a, b) for i, m, s, y, a, b in rows], "image_id long, mask_id long, score double, pieces long, y int, x_start int, x_end int")
    rank = runs.groupBy("mask_id").agg(F.struct(F.max("score").alias("score"), (-F.first("mask_id")).alias("k")).alias("rank"))
    best = max(range(5000), key=lambda k: (k * 37 % 5000, -k))
    assert {r.mask_id for r in M.fold_equal(runs, rank).select("mask_id").distinct().collect()} == {best, 9000, 9500, 9600}
    assert {r.mask_id for r in CR.clean(runs, 0.6, 0.0).select("mask_id").distinct().collect()} == {best, 9000, 9600}


def test_metrics_over_thresholds(spark):
    rng = random.Random(4)
    preds = [(k, rng.choice([0.1, 0.5, 0.9, rng.random()])) for k in range(60)]
    pairs = [(rng.randrange(60), t, rng.choice([0.5, 0.55, 0.7, 0.95, 0.5 + rng.random() / 2])) for t in range(40) for _ in range(3)]
    pairs = list({(p, t): (p, t, v) for p, t, v in pairs}.values())
    thresholds = [k / 20 for k in range(10, 20)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = G.object_metrics_range(frame(pairs, "pred long, truth long, iou double"), frame(preds, "pred long, score double"), frame([(t,) for t in range(40)], "truth long"), thresholds)
    found = {r.threshold: r for r in found.collect()}
    aps = []
    for th in thresholds:
        taken, hit = set(), []
        for p, _ in sorted(preds, key=lambda r: (-r[1], r[0])):
            options = sorted((-v, t) for q, t, v in pairs if q == p and v >= th and t not in taken)
            taken |= {options[0][1]} if options else set()
            hit.append(bool(options))
        precision = np.cumsum(hit) / np.arange(1, 61)
        best = np.maximum.accumulate(precision[::-1])[::-1]
        aps.append(best[np.array(hit)].sum() / 40)
        r = found[th]
        assert (r.tp, r.n_pred, r.n_truth) == (sum(hit), 60, 40)
        assert r.average_precision == pytest.approx(aps[-1])
    assert all(r.mean_average_precision == pytest.approx(np.mean(aps)) for r in found.values())
    none = G.object_metrics_range(frame([], "pred long, truth long, iou double"), frame(preds, "pred long, score double"), frame([(1,)], "truth long"), [0.5, 0.9]).collect()
    assert [(r.tp, r.average_precision) for r in none] == [(0, 0.0)] * 2
