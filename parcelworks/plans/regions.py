"""Suppression, selection and connected-region queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelworks.functions import bbox as B, ring as R
from parcelworks.functions.bbox import Box
from parcelworks.functions.numbers import r6
from parcelworks.operators import components as C, crowns as CR, greedy as G, masks as M, shape as S
from parcelworks.operators.detections import bbox_iou_join, prompt_sized
from parcelworks.plans.registry import query
from parcelworks.session import materialize

BOX = Box.of()


# ---- suppression --------------------------------------------------------------------

#: One item after the other in each group: it is kept if no kept item is among those ``above`` that conflict with it.
WALK = """walk AS (SELECT grp, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS key, FALSE AS ok, CAST([] AS BIGINT[]) AS kept FROM items WHERE turn = 1
  UNION ALL SELECT i.grp, i.turn, i.key, NOT list_has_any(coalesce(h.above, []), w.kept), CASE WHEN list_has_any(coalesce(h.above, []), w.kept) THEN w.kept ELSE list_append(w.kept, i.key) END
  FROM walk w JOIN items i ON i.grp = w.grp AND i.turn = w.turn + 1 LEFT JOIN hits h ON h.loser = i.key)"""


def box_walk(group, order, iou):
    """Greedy suppression of boxes as a recursive query."""
    return f"""items AS (SELECT {group} AS grp, det_id AS key, image_id, score, x1, y1, x2, y2, (x2 - x1) * (y2 - y1) AS area, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS turn FROM detections),
met AS (SELECT a.key AS above, b.key AS loser, greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS common, a.area AS aa, b.area AS ba FROM items a JOIN items b ON a.grp = b.grp AND a.turn < b.turn),
hits AS (SELECT loser, list(above) AS above FROM met WHERE common / (aa + ba - common) >= {iou} GROUP BY loser), {WALK}"""


def mask_walk(condition, where="TRUE"):
    """Greedy suppression of masks as a recursive query; ``shared`` are the common pixels of every pair."""
    return f"""sizes AS (SELECT image_id, mask_id, SUM(x_end - x_start + 1) AS area FROM instance_runs WHERE {where} GROUP BY ALL),
items AS (SELECT s.image_id AS grp, s.mask_id AS key, s.area, row_number() OVER (PARTITION BY s.image_id ORDER BY d.score DESC, (d.x2 - d.x1) * (d.y2 - d.y1) DESC, d.det_id) AS turn FROM sizes s JOIN detections d ON d.det_id = s.mask_id),
shared AS (SELECT a.image_id, a.mask_id AS one, b.mask_id AS two, SUM(least(a.x_end, b.x_end) - greatest(a.x_start, b.x_start) + 1) AS common FROM instance_runs a JOIN instance_runs b
  ON a.image_id = b.image_id AND a.y = b.y AND a.mask_id <> b.mask_id AND a.x_start <= b.x_end AND b.x_start <= a.x_end GROUP BY ALL),
hits AS (SELECT y.key AS loser, list(x.key) AS above FROM shared s JOIN items x ON x.key = s.one JOIN items y ON y.key = s.two AND x.turn < y.turn
  WHERE {condition.format(iou="s.common / CAST(x.area + y.area - s.common AS DOUBLE)", smaller="s.common / CAST(least(x.area, y.area) AS DOUBLE)")} GROUP BY y.key), {WALK}"""


@query("nms_by_class", f"WITH RECURSIVE {box_walk("concat(image_id, '/', class_id)", '(x2 - x1) * (y2 - y1) DESC, det_id', 0.5)} SELECT key AS det_id FROM walk WHERE ok", "detections")
def _(t):
    """Larger boxes first, IoU >= 0.5 suppressed, per image and class."""
    return G.suppress_boxes(t.detections, ["image_id", "class_id"], "det_id", BOX.area, 0.5)


@query("nms_by_score", f"WITH RECURSIVE {box_walk('image_id', 'score DESC, det_id', 0.35)} SELECT key AS det_id FROM walk WHERE ok QUALIFY row_number() OVER (PARTITION BY grp ORDER BY turn) <= 6", "detections")
def _(t):
    """The six best of each image (fixed value) after suppression at IoU 0.35."""
    kept = G.suppress_boxes(t.detections, ["image_id"], "det_id", F.col("score"), 0.35)
    return G.first_kept(kept, t.detections, ["image_id"], "det_id", F.col("score"), 6)


def mask_rank(t):
    return t.detections.select(F.col("det_id").alias("mask_id"), F.struct("score", BOX.area.alias("area"), (-F.col("det_id")).alias("k")).alias("rank"))


def suppress_masks(t, runs, condition):
    best = materialize(M.best_of_equal(runs, mask_rank(t)), "masks")
    return G.suppress_edges(best.select("image_id", "mask_id"), "mask_id", G.mask_conflicts(M.folded_overlaps(runs, best), mask_rank(t), condition))


@query("mask_nms", f"WITH RECURSIVE {mask_walk('{iou} >= 0.70')} SELECT grp AS image_id, key AS mask_id FROM walk WHERE ok", "instance_runs")
def _(t):
    return suppress_masks(t, t.instance_runs, F.col("iou") >= 0.70)


@query("mask_dedupe_coverage", f"WITH RECURSIVE {mask_walk('{iou} >= 0.60 OR {smaller} >= 0.80')} SELECT grp AS image_id, key AS mask_id FROM walk WHERE ok", "instance_runs")
def _(t):
    return suppress_masks(t, t.instance_runs, (F.col("iou") >= 0.60) | (F.col("smaller_coverage") >= 0.80))


TILE = 64
#: The pieces of the masks cut at tile borders, their contacts on both sides of each seam, and the crowns that chains of contacts make.
STITCHED = """cut AS (SELECT image_id, mask_id * 64 + (y // 64) * 8 + tx AS piece, y // 64 AS ty, tx, score, y, greatest(x_start, tx * 64) AS xs, least(x_end, tx * 64 + 63) AS xe FROM (SELECT *, unnest(range(x_start // 64, x_end // 64 + 1)) AS tx FROM instance_runs)),
contacts AS (SELECT image_id, 'x' AS kind, tx + 1 AS sx, ty AS sy, 0 AS side, piece, y AS lo, y AS hi FROM cut WHERE xe = tx * 64 + 63 UNION ALL SELECT image_id, 'x', tx, ty, 1, piece, y, y FROM cut WHERE xs = tx * 64
  UNION ALL SELECT image_id, 'y', tx, ty + 1, 0, piece, xs, xe FROM cut WHERE y % 64 = 63 UNION ALL SELECT image_id, 'y', tx, ty, 1, piece, xs, xe FROM cut WHERE y % 64 = 0),
lengths AS (SELECT image_id, kind, sx, sy, side, piece, SUM(hi - lo + 1) AS n FROM contacts GROUP BY ALL),
shared AS (SELECT a.image_id, a.kind, a.sx, a.sy, a.piece AS u, b.piece AS v, SUM(least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1) AS common FROM contacts a JOIN contacts b
  ON a.image_id = b.image_id AND a.kind = b.kind AND a.sx = b.sx AND a.sy = b.sy AND a.side = 0 AND b.side = 1 AND a.lo <= b.hi AND b.lo <= a.hi GROUP BY ALL),
links AS (SELECT DISTINCT s.u, s.v FROM shared s JOIN lengths a ON a.image_id = s.image_id AND a.kind = s.kind AND a.sx = s.sx AND a.sy = s.sy AND a.side = 0 AND a.piece = s.u
  JOIN lengths b ON b.image_id = s.image_id AND b.kind = s.kind AND b.sx = s.sx AND b.sy = s.sy AND b.side = 1 AND b.piece = s.v WHERE s.common / CAST(a.n + b.n - s.common AS DOUBLE) >= 0.5),
ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links), reached AS (SELECT DISTINCT piece AS a, piece AS b FROM cut UNION SELECT r.a, w.v FROM reached r JOIN ways w ON r.b = w.u),
crowns AS (SELECT a AS piece, MIN(b) AS crown FROM reached GROUP BY a)"""


def crowns(t):
    """Crowns stitched from the masks of tiles of 64 pixels, numbered by their first piece in tile order."""
    pieces = CR.cut_at_tiles(t.instance_runs, TILE).withColumn("mask_id", F.col("mask_id") * 64 + F.col("tile_y") * 8 + F.col("tile_x"))
    return CR.stitch(pieces, TILE).withColumn("mask_id", F.col("crown.mask_id"))


@query("crown_stitch", f"""WITH RECURSIVE {STITCHED}
SELECT image_id, min({{'tx': piece % 8, 'ty': (piece // 8) % 8, 'piece': piece}}).piece AS least_piece, COUNT(DISTINCT piece) AS pieces, MAX(score) AS score, CAST(COUNT(DISTINCT (y, x)) AS BIGINT) AS area FROM (SELECT image_id, c.piece, k.crown, score, y, unnest(range(xs, xe + 1)) AS x FROM cut c JOIN crowns k ON k.piece = c.piece) GROUP BY image_id, crown""", "instance_runs")
def _(t):
    """Area, pieces and score of every crown after stitching."""
    named = crowns(t).groupBy("image_id", "crown").agg(F.first("mask_id").alias("least_piece"), F.first("pieces").alias("pieces"), F.first("score").alias("score"), F.sum(M.length()).cast("bigint").alias("area"))
    return named.drop("crown")


@query("crown_clean")
def _(t):
    """From tile-local masks to a crown map: stitched at the seams, enough confidence, overlaps at IoU >= 0.6 keep the surer one, outlines simplified by 0.3."""
    rings = CR.outlines(CR.clean(materialize(crowns(t), "crowns")))
    return rings.groupBy("image_id", "mask_id").agg(F.count("*").alias("rings"), F.sum(F.size("ring")).alias("points"), r6(F.sum(R.area(F.col("ring")))).alias("area"))


def cascade(t):
    first, second = t.instance_runs.filter("score >= 0.5"), t.instance_runs.filter("score < 0.5")
    kept = suppress_masks(t, second, (F.col("iou") >= 0.60) | (F.col("smaller_coverage") >= 0.80))
    from parcelworks.operators.sets import union_passes

    return union_passes(M.unrepeated(first, second, kept), first.select("image_id", "mask_id").distinct())


@query("cascade_fusion", f"""WITH RECURSIVE {mask_walk('{iou} >= 0.60 OR {smaller} >= 0.80', 'score < 0.5')},
firsts AS (SELECT image_id, mask_id, SUM(x_end - x_start + 1) AS area FROM instance_runs WHERE score >= 0.5 GROUP BY ALL), added AS (SELECT i.grp AS image_id, i.key AS mask_id, i.area FROM walk w JOIN items i ON i.key = w.key WHERE w.ok),
repeated AS (SELECT a.mask_id FROM shared s JOIN added a ON a.mask_id = s.two JOIN firsts f ON f.mask_id = s.one
  WHERE s.common / CAST(f.area + a.area - s.common AS DOUBLE) >= 0.45 OR s.common / CAST(least(f.area, a.area) AS DOUBLE) >= 0.75 OR s.common / CAST(a.area AS DOUBLE) >= 0.65)
SELECT image_id, mask_id, 0 AS paint_pass FROM added WHERE mask_id NOT IN (SELECT mask_id FROM repeated) UNION ALL SELECT image_id, mask_id, 1 FROM firsts""", "instance_runs")
def _(t):
    return cascade(t)


def proposals(t):
    scored = t.detections.filter(prompt_sized(BOX, 256, 256)).select(
        "image_id", F.col("det_id").alias("key"), "x1", "y1", "x2", "y2", "score", BOX.area.alias("area"),
        B.proposal_score(BOX, F.lit(256), F.lit(256), F.col("score")).alias("base"),
    )
    return scored


@query("diverse_select")
def _(t):
    return G.diverse_select(proposals(t), "image_id", 4)


@query("spatially_diverse_select")
def _(t):
    ready = proposals(t).withColumn("area_score", F.sqrt(F.col("area") / 65536.0)).withColumn("center_distance", B.image_center_distance(BOX, 256, 256))
    return G.spatially_diverse_select(ready, "image_id", 4, 256.0, 256.0)


@query("group_proposals")
def _(t):
    return G.group_proposals(proposals(t), "image_id", 256.0, 256.0)


@query("group_sort")
def _(t):
    """Groups by padded area, then member count, both descending."""
    # written once: an order over everything samples its rows first and would group them twice
    grouped = materialize(G.group_proposals(proposals(t), "image_id", 256.0, 256.0), "groups")
    return grouped.select("image_id", "first_key", "members", BOX.area.alias("area")).orderBy(F.col("area").desc(), F.col("members").desc(), "image_id", "first_key")


def predictions(t):
    """Class 0 boxes are the predictions, the others the truth: (pairs, preds, truths)."""
    pairs = bbox_iou_join(t.detections, ["image_id"], "det_id", 0.5)
    side = lambda name: t.detections.select(F.col("det_id").alias(f"id_{name}"), (F.col("class_id") == 0).alias(f"_{name}"))
    crossed = pairs.join(side("a"), "id_a").join(side("b"), "id_b").filter(F.col("_a") != F.col("_b"))
    pick = lambda first: F.when(F.col("_a") == first, F.col("id_a")).otherwise(F.col("id_b"))
    crossed = crossed.select(pick(True).alias("pred"), pick(False).alias("truth"), "iou")
    preds = t.detections.filter("class_id = 0").select(F.col("det_id").alias("pred"), "score")
    return crossed, preds, t.detections.filter("class_id <> 0").select(F.col("det_id").alias("truth"))


#: Greedy matching one prediction after the other in each image, for every threshold; ``taken`` are the truths already matched.
MATCHED = """levels AS (SELECT unnest(range(10, 20)) / 20.0::DOUBLE AS threshold), sized AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM detections),
pairs AS (SELECT p.image_id, p.det_id AS pred, p.score, q.det_id AS truth, (least(p.x2, q.x2) - greatest(p.x1, q.x1)) * (least(p.y2, q.y2) - greatest(p.y1, q.y1)) AS common, p.area AS pa, q.area AS qa
  FROM sized p JOIN sized q ON p.image_id = q.image_id AND p.class_id = 0 AND q.class_id <> 0 AND p.x1 < q.x2 AND q.x1 < p.x2 AND p.y1 < q.y2 AND q.y1 < p.y2),
options AS (SELECT threshold, image_id, pred, any_value(score) AS score, list(truth ORDER BY common / (pa + qa - common) DESC, truth) AS truths FROM pairs JOIN levels ON common / (pa + qa - common) >= threshold GROUP BY threshold, image_id, pred),
turns AS (SELECT *, row_number() OVER (PARTITION BY threshold, image_id ORDER BY score DESC, pred) AS turn FROM options),
walk AS (SELECT threshold, image_id, CAST(0 AS BIGINT) AS turn, CAST(NULL AS BIGINT) AS pred, CAST(NULL AS BIGINT) AS truth, CAST([] AS BIGINT[]) AS taken FROM turns WHERE turn = 1
  UNION ALL SELECT o.threshold, o.image_id, o.turn, o.pred, list_filter(o.truths, lambda x: NOT list_contains(w.taken, x))[1], list_append(w.taken, coalesce(list_filter(o.truths, lambda x: NOT list_contains(w.taken, x))[1], -1))
  FROM walk w JOIN turns o ON o.threshold = w.threshold AND o.image_id = w.image_id AND o.turn = w.turn + 1),
matched AS (SELECT threshold, pred FROM walk WHERE truth IS NOT NULL),
places AS (SELECT det_id AS pred, row_number() OVER (ORDER BY score DESC, det_id) AS position FROM detections WHERE class_id = 0),
hits AS (SELECT threshold, position, row_number() OVER (PARTITION BY threshold ORDER BY position) / CAST(position AS DOUBLE) AS precision_at FROM matched JOIN places USING (pred)),
enveloped AS (SELECT threshold, precision_at, MAX(precision_at) OVER (PARTITION BY threshold ORDER BY position DESC) AS best FROM hits),
counts AS (SELECT COUNT(*) FILTER (WHERE class_id = 0) AS n_pred, COUNT(*) FILTER (WHERE class_id <> 0) AS n_truth FROM detections)"""
SCORES = """round_even(CAST(tp AS DOUBLE) / greatest(n_pred, 1), 6) + 0.0 AS precision, round_even(CAST(tp AS DOUBLE) / greatest(n_truth, 1), 6) + 0.0 AS recall,
  round_even(2.0 * (CAST(tp AS DOUBLE) / greatest(n_pred, 1)) * (CAST(tp AS DOUBLE) / greatest(n_truth, 1)) / greatest(CAST(tp AS DOUBLE) / greatest(n_pred, 1) + CAST(tp AS DOUBLE) / greatest(n_truth, 1), 1e-8), 6) + 0.0 AS f1, round_even(area / greatest(n_truth, 1), 6) + 0.0 AS average_precision"""


@query("object_metrics", f"""WITH RECURSIVE {MATCHED}, sums AS (SELECT COUNT(*) AS tp, coalesce(SUM(precision_at), 0.0) AS area FROM enveloped WHERE threshold = 0.5)
SELECT CAST(0.5 AS DOUBLE) AS threshold, n_pred, n_truth, tp, {SCORES} FROM counts, sums""", "detections")
def _(t):
    return G.object_metrics(*predictions(t), 0.5).select("threshold", "n_pred", "n_truth", "tp", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "average_precision")))


@query("object_metrics_range", f"""WITH RECURSIVE {MATCHED}, sums AS (SELECT l.threshold, COUNT(e.best) AS tp, coalesce(SUM(e.best), 0.0) AS area FROM levels l LEFT JOIN enveloped e ON e.threshold = l.threshold GROUP BY l.threshold)
SELECT threshold, n_pred, n_truth, tp, {SCORES}, round_even(AVG(area / greatest(n_truth, 1)) OVER (), 6) + 0.0 AS mean_average_precision FROM counts, sums""", "detections")
def _(t):
    """Ten IoU thresholds from 0.5 to 0.95, and the mean of their average precisions."""
    found = G.object_metrics_range(*predictions(t), [k / 20 for k in range(10, 20)])
    return found.select("threshold", "n_pred", "n_truth", "tp", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1", "average_precision", "mean_average_precision")))


# ---- connected regions --------------------------------------------------------------

def interior(t):
    """Interior pixels only: boundary pixels part the fields."""
    return M.binary_runs(t.mask_blocks, [1]).select("image_id", "y", "x_start", "x_end")


def widened(rows, *columns):
    """Columns that the SQL makes from a range, which is of 64 bits."""
    return rows.withColumns({c: F.col(c).cast("bigint") for c in columns})


def sizes(t):
    return t.images.select("image_id", "width", "height")


#: Interiors are parted by boundary lines every 12 x 10 pixels, so runs connect inside such a cell only; a region is named by its first pixel.
REGION_PIXELS = """cell_runs AS (SELECT image_id, (y // 10) * 1000 + x_start // 12 AS cell, y, x_start, x_end, y * 4294967296 + x_start AS id FROM mask_runs WHERE cls = 1),
touching AS (SELECT a.image_id, a.id AS a, b.id AS b FROM cell_runs a JOIN cell_runs b ON a.image_id = b.image_id AND a.cell = b.cell AND abs(a.y - b.y) = 1 AND a.x_start <= b.x_end + 1 AND b.x_start <= a.x_end + 1),
linked AS (SELECT image_id, id AS a, id AS b FROM cell_runs UNION SELECT l.image_id, l.a, t.b FROM linked l JOIN touching t ON t.image_id = l.image_id AND t.a = l.b),
labels AS (SELECT image_id, a AS id, MIN(b) AS region FROM linked GROUP BY image_id, a),
cells AS (SELECT image_id, region, y, unnest(range(x_start, x_end + 1)) AS x FROM cell_runs JOIN labels USING (image_id, id))"""
CELL_PIXELS = "cells AS (SELECT image_id, (y // 10) * 1000 + x // 12 AS region, y, x FROM mask_pixels WHERE cls = 1)"
CELL_SIZES = "sized AS (SELECT image_id, region, COUNT(*) AS area, MIN(y * 4294967296 + x) AS first FROM cells GROUP BY ALL)"
RUNS = "SELECT image_id, y, MIN(x) AS x_start, MAX(x) AS x_end FROM (SELECT image_id, y, x, x - row_number() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM {pixels}) GROUP BY image_id, y, island"


@query("connected_components", f"""WITH RECURSIVE {REGION_PIXELS}, {CELL_SIZES} SELECT image_id, first AS region, s.area, MIN(x) AS x1, MIN(y) AS y1, MAX(x) AS x2, MAX(y) AS y2, row_number() OVER (PARTITION BY image_id ORDER BY first) AS label
FROM cells c JOIN sized s USING (image_id, region) GROUP BY image_id, first, s.area""", "mask_pixels mask_runs")
def _(t):
    found = C.number_regions(C.region_table(C.connected_components(interior(t), 8)))
    return widened(found, "x1", "x2")


@query("clean_components", f"""WITH RECURSIVE {REGION_PIXELS}, {CELL_SIZES}, kept AS (SELECT c.image_id, c.y, c.x FROM cells c JOIN sized s USING (image_id, region) WHERE s.area >= 40),
ground AS (SELECT g.image_id, g.y, g.x FROM mask_pixels g ANTI JOIN kept k USING (image_id, y, x)), hole AS (SELECT g.image_id, g.y, g.x FROM ground g JOIN images i USING (image_id) WHERE g.x > 0 AND g.y > 0 AND g.x < i.width - 1 AND g.y < i.height - 1
  AND NOT EXISTS (SELECT 1 FROM ground o WHERE o.image_id = g.image_id AND (o.y <> g.y OR o.x <> g.x) AND o.y BETWEEN g.y - 1 AND g.y + 1 AND o.x BETWEEN g.x - 1 AND g.x + 1)),
filled AS (SELECT * FROM kept UNION ALL SELECT * FROM hole) {RUNS.format(pixels='filled')}""", "mask_pixels mask_runs images")
def _(t):
    return widened(C.clean_components(interior(t), sizes(t), smallest=40, max_hole=64), "x_start", "x_end")


@query("largest_component", f"""WITH RECURSIVE {REGION_PIXELS}, {CELL_SIZES}, best AS (SELECT image_id, region FROM sized QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY area DESC, first) = 1),
chosen AS (SELECT c.* FROM cells c JOIN best b USING (image_id, region)) {RUNS.format(pixels='chosen')}""", "mask_pixels mask_runs")
def _(t):
    return widened(C.largest_component(interior(t)).select("image_id", "y", "x_start", "x_end"), "x_start", "x_end")


@query("region_groups_fill")
def _(t):
    filled = C.region_groups_fill(interior(t), sizes(t), 40, None, 32)
    return C.number_regions(C.region_table(filled))


PROPS = ["extent", "centroid_x", "centroid_y", "axis_major", "axis_minor", "eccentricity", "equivalent_diameter", "orientation", "elongation"]


@query("region_props", """WITH px AS (SELECT image_id, mask_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (SELECT image_id, mask_id, y, unnest(range(x_start, x_end + 1)) AS x FROM instance_runs)),
s AS (SELECT image_id, mask_id, COUNT(*) AS area, (MAX(x) - MIN(x) + 1) * (MAX(y) - MIN(y) + 1) AS box, AVG(x) AS cx, AVG(y) AS cy, AVG(x * x) - AVG(x) * AVG(x) + 1 / 12.0 AS vx, AVG(y * y) - AVG(y) * AVG(y) + 1 / 12.0 AS vy, AVG(x * y) - AVG(x) * AVG(y) AS vxy FROM px GROUP BY ALL),
r AS (SELECT *, sqrt((vx - vy) * (vx - vy) + 4 * vxy * vxy) AS root FROM s), l AS (SELECT *, (vx + vy + root) / 2 AS big, (vx + vy - root) / 2 AS little FROM r)
SELECT image_id, mask_id AS region, area, round_even(area / box, 5) + 0.0 AS extent, round_even(cx, 5) + 0.0 AS centroid_x, round_even(cy, 5) + 0.0 AS centroid_y, round_even(4 * sqrt(big), 5) + 0.0 AS axis_major, round_even(4 * sqrt(little), 5) + 0.0 AS axis_minor,
  round_even(sqrt(1 - little / big), 5) + 0.0 AS eccentricity, round_even(sqrt(4 * area / pi()), 5) + 0.0 AS equivalent_diameter, round_even(4 * sqrt(big) / (4 * sqrt(little)), 5) + 0.0 AS elongation FROM l""", "instance_runs")
def _(t):
    props = C.region_props(t.instance_runs.withColumn("region", F.col("mask_id")))
    measured = [c for c in PROPS if c != "orientation"]
    return props.select("image_id", "region", "area", *((F.bround(F.col(c), 5) + 0.0).alias(c) for c in measured))


def field_cells(t):
    """Field interiors by the cell that holds them; the boundary lines part the cells."""
    runs = t.mask_runs.filter("cls = 1")
    return runs.select("image_id", (F.floor(F.col("y") / 10) * 1000 + F.floor(F.col("x_start") / 12)).alias("region"), "y", "x_start", "x_end")


@query("region_shape", f"""WITH RECURSIVE {CELL_PIXELS},
area AS (SELECT image_id, region, COUNT(*) AS area, MIN(x) AS x1, MAX(x) AS x2, MIN(y) AS y1, MAX(y) AS y2 FROM cells GROUP BY ALL),
border AS (SELECT c.* FROM cells c WHERE (SELECT COUNT(*) FROM cells n WHERE n.image_id = c.image_id AND n.region = c.region AND abs(n.y - c.y) + abs(n.x - c.x) = 1) < 4),
sums AS (SELECT a.image_id, a.region, a.y, a.x, SUM(CASE abs(b.y - a.y) + abs(b.x - a.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS v FROM border a JOIN border b
  ON a.image_id = b.image_id AND a.region = b.region AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY ALL),
outline AS (SELECT image_id, region, SUM(CASE WHEN v IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN v IN (21, 33) THEN sqrt(2) WHEN v IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END) AS perimeter FROM sums GROUP BY ALL),
box AS (SELECT image_id, region, x1, x2, y1, y2, unnest(range(y1, y2 + 1)) AS y FROM area), grid_cells AS (SELECT *, unnest(range(x1, x2 + 1)) AS x FROM box),
ground AS (SELECT g.* FROM grid_cells g ANTI JOIN cells c USING (image_id, region, y, x)),
out AS (SELECT image_id, region, y, x FROM ground WHERE x IN (x1, x2) OR y IN (y1, y2) UNION
  SELECT g.image_id, g.region, g.y, g.x FROM out o JOIN ground g ON g.image_id = o.image_id AND g.region = o.region AND abs(g.y - o.y) <= 1 AND abs(g.x - o.x) <= 1),
inner_ground AS (SELECT image_id, region, COUNT(*) AS n FROM (SELECT image_id, region, y, x FROM ground EXCEPT SELECT * FROM out) GROUP BY ALL),
ends AS (SELECT image_id, region, y, MIN(x) AS lo, MAX(x) AS hi FROM cells GROUP BY ALL),
points AS (SELECT image_id, region, CAST(y AS DOUBLE) AS y, lo - 0.5 AS lo, hi + 0.5 AS hi FROM ends UNION ALL SELECT image_id, region, y - 0.5, lo, hi FROM ends UNION ALL SELECT image_id, region, y + 0.5, lo, hi FROM ends),
lines AS (SELECT b.image_id, b.region, b.y, MIN(CASE WHEN p.y = q.y THEN least(p.lo, q.lo) ELSE p.lo + (q.lo - p.lo) * (b.y - p.y) / (q.y - p.y) END) AS lo, MAX(CASE WHEN p.y = q.y THEN greatest(p.hi, q.hi) ELSE p.hi + (q.hi - p.hi) * (b.y - p.y) / (q.y - p.y) END) AS hi
  FROM box b JOIN points p ON p.image_id = b.image_id AND p.region = b.region AND p.y <= b.y JOIN points q ON q.image_id = b.image_id AND q.region = b.region AND q.y >= b.y GROUP BY ALL),
hull AS (SELECT image_id, region, CAST(SUM(floor(hi + 1e-9) - ceil(lo - 1e-9) + 1) AS BIGINT) AS convex_area FROM lines GROUP BY ALL)
SELECT a.image_id, a.region, a.area, round_even(o.perimeter, 5) + 0.0 AS perimeter, a.area + coalesce(i.n, 0) AS filled_area, h.convex_area, round_even(CAST(a.area AS DOUBLE) / h.convex_area, 5) + 0.0 AS solidity
FROM area a JOIN outline o USING (image_id, region) JOIN hull h USING (image_id, region) LEFT JOIN inner_ground i ON i.image_id = a.image_id AND i.region = a.region""", "mask_pixels")
def _(t):
    """Perimeter, filled area, convex area and solidity of the field interiors."""
    found = S.region_shape(field_cells(t))
    return found.select("image_id", F.col("region").cast("int").alias("region"), "area", (F.bround("perimeter", 5) + 0.0).alias("perimeter"), "filled_area", "convex_area", (F.bround("solidity", 5) + 0.0).alias("solidity"))


@query("proposal_candidates", f"""WITH RECURSIVE {REGION_PIXELS},
area AS (SELECT image_id, region, MIN(x) AS x1, MAX(x) AS x2, MIN(y) AS y1, MAX(y) AS y2, arg_min(y * 4294967296 + x, y * 4294967296 + x) AS label FROM cells GROUP BY ALL),
ends AS (SELECT image_id, region, y, MIN(x) AS lo, MAX(x) AS hi FROM cells GROUP BY ALL),
outline AS (SELECT a.image_id, a.region, SUM((a.hi - a.lo + b.hi - b.lo) / 2.0) AS outline_area FROM ends a JOIN ends b ON a.image_id = b.image_id AND a.region = b.region AND b.y = a.y + 1 GROUP BY ALL),
points AS (SELECT DISTINCT * FROM (SELECT image_id, region, y, lo AS x FROM ends UNION ALL SELECT image_id, region, y, hi FROM ends)),
sides AS (SELECT p.image_id, p.region, q.x - p.x AS dx, q.y - p.y AS dy, sqrt((q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y)) AS len, MIN((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) AS least,
  MAX((q.x - p.x) * (r.x) + (q.y - p.y) * r.y) - MIN((q.x - p.x) * (r.x) + (q.y - p.y) * r.y) AS along, MAX((q.x - p.x) * (r.y - p.y) - (q.y - p.y) * (r.x - p.x)) AS across
  FROM points p JOIN points q ON p.image_id = q.image_id AND p.region = q.region AND (p.x <> q.x OR p.y <> q.y) JOIN points r ON p.image_id = r.image_id AND p.region = r.region GROUP BY p.image_id, p.region, p.x, p.y, q.x, q.y),
rect AS (SELECT image_id, region, MIN(along / len * (across / len)) AS rect_area FROM sides WHERE least >= 0 GROUP BY ALL),
frame AS (SELECT a.image_id, a.region, COUNT(*) AS frame, SUM(CASE WHEN g.cls = 1 THEN 1 ELSE 0 END) AS hits FROM area a JOIN mask_pixels g ON a.image_id = g.image_id AND g.x BETWEEN a.x1 - 1 AND a.x2 + 1 AND g.y BETWEEN a.y1 - 1 AND a.y2 + 1
  WHERE NOT (g.x BETWEEN a.x1 + 1 AND a.x2 - 1 AND g.y BETWEEN a.y1 + 1 AND a.y2 - 1) GROUP BY ALL),
scored AS (SELECT a.image_id, a.label AS region, a.x1, a.y1, a.x2 + 1 AS x2, a.y2 + 1 AS y2, coalesce(o.outline_area, 0.0) AS outline_area, coalesce(r.rect_area, 0.0) AS rect_area,
  CASE WHEN r.rect_area > 0 THEN coalesce(o.outline_area, 0.0) / r.rect_area ELSE 0.0 END AS rectangularity, CAST(f.hits AS DOUBLE) / f.frame AS edge_density, least(1.0, coalesce(o.outline_area, 0.0) / greatest(1.0, i.width * i.height * 0.01)) AS size
  FROM area a JOIN frame f USING (image_id, region) JOIN images i ON i.image_id = a.image_id LEFT JOIN outline o ON o.image_id = a.image_id AND o.region = a.region LEFT JOIN rect r ON r.image_id = a.image_id AND r.region = a.region)
SELECT image_id, CAST(region AS BIGINT) AS region, CAST(x1 AS BIGINT) AS x1, CAST(y1 AS BIGINT) AS y1, CAST(x2 AS BIGINT) AS x2, CAST(y2 AS BIGINT) AS y2, CAST(outline_area AS DOUBLE) AS outline_area, round_even(rect_area, 5) + 0.0 AS rect_area,
  round_even(rectangularity, 5) + 0.0 AS rectangularity, round_even(edge_density, 5) + 0.0 AS edge_density, round_even(0.55 * rectangularity + 0.35 * edge_density + 0.10 * size, 8) + 0.0 AS score FROM scored""", "mask_pixels mask_runs images")
def _(t):
    """Boxes of the components of an edge table, here the field interiors, with their scores."""
    found = S.proposal_candidates(t.mask_runs.filter("cls = 1").select("image_id", "y", "x_start", "x_end"), sizes(t))
    rounded = [(F.bround(F.col(c), 5) + 0.0).alias(c) for c in ("rect_area", "rectangularity", "edge_density")]
    return found.select("image_id", "region", "x1", "y1", "x2", "y2", "outline_area", *rounded, (F.bround("score", 8) + 0.0).alias("score"))


@query("region_props_join")
def _(t):
    labelled = C.connected_components(interior(t), 8)
    regions = C.number_regions(C.region_table(labelled))
    intensity = t.rgb_rows.select("image_id", "y", F.transform("bands", lambda p: p[0]).alias("values"))
    measured = C.region_intensity(labelled, intensity).join(regions.select("image_id", "region", "label"), ["image_id", "region"]).drop("region")
    shape = S.region_shape(labelled).drop("area")
    props = C.region_props(labelled).join(shape, ["image_id", "region"]).join(regions.select("image_id", "region", "label"), ["image_id", "region"]).drop("region", "area", "x1", "y1", "x2", "y2")
    return C.region_props_join(C.region_props_join(regions, props), measured)
