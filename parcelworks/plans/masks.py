"""Run, overlap, painting and morphology queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelworks.functions.numbers import r6
from parcelworks.operators import masks as M, sets
from parcelworks.operators.ordering import rank_by_id, rank_within, rank_within_by
from parcelworks.plans.registry import query
from parcelworks.session import materialize

FIELD = "CASE WHEN cls IN (1, 2) THEN 1 ELSE 0 END"


def morph(chain, source="mask_pixels"):
    """Pixel-level twin: MIN/MAX over a 3 x 3 window, one step after the other."""
    text = f"(SELECT image_id, y, x, {FIELD} AS v FROM {source})"
    for kind in chain:
        text = f"""(SELECT image_id, y, x, {kind}(h) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v FROM (
  SELECT *, {kind}(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS h FROM {text}))"""
    return text


def as_runs(pixels):
    return f"""SELECT image_id, y, MIN(x) AS x_start, MAX(x) AS x_end FROM (SELECT *, x - ROW_NUMBER() OVER (PARTITION BY image_id, y ORDER BY x) AS island FROM {pixels} WHERE v = 1) GROUP BY image_id, y, island"""


def field(t):
    return M.binary_runs(t.mask_blocks, [1, 2])


RUN = ["image_id", "y", "x_start", "x_end"]


@query("erode", as_runs(morph(["MIN"])), "mask_pixels")
def _(t):
    return M.erode(field(t)).select(*RUN)


@query("dilate", as_runs(morph(["MAX"])), "mask_pixels")
def _(t):
    return M.dilate(field(t)).select(*RUN)


@query("open", as_runs(morph(["MIN", "MAX"])), "mask_pixels")
def _(t):
    return M.opened(field(t)).select(*RUN)


@query("close", as_runs(morph(["MAX", "MIN"])), "mask_pixels")
def _(t):
    return M.closed(field(t)).select(*RUN)


EDGE = f"(SELECT a.image_id, a.y, a.x, 1 AS v FROM (SELECT image_id, y, x FROM mask_pixels WHERE cls IN (1, 2)) a JOIN {morph(['MIN'])} e ON a.image_id = e.image_id AND a.y = e.y AND a.x = e.x WHERE e.v = 0)"


@query("extract_boundary", as_runs(EDGE), "mask_pixels")
def _(t):
    return M.extract_boundary(field(t))


@query("field_area_ratio", f"""SELECT image_id, round_even(n / CAST(total AS DOUBLE), 6) + 0.0 AS field_area_ratio, round_even(b / CAST(total AS DOUBLE), 6) + 0.0 AS boundary_area_ratio FROM (
  SELECT image_id, COUNT(*) AS total, COUNT(*) FILTER (WHERE cls IN (1, 2)) AS n FROM mask_pixels GROUP BY image_id) JOIN (SELECT image_id, COUNT(*) AS b FROM {EDGE} GROUP BY image_id) USING (image_id)""", "mask_pixels")
def _(t):
    shares = M.field_area_ratio(t.mask_rows)
    return shares.select("image_id", r6(F.col("field_area_ratio")).alias("field_area_ratio"), r6(F.col("boundary_area_ratio")).alias("boundary_area_ratio"))


@query("mask_difference", "SELECT image_id, y, COUNT(*) AS pixels FROM mask_pixels m WHERE cls = 1 AND NOT EXISTS (SELECT 1 FROM mask_pixels n WHERE n.image_id = m.image_id AND n.y = m.y + 1 AND n.x = m.x AND n.cls = 2) GROUP BY image_id, y", "mask_pixels")
def _(t):
    inner = t.mask_runs.filter("cls = 1").select(*RUN)
    edge = t.mask_runs.filter("cls = 2").select("image_id", (F.col("y") - 1).alias("y"), "x_start", "x_end")
    left = M.run_difference(inner, edge)
    return left.groupBy("image_id", "y").agg(F.sum(M.length()).alias("pixels"))


@query("rle_encode", """SELECT image_id, MIN(p) AS start, cls AS value, COUNT(*) AS length FROM (
  SELECT image_id, p, cls, p - ROW_NUMBER() OVER (PARTITION BY image_id, cls ORDER BY p) AS island FROM (
    SELECT m.image_id, CAST(m.y AS BIGINT) * i.width + m.x AS p, m.cls FROM mask_pixels m JOIN images i USING (image_id))) GROUP BY image_id, cls, island""", "mask_pixels images")
def _(t):
    return M.rle_encode(t.mask_rows)


MASKS = "(SELECT image_id, mask_id, CAST(SUM(x_end - x_start + 1) AS BIGINT) AS area, MIN(x_start) AS x1, MIN(y) AS y1, MAX(x_end) AS x2, MAX(y) AS y2, MAX(score) AS score FROM {runs} GROUP BY image_id, mask_id)"
SOME = "(SELECT * FROM instance_runs WHERE score > 0.1)"


@query("mask_area_bbox", f"""SELECT d.image_id, d.det_id AS mask_id, coalesce(area, 0) AS area, coalesce(m.x1, 0) AS x1, coalesce(m.y1, 0) AS y1, coalesce(m.x2, 0) AS x2, coalesce(m.y2, 0) AS y2, round_even(coalesce(area, 0) / 65536.0, 6) + 0.0 AS area_ratio
FROM detections d LEFT JOIN {MASKS.format(runs=SOME)} m ON d.image_id = m.image_id AND d.det_id = m.mask_id""", "instance_runs")
def _(t):
    instances = t.detections.select("image_id", F.col("det_id").alias("mask_id"))
    measured = M.mask_area_bbox(t.instance_runs.filter("score > 0.1"), ["image_id", "mask_id"], instances)
    return measured.withColumn("area_ratio", r6(F.col("area") / 65536.0))


@query("mask_size_filter", f"SELECT image_id, mask_id, area FROM {MASKS.format(runs='instance_runs')} WHERE area BETWEEN 1000 AND 3000", "instance_runs")
def _(t):
    return M.mask_size_filter(t.instance_runs, ["image_id", "mask_id"], 1000, 3000).select("image_id", "mask_id", "area")


@query("numbering", f"SELECT mask_id, ROW_NUMBER() OVER (ORDER BY mask_id) AS id FROM {MASKS.format(runs=SOME)}", "instance_runs")
def _(t):
    filled = M.mask_area_bbox(t.instance_runs.filter("score > 0.1"), ["image_id", "mask_id"])
    return rank_by_id(filled.select("mask_id"), "mask_id").select("mask_id", (F.col("rank0") + 1).alias("id"))


@query("bbox_per_value", "SELECT image_id, cls AS value, CAST(ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY cls) AS BIGINT) AS id, MIN(x) AS x1, MIN(y) AS y1, MAX(x) AS x2, MAX(y) AS y2 FROM mask_pixels WHERE cls <> 0 GROUP BY image_id, cls", "mask_pixels")
def _(t):
    return M.bbox_per_value(t.mask_runs, "cls").withColumnRenamed("cls", "value")


INSTANCE_PIXELS = "(SELECT image_id, mask_id, score, y, CAST(unnest(range(x_start, x_end + 1)) AS INT) AS x FROM instance_runs)"


@query("semantic_union", f"SELECT image_id, y, COUNT(DISTINCT x) AS pixels, 255 AS value FROM {INSTANCE_PIXELS} GROUP BY image_id, y", "instance_runs")
def _(t):
    union = M.semantic_union(t.instance_runs)
    return union.groupBy("image_id", "y").agg(F.sum(M.length()).alias("pixels")).withColumn("value", F.lit(255))


@query("paint_order_unique_area", f"""SELECT image_id, value, COUNT(*) AS pixels FROM (SELECT p.image_id, p.y, p.x, MIN(m.n - m.r) AS value FROM {INSTANCE_PIXELS} p JOIN (
  SELECT image_id, mask_id, area, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY area DESC, mask_id) - 1 AS r, COUNT(*) OVER (PARTITION BY image_id) AS n FROM {MASKS.format(runs='instance_runs')}) m
  ON p.image_id = m.image_id AND p.mask_id = m.mask_id WHERE m.area BETWEEN 800 AND 4000 GROUP BY ALL) GROUP BY image_id, value""", "instance_runs")
def _(t):
    # ranges are sampled before they are cut, so the areas are written once instead of being summed for each use
    areas = materialize(M.mask_area_bbox(t.instance_runs, ["image_id", "mask_id"]).select("image_id", "mask_id", "area"), "areas")
    ranked = rank_within_by(areas, "image_id", [F.col("area").desc(), F.col("mask_id")])
    counts = areas.groupBy("image_id").agg(F.count("*").alias("n"))
    painted = M.paint_order_unique_area(t.instance_runs, ranked.join(counts, "image_id"), 800, 4000)
    return painted.groupBy("image_id", "value").agg(F.sum(M.length()).alias("pixels"))


@query("paint_order_unique_seq", f"""SELECT image_id, value, COUNT(*) AS pixels, MAX(score) AS score FROM (SELECT p.image_id, p.y, p.x, MAX(m.r) AS value, arg_max(p.score, m.r) AS score FROM {INSTANCE_PIXELS} p JOIN (
  SELECT image_id, mask_id, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY mask_id) AS r FROM {MASKS.format(runs='instance_runs')} WHERE area >= 1000) m
  ON p.image_id = m.image_id AND p.mask_id = m.mask_id GROUP BY ALL) GROUP BY image_id, value""", "instance_runs")
def _(t):
    sized = M.mask_size_filter(t.instance_runs, ["image_id", "mask_id"], 1000).select("image_id", "mask_id")
    labels = rank_within(sized, "image_id", "mask_id").select("image_id", "mask_id", (F.col("rank0") + 1).alias("value"))
    painted = M.paint_packets(M.labelled_packets(t.instance_runs, labels), "value")
    scores = labels.join(t.detections.select("image_id", F.col("det_id").alias("mask_id"), "score"), ["image_id", "mask_id"])
    visible = painted.groupBy("image_id", "value").agg(F.sum(M.length()).alias("pixels"))
    return visible.join(scores, ["image_id", "value"]).select("image_id", "value", "pixels", "score")


OVERLAPS = """(SELECT a.image_id, a.mask_id AS id_a, b.mask_id AS id_b, CAST(SUM(least(a.x_end, b.x_end) - greatest(a.x_start, b.x_start) + 1) AS BIGINT) AS common
  FROM {left} a JOIN {right} b ON a.image_id = b.image_id AND a.y = b.y AND greatest(a.x_start, b.x_start) <= least(a.x_end, b.x_end) {extra} GROUP BY ALL)"""
AREAS = "(SELECT mask_id, SUM(x_end - x_start + 1) AS area FROM instance_runs GROUP BY mask_id)"
METRICS = f"""(SELECT o.image_id, id_a, id_b, common, common / CAST(greatest(p.area + q.area - common, 1) AS DOUBLE) AS iou, common / CAST(greatest(least(p.area, q.area), 1) AS DOUBLE) AS smaller_coverage,
  common / CAST(greatest(q.area, 1) AS DOUBLE) AS second_coverage FROM {{overlaps}} o JOIN {AREAS} p ON p.mask_id = id_a JOIN {AREAS} q ON q.mask_id = id_b)"""


@query("mask_overlap_join", f"SELECT image_id, id_a, id_b, common, round_even(iou, 6) + 0.0 AS iou, round_even(smaller_coverage, 6) + 0.0 AS smaller_coverage, round_even(second_coverage, 6) + 0.0 AS second_coverage FROM {METRICS.format(overlaps=OVERLAPS.format(left='instance_runs', right='instance_runs', extra='AND a.mask_id < b.mask_id'))}", "instance_runs")
def _(t):
    pairs = M.mask_overlap_join(t.instance_runs)
    return pairs.select("image_id", "id_a", "id_b", "common", *(r6(F.col(c)).alias(c) for c in ("iou", "smaller_coverage", "second_coverage")))


FIRST, SECOND = "(SELECT * FROM instance_runs WHERE score >= 0.5)", "(SELECT * FROM instance_runs WHERE score < 0.5)"


def passes(t):
    """First and second pass: confident masks and the rest."""
    return t.instance_runs.filter("score >= 0.5"), t.instance_runs.filter("score < 0.5")


@query("cross_pass_anti_join", f"SELECT DISTINCT image_id, mask_id FROM {SECOND} WHERE mask_id NOT IN (SELECT id_b FROM {METRICS.format(overlaps=OVERLAPS.format(left=FIRST, right=SECOND, extra=''))} WHERE iou >= 0.45 OR smaller_coverage >= 0.75 OR second_coverage >= 0.65)", "instance_runs")
def _(t):
    return M.unrepeated(*passes(t))


@query("union_passes", f"""SELECT image_id, mask_id, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS paint_pass FROM (SELECT DISTINCT image_id, mask_id, score FROM instance_runs)""", "instance_runs")
def _(t):
    first, second = (p.select("image_id", "mask_id").distinct() for p in passes(t))
    return sets.union_passes(second, first)


@query("proposal_semi_join", f"""WITH boxes AS (SELECT * FROM detections WHERE class_id = 0 AND score > 0.8),
covered AS (SELECT DISTINCT p.image_id, p.mask_id, p.y, p.x FROM {INSTANCE_PIXELS} p JOIN boxes b ON p.image_id = b.image_id AND p.y >= b.y1 AND p.y < b.y2 AND p.x >= b.x1 AND p.x < b.x2),
inside AS (SELECT mask_id, COUNT(*) AS n FROM covered GROUP BY mask_id)
SELECT m.image_id, m.mask_id, m.area FROM {MASKS.format(runs='instance_runs')} m LEFT JOIN inside USING (mask_id)
WHERE m.image_id NOT IN (SELECT image_id FROM boxes) OR coalesce(n, 0) / CAST(m.area AS DOUBLE) >= 0.30""", "instance_runs")
def _(t):
    boxes = t.detections.filter((F.col("class_id") == 0) & (F.col("score") > 0.8))
    return M.proposal_semi_join(t.instance_runs, boxes)


@query("best_mask_per_prompt", """SELECT image_id, class_id, det_id, score FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id, class_id ORDER BY score DESC, det_id) AS r FROM detections) WHERE r = 1""", "detections")
def _(t):
    from parcelworks.operators.detections import best_per_prompt

    prompts = t.detections.select(F.struct("image_id", "class_id").alias("prompt"), "det_id", "score")
    return best_per_prompt(prompts, "prompt", "score", "det_id").select("prompt.image_id", "prompt.class_id", "det_id", "score")


@query("detection_filter", "SELECT det_id FROM detections WHERE class_id <> 2 AND (x2 - x1) * (y2 - y1) > 1500 AND score > 0.3", "detections")
def _(t):
    from parcelworks.functions.bbox import Box
    from parcelworks.operators.detections import detection_filter

    wanted = (F.col("class_id") != 2) & (Box.of().area > 1500) & (F.col("score") > 0.3)
    return detection_filter(t.detections, wanted).select("det_id")


@query("score_threshold", "SELECT det_id, score FROM detections WHERE score >= 0.5", "detections")
def _(t):
    from parcelworks.operators.detections import score_threshold

    return score_threshold(t.detections, "score", 0.5).select("det_id", "score")


@query("bbox_iou_join", """SELECT a.image_id, a.class_id, a.det_id AS id_a, b.det_id AS id_b, round_even(inter / (aa + ab - inter), 6) + 0.0 AS iou FROM (
  SELECT a.*, b.det_id AS other, (a.x2 - a.x1) * (a.y2 - a.y1) AS aa, (b.x2 - b.x1) * (b.y2 - b.y1) AS ab,
    greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0) AS inter
  FROM detections a JOIN detections b ON a.image_id = b.image_id AND a.class_id = b.class_id AND a.det_id < b.det_id) a JOIN detections b ON b.det_id = a.other WHERE inter / (aa + ab - inter) >= 0.2""", "detections")
def _(t):
    from parcelworks.operators.detections import bbox_iou_join

    pairs = bbox_iou_join(t.detections, ["image_id", "class_id"], "det_id", 0.2)
    return pairs.select("image_id", "class_id", "id_a", "id_b", r6(F.col("iou")).alias("iou"))


@query("polygons_by_area", "SELECT feature_id, area FROM (SELECT feature_id, round_even(abs(SUM(ax * ey - bx * ay)) / 2, 6) + 0.0 AS area FROM feature_edges GROUP BY feature_id) ORDER BY area DESC, feature_id", "feature_edges")
def _(t):
    from parcelworks.functions import ring as R

    return t.features.select("feature_id", r6(R.area(F.col("ring"))).alias("area")).orderBy(F.col("area").desc(), "feature_id")


@query("union_layers", """SELECT feature_id, layer_id, round_even(px0, 6) + 0.0 AS x, round_even(py0, 6) + 0.0 AS y, land_type, NULL::VARCHAR AS source_note FROM features WHERE layer_id < 12
UNION ALL SELECT feature_id, layer_id, round_even(degrees(px0 * 1000 / 6378137.0), 6) + 0.0, round_even(degrees(atan(exp(py0 * 1000 / 6378137.0))) * 2 - 90, 6) + 0.0, NULL, 'second' FROM features WHERE layer_id >= 12""", "features")
def _(t):
    first = t.features.filter("layer_id < 12").select("feature_id", "layer_id", "land_type", "ring")
    metres = F.transform("ring", lambda p: F.struct((p["x"] * 1000).alias("x"), (p["y"] * 1000).alias("y")))
    second = t.features.filter("layer_id >= 12").select("feature_id", "layer_id", metres.alias("ring"), F.lit("second").alias("source_note"))
    merged = sets.union_layers([(first, "EPSG:4326"), (second, "EPSG:3857")])
    corner = F.get("ring", F.lit(0))
    return merged.select("feature_id", "layer_id", r6(corner["x"]).alias("x"), r6(corner["y"]).alias("y"), "land_type", "source_note")


@query("union_sources", "SELECT CAST(sample_id AS VARCHAR) AS sample_id, fg_ratio, 'official' AS source FROM samples UNION ALL SELECT concat('patch_', CAST(patch_id AS VARCHAR)), CAST(n_interior AS DOUBLE) / 1000, 'local' FROM patches", "samples patches")
def _(t):
    local = t.patches.select(F.concat(F.lit("patch_"), F.col("patch_id").cast("string")).alias("sample_id"), (F.col("n_interior") / 1000.0).alias("fg_ratio"))
    official = t.samples.select(F.col("sample_id").cast("string").alias("sample_id"), "fg_ratio")
    return sets.union_sources({"official": official, "local": local})
