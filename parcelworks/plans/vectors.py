"""Spatial join, burning, tracing and polygon layer queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelworks.functions import grid as GR, ring as R
from parcelworks.functions.numbers import r6
from parcelworks.operators import components as C, masks as M, tiling, vector as V
from parcelworks.plans.raster import grid_sql, snapped
from parcelworks.plans.registry import query
from parcelworks.plans.regions import interior, sizes

MAPPED = "(SELECT feature_id, k, 100 + 64 * layer_id + ax * 0.5 AS ax, 40 + layer_id - ay * 0.5 AS ay, 100 + 64 * layer_id + bx * 0.5 AS bx, 40 + layer_id - ey * 0.5 AS ey FROM feature_edges JOIN (SELECT feature_id, layer_id FROM features) USING (feature_id))"
IMAGE_BOX = "(SELECT image_id, image_name, c AS x1, f - 0.5 * height AS y1, c + 0.5 * width AS x2, f AS y2 FROM images)"


def meeting(edges, boxes, box_key):
    """Ring/box pairs: an edge meets the box or the ring holds its corner."""
    return f"""(SELECT feature_id, {box_key} FROM (
  SELECT feature_id, {box_key}, SUM(CASE WHEN (ay <= y1) <> (ey <= y1) AND x1 < ax + (y1 - ay) * (bx - ax) / (CASE WHEN ey = ay THEN 1 ELSE ey - ay END) THEN 1 ELSE 0 END) AS crossings,
    BOOL_OR(least(ax, bx) <= x2 AND greatest(ax, bx) >= x1 AND least(ay, ey) <= y2 AND greatest(ay, ey) >= y1
      AND least(s1, s2, s3, s4) <= 0 AND greatest(s1, s2, s3, s4) >= 0) AS touched FROM (
    SELECT *, (bx - ax) * (y1 - ay) - (ey - ay) * (x1 - ax) AS s1, (bx - ax) * (y1 - ay) - (ey - ay) * (x2 - ax) AS s2, (bx - ax) * (y2 - ay) - (ey - ay) * (x2 - ax) AS s3, (bx - ax) * (y2 - ay) - (ey - ay) * (x1 - ax) AS s4
    FROM {edges} e JOIN {boxes} b ON TRUE) GROUP BY feature_id, {box_key}) WHERE touched OR crossings % 2 = 1)"""


def mapped(t):
    """Features in map units of their layer's images."""
    x, y = 100 + 64 * F.col("layer_id"), 40 + F.col("layer_id")
    return t.features.withColumn("ring", F.transform("ring", lambda p: F.struct((x + p["x"] * 0.5).alias("x"), (y - p["y"] * 0.5).alias("y"))))


@query("label_image_join", f"SELECT feature_id, image_id FROM {meeting(MAPPED, IMAGE_BOX, 'image_id')}", "feature_edges features images")
def _(t):
    return V.folded_ring_box_join(mapped(t), V.image_boxes(t.images), "image_id", 64.0)


@query("overlap_report", f"""SELECT image_id, image_name, coalesce(n, 0) AS overlap_polygon_count, coalesce(n, 0) > 0 AS has_overlap FROM images
LEFT JOIN (SELECT image_id, COUNT(*) AS n FROM {meeting(MAPPED, IMAGE_BOX, 'image_id')} GROUP BY image_id) USING (image_id)""", "feature_edges features images")
def _(t):
    return V.overlap_report(t.images, mapped(t).drop("image_id"), 64.0)


TILE_BOX = f"(SELECT concat(CAST(image_id AS VARCHAR), '/', CAST(x0 AS VARCHAR), '/', CAST(y0 AS VARCHAR)) AS tile, c + 0.5 * x0 AS x1, f - 0.5 * (y0 + th) AS y1, c + 0.5 * (x0 + tw) AS x2, f - 0.5 * y0 AS y2 FROM ({grid_sql(snapped('width', 64, 64), snapped('height', 64, 64), 'image_id, c, f, x0, y0, least(64, width - x0) AS tw, least(64, height - y0) AS th')}))"


@query("tile_label_join", f"SELECT feature_id, tile FROM {meeting(MAPPED, TILE_BOX, 'tile')}", "feature_edges features images")
def _(t):
    tiles = tiling.with_footprint(tiling.tile_grid(t.images, 64, 0))
    name = F.concat_ws("/", F.col("image_id").cast("string"), F.col("x0").cast("string"), F.col("y0").cast("string"))
    boxes = tiles.select(name.alias("tile"), F.col("west").alias("x1"), F.col("south").alias("y1"), F.col("east").alias("x2"), F.col("north").alias("y2"))
    return V.folded_ring_box_join(mapped(t), boxes, "tile", 32.0)


def drawn(t):
    """Features in pixel units beside the size of their image."""
    return t.features.select("feature_id", "image_id", "ring").join(sizes(t), "image_id")


INSIDE = """(SELECT feature_id, image_id, y, x FROM (
  SELECT p.feature_id, p.image_id, p.y, p.x, COUNT(*) FILTER (WHERE (ay <= p.y + 0.5) <> (ey <= p.y + 0.5) AND p.x + 0.5 < ax + (p.y + 0.5 - ay) * (bx - ax) / (CASE WHEN ey = ay THEN 1 ELSE ey - ay END)) AS crossings FROM (
    SELECT *, CAST(unnest(range(lx, hx + 1)) AS INT) AS x FROM (SELECT *, CAST(unnest(range(ly, hy + 1)) AS INT) AS y FROM (
      SELECT e.feature_id, e.image_id, greatest(CAST(floor(MIN(ax)) AS BIGINT), 0) AS lx, least(CAST(floor(MAX(ax)) AS BIGINT), MAX(i.width) - 1) AS hx, greatest(CAST(floor(MIN(ay)) AS BIGINT), 0) AS ly, least(CAST(floor(MAX(ay)) AS BIGINT), MAX(i.height) - 1) AS hy
      FROM feature_edges e JOIN images i ON e.image_id = i.image_id GROUP BY 1, 2))) p JOIN feature_edges e ON p.feature_id = e.feature_id GROUP BY ALL) WHERE crossings % 2 = 1)"""


@query("rasterize_binary", f"SELECT feature_id, y, MIN(x) AS x_start, MAX(x) AS x_end FROM {INSIDE} GROUP BY feature_id, y", "feature_edges images")
def _(t):
    return V.rasterize_binary(drawn(t), ["feature_id"]).select("feature_id", "y", "x_start", "x_end")


BAND = """(SELECT DISTINCT image_id, y, x FROM (
  SELECT *, least(ax, bx) <= x + 1 AND greatest(ax, bx) >= x AND least(ay, ey) <= y + 1 AND greatest(ay, ey) >= y AND least(s1, s2, s3, s4) <= 0 AND greatest(s1, s2, s3, s4) >= 0 AS meets FROM (
  SELECT *, bx - ax AS dx, ey - ay AS dy, (bx - ax) * (y - ay) - (ey - ay) * (x - ax) AS s1, (bx - ax) * (y - ay) - (ey - ay) * (x + 1 - ax) AS s2, (bx - ax) * (y + 1 - ay) - (ey - ay) * (x - ax) AS s3, (bx - ax) * (y + 1 - ay) - (ey - ay) * (x + 1 - ax) AS s4 FROM (
    SELECT *, CAST(unnest(range(greatest(CAST(floor(least(ax, bx)) AS BIGINT) - 2, 0), least(CAST(floor(greatest(ax, bx)) AS BIGINT) + 3, width))) AS INT) AS x FROM (
      SELECT e.*, i.width, CAST(unnest(range(greatest(CAST(floor(least(ay, ey)) AS BIGINT) - 2, 0), least(CAST(floor(greatest(ay, ey)) AS BIGINT) + 3, i.height))) AS INT) AS y FROM feature_edges e JOIN images i ON e.image_id = i.image_id))))
  WHERE meets OR least(CORNER(x, y), CORNER(x + 1, y), CORNER(x, y + 1), CORNER(x + 1, y + 1), END(ax, ay), END(bx, ey)) <= 1.0)"""


def _expand(text):
    import re

    t = "greatest(least((({0} - ax) * dx + ({1} - ay) * dy) / (dx * dx + dy * dy), 1), 0)"
    corner = lambda m: f"sqrt(power({m[1]} - ax - {t.format(m[1], m[2])} * dx, 2) + power({m[2]} - ay - {t.format(m[1], m[2])} * dy, 2))"
    text = re.sub(r"CORNER\(([^,]+), ([^)]+)\)", corner, text)
    return re.sub(r"END\(([^,]+), ([^)]+)\)", lambda m: f"sqrt(power(greatest(x - {m[1]}, {m[1]} - x - 1, 0), 2) + power(greatest(y - {m[2]}, {m[2]} - y - 1, 0), 2))", text)


@query("rasterize_field_boundary", f"""SELECT image_id, y, COUNT(*) FILTER (WHERE cls = 1) AS interior, COUNT(*) FILTER (WHERE cls = 2) AS boundary FROM (
  SELECT image_id, y, x, MAX(cls) AS cls FROM (SELECT image_id, y, x, 1 AS cls FROM {INSIDE} UNION ALL SELECT image_id, y, x, 2 FROM {_expand(BAND)}) GROUP BY ALL) GROUP BY image_id, y""", "feature_edges images")
def _(t):
    burned = V.rasterize_field_boundary(drawn(t), 1.0)
    size = lambda c: F.coalesce(F.sum(F.when(F.col("cls") == c, M.length())), F.lit(0)).cast("bigint")
    return burned.groupBy("image_id", "y").agg(size(1).alias("interior"), size(2).alias("boundary"))


@query("topology_resolve", f"SELECT feature_id, COUNT(*) AS pixels FROM (SELECT image_id, y, x, MIN(feature_id) AS feature_id FROM {INSIDE} GROUP BY ALL) GROUP BY feature_id", "feature_edges images")
def _(t):
    owned = V.topology_resolve(V.rasterize_binary(drawn(t), ["image_id", "feature_id"]), "feature_id")
    return owned.groupBy("feature_id").agg(F.sum(M.length()).alias("pixels"))


@query("crown_coverage_filter", f"""SELECT image_id, ty, tx, round_even(share, 6) + 0.0 AS coverage FROM (
  SELECT p.image_id, CAST(y // 20 AS BIGINT) AS ty, CAST(x // 20 AS BIGINT) AS tx, COUNT(*) / CAST(MAX(least(20, width - x // 20 * 20) * least(20, height - y // 20 * 20)) AS DOUBLE) AS share
  FROM (SELECT DISTINCT image_id, y, x FROM {INSIDE}) p JOIN images i ON p.image_id = i.image_id GROUP BY 1, 2, 3) WHERE share >= 0.6""", "feature_edges images")
def _(t):
    burned = V.rasterize_binary(drawn(t), ["image_id"])
    return V.crown_coverage_filter(burned, t.images, 20).select("image_id", "ty", "tx", r6(F.col("coverage")).alias("coverage"))


RECT = """(SELECT feature_id, MIN(area) AS rect_area FROM (
  SELECT feature_id, k, round((MAX(px * ux + py * uy) - MIN(px * ux + py * uy)) * (MAX(py * ux - px * uy) - MIN(py * ux - px * uy)), 9) AS area FROM (
    SELECT e.feature_id, e.k, q.ax AS px, q.ay AS py, (e.bx - e.ax) / sqrt(power(e.bx - e.ax, 2) + power(e.ey - e.ay, 2)) AS ux, (e.ey - e.ay) / sqrt(power(e.bx - e.ax, 2) + power(e.ey - e.ay, 2)) AS uy
    FROM feature_edges e JOIN feature_edges q ON e.feature_id = q.feature_id) GROUP BY feature_id, k) GROUP BY feature_id)"""
RING_AREA = "(SELECT feature_id, abs(SUM(ax * ey - bx * ay)) / 2 AS area FROM feature_edges GROUP BY feature_id)"


@query("min_rect_layer", f"SELECT feature_id, round_even(rect_area, 5) + 0.0 AS rect_area, round_even(rect_area, 5) + 0.0 AS ring_area FROM {RECT}", "feature_edges")
def _(t):
    rects = V.min_rect_layer(t.features.select("feature_id", "ring"))
    five = lambda c: F.bround(c, 5) + 0.0
    return rects.select("feature_id", five(F.col("rect_area")).alias("rect_area"), five(R.area(F.col("ring"))).alias("ring_area"))


@query("rect_snap_layer", f"""SELECT feature_id, rect_area / area - 1 < CASE WHEN rect_area < 100 THEN 0.25 WHEN rect_area < 300 THEN 0.2 WHEN rect_area < 500 THEN 0.15 WHEN rect_area < 2000 THEN 0.1 WHEN rect_area < 5000 THEN 0.05 ELSE 0.02 END AS snapped
FROM {RECT} JOIN {RING_AREA} USING (feature_id)""", "feature_edges")
def _(t):
    return V.rect_snap_layer(t.features.select("feature_id", "ring")).select("feature_id", "snapped")


@query("simplify_layer")
def _(t):
    dense = F.flatten(F.transform(R.edges(F.col("ring")), lambda g: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.struct((g["ax"] + (g["bx"] - g["ax"]) * i / 8.0).alias("x"), (g["ay"] + (g["by"] - g["ay"]) * i / 8.0).alias("y")))))
    layer = t.features.select("feature_id", F.concat(dense, F.slice("ring", 1, 1)).alias("ring"))
    short = V.simplify_layer(layer, F.lit(0.01))
    return short.select("feature_id", F.size("ring").alias("points"), r6(R.area(F.col("ring"))).alias("area"))


@query("vectorize")
def _(t):
    labelled = C.connected_components(t.mask_runs, 4, "cls")
    rings = V.vectorize(labelled)
    values = labelled.groupBy("image_id", "region").agg(F.first("cls").alias("value"))
    signed = r6(R.signed_area(F.col("ring")))
    return rings.join(values, ["image_id", "region"]).select("image_id", "region", "value", "ring_index", F.size("ring").alias("points"), signed.alias("signed_area"))


@query("polygonize_mask")
def _(t):
    return V.polygonize_mask(C.connected_components(interior(t), 8), sizes(t), 40)


@query("field_polygons")
def _(t):
    """Interior regions parted by the boundary class, small ones removed, as simplified polygons."""
    fields = C.size_filter(C.connected_components(interior(t), 4), 40)
    polygons = V.outer_polygons(fields, 40)
    return polygons.select("image_id", "region", F.size("ring").alias("points"), r6(R.area(F.col("ring"))).alias("area"))
