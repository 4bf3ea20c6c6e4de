"""Box, ring, affine, projection and text-format queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelworks.functions import affine, bbox as B, paths as P, projection as PJ, ring as R
from parcelworks.functions.bbox import Box
from parcelworks.functions.numbers import half_even, r6
from parcelworks.operators import annotations as A
from parcelworks.plans.registry import query

#: Ids in one text document of a layer or image, as in the SQL; a larger one continues in the next part.
PART = 50000


# ---- boxes --------------------------------------------------------------------------

BOX = Box.of()


@query("bbox_area", "SELECT det_id, greatest(x2 - x1, 0) * greatest(y2 - y1, 0) AS area FROM detections", "detections")
def _(t):
    return t.detections.select("det_id", BOX.area.alias("area"))


@query("bbox_diagonal", "SELECT det_id, round_even(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 6) + 0.0 AS diagonal FROM detections", "detections")
def _(t):
    return t.detections.select("det_id", r6(BOX.diagonal).alias("diagonal"))


def chained(t):
    """Every detection beside the one with the next id."""
    left = t.detections.select(*(F.col(c).alias(f"a_{c}") for c in ("det_id", "x1", "y1", "x2", "y2")))
    right = t.detections.select(*(F.col(c).alias(f"b_{c}") for c in ("det_id", "x1", "y1", "x2", "y2")))
    return left.join(right, F.col("a_det_id") + 1 == F.col("b_det_id"))


CHAINED = "(SELECT a.det_id, a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2 FROM detections a JOIN detections b ON a.det_id + 1 = b.det_id)"
LEFT, RIGHT = Box.of("a_"), Box.of("b_")


@query("bbox_union", f"SELECT det_id, least(ax1, bx1) AS x1, least(ay1, by1) AS y1, greatest(ax2, bx2) AS x2, greatest(ay2, by2) AS y2 FROM {CHAINED}", "detections")
def _(t):
    return chained(t).select(F.col("a_det_id").alias("det_id"), *B.union(LEFT, RIGHT).columns())


@query("bbox_gap", f"SELECT det_id, greatest(greatest(bx1 - ax2, ax1 - bx2, 0), greatest(by1 - ay2, ay1 - by2, 0)) AS gap FROM {CHAINED}", "detections")
def _(t):
    return chained(t).select(F.col("a_det_id").alias("det_id"), B.gap(LEFT, RIGHT).alias("gap"))


@query("bbox_containment", f"""SELECT det_id, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0)
  / least(greatest((ax2 - ax1) * (ay2 - ay1), 1), greatest((bx2 - bx1) * (by2 - by1), 1)) AS containment FROM {CHAINED}""", "detections")
def _(t):
    return chained(t).select(F.col("a_det_id").alias("det_id"), B.containment(LEFT, RIGHT).alias("containment"))


@query("bbox_pad", """SELECT det_id, greatest(x1 - p, 0) AS x1, greatest(y1 - p, 0) AS y1, least(x2 + p, 256) AS x2, least(y2 + p, 256) AS y2 FROM (
  SELECT *, greatest(8.0, round_even(CAST(greatest(x2 - x1, y2 - y1, 1) * 0.08 AS DOUBLE), 0)) AS p FROM detections)""", "detections")
def _(t):
    padded = B.pad(BOX, F.lit(256.0), F.lit(256.0), B.pad_amount(BOX, 0.08, 8))
    return t.detections.select("det_id", *padded.columns())


@query("bbox_center_distance", f"""SELECT det_id, round_even(sqrt(power((ax1 + ax2 - bx1 - bx2) / 2, 2) + power((ay1 + ay2 - by1 - by2) / 2, 2)), 6) + 0.0 AS distance,
  round_even(least(sqrt(power((ax1 + ax2) / 2 - 128, 2) + power((ay1 + ay2) / 2 - 128, 2)) / sqrt(32768.0), 1), 6) + 0.0 AS from_center FROM {CHAINED}""", "detections")
def _(t):
    return chained(t).select(
        F.col("a_det_id").alias("det_id"),
        r6(B.center_distance(LEFT, RIGHT)).alias("distance"),
        r6(B.image_center_distance(LEFT, 256, 256)).alias("from_center"),
    )


@query("xyxy_to_cxcywh", """SELECT det_id, (x1 + greatest(x2 - x1, 1) / 2) / 256 AS cx, (y1 + greatest(y2 - y1, 1) / 2) / 256 AS cy,
  greatest(x2 - x1, 1) / 256 AS w, greatest(y2 - y1, 1) / 256 AS h FROM detections""", "detections")
def _(t):
    form = B.normalized_center_form(BOX, F.lit(256), F.lit(256))
    return t.detections.select("det_id", *(c.alias(n) for n, c in form.items()))


@query("prompt_size_filter", """SELECT det_id, cascade_ok FROM (SELECT det_id,
    (x2 - x1) * (y2 - y1) / 65536.0 AS ar, least(x2 - x1, y2 - y1) / 256.0 AS ss, (x2 - x1) * (y2 - y1) / 65536.0 >= 0.05 AS cascade_ok FROM detections)
WHERE ar BETWEEN 0.005 AND 0.55 AND ss >= 0.15""", "detections")
def _(t):
    from parcelworks.operators.detections import prompt_size_filter, prompt_sized

    kept = prompt_size_filter(t.detections, 256, 256, min_side=0.15)
    return kept.select("det_id", prompt_sized(BOX, 256, 256, min_area=0.05, min_side=0.015, max_area=None).alias("cascade_ok"))


PROPOSAL_SCORE = """SELECT det_id, image_id, score, round_even(0.60 * (1.0 - dist) * (0.35 + 0.65 * sized) + 0.30 * sized + 0.10 * least(greatest(score, 0), 1), 6) + 0.0 AS rank_score FROM (
  SELECT *, CASE WHEN ar < 0.08 THEN ar / 0.08 WHEN ar <= 0.20 THEN 1.0 ELSE greatest(0.0, 1.0 - (ar - 0.20) / 0.35) END AS sized,
    least(sqrt(power((x1 + x2) / 2 - 128, 2) + power((y1 + y2) / 2 - 128, 2)) / sqrt(32768.0), 1) AS dist FROM (
      SELECT *, least((x2 - x1) * (y2 - y1) / 65536.0, 1.0) AS ar FROM detections))"""


@query("proposal_rank", f"SELECT det_id, rank_score FROM ({PROPOSAL_SCORE}) ORDER BY rank_score DESC, det_id LIMIT 200", "detections")
def _(t):
    scored = t.detections.select("det_id", r6(B.proposal_score(BOX, F.lit(256), F.lit(256), F.col("score"))).alias("rank_score"))
    return scored.orderBy(F.col("rank_score").desc(), "det_id").limit(200)


@query("region_counts", """SELECT image_id, CASE WHEN d <= 0.30 THEN 'center' WHEN d <= 0.60 THEN 'transition' ELSE 'outer' END AS region, COUNT(*) AS n FROM (
  SELECT image_id, least(sqrt(power((x1 + x2) / 2 - 128, 2) + power((y1 + y2) / 2 - 128, 2)) / sqrt(32768.0), 1) AS d FROM detections) GROUP BY 1, 2""", "detections")
def _(t):
    distance = B.image_center_distance(BOX, 256, 256)
    region = F.when(distance <= 0.30, "center").when(distance <= 0.60, "transition").otherwise("outer")
    return t.detections.groupBy("image_id", region.alias("region")).agg(F.count("*").alias("n"))


@query("boxes_to_polygon", """SELECT det_id, concat('[[', CAST(gx1 AS VARCHAR), ',', CAST(gy1 AS VARCHAR), '],[', CAST(gx2 AS VARCHAR), ',', CAST(gy1 AS VARCHAR), '],[',
  CAST(gx2 AS VARCHAR), ',', CAST(gy2 AS VARCHAR), '],[', CAST(gx1 AS VARCHAR), ',', CAST(gy2 AS VARCHAR), '],[', CAST(gx1 AS VARCHAR), ',', CAST(gy1 AS VARCHAR), ']]') AS ring FROM (
  SELECT det_id, c + 0.5 * (x1 + 0.5) AS gx1, f - 0.5 * (y2 + 0.5) AS gy1, c + 0.5 * (x2 + 0.5) AS gx2, f - 0.5 * (y1 + 0.5) AS gy2
  FROM detections d JOIN images i ON d.image_id // 15 = i.image_id)""", "detections images")
def _(t):
    ring = A.box_ring(affine.box_to_map(BOX))
    text = F.to_json(F.transform(ring, lambda p: F.array(p["x"], p["y"])))
    return located(t).select("det_id", text.alias("ring"))


# ---- affine and projections ---------------------------------------------------------

def located(t):
    """Detections with the transform of the image they fall in."""
    owner = F.floor(F.col("image_id") / 15)
    images = t.images.select(F.col("image_id").alias("owner"), "image_name", "width", "height", *affine.COEFFICIENTS)
    return t.detections.withColumn("owner", owner).join(images, "owner")


LOCATED = "(SELECT d.*, i.image_id AS owner, i.image_name, i.width, i.height, i.a, i.b, i.c, i.d, i.e, i.f FROM detections d JOIN images i ON d.image_id // 15 = i.image_id)"


@query("affine_forward", f"SELECT det_id, a * (x1 + 0.5) + b * (y1 + 0.5) + c AS px, d * (x1 + 0.5) + e * (y1 + 0.5) + f AS py, a * (x1 + 0.5) + b * (y1 + 0.5) + c AS x1, d * (x2 + 0.5) + e * (y2 + 0.5) + f AS y1, a * (x2 + 0.5) + b * (y2 + 0.5) + c AS x2, d * (x1 + 0.5) + e * (y1 + 0.5) + f AS y2 FROM {LOCATED}", "detections images")
def _(t):
    px, py = affine.forward(F.col("x1"), F.col("y1"), 0.5)
    return located(t).select("det_id", px.alias("px"), py.alias("py"), *affine.box_to_map(BOX).columns())


@query("affine_inverse", f"""SELECT det_id, CAST(floor((e * (mx - c) - b * (my - f)) / (a * e - b * d)) AS INT) AS col, CAST(floor((a * (my - f) - d * (mx - c)) / (a * e - b * d)) AS INT) AS row
FROM (SELECT *, c + x1 / 3 AS mx, f - y1 / 3 AS my FROM {LOCATED})""", "detections images")
def _(t):
    col, row = affine.inverse(F.col("c") + F.col("x1") / 3, F.col("f") - F.col("y1") / 3)
    return located(t).select("det_id", col.alias("col"), row.alias("row"))


@query("bbox_to_pixel", f"""SELECT det_id, CAST(floor(x1 * 0.25 / 0.5) AS INT) AS x1, CAST(floor(y1 * 0.25 / 0.5) AS INT) AS y1, CAST(floor(x2 * 0.25 / 0.5) AS INT) AS x2, CAST(floor(y2 * 0.25 / 0.5) AS INT) AS y2
FROM {LOCATED}""", "detections images")
def _(t):
    on_map = Box(F.col("c") + F.col("x1") * 0.25, F.col("f") - F.col("y2") * 0.25, F.col("c") + F.col("x2") * 0.25, F.col("f") - F.col("y1") * 0.25)
    return located(t).select("det_id", *affine.box_to_pixel(on_map).columns())


@query("in_bounds_filter", f"SELECT det_id, (x1 >= 0 AND y1 >= 0 AND x2 < width AND y2 < height) AS inside FROM {LOCATED}", "detections images")
def _(t):
    return located(t).select("det_id", affine.inside(BOX, F.col("width"), F.col("height")).alias("inside"))


def points(t):
    key = F.col("c_custkey")
    return t.raw("customer").select(
        key.alias("point_id"),
        ((key * 7919) % 35999 / 100.0 - 179.99).alias("lon"),
        ((key * 104729) % 15999 / 100.0 - 79.99).alias("lat"),
    )


POINTS = "(SELECT c_custkey AS point_id, (c_custkey * 7919) % 35999 / 100.0 - 179.99 AS lon, (c_custkey * 104729) % 15999 / 100.0 - 79.99 AS lat FROM customer)"
RADIUS = PJ.EQUATOR_RADIUS


@query("mercator", f"SELECT point_id, round_even(radians(lon) * {RADIUS}, 3) + 0.0 AS x, round_even(ln(tan(radians(45 + lat / 2.0))) * {RADIUS}, 3) + 0.0 AS y FROM {POINTS}")
def _(t):
    x, y = PJ.mercator_forward(F.col("lon"), F.col("lat"))
    return points(t).select("point_id", (half_even(x, 3) + 0.0).alias("x"), (half_even(y, 3) + 0.0).alias("y"))


SLIPPY = f"(SELECT point_id, (lon + 180) / 360 * 4096 AS fx, (1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096 AS fy, (lon + 180.25) / 360 * 4096 AS gx, (1 - ln(tan(radians(lat - 0.25)) + 1 / cos(radians(lat - 0.25))) / pi()) / 2 * 4096 AS gy FROM {POINTS})"


@query("slippy_tile", f"""SELECT point_id, CAST(tx AS BIGINT) AS tile_x, CAST(unnest(range(CAST(floor(fy) AS BIGINT), CAST(ceil(gy) AS BIGINT))) AS BIGINT) AS tile_y FROM (
  SELECT *, unnest(range(CAST(floor(fx) AS BIGINT), CAST(ceil(gx) AS BIGINT))) AS tx FROM {SLIPPY})""")
def _(t):
    from parcelworks.operators.tiling import tiles_covering

    boxes = points(t).select("point_id", F.col("lon").alias("west"), (F.col("lat") - 0.25).alias("south"), (F.col("lon") + 0.25).alias("east"), F.col("lat").alias("north"))
    return tiles_covering(boxes, 12).select("point_id", "tile_x", "tile_y")


@query("zoom_for_resolution", "SELECT det_id, CAST(trunc(log2(156543.03392804097 / (x2 - x1))) AS INT) AS zoom FROM detections", "detections")
def _(t):
    return t.detections.select("det_id", PJ.zoom_for_resolution(F.col("x2") - F.col("x1")).alias("zoom"))


@query("tile_url", f"SELECT point_id, concat('https://tiles.example/12/', CAST(CAST(floor(fx) AS BIGINT) AS VARCHAR), '/', CAST(CAST(floor(fy) AS BIGINT) AS VARCHAR), '.png') AS url FROM {SLIPPY}")
def _(t):
    x, y = PJ.slippy_tile(F.col("lon"), F.col("lat"), 12)
    url = PJ.tile_url("https://tiles.example/{z}/{x}/{y}.png", F.lit(12), F.floor(x), F.floor(y))
    return points(t).select("point_id", url.alias("url"))


def _series(kind):
    alpha, beta, delta = PJ._ALPHA, PJ._BETA, PJ._DELTA
    if kind == "forward":
        east = "eta" + "".join(f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
        north = "xi" + "".join(f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
        return east, north
    xi0 = "xi" + "".join(f" - {b!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, b in enumerate(beta, 1))
    eta0 = "eta" + "".join(f" - {b!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, b in enumerate(beta, 1))
    phi = "chi" + "".join(f" + {d!r} * sin({2 * j} * chi)" for j, d in enumerate(delta, 1))
    return xi0, eta0, phi


EAST, NORTH = _series("forward")
SCALE = repr(PJ.UTM_SCALE * PJ._RECTIFYING)
UTM = f"""(SELECT point_id, zone, lat < 0 AS south, ({EAST}) * {SCALE} + 500000.0 AS x, CASE WHEN ({NORTH}) < 0 THEN ({NORTH}) * {SCALE} + 10000000.0 ELSE ({NORTH}) * {SCALE} END AS y FROM (
  SELECT *, atan2(t, cos(away)) AS xi, atanh(sin(away) / sqrt(1 + t * t)) AS eta FROM (
    SELECT *, sinh(atanh(sin(radians(lat))) - {PJ._CONFORMAL!r} * atanh({PJ._CONFORMAL!r} * sin(radians(lat)))) AS t, radians(lon) - radians(zone * 6.0 - 183.0) AS away FROM (
      SELECT *, CAST(least(greatest(floor((lon + 180) / 6) + 1, 1), 60) AS INT) AS zone FROM {POINTS}))))"""


@query("utm_forward", f"SELECT point_id, zone, round_even(x, 3) + 0.0 AS x, round_even(y, 3) + 0.0 AS y FROM {UTM}")
def _(t):
    zone = PJ.utm_zone(F.col("lon"))
    x, y = PJ.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    return points(t).withColumn("zone", zone).select("point_id", "zone", (half_even(x, 3) + 0.0).alias("x"), (half_even(y, 3) + 0.0).alias("y"))


XI0, ETA0, PHI = _series("inverse")


@query("utm_inverse", f"""SELECT point_id, round_even(degrees(radians(zone * 6.0 - 183.0) + atan2(sinh(eta0), cos(xi0))), 6) + 0.0 AS lon, round_even(degrees({PHI}), 6) + 0.0 AS lat FROM (
  SELECT *, asin(sin(xi0) / cosh(eta0)) AS chi FROM (SELECT *, {XI0} AS xi0, {ETA0} AS eta0 FROM (
    SELECT *, (CASE WHEN south THEN y - 10000000.0 ELSE y END) / {SCALE} AS xi, (x - 500000.0) / {SCALE} AS eta FROM {UTM})))""")
def _(t):
    zone = PJ.utm_zone(F.col("lon"))
    x, y = PJ.utm_forward(F.col("lon"), F.col("lat"), F.col("zone"))
    projected = points(t).withColumn("zone", zone).select("point_id", "zone", (F.col("lat") < 0).alias("south"), x.alias("x"), y.alias("y"))
    lon, lat = PJ.utm_inverse(F.col("x"), F.col("y"), F.col("zone"), F.col("south"))
    return projected.select("point_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


@query("crs_transform", f"""SELECT point_id, round_even(degrees(mx / {RADIUS}), 6) + 0.0 AS lon, round_even(degrees(atan(exp(my / {RADIUS}))) * 2 - 90, 6) + 0.0 AS lat FROM (
  SELECT point_id, lon * 100000 AS mx, lat * 100000 AS my FROM {POINTS})""")
def _(t):
    lon, lat = PJ.crs_transform("EPSG:3857", "EPSG:4326", F.col("lon") * 100000, F.col("lat") * 100000)
    return points(t).select("point_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


# ---- rings --------------------------------------------------------------------------

RING = "ring"
MEASURED = """(SELECT feature_id, abs(SUM(ax * ey - bx * ay)) / 2 AS area, SUM(sqrt((bx - ax) * (bx - ax) + (ey - ay) * (ey - ay))) AS perimeter,
  SUM((ax + bx) * (ax * ey - bx * ay)) / (3 * SUM(ax * ey - bx * ay)) AS cx, SUM((ay + ey) * (ax * ey - bx * ay)) / (3 * SUM(ax * ey - bx * ay)) AS cy,
  MIN(ax) AS xmin, MIN(ay) AS ymin, MAX(ax) AS xmax, MAX(ay) AS ymax FROM feature_edges GROUP BY feature_id)"""


@query("ring_measures", f"SELECT feature_id, round_even(area, 6) + 0.0 AS area, round_even(perimeter, 6) + 0.0 AS perimeter, round_even(cx, 6) + 0.0 AS cx, round_even(cy, 6) + 0.0 AS cy, xmin, ymin, xmax, ymax FROM {MEASURED}", "feature_edges")
def _(t):
    cx, cy = R.centroid(RING)
    return t.features.select(
        "feature_id", r6(R.area(RING)).alias("area"), r6(R.perimeter(RING)).alias("perimeter"), r6(cx).alias("cx"), r6(cy).alias("cy"),
        *(c.alias(n) for n, c in R.bounds(RING).items()),
    )


@query("feature_area_filter", f"SELECT feature_id, round_even(area, 6) + 0.0 AS area FROM {MEASURED} WHERE area >= 200", "feature_edges")
def _(t):
    return t.features.withColumn("area", R.area(RING)).filter(F.col("area") >= 200).select("feature_id", r6(F.col("area")).alias("area"))


@query("feature_attribute_filter", "SELECT feature_id, land_type FROM features WHERE land_type IN ('BUILDING', 'MACHINERY')", "features")
def _(t):
    from parcelworks.operators.vector import attribute_filter

    return attribute_filter(t.features, F.col("land_type"), ["BUILDING", "MACHINERY"]).select("feature_id", "land_type")


@query("scale_points", """SELECT feature_id, concat('[', CAST(CAST(round_even(px0 * 1.5, 0) AS INT) AS VARCHAR), ',', CAST(CAST(round_even(py2 * 0.75, 0) AS INT) AS VARCHAR), ']') AS corner,
  CAST(round_even(px2 * 1.5, 0) AS INT) AS x2 FROM features""", "features")
def _(t):
    scaled = R.scale_points(RING, F.lit(1.5), F.lit(0.75))
    corner = F.to_json(F.array(F.get(scaled, F.lit(0))["x"], F.get(scaled, F.lit(2))["y"]))
    return t.features.select("feature_id", corner.alias("corner"), F.get(scaled, F.lit(2))["x"].alias("x2"))


@query("rotate_local", """SELECT feature_id, 0 AS point, round_even((px1 - 40) * cos(radians(30.0)) + (py1 - 30) * sin(radians(30.0)), 6) + 0.0 AS x, round_even((py1 - 30) * cos(radians(30.0)) - (px1 - 40) * sin(radians(30.0)), 6) + 0.0 AS y FROM features
UNION ALL SELECT feature_id, 1, round_even(px1, 6) + 0.0, round_even(py1, 6) + 0.0 FROM features""", "features")
def _(t):
    turned = R.rotate_local(RING, F.lit(40.0), F.lit(30.0), F.lit(30.0))
    back = R.rotate_local(F.col("turned"), F.lit(40.0), F.lit(30.0), F.lit(30.0), back=True)
    both = t.features.withColumn("turned", turned).select("feature_id", F.posexplode(F.array(F.get("turned", F.lit(1)), F.get(back, F.lit(1)))).alias("point", "p"))
    return both.select("feature_id", "point", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@query("long_edge_angle", """SELECT feature_id, round_even(degrees(atan2(ey - ay, bx - ax)), 6) + 0.0 AS angle FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY feature_id ORDER BY (bx - ax) * (bx - ax) + (ey - ay) * (ey - ay) DESC, k) AS r FROM feature_edges) WHERE r = 1""", "feature_edges")
def _(t):
    return t.features.select("feature_id", r6(R.long_edge_angle(RING)).alias("angle"))


@query("circle_similar", f"SELECT feature_id, (2 * area / perimeter) / (perimeter / (2 * pi())) > 0.7 AS roundish, (2 * area / perimeter) / (perimeter / (2 * pi())) > 0.9 AND (2 * area / perimeter) / (perimeter / (2 * pi())) < 1.05 AS similar FROM {MEASURED}", "feature_edges")
def _(t):
    import math

    ratio = (R.area(RING) * 2.0 / R.perimeter(RING)) / (R.perimeter(RING) / (2.0 * math.pi))
    return t.features.select("feature_id", (ratio > 0.7).alias("roundish"), R.circle_similar(RING).alias("similar"))


@query("circle_layer", f"""SELECT feature_id, CAST(k AS INT) AS vertex, round_even(cx + r * cos(radians(CAST(deg AS DOUBLE))), 6) + 0.0 AS x, round_even(cy + r * sin(radians(CAST(deg AS DOUBLE))), 6) + 0.0 AS y FROM (
  SELECT feature_id, cx, cy, perimeter / (2 * pi()) AS r, unnest(range(37)) AS k, unnest(list_append(range(0, 360, 10), 0)) AS deg FROM {MEASURED})""", "feature_edges")
def _(t):
    opened = t.features.select("feature_id", F.posexplode(R.circle_ring(RING)).alias("vertex", "p"))
    return opened.select("feature_id", "vertex", r6(F.col("p.x")).alias("x"), r6(F.col("p.y")).alias("y"))


@query("dominant_direction", """SELECT feature_id, CAST(min_by(deg, w * 100000000 + deg) AS INT) AS direction FROM (
  SELECT feature_id, deg, round(SUM(least(abs(90 - ang), abs(180 - ang), abs(ang)) / 90 * len), 6) AS w FROM (
    SELECT feature_id, deg, len, degrees(acos(least(greatest(((bx - ax) * cos(radians(CAST(deg AS DOUBLE))) + (ey - ay) * sin(radians(CAST(deg AS DOUBLE)))) / len, -1.0), 1.0))) AS ang FROM (
      SELECT *, sqrt((bx - ax) * (bx - ax) + (ey - ay) * (ey - ay)) AS len, unnest(range(90)) AS deg FROM feature_edges) WHERE len > 0)
  GROUP BY feature_id, deg) GROUP BY feature_id""", "feature_edges")
def _(t):
    return t.features.select("feature_id", R.dominant_direction(RING).alias("direction"))


@query("area_control", f"""SELECT feature_id, CASE WHEN area = 0 THEN TRUE WHEN area > 1000 AND change < 0.25 THEN TRUE WHEN change >= 0.25 OR 0.8 * (feature_id % 3) > 1 THEN FALSE ELSE TRUE END AS accepted
FROM (SELECT *, abs(area - area * power(1 - (feature_id % 4) / 20.0, 2)) / area AS change FROM {MEASURED})""", "feature_edges")
def _(t):
    cx, cy = R.centroid(RING)
    factor, shift = 1 - (F.col("feature_id") % 4) / 20.0, (F.col("feature_id") % 3) * 0.8
    moved = F.transform(RING, lambda p: F.struct((F.col("cx") + (p["x"] - F.col("cx")) * factor + shift).alias("x"), (F.col("cy") + (p["y"] - F.col("cy")) * factor).alias("y")))
    layer = t.features.withColumn("cx", cx).withColumn("cy", cy).withColumn("after", moved)
    return layer.select("feature_id", R.area_control(RING, F.col("after")).alias("accepted"))


# ---- text formats -------------------------------------------------------------------

FEATURE_TEXT = """concat('{"type":"Feature","properties":{"id":', CAST(feature_id AS VARCHAR), ',"land_type":"', land_type, '"},"geometry":{"type":"Polygon","coordinates":[[[',
  CAST(px0 AS VARCHAR), ',', CAST(py0 AS VARCHAR), '],[', CAST(px1 AS VARCHAR), ',', CAST(py1 AS VARCHAR), '],[', CAST(px2 AS VARCHAR), ',', CAST(py2 AS VARCHAR), '],[',
  CAST(px3 AS VARCHAR), ',', CAST(py3 AS VARCHAR), '],[', CAST(px4 AS VARCHAR), ',', CAST(py4 AS VARCHAR), ']]]}}')"""


def feature_texts(t):
    properties = [F.col("feature_id").alias("id"), F.col("land_type")]
    return t.features.select("feature_id", "layer_id", A.polygon_feature(RING, properties).alias("feature"))


@query("geojson_features", f"""SELECT layer_id, feature_id // 50000 AS part, COUNT(*) AS num_detections,
  concat('{{"type":"FeatureCollection","features":[', string_agg({FEATURE_TEXT}, ',' ORDER BY feature_id), '],"num_detections":', CAST(COUNT(*) AS VARCHAR), ',"crs":"EPSG:4326"}}') AS collection
FROM features GROUP BY 1, 2""", "features")
def _(t):
    return A.collect_features(feature_texts(t), "layer_id", "feature_id", chunk=PART, crs="EPSG:4326")


@query("geojson_read", f"""SELECT feature_id, land_type, round_even(cx, 6) + 0.0 AS cx, round_even(cy, 6) + 0.0 AS cy, xmin, ymin, xmax, ymax FROM features JOIN {MEASURED} USING (feature_id)""", "features feature_edges")
def _(t):
    collections = A.collect_features(feature_texts(t), "layer_id", "feature_id", chunk=PART)
    read = A.read_geojson(collections.select("collection"), "collection")
    cx, cy = R.centroid(RING)
    return read.select(
        F.col("properties")["id"].cast("bigint").alias("feature_id"), F.col("properties")["land_type"].alias("land_type"),
        r6(cx).alias("cx"), r6(cy).alias("cy"), *(c.alias(n) for n, c in R.bounds(RING).items()),
    )


@query("detections_json", """SELECT image_id, part, COUNT(*) AS num_detections, concat('[', string_agg(concat('{"id":', CAST(n AS VARCHAR), ',"bbox":[', CAST(CAST(x1 AS INT) AS VARCHAR), ',', CAST(CAST(y1 AS INT) AS VARCHAR), ',',
  CAST(CAST(x2 AS INT) AS VARCHAR), ',', CAST(CAST(y2 AS INT) AS VARCHAR), '],"width":', CAST(CAST(x2 - x1 AS INT) AS VARCHAR), ',"height":', CAST(CAST(y2 - y1 AS INT) AS VARCHAR), ',"score":', CAST(round_even(score, 3) AS VARCHAR), '}'), ',' ORDER BY n), ']') AS detections
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY image_id ORDER BY det_id) AS n, det_id // 50000 AS part FROM detections) GROUP BY image_id, part""", "detections")
def _(t):
    from parcelworks.operators.detections import detections_json

    return detections_json(t.detections.withColumn("score", half_even(F.col("score"), 3)), chunk=PART)


def label_lines(t):
    """Detections as label text, with some blank and broken lines."""
    tile_row, tile_col = F.floor(F.col("y1") / 64).cast("int"), F.floor(F.col("x1") / 64).cast("int")
    rows = located(t).withColumn("row", tile_row).withColumn("col", tile_col)
    norm = lambda v, s: (v / s).cast("string")
    text = F.concat_ws(
        " ", F.col("class_id").cast("string"),
        norm((F.col("x1") + F.col("x2")) / 2 - F.col("col") * 64, 64.0), norm((F.col("y1") + F.col("y2")) / 2 - F.col("row") * 64, 64.0),
        norm(F.col("x2") - F.col("x1"), 64.0), norm(F.col("y2") - F.col("y1"), 64.0),
    )
    line = F.when(F.col("det_id") % 17 == 0, "").when(F.col("det_id") % 19 == 0, "1 0.5 0.5").otherwise(F.concat(F.lit(" "), text))
    name = P.tile_name(P.stem(F.col("image_name")), F.col("row"), F.col("col"))
    return rows.select("det_id", F.concat(name, F.lit(".txt")).alias("label_file"), line.alias("line"))


GOOD = "det_id % 17 <> 0 AND det_id % 19 <> 0"
LINES = f"""(SELECT *, ((x1 + x2) / 2 - col * 64) / 64 AS cx, ((y1 + y2) / 2 - row * 64) / 64 AS cy, (x2 - x1) / 64 AS w, (y2 - y1) / 64 AS h,
  concat(regexp_replace(image_name, '\\.[a-z]+$', ''), format('_{{:04d}}_{{:04d}}', row, col)) AS tile FROM (
  SELECT *, CAST(floor(y1 / 64) AS INT) AS row, CAST(floor(x1 / 64) AS INT) AS col FROM {LOCATED}))"""


@query("yolo_read", f"SELECT det_id, class_id, cx, cy, w, h FROM {LINES} WHERE {GOOD}", "detections images")
def _(t):
    return A.read_label_lines(label_lines(t), "line").select("det_id", "class_id", "cx", "cy", "w", "h")


@query("group_labels_by_source", f"SELECT regexp_replace(image_name, '\\.[a-z]+$', '') AS source, COUNT(DISTINCT tile) AS tiles, COUNT(*) FILTER (WHERE {GOOD}) AS detections FROM {LINES} GROUP BY 1", "detections images")
def _(t):
    from parcelworks.operators.detections import group_labels_by_source

    return group_labels_by_source(label_lines(t))


TILED = f"""(SELECT image_id AS tile_image, image_name AS tile_image_name, width AS iw, height AS ih, c AS tc, f AS tf, CAST(tr AS INT) AS trow, CAST(unnest(range((width + 63) // 64)) AS INT) AS tcol FROM (
  SELECT *, unnest(range((height + 63) // 64)) AS tr FROM images))"""


@query("label_tile_text_join", f"""SELECT det_id, tile, class_id FROM {LINES} JOIN {TILED} ON tile_image = owner AND trow = row AND tcol = col WHERE {GOOD}""", "detections images")
def _(t):
    from parcelworks.operators.detections import label_tile_text_join

    joined = label_tile_text_join(tile_catalog(t), A.read_label_lines(label_lines(t), "line"))
    return joined.select("det_id", F.col("tile_name").alias("tile"), "class_id")


def tile_catalog(t):
    from parcelworks.operators.tiling import tile_catalog as build

    return build(t.images, tile=64, stride=64)


@query("yolo_to_geo", f"""SELECT det_id, round_even(gx - w * wide / 2, 6) + 0.0 AS x1, round_even(gy + h * tall / 2, 6) + 0.0 AS y1, round_even(gx + w * wide / 2, 6) + 0.0 AS x2, round_even(gy - h * tall / 2, 6) + 0.0 AS y2, source FROM (
  SELECT *, CASE WHEN tile_image % 5 = 0 THEN 'pixel' ELSE 'map' END AS source,
    CASE WHEN tile_image % 5 = 0 THEN tcol * 64 + cx * tw ELSE tc + 0.5 * tcol * 64 + cx * 0.5 * tw END AS gx, CASE WHEN tile_image % 5 = 0 THEN trow * 64 + cy * th ELSE tf - 0.5 * trow * 64 - cy * 0.5 * th END AS gy,
    CASE WHEN tile_image % 5 = 0 THEN tw ELSE 0.5 * tw END AS wide, CASE WHEN tile_image % 5 = 0 THEN -th ELSE 0.5 * th END AS tall FROM (
    SELECT *, least(64, iw - tcol * 64) AS tw, least(64, ih - trow * 64) AS th FROM {LINES} JOIN {TILED} ON tile_image = owner AND trow = row AND tcol = col WHERE {GOOD}))""", "detections images")
def _(t):
    from parcelworks.operators.detections import labels_to_geo, label_tile_text_join

    tiles = tile_catalog(t).withColumn("has_crs", F.col("image_id") % 5 != 0)
    placed = labels_to_geo(label_tile_text_join(tiles, A.read_label_lines(label_lines(t), "line")))
    return placed.select("det_id", *(r6(F.col(c)).alias(c) for c in ("x1", "y1", "x2", "y2")), "source")


@query("parse_prompts", """SELECT det_id, kind, accepted, x, y, label FROM (
  SELECT det_id, 'box' AS kind, det_id % 13 <> 0 AND det_id % 11 <> 0 AS accepted, CASE WHEN det_id % 13 <> 0 AND det_id % 11 <> 0 THEN CAST(x1 AS INT) END AS x, CASE WHEN det_id % 13 <> 0 AND det_id % 11 <> 0 THEN CAST(y1 AS INT) END AS y, NULL::INT AS label FROM detections
  UNION ALL SELECT det_id, 'point', det_id % 9 <> 0 AND det_id % 8 <> 0, CASE WHEN det_id % 9 <> 0 AND det_id % 8 <> 0 THEN CAST(x1 AS INT) END, CASE WHEN det_id % 9 <> 0 AND det_id % 8 <> 0 THEN CAST(y1 AS INT) END, CASE WHEN det_id % 9 <> 0 AND det_id % 8 <> 0 THEN 1 END FROM detections
  UNION ALL SELECT det_id, 'point', TRUE, CAST(x2 AS INT), CAST(y2 AS INT), 0 FROM detections WHERE det_id % 9 <> 0 AND det_id % 8 <> 0)""", "detections")
def _(t):
    whole = [F.col(c).cast("int").cast("string") for c in ("x1", "y1", "x2", "y2")]
    key = F.col("det_id")
    box_text = F.when(key % 13 == 0, F.concat_ws(",", *whole[:3])).when(key % 11 == 0, F.lit("a,b,c,d")).otherwise(F.concat_ws(", ", *whole))
    good = F.concat(F.lit("[["), whole[0], F.lit(","), whole[1], F.lit(",1],["), whole[2], F.lit(","), whole[3], F.lit(",0]]"))
    point_text = F.when(key % 9 == 0, "[[1,2]]").when(key % 8 == 0, "not json").otherwise(good)
    boxes = A.parse_box_prompts(t.detections.select("det_id", box_text.alias("text")), "text")
    points_ = A.parse_point_prompts(t.detections.select("det_id", point_text.alias("text")), "text")
    left = boxes.select("det_id", F.lit("box").alias("kind"), "accepted", F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(None).cast("int").alias("label"))
    return left.unionByName(points_.select("det_id", F.lit("point").alias("kind"), "accepted", "x", "y", "label"))


@query("flatten_vocab", "SELECT DISTINCT name FROM (SELECT p_name AS name FROM part UNION ALL SELECT p_brand FROM part UNION ALL SELECT p_type FROM part)")
def _(t):
    doc = F.to_json(F.struct(F.array("p_name").alias("names"), F.struct(F.array("p_brand").alias("brands"), F.array("p_type").alias("types")).alias("other")))
    return A.flatten_vocabulary(t.raw("part").select(doc.alias("text")), "text")


VOCABULARY = """vocab_words AS (SELECT list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda w: w <> '') AS w FROM benchmark),
vocab AS (SELECT DISTINCT phrase, replace(phrase, ' ', '_') AS name FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) AS phrase FROM vocab_words
  UNION ALL SELECT w[1] FROM vocab_words WHERE len(w) >= 1))"""


def vocabulary(t):
    """Neighbouring word pairs and leading words of the ``benchmark`` texts."""
    words = A.tokens(F.col("text"))
    items = t.raw("benchmark").select(words.alias("w")).filter(F.size("w") >= 1)
    listed = items.select(F.explode(F.concat(A.phrases(F.col("w"), 2), F.slice("w", 1, 1))).alias("phrase")).distinct()
    return listed.select("phrase", F.replace("phrase", F.lit(" "), F.lit("_")).alias("name"))


BANNED = ", ".join(f"'{w}'" for w in A.LARGE_SCALE_WORDS)


@query("caption_features", f"""WITH {VOCABULARY},
words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda w: w <> '') AS w FROM documents),
cand AS (SELECT DISTINCT doc_id, phrase FROM (SELECT doc_id, unnest(list_filter(w, lambda x: NOT list_contains([{BANNED}], x))) AS phrase FROM words
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1]))) FROM words)),
hit AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS found FROM cand JOIN vocab USING (phrase) GROUP BY doc_id),
alone AS (SELECT doc_id, string_agg(DISTINCT phrase, ',' ORDER BY phrase) AS every FROM cand WHERE NOT contains(phrase, ' ') GROUP BY doc_id)
SELECT doc_id, md5(coalesce(found, every, '')) AS digest, CASE WHEN found IS NULL THEN 0 ELSE 1 END AS matched FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN alone USING (doc_id)""")
def _(t):
    found = A.caption_features(t.raw("documents"), "doc_id", "text", vocabulary(t))
    return found.select("doc_id", F.md5(F.array_join("features", ",")).alias("digest"), F.col("matched").cast("int").alias("matched"))


@query("vocab_except", f"""WITH {VOCABULARY} SELECT name FROM vocab WHERE NOT contains(name, '_') AND name NOT IN (SELECT DISTINCT lower(p_name) FROM part) AND name NOT IN ({BANNED})""")
def _(t):
    from parcelworks.operators.sets import vocab_except

    nouns = vocabulary(t).filter(~F.col("name").contains("_")).select("name")
    banned = t.spark.createDataFrame([(w,) for w in A.LARGE_SCALE_WORDS], "name string")
    return vocab_except(nouns, t.raw("part").select(F.lower("p_name").alias("name")).union(banned), "name")
