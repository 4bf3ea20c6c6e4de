"""SQL twins of the derived layers, for the side-by-side check."""

from __future__ import annotations

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "images": ((), """
SELECT s_suppkey AS image_id,
  concat('img_', CAST(s_suppkey AS VARCHAR), CASE WHEN s_suppkey % 5 = 0 THEN '.png' ELSE '.tif' END) AS image_name,
  CAST(96 + (s_suppkey * 37) % 48 AS INT) AS width, CAST(80 + (s_suppkey * 53) % 48 AS INT) AS height,
  3 AS band_count, 'uint8' AS dtype, 'EPSG:4326' AS crs,
  CAST(0.5 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(100 + s_nationkey * 64 AS DOUBLE) AS c,
  CAST(0 AS DOUBLE) AS d, CAST(-0.5 AS DOUBLE) AS e, CAST(40 + s_nationkey AS DOUBLE) AS f,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 0 END AS nodata
FROM supplier"""),
    "image_lines": (("images",), """
SELECT image_id, width, height, nodata, CAST(unnest(range(height)) AS INT) AS y FROM images"""),
    "grid": (("image_lines",), """
SELECT image_id, width, height, nodata, y, CAST(unnest(range(width)) AS INT) AS x FROM image_lines"""),
    "mask_pixels": (("grid",), """
SELECT image_id, y, x,
  CASE WHEN (x * 31 + y * 17 + image_id * 7) % 89 = 0 THEN 255
       WHEN (x // 12 + 3 * (y // 10) + image_id) % 3 = 0 THEN 0
       WHEN x % 12 = 0 OR y % 10 = 0 THEN 2 ELSE 1 END AS cls
FROM grid"""),
    "mask_runs": (("mask_pixels",), """
SELECT image_id, y, MIN(x) AS x_start, MAX(x) AS x_end, cls FROM (
  SELECT *, x - ROW_NUMBER() OVER (PARTITION BY image_id, y, cls ORDER BY x) AS island FROM mask_pixels)
GROUP BY image_id, y, cls, island"""),
    "rgb_pixels": (("grid",), """
SELECT image_id, nodata, y, x,
  CASE WHEN (x + y + image_id) % 23 = 0 THEN 0 ELSE CAST((x * 7 + y * 3 + image_id) % 256 AS INT) END AS b1,
  CASE WHEN (x + y + image_id) % 23 = 0 THEN 0 ELSE CAST((x * 5 + y * 11 + image_id * 2) % 256 AS INT) END AS b2,
  CASE WHEN (x + y + image_id) % 23 = 0 THEN 0 ELSE CAST((x + y * 2 + image_id * 3) % 200 AS INT) END AS b3
FROM grid"""),
    "band_pixels": ((), "SELECT vec_id AS pixel_id, label AS image_id, embedding AS bands FROM embeddings"),
    "band_values": (("band_pixels",), """
SELECT pixel_id, image_id, CAST(unnest(range(len(bands))) + 1 AS INT) AS band, CAST(unnest(bands) AS DOUBLE) AS v FROM band_pixels"""),
    "patches": ((), """
SELECT p_partkey AS patch_id, concat('img_', CAST(p_partkey % 10 AS VARCHAR), '.tif') AS source_tif,
  CAST(p_size * 20 AS BIGINT) AS n_total, CAST((p_partkey * 13) % (p_size * 20) AS BIGINT) AS n_ignore,
  CAST(FLOOR((p_size * 20 - (p_partkey * 13) % (p_size * 20)) * ((p_partkey * 7) % 12) / 11.0) AS BIGINT) AS n_interior,
  CAST(CASE WHEN p_partkey % 4 = 0 THEN FLOOR((p_size * 20 - (p_partkey * 13) % (p_size * 20)) / 23.0) ELSE 0 END AS BIGINT) AS n_boundary
FROM part"""),
    "patch_ratio": (("patches",), """
SELECT patch_id, concat('patch_', CAST(patch_id AS VARCHAR)) AS patch_name, source_tif,
  interior + boundary AS cropland_ratio, interior AS interior_ratio, boundary AS boundary_ratio,
  background AS background_ratio, ignored AS ignore_ratio FROM (
  SELECT *, CAST(n_interior AS DOUBLE) / greatest(n_total - n_ignore, 1) AS interior,
    CAST(n_boundary AS DOUBLE) / greatest(n_total - n_ignore, 1) AS boundary,
    CAST(greatest(n_total - n_ignore - n_interior - n_boundary, 0) AS DOUBLE) / greatest(n_total - n_ignore, 1) AS background,
    CAST(n_ignore AS DOUBLE) / n_total AS ignored FROM patches)"""),
    "samples": ((), """
SELECT doc_id AS sample_id, source AS source_dataset, lang AS country,
  CASE WHEN doc_id % 2 = 0 THEN 'window_a' ELSE 'window_b' END AS season_window,
  CAST(n_chars % 1000 AS DOUBLE) / 1000.0 AS fg_ratio, CAST(n_chars % 37 AS DOUBLE) / 5000.0 AS boundary_ratio,
  CAST(n_chars % 11 AS DOUBLE) / 18.0 AS ignore_ratio, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE 1 END AS use_for_train,
  CASE doc_id % 7 WHEN 0 THEN 'TEST' WHEN 1 THEN 'Val' WHEN 2 THEN '' ELSE 'train' END AS split
FROM documents"""),
    "bucketed": (("samples",), """
SELECT *, CASE WHEN ignore_ratio > 0.5 THEN 'drop' WHEN boundary_ratio > 0.005 THEN 'boundary_rich'
  WHEN fg_ratio < 0.01 THEN 'near_background' WHEN fg_ratio < 0.10 THEN 'low_fg' WHEN fg_ratio < 0.70 THEN 'mid_fg'
  WHEN fg_ratio < 0.95 THEN 'high_fg' ELSE 'very_high_fg' END AS bucket FROM samples"""),
    "detections": ((), """
SELECT o_orderkey AS det_id, o_custkey AS image_id, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS class_id,
  CAST((o_orderkey * 7919) % 160 AS DOUBLE) AS x1, CAST((o_orderkey * 104729) % 160 AS DOUBLE) AS y1,
  CAST((o_orderkey * 7919) % 160 + 24 + (o_orderkey * 31) % 64 AS DOUBLE) AS x2,
  CAST((o_orderkey * 104729) % 160 + 24 + (o_orderkey * 37) % 64 AS DOUBLE) AS y2, o_totalprice / 500000.0 AS score
FROM orders"""),
    "instance_runs": (("detections",), """
SELECT image_id, mask_id, score, y, CAST(x1 AS INT) + CAST((y - CAST(y1 AS INT)) % 5 AS INT) AS x_start,
  CAST(x2 AS INT) - 1 - CAST(mask_id % 4 AS INT) AS x_end FROM (
  SELECT image_id, det_id AS mask_id, score, x1, x2, y1, CAST(unnest(range(CAST(y1 AS INT), CAST(y2 AS INT))) AS INT) AS y FROM detections)"""),
    "features": ((), """
SELECT feature_id, layer_id, land_type, image_id, x0 AS px0, y0 AS py0, x0 + w AS px1, y0 + s AS py1,
  x0 + w - s AS px2, y0 + h AS py2, x0 - s AS px3, y0 + h - s AS py3, x0 AS px4, y0 AS py4 FROM (
  SELECT c_custkey AS feature_id, c_nationkey AS layer_id, c_mktsegment AS land_type, c_custkey % 10 AS image_id,
    CAST(8 + (c_custkey * 29) % 64 AS DOUBLE) + 0.25 AS x0, CAST(6 + (c_custkey * 43) % 48 AS DOUBLE) + 0.25 AS y0,
    CAST(10 + (c_custkey * 11) % 20 AS DOUBLE) AS w, CAST(9 + (c_custkey * 17) % 16 AS DOUBLE) AS h,
    CAST(c_custkey % 4 AS DOUBLE) AS s FROM customer)"""),
    "feature_edges": (("features",), """
SELECT feature_id, image_id, 0 AS k, px0 AS ax, py0 AS ay, px1 AS bx, py1 AS ey FROM features UNION ALL
SELECT feature_id, image_id, 1, px1, py1, px2, py2 FROM features UNION ALL
SELECT feature_id, image_id, 2, px2, py2, px3, py3 FROM features UNION ALL
SELECT feature_id, image_id, 3, px3, py3, px4, py4 FROM features"""),
    "truth_pred": ((), "SELECT doc_id AS item_id, quality AS truth, toxic AS pred FROM labels"),
    "mask_pairs": (("mask_pixels",), """
SELECT image_id, cls AS truth, CAST(CASE WHEN (x + 2 * y + image_id) % 7 = 0 THEN (cls + 1) % 3 ELSE cls % 3 END AS INT) AS pred FROM mask_pixels"""),
    "epochs": ((), """
SELECT user_id AS run_id, event_id AS epoch, value / 500.0 AS val_loss,
  CAST((event_id * 11) % 23 AS DOUBLE) / 23.0 AS val_boundary_f1, (event_id * 7) % 32 + 1 AS batch FROM events"""),
    "job_events": ((), """
SELECT user_id AS job_id, event_id AS seq, ts AS event_time,
  CASE event_type WHEN 'signup' THEN 'queued' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'running' END AS status,
  value, concat('log ', props) AS line FROM events"""),
    "paths": ((), """
SELECT page_id, url, concat('field_', CAST(page_id // 4 AS VARCHAR),
    CASE page_id % 4 WHEN 0 THEN '_mask' WHEN 1 THEN '_Label' WHEN 2 THEN '_semantic_3class' ELSE '' END) AS stem,
  CASE page_id % 3 WHEN 0 THEN '.tif' WHEN 1 THEN '.png' ELSE '.txt' END AS suffix FROM pages"""),
}


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the views it names and those they need."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for parent in VIEWS[name][0]:
            need(parent)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        need(name)
    if not ordered:
        return body
    chain = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in ordered)
    text = body.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {chain},\n{text[len('WITH RECURSIVE '):]}"
    if text.upper().startswith("WITH "):
        return f"WITH {chain},\n{text[len('WITH '):]}"
    return f"WITH {chain}\n{text}"
