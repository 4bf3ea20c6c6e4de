"""Index, catalogue, filter, split and selection queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from parcelworks.functions import paths as P
from parcelworks.functions.numbers import r6
from parcelworks.operators import catalog, selection, splits
from parcelworks.operators.ordering import previous_value, running_before
from parcelworks.plans.registry import query
from parcelworks.sources.tables import Tables

DRAW = "('0x' || substr(md5('42:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0"
ORDER = "md5('42:' || CAST({key} AS VARCHAR)), {key}"
MASK_ENDINGS = "_mask|_label|_labels|_semantic|_semantic_3class|_semantic_2class"


# ---- ratios and buckets -------------------------------------------------------------

def ratio_patches(t: Tables):
    """Patch ratios from pixel counts, plus type."""
    valid = F.greatest(F.col("n_total") - F.col("n_ignore"), F.lit(1)).cast("double")
    background = F.greatest(F.col("n_total") - F.col("n_ignore") - F.col("n_interior") - F.col("n_boundary"), F.lit(0))
    base = t.patches.select(
        "patch_id",
        F.concat(F.lit("patch_"), F.col("patch_id").cast("string")).alias("patch_name"),
        "source_tif",
        (F.col("n_interior") / valid).alias("interior_ratio"),
        (F.col("n_boundary") / valid).alias("boundary_ratio"),
        (background / valid).alias("background_ratio"),
        (F.col("n_ignore") / F.col("n_total").cast("double")).alias("ignore_ratio"),
    )
    return base.withColumn("cropland_ratio", F.col("interior_ratio") + F.col("boundary_ratio")).withColumn(
        "patch_type", selection.patch_type_of(F.col("interior_ratio"), F.col("boundary_ratio"), F.col("ignore_ratio"))
    )


TYPED = """(SELECT *, CASE WHEN ignore_ratio >= 1.0 THEN 'ignored' WHEN boundary_ratio > 0 THEN 'boundary'
  WHEN interior_ratio > 0 THEN 'interior' ELSE 'background' END AS patch_type FROM patch_ratio)"""


@query("assign_bucket", "SELECT sample_id, bucket FROM bucketed", "bucketed")
def _(t):
    return selection.with_bucket(t.samples).select("sample_id", "bucket")


@query("patch_type", f"SELECT patch_id, patch_type FROM {TYPED}", "patch_ratio")
def _(t):
    return ratio_patches(t).select("patch_id", "patch_type")


@query("keep_patch", f"""SELECT patch_id, patch_type FROM {TYPED}
WHERE ignore_ratio <= 0.5 AND (patch_type IN ('boundary', 'interior')
  OR (patch_type = 'background' AND {DRAW.format(key='patch_name')} < 0.2))""", "patch_ratio")
def _(t):
    return selection.keep_patches(ratio_patches(t)).select("patch_id", "patch_type")


@query("split_filter", "SELECT sample_id, split FROM samples WHERE lower(split) = 'test' AND use_for_train = 1", "samples")
def _(t):
    return selection.split_filter(t.samples, "test", train_only=True).select("sample_id", "split")


@query("country_window_filter", "SELECT sample_id, country, season_window FROM samples WHERE lower(country) IN ('en', 'de') AND season_window = 'window_a'", "samples")
def _(t):
    return selection.country_window_filter(t.samples, "en, DE", "window_a").select("sample_id", "country", "season_window")


@query("countries_normalize", """SELECT trim(part) AS country FROM (
  SELECT unnest(string_split(concat(' ', lang, ' , ,', source, ','), ',')) AS part FROM documents) WHERE trim(part) <> ''""")
def _(t):
    lists = t.raw("documents").select(F.concat(F.lit(" "), "lang", F.lit(" , ,"), "source", F.lit(",")).alias("listed"))
    return selection.countries_normalize(lists, "listed")


# ---- top-k selections ---------------------------------------------------------------

def select_query(name, order, where="TRUE", extra=""):
    return f"SELECT sample_id, fg_ratio, boundary_ratio FROM bucketed WHERE {where} ORDER BY {order} LIMIT 8"


@query("select_random", select_query("", ORDER.format(key="sample_id")), "bucketed")
def _(t):
    return selection.select_random(t.samples, "sample_id").select("sample_id", "fg_ratio", "boundary_ratio")


@query("select_boundary", select_query("", "boundary_ratio DESC, sample_id"), "bucketed")
def _(t):
    return selection.select_top(t.samples, "boundary_ratio", "sample_id").select("sample_id", "fg_ratio", "boundary_ratio")


@query("select_low_fg", select_query("", "fg_ratio, sample_id", "fg_ratio > 0 AND fg_ratio <= 0.15"), "bucketed")
def _(t):
    return selection.select_low_foreground(t.samples, "sample_id").select("sample_id", "fg_ratio", "boundary_ratio")


@query("select_high_fg", select_query("", "fg_ratio DESC, sample_id"), "bucketed")
def _(t):
    return selection.select_top(t.samples, "fg_ratio", "sample_id").select("sample_id", "fg_ratio", "boundary_ratio")


@query("select_bucket", select_query("", "sample_id", "bucket = 'mid_fg'"), "bucketed")
def _(t):
    rows = selection.with_bucket(t.samples).filter(F.col("bucket") == "mid_fg")
    return rows.orderBy("sample_id").limit(8).select("sample_id", "fg_ratio", "boundary_ratio")


@query("select_empty", "SELECT patch_id, ignore_ratio FROM patch_ratio WHERE cropland_ratio = 0 ORDER BY patch_id LIMIT 8", "patch_ratio")
def _(t):
    return ratio_patches(t).filter(F.col("cropland_ratio") == 0).orderBy("patch_id").limit(8).select("patch_id", "ignore_ratio")


@query("select_high_ignore", "SELECT patch_id, ignore_ratio FROM patch_ratio ORDER BY ignore_ratio DESC, patch_id LIMIT 8", "patch_ratio")
def _(t):
    return selection.select_top(ratio_patches(t), "ignore_ratio", "patch_id").select("patch_id", "ignore_ratio")


@query("max_samples", f"SELECT sample_id FROM samples ORDER BY {ORDER.format(key='sample_id')} LIMIT 100", "samples")
def _(t):
    return selection.max_samples(t.samples, "sample_id", 100).select("sample_id")


@query("select_eval_rows", f"""SELECT sample_id, split FROM samples
WHERE lower(split) = 'test' OR NOT EXISTS (SELECT 1 FROM samples WHERE lower(split) = 'test')
ORDER BY {ORDER.format(key='sample_id')} LIMIT 12""", "samples")
def _(t):
    return selection.select_eval_rows(t.samples, "sample_id", 12).select("sample_id", "split")


@query("quantile_pick", """SELECT sample_id, fg_ratio FROM (
  SELECT sample_id, fg_ratio, ROW_NUMBER() OVER (ORDER BY fg_ratio, sample_id) - 1 AS r, COUNT(*) OVER () AS n FROM samples)
WHERE n <= 10 OR r IN (SELECT CAST(round_even(CAST(i * (n2 - 1) AS DOUBLE) / 9, 0) AS BIGINT)
  FROM (SELECT unnest(range(10)) AS i, (SELECT COUNT(*) FROM samples) AS n2))""", "samples")
def _(t):
    return selection.quantile_pick(t.samples, "fg_ratio", "sample_id", 10).select("sample_id", "fg_ratio")


CUMULATIVE = """weighted AS (SELECT sample_id, bucket, weight, CAST(SUM(weight) OVER (ORDER BY sample_id) AS BIGINT) AS cum,
    CAST(SUM(weight) OVER () AS BIGINT) AS total FROM (
  SELECT sample_id, bucket, CASE bucket WHEN 'boundary_rich' THEN 30 WHEN 'low_fg' THEN 15 WHEN 'mid_fg' THEN 10
    WHEN 'high_fg' THEN 7 WHEN 'very_high_fg' THEN 4 WHEN 'near_background' THEN 3 ELSE 10 END AS weight
  FROM bucketed WHERE use_for_train = 1)),
drawn AS (SELECT sample_id AS draw_id, """ + DRAW.format(key="sample_id") + """ * total AS position FROM weighted)"""


@query("weighted_sample", f"""WITH {CUMULATIVE}
SELECT draw_id, sample_id, bucket FROM drawn JOIN weighted ON position >= cum - weight AND position < cum""", "bucketed")
def _(t):
    return selection.weighted_sample(selection.with_bucket(t.samples), "sample_id").select("draw_id", "sample_id", "bucket")


@query("sampling_interval_join", f"""WITH {CUMULATIVE}
SELECT bucket, COUNT(*) AS draws, COUNT(DISTINCT sample_id) AS samples
FROM drawn JOIN weighted ON position >= cum - weight AND position < cum GROUP BY bucket""", "bucketed")
def _(t):
    sampled = selection.weighted_sample(selection.with_bucket(t.samples), "sample_id")
    return sampled.groupBy("bucket").agg(F.count("*").alias("draws"), F.countDistinct("sample_id").alias("samples"))


# ---- splits -------------------------------------------------------------------------

def split_sql(key, source, train, val, views_key=None, columns=None):
    columns = columns or key
    return f"""SELECT {columns}, CASE WHEN r < tr THEN 'train' WHEN r < tr + va THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, {train} AS tr, {val} AS va FROM (
    SELECT *, ROW_NUMBER() OVER (ORDER BY {ORDER.format(key=key)}) - 1 AS r, COUNT(*) OVER () AS n FROM {source}))"""


ROUND_TRAIN = "CAST(round_even(CAST(n * 0.8 AS DOUBLE), 0) AS BIGINT)"
ROUND_VAL = f"least(CAST(round_even(CAST(n * 0.1 AS DOUBLE), 0) AS BIGINT), greatest(n - {ROUND_TRAIN}, 0))"


@query("split_assign_round", split_sql("sample_id", "samples", ROUND_TRAIN, ROUND_VAL), "samples")
def _(t):
    return splits.split_assign_round(t.samples.select("sample_id"), "sample_id")


@query("split_assign_floor", split_sql("sample_id", "samples", "CAST(floor(CAST(n AS DOUBLE) * 0.8) AS BIGINT)", "CAST(floor(CAST(n AS DOUBLE) * 0.1) AS BIGINT)"), "samples")
def _(t):
    return splits.split_assign_floor(t.samples.select("sample_id"), "sample_id")


@query("split_by_image", f"""SELECT patch_id, p.source_tif, split FROM patches p JOIN (
{split_sql("source_tif", "(SELECT DISTINCT source_tif FROM patches)", ROUND_TRAIN, ROUND_VAL)}) u ON p.source_tif = u.source_tif""", "patches")
def _(t):
    return splits.split_by_unit(t.patches.select("patch_id", "source_tif"), "source_tif").select("patch_id", "source_tif", "split")


@query("split_by_patch", split_sql("patch_id", "patches", ROUND_TRAIN, ROUND_VAL), "patches")
def _(t):
    return splits.split_assign_round(t.patches.select("patch_id"), "patch_id")


@query("split_train_val", f"""SELECT sample_id, split FROM (
  SELECT sample_id, CASE WHEN r < CAST(floor(CAST(n AS DOUBLE) * 0.8) AS BIGINT) THEN 'train' ELSE 'val' END AS split FROM (
    SELECT *, ROW_NUMBER() OVER (ORDER BY {ORDER.format(key='sample_id')}) - 1 AS r, COUNT(*) OVER () AS n FROM samples))
WHERE sample_id IN (SELECT doc_id FROM labels)""", "samples")
def _(t):
    masked = t.raw("labels").select(F.col("doc_id").alias("sample_id"))
    return splits.split_train_val(t.samples.select("sample_id"), "sample_id", masked)


@query("split_test_fraction", f"""SELECT patch_id, CASE WHEN r < CAST(floor(CAST(n AS DOUBLE) * 0.15) AS BIGINT) THEN 'test' ELSE 'train' END AS split FROM (
    SELECT *, ROW_NUMBER() OVER (ORDER BY {ORDER.format(key='patch_id')}) - 1 AS r, COUNT(*) OVER () AS n FROM patches)""", "patches")
def _(t):
    return splits.split_test_fraction(t.patches.select("patch_id"), "patch_id")


@query("split_join", f"""SELECT sample_id, CASE WHEN lower(trim(s.split)) IN ('train', 'val', 'test') THEN lower(trim(s.split)) ELSE a.split END AS split
FROM samples s LEFT JOIN ({split_sql("sample_id", "samples", ROUND_TRAIN, ROUND_VAL)}) a USING (sample_id)""", "samples")
def _(t):
    rows = t.samples.select("sample_id", "split")
    return splits.split_join(rows, splits.split_assign_round(rows.select("sample_id"), "sample_id"), "sample_id")


# ---- listings, manifests, catalogues ------------------------------------------------

PATHS_SQL = "(SELECT page_id, concat('data/c', CAST(page_id % 7 AS VARCHAR), '/', stem, suffix) AS path, stem, suffix FROM paths)"


def listing(t: Tables):
    folder = F.concat(F.lit("data/c"), (F.col("page_id") % 7).cast("string"), F.lit("/"))
    return t.paths.select("page_id", F.concat(folder, "stem", "suffix").alias("path"), "stem", "suffix")


@query("scan_files", f"""SELECT path FROM {PATHS_SQL} WHERE suffix IN ('.tif', '.tiff', '.png', '.jpg', '.jpeg')
  AND NOT regexp_matches(lower(stem), '(_mask|_label|_labels)$')""", "paths")
def _(t):
    return catalog.scan_files(listing(t)).select("path")


@query("detect_dataset_type", f"""SELECT dataset, CASE MAX(CASE WHEN suffix = '.tif' THEN 2 WHEN suffix = '.png' THEN 1 ELSE 0 END)
  WHEN 2 THEN 'tif' WHEN 1 THEN 'image' ELSE 'unknown' END AS dataset_type
FROM (SELECT page_id // 2 AS dataset, suffix FROM paths) GROUP BY dataset""", "paths")
def _(t):
    return catalog.detect_dataset_type(listing(t).withColumn("dataset", F.floor(F.col("page_id") / 2)), "dataset")


def manifest(t: Tables):
    page = F.col("page_id")
    return t.paths.select(
        F.when(page % 3 == 0, "").otherwise(F.concat(F.lit("s"), page.cast("string"))).alias("sample_id"),
        F.concat(
            F.when(page % 5 == 0, "/abs/x/").when(page % 5 == 1, "").otherwise(F.concat(F.lit("c"), (page % 7).cast("string"), F.lit("/"))),
            "stem", "suffix",
        ).alias("image_path"),
        F.when(page % 4 == 0, "").otherwise(F.concat(F.lit("masks/"), "stem", "suffix")).alias("mask_path"),
        F.when(page % 6 == 0, " Train ").when(page % 6 == 1, "VAL").when(page % 6 == 2, "holdout").otherwise("").alias("split"),
        F.when(page % 2 == 0, "").otherwise("fr").alias("country"),
    )


@query("read_manifest", """SELECT CASE WHEN page_id % 3 = 0 THEN stem ELSE concat('s', CAST(page_id AS VARCHAR)) END AS sample_id, image_path,
  CASE WHEN page_id % 4 = 0 THEN NULL ELSE concat('/root/set/masks/', stem, suffix) END AS mask_path,
  CASE page_id % 6 WHEN 0 THEN 'train' WHEN 1 THEN 'val' END AS split,
  CASE WHEN page_id % 2 = 1 THEN 'fr' WHEN page_id % 5 IN (0, 1) THEN 'unknown' ELSE concat('c', CAST(page_id % 7 AS VARCHAR)) END AS country
FROM (SELECT *, concat(CASE page_id % 5 WHEN 0 THEN '/abs/x/' WHEN 1 THEN '/root/set/'
  ELSE concat('/root/set/c', CAST(page_id % 7 AS VARCHAR), '/') END, stem, suffix) AS image_path FROM paths)""", "paths")
def _(t):
    return catalog.normalize_manifest(manifest(t), "/root/set")


@query("read_patch_index", """SELECT concat('patch_', CAST(patch_id AS VARCHAR)) AS sample_id, source_tif, 'train' AS split,
  CASE WHEN patch_id % 9 = 0 THEN 0 ELSE CAST(patch_id % 512 AS INT) END AS x,
  0 AS y, CAST(n_total AS INT) AS width, 512 AS height,
  concat('/data/set/patches/', CAST(patch_id AS VARCHAR), '.tif') AS image_path,
  fg AS fg_ratio, boundary_ratio, ignore_ratio,
  CASE WHEN ignore_ratio > 0.5 THEN 'drop' WHEN boundary_ratio > 0.005 THEN 'boundary_rich' WHEN fg < 0.01 THEN 'near_background'
    WHEN fg < 0.10 THEN 'low_fg' WHEN fg < 0.70 THEN 'mid_fg' WHEN fg < 0.95 THEN 'high_fg' ELSE 'very_high_fg' END AS bucket,
  1 AS use_for_train, '' AS note
FROM (SELECT *, CASE WHEN patch_id % 9 = 1 THEN 0.0 ELSE CAST(n_interior AS DOUBLE) / 1000 END AS fg,
  CAST(n_boundary AS DOUBLE) / 1000 AS boundary_ratio, CAST(n_ignore AS DOUBLE) / 1000 AS ignore_ratio FROM patches)""", "patches")
def _(t):
    key = F.col("patch_id")
    ratio = lambda c: (F.col(c) / 1000.0).cast("string")
    raw = t.patches.select(
        F.when(key % 2 == 0, F.concat(F.lit("patch_"), key.cast("string"))).alias("patch_name"),
        F.concat(F.lit("patch_"), key.cast("string")).alias("patch_id"),
        "source_tif", F.lit("train").alias("split"),
        F.when(key % 9 == 0, "n/a").otherwise((key % 512).cast("string")).alias("x"), F.lit("").alias("y"),
        F.col("n_total").cast("string").alias("width"), F.lit("512.0").alias("height"),
        F.concat(F.lit("patches/"), key.cast("string"), F.lit(".tif")).alias("image_path"),
        F.when(key % 9 == 1, "bad").otherwise(ratio("n_interior")).alias("cropland_ratio"),
        ratio("n_boundary").alias("boundary_ratio"), ratio("n_ignore").alias("ignore_ratio"),
        F.lit(None).cast("string").alias("patch_type"),
    )
    return catalog.normalize_patch_index(raw, "/data/set", selection.bucket_of)


@query("image_catalog", """SELECT image_id, image_name, width, height, band_count, dtype, crs,
  concat('[', CAST(a AS VARCHAR), ',', CAST(b AS VARCHAR), ',', CAST(c AS VARCHAR), ',', CAST(d AS VARCHAR), ',', CAST(e AS VARCHAR), ',', CAST(f AS VARCHAR), ']') AS transform,
  c AS bounds_left, f + d * width + e * height AS bounds_bottom, c + a * width + b * height AS bounds_right, f AS bounds_top,
  coalesce(CAST(nodata AS VARCHAR), '') AS nodata, abs(a) AS res_x, abs(e) AS res_y FROM images""", "images")
def _(t):
    return catalog.image_catalog(t.images)


@query("label_catalog", """SELECT layer_id, CAST(SUM(n) AS BIGINT) AS feature_count, 'EPSG:4326' AS crs, 'feature_id,land_type,geometry' AS columns,
  concat('{', string_agg(concat('"', kind, '":', CAST(n AS VARCHAR)), ',' ORDER BY kind), '}') AS geometry_types
FROM (SELECT layer_id, CASE WHEN feature_id % 11 = 0 THEN 'MultiPolygon' ELSE 'Polygon' END AS kind, COUNT(*) AS n FROM features GROUP BY 1, 2)
GROUP BY layer_id""", "features")
def _(t):
    kind = F.when(F.col("feature_id") % 11 == 0, "MultiPolygon").otherwise("Polygon")
    return catalog.label_catalog(t.features, "layer_id", kind, "feature_id,land_type,geometry", "EPSG:4326")


@query("missing_paths", f"""WITH files AS (SELECT path FROM {PATHS_SQL} WHERE suffix <> '.txt'),
idx AS (SELECT page_id AS sample_id, path AS image_path, concat('masks/', path) AS mask_path FROM {PATHS_SQL})
SELECT DISTINCT sample_id FROM idx WHERE image_path NOT IN (SELECT path FROM files)
  OR mask_path NOT IN (SELECT concat('masks/', path) FROM files)""", "paths")
def _(t):
    present = listing(t).filter(F.col("suffix") != ".txt").select("path")
    files = present.union(present.select(F.concat(F.lit("masks/"), "path").alias("path")))
    index = listing(t).select(F.col("page_id").alias("sample_id"), F.col("path").alias("image_path"), F.concat(F.lit("masks/"), "path").alias("mask_path"))
    return catalog.missing_paths(index, files, "sample_id")


@query("resolve_patch_file", f"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN concat('given/', stem) ELSE coalesce(found, '') END AS image_path
FROM {PATHS_SQL} LEFT JOIN (SELECT stem AS s2, min_by(path, CASE suffix WHEN '.tif' THEN concat('0', path) ELSE concat('1', path) END) AS found
  FROM {PATHS_SQL} WHERE suffix <> '.txt' GROUP BY stem) ON stem = s2""", "paths")
def _(t):
    index = listing(t).select("page_id", F.col("stem").alias("patch_name"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("given/"), "stem")).otherwise("").alias("image_path"))
    return catalog.resolve_patch_file(index, listing(t)).select("page_id", "image_path")


@query("image_mask_join", f"""SELECT i.page_id, i.path, m.mask_path FROM {PATHS_SQL} i JOIN (
  SELECT regexp_replace(lower(stem), '({MASK_ENDINGS})$', '') AS s, MAX(path) AS mask_path FROM {PATHS_SQL} WHERE page_id % 4 <> 3 GROUP BY 1) m
ON regexp_replace(lower(i.stem), '({MASK_ENDINGS})$', '') = m.s WHERE i.page_id % 4 = 3""", "paths")
def _(t):
    is_mask = P.normalized_stem(F.col("stem")) != F.lower("stem")
    files = listing(t)
    return catalog.image_mask_join(files.filter(~is_mask), files.filter(is_mask)).select("page_id", "path", "mask_path")


@query("summarize_index", """SELECT 'count' AS dimension, '' AS value, COUNT(*) AS n FROM bucketed UNION ALL
SELECT 'bucket', bucket, COUNT(*) FROM bucketed GROUP BY bucket UNION ALL
SELECT 'split', split, COUNT(*) FROM bucketed GROUP BY split UNION ALL
SELECT 'country', country, COUNT(*) FROM bucketed GROUP BY country""", "bucketed")
def _(t):
    return catalog.summarize_index(selection.with_bucket(t.samples))


@query("path_within_root", """SELECT page_id, path, NOT (contains(concat(path, '/'), '/../') OR NOT starts_with(path, '/data/set/')) AS accepted
FROM (SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN '/data/set/' WHEN 1 THEN '/data/set/../' ELSE '/other/' END, stem, suffix) AS path FROM paths)""", "paths")
def _(t):
    page = F.col("page_id")
    path = F.concat(F.when(page % 3 == 0, "/data/set/").when(page % 3 == 1, "/data/set/../").otherwise("/other/"), "stem", "suffix")
    return t.paths.select("page_id", path.alias("path")).withColumn("accepted", P.is_within(F.col("path"), "/data/set"))


@query("patch_names", """SELECT image_id, format('{}_x{:06d}_y{:06d}', stem, width, height) AS window_name, format('{}_{:04d}_{:04d}', stem, width, height) AS tile_name,
  concat(regexp_replace(concat('c. ', stem), '[^A-Za-z0-9_-]', '_', 'g'), '_t1') AS patch_id,
  concat(substr(regexp_replace(concat(repeat('long.', 20), stem), '[^A-Za-z0-9_-]', '_', 'g'), 1, 71), '_', substr(md5(concat(repeat('long.', 20), stem)), 1, 8)) AS short_name
FROM (SELECT *, regexp_replace(image_name, '\\.[A-Za-z0-9]+$', '') AS stem FROM images)""", "images")
def _(t):
    stem = P.stem(F.col("image_name"))
    return t.images.select(
        "image_id",
        P.window_name(stem, F.col("width"), F.col("height")).alias("window_name"),
        P.tile_name(stem, F.col("width"), F.col("height")).alias("tile_name"),
        F.concat(P.safe_name(F.concat(F.lit("c. "), stem)), F.lit("_t1")).alias("patch_id"),
        P.safe_name(F.concat(F.lit("long." * 20), stem), 80).alias("short_name"),
    )


# ---- training log and messages ------------------------------------------------------

@query("best_checkpoint", """SELECT run_id, epoch, best_loss, best_f1 FROM (
  SELECT run_id, epoch, coalesce(val_loss < prev_loss, TRUE) AS best_loss, coalesce(val_boundary_f1 > prev_f1, TRUE) AS best_f1 FROM (
    SELECT *, MIN(val_loss) OVER w AS prev_loss, MAX(val_boundary_f1) OVER w AS prev_f1 FROM epochs
    WINDOW w AS (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)))
WHERE best_loss OR best_f1""", "epochs")
def _(t):
    seen = running_before(t.epochs, "run_id", "epoch", {"prev_loss": ("min", F.col("val_loss")), "prev_f1": ("max", F.col("val_boundary_f1"))})
    better_loss = F.coalesce(F.col("val_loss") < F.col("prev_loss"), F.lit(True))
    better_f1 = F.coalesce(F.col("val_boundary_f1") > F.col("prev_f1"), F.lit(True))
    return seen.select("run_id", "epoch", better_loss.alias("best_loss"), better_f1.alias("best_f1")).filter("best_loss OR best_f1")


@query("log_tail", """SELECT job_id, seq, line FROM (SELECT *, LAG(line) OVER (PARTITION BY job_id ORDER BY seq) AS prev FROM job_events)
WHERE prev IS DISTINCT FROM line""", "job_events")
def _(t):
    from parcelworks.streaming.jobs import log_tail

    return log_tail(t.job_events)


@query("loss_mean", "SELECT run_id, round_even(SUM(val_loss * batch) / SUM(batch), 6) + 0.0 AS mean_loss FROM epochs GROUP BY run_id", "epochs")
def _(t):
    weighted = F.sum(F.col("val_loss") * F.col("batch")) / F.sum("batch")
    return t.epochs.groupBy("run_id").agg(r6(weighted).alias("mean_loss"))
