"""Streams with batch twins, augmentation, sinks and the scorer slot."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from parcelworks.functions.numbers import r6
from parcelworks.operators import augment, metrics, splits
from parcelworks.operators.raster import tile_map
from parcelworks.plans.raster import metric_sql, rounded
from parcelworks.plans.registry import query
from parcelworks.session import scratch_dir
from parcelworks.sources import files
from parcelworks.sources.tables import Tables
from parcelworks.streaming import jobs as J

# ---- streams ------------------------------------------------------------------------

def status():
    return F.when(F.col("event_type") == "signup", "queued").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed").otherwise("running")


def event_stream(t: Tables):
    raw = J.read_events(t.spark, t.folder, t.raw("events").schema)
    return raw.select(
        F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_time"), status().alias("status"),
        F.col("value").alias("current"), F.lit(400.0).alias("total"), "event_type", "value", "props",
    )


def log_line():
    key = F.col("seq").cast("string")
    good = F.concat(F.lit('epoch done {"epoch": '), key, F.lit(', "val_loss": '), F.col("value").cast("string"), F.lit(', "lr": "n/a"}'))
    return F.when(F.col("event_type") == "view", good).when(F.col("event_type") == "click", F.concat(F.lit('broken {"epoch": '), key)).otherwise(F.concat(F.lit("log "), "props"))


@query("stream_log_metrics", "SELECT user_id AS job_id, event_id AS seq, CAST(event_id AS DOUBLE) AS epoch, value AS val_loss, CAST(0 AS DOUBLE) AS lr FROM events WHERE event_type = 'view'")
def _(t):
    lines = event_stream(t).select("job_id", "seq", log_line().alias("line"))
    return J.run_available(J.log_metrics(lines), "log-metrics").select("job_id", "seq", "epoch", "val_loss", "lr")


@query("stream_job_progress", """SELECT job_id, seq, status, CASE WHEN status = 'completed' THEN 1.0 ELSE least(greatest(value / 400.0, 0), 1) END AS progress FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY seq DESC) AS r FROM job_events) WHERE r = 1""", "job_events")
def _(t):
    states = J.run_available(J.stream_job_states(event_stream(t)), "progress", "update")
    progress = F.when(F.col("status") == "completed", 1.0).otherwise(J.progress_of(F.col("current"), F.col("total")))
    return states.select("job_id", "seq", "status", progress.alias("progress"))


FINAL = """(SELECT job_id, status, seq FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY job_id ORDER BY CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN 0 ELSE 1 END,
  CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN seq ELSE -seq END) AS r FROM {events}) WHERE r = 1)"""


@query("stream_job_state_machine", f"SELECT * FROM {FINAL.format(events='job_events')}", "job_events")
def _(t):
    states = J.run_available(J.stream_job_states(event_stream(t)), "states", "update")
    return states.select("job_id", F.col("final_status").alias("status"), F.col("final_seq").alias("seq"))


@query("active_job_guard", f"SELECT DISTINCT job_id // 2 AS dataset_id FROM job_events WHERE job_id // 2 NOT IN (SELECT job_id // 2 FROM {FINAL.format(events='job_events')} WHERE status NOT IN ('completed', 'failed', 'cancelled'))", "job_events")
def _(t):
    dataset = F.floor(F.col("job_id") / 2).alias("dataset_id")
    states = J.final_state(t.job_events).select("status", dataset)
    return J.active_job_guard(t.job_events.select(dataset).distinct(), states)


@query("job_history", "SELECT job_id, epoch_us(MIN(event_time)) AS created FROM job_events GROUP BY job_id ORDER BY created DESC, job_id", "job_events")
def _(t):
    created = t.job_events.groupBy("job_id").agg(F.unix_micros(F.min("event_time").cast("timestamp")).alias("created"))
    return J.job_history(created)


# ---- augmentation -------------------------------------------------------------------

def draw_sql(op, seed="sample_seed"):
    return f"(('0x' || substr(md5(CAST({seed} AS VARCHAR) || ':{op}'), 1, 8))::BIGINT / 4294967296.0)"


def factor_sql(op, amount):
    return f"1.0 + ({draw_sql(op)} * 2.0 - 1.0) * {amount}"


def digits_sql(e):
    return f"concat(CAST(CAST(round_even({e} * 100, 0) AS INT) // 100 AS VARCHAR), '.', lpad(CAST(CAST(round_even({e} * 100, 0) AS INT) % 100 AS VARCHAR), 2, '0'))"


PLAN = f"""SELECT sample_id, sample_seed, hflip, vflip, turns, concat_ws(', ', CASE WHEN hflip THEN 'hflip' END, CASE WHEN vflip THEN 'vflip' END, CASE WHEN turns > 0 THEN concat('rotate90x', CAST(turns AS VARCHAR)) END,
  concat('scale=', {digits_sql('scale')}), concat('brightness=', {digits_sql('brightness')}), concat('contrast=', {digits_sql('contrast')})) AS applied FROM (
  SELECT *, {draw_sql('hflip')} < 0.5 AS hflip, {draw_sql('vflip')} < 0.5 AS vflip, CAST(floor({draw_sql('rotate90')} * 4) AS INT) AS turns, {factor_sql('scale', 0.15)} AS scale, {factor_sql('brightness', 0.12)} AS brightness, {factor_sql('contrast', 0.12)} AS contrast
  FROM (SELECT sample_id, 42 + 101 * (ROW_NUMBER() OVER (ORDER BY sample_id) - 1) AS sample_seed FROM samples))"""


@query("augment_plan", PLAN, "samples")
def _(t):
    return augment.augment_plan(t.samples, "sample_id").select("sample_id", "sample_seed", "hflip", "vflip", "turns", "applied")


@query("augment_flip_rot", """SELECT image_id, y, COUNT(*) AS pixels, CAST(SUM(cls * (x + 1)) AS BIGINT) AS checksum FROM (
  SELECT image_id, cls, CASE image_id % 4 WHEN 1 THEN width - 1 - fx WHEN 2 THEN height - 1 - fy WHEN 3 THEN fx ELSE fy END AS y, CASE image_id % 4 WHEN 1 THEN fy WHEN 2 THEN width - 1 - fx WHEN 3 THEN height - 1 - fy ELSE fx END AS x FROM (
    SELECT m.image_id, m.cls, i.width, i.height, CASE WHEN m.image_id % 2 = 0 THEN i.width - 1 - m.x ELSE m.x END AS fx, CASE WHEN m.image_id % 3 = 0 THEN i.height - 1 - m.y ELSE m.y END AS fy FROM mask_pixels m JOIN images i USING (image_id))) GROUP BY image_id, y""", "mask_pixels images")
def _(t):
    image = F.col("image_id")
    pixels = t.mask_rows.select("image_id", "width", "height", "y", F.posexplode_outer("cls").alias("x", "cls"))
    turned = augment.flip_rotate(pixels, image % 2 == 0, image % 3 == 0, image % 4)
    return turned.groupBy("image_id", "y").agg(F.count("*").alias("pixels"), F.sum(F.col("cls") * (F.col("x") + 1)).alias("checksum"))


def scaled_axis(i, size):
    new = f"CAST(greatest(round_even({size} * factor, 0), 1) AS INT)"
    crop, paste = f"greatest(({new} - {size}) // 2, 0)", f"CAST(floor(({size} - {new}) / 2) AS INT)"
    position = f"(CASE WHEN factor >= 1 THEN {i} + {crop} ELSE {i} - {paste} END)"
    return f"CASE WHEN {position} >= 0 AND {position} < {new} THEN least(CAST(floor(({position} + 0.5) * {size} / {new}) AS INT), {size} - 1) END"


@query("augment_scale", f"""SELECT g.image_id, g.y, COUNT(*) AS pixels, CAST(SUM(coalesce(m.cls, 255) * (g.x + 1)) AS BIGINT) AS checksum FROM (
  SELECT image_id, y, x, {scaled_axis('y', 'height')} AS sy, {scaled_axis('x', 'width')} AS sx FROM (SELECT *, CAST(0.85 + (image_id % 7) * 0.05 AS DOUBLE) AS factor FROM grid)) g
  LEFT JOIN mask_pixels m ON m.image_id = g.image_id AND m.y = g.sy AND m.x = g.sx GROUP BY ALL""", "mask_pixels grid")
def _(t):
    scaled = augment.scale_rows(t.mask_rows, (F.lit(0.85) + (F.col("image_id") % 7) * F.lit(0.05)).cast("double"))
    pixels = scaled.select("image_id", "y", F.posexplode_outer("cls").alias("x", "cls"))
    return pixels.groupBy("image_id", "y").agg(F.count("*").alias("pixels"), F.sum(F.col("cls") * (F.col("x") + 1)).alias("checksum"))


CLIP = "least(greatest({0}, 0), 255)"


@query("augment_photometric", f"""SELECT image_id, y, round_even(SUM(v1), 3) + 0.0 AS s1, round_even(SUM(v2), 3) + 0.0 AS s2, round_even(SUM(v3), 3) + 0.0 AS s3 FROM (
  SELECT image_id, y, x, {', '.join(CLIP.format(CLIP.format(f'(l{b} - mean) * 0.9 + mean') + ' + z') + f' AS v{b}' for b in (1, 2, 3))} FROM (
    SELECT *, sqrt(-2.0 * ln((('0x' || substr(h, 1, 8))::BIGINT + 1.0) / 4294967297.0)) * cos((('0x' || substr(h, 9, 8))::BIGINT + 1.0) / 4294967297.0 * 6.283185307179586) * 5.1 AS z FROM (
      SELECT *, md5(concat('42:', CAST(image_id AS VARCHAR), ':', CAST(y AS VARCHAR), ':', CAST(x AS VARCHAR))) AS h FROM (
        SELECT image_id, y, x, CAST({CLIP.format('b1 * 1.1')} AS DOUBLE) AS l1, CAST({CLIP.format('b2 * 1.1')} AS DOUBLE) AS l2, CAST({CLIP.format('b3 * 1.1')} AS DOUBLE) AS l3 FROM rgb_pixels)
      JOIN (SELECT image_id, round_even(AVG(CAST(0.299 AS DOUBLE) * {CLIP.format('b1 * 1.1')} + CAST(0.587 AS DOUBLE) * {CLIP.format('b2 * 1.1')} + CAST(0.114 AS DOUBLE) * {CLIP.format('b3 * 1.1')}), 6) AS mean FROM rgb_pixels GROUP BY image_id) USING (image_id)))) GROUP BY image_id, y""", "rgb_pixels")
def _(t):
    shown = augment.photometric(t.blocks, t.rgb_pixels_of, F.lit(1.1), F.lit(0.9), 0.02, 42)
    total = lambda i: (F.bround(F.sum(F.element_at("bands", i)), 3) + 0.0).alias(f"s{i}")
    return shown.groupBy("image_id", "y").agg(total(1), total(2), total(3))


# ---- sinks and the scorer slot ------------------------------------------------------

@query("write_index", """SELECT patch_id, source_tif, split FROM (SELECT patch_id, source_tif, CASE WHEN r < CAST(floor(CAST(n AS DOUBLE) * 0.8) AS BIGINT) THEN 'train' WHEN r < CAST(floor(CAST(n AS DOUBLE) * 0.8) AS BIGINT) + CAST(floor(CAST(n AS DOUBLE) * 0.1) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM (
  SELECT *, ROW_NUMBER() OVER (ORDER BY md5('42:' || CAST(patch_id AS VARCHAR)), patch_id) - 1 AS r, COUNT(*) OVER () AS n FROM patches))""", "patches")
def _(t):
    path = f"{scratch_dir(t.spark)}/index-{uuid.uuid4().hex}"
    rows = splits.split_assign_floor(t.patches.select("patch_id", "source_tif"), "patch_id")
    files.write_index(rows, path, ("patch_id", "source_tif", "split"), files_per_split=4)
    return t.spark.read.schema("patch_id bigint, source_tif string, split string").parquet(path)


@query("read_summary", f"SELECT ROW_NUMBER() OVER (ORDER BY image_id) AS id, CAST(image_id AS VARCHAR) AS sample_id, miou, macro_f1 FROM ({metric_sql('image_id', 'mask_pairs', 3)})", "mask_pairs")
def _(t):
    scores = rounded(metrics.seg_metrics(t.mask_pairs, ["image_id"], 3), ["image_id"])
    path = f"{scratch_dir(t.spark)}/summary-{uuid.uuid4().hex}"
    files.summary_texts(scores, "image_id", ["miou", "macro_f1"], chunk=1 << 30).select("summary").write.text(path)
    return files.read_summary(t.spark, path).select("id", "sample_id", F.col("metrics")["miou"].alias("miou"), F.col("metrics")["macro_f1"].alias("macro_f1"))


@query("model_scorer", "SELECT image_id, CAST(width // 4 AS BIGINT) AS x1, CAST(height // 4 AS BIGINT) AS y1, CAST(width // 4 + greatest(width // 2, 1) AS BIGINT) AS x2, CAST(height // 4 + greatest(height // 2, 1) AS BIGINT) AS y2, CAST(1 AS DOUBLE) AS score FROM images", "images")
def _(t):
    """The scorer slot with its built-in stand-in: the middle half of every image, score 1."""

    def score(pdf):
        w, h = pdf["width"], pdf["height"]
        x1, y1 = w // 4, h // 4
        return pdf[["image_id"]].assign(x1=x1, y1=y1, x2=x1 + (w // 2).clip(lower=1), y2=y1 + (h // 2).clip(lower=1), score=1.0)

    return tile_map(t.images.select("image_id", "width", "height"), score, "image_id bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint, score double")
