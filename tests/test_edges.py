"""Edge cases and the file and stream edges."""

import json

import pytest
from pyspark.sql import functions as F

from parcelworks.operators import metrics, selection, splits, tiling, vector as V
from parcelworks.sources import files
from parcelworks.streaming import jobs as J


def test_image_smaller_than_one_tile(spark):
    images = spark.createDataFrame([(1, 30, 20)], "image_id bigint, width int, height int")
    row = tiling.tile_grid(images, 64, 8).collect()
    assert [(r.x0, r.y0, r.tile_width, r.tile_height) for r in row] == [(0, 0, 30, 20)]
    assert tiling.tile_count(images, 64, 8).first().windows == 1


def test_last_window_is_snapped(spark):
    images = spark.createDataFrame([(1, 1000, 512)], "image_id bigint, width int, height int")
    assert sorted(r.x0 for r in tiling.tile_grid(images, 512, 64).collect()) == [0, 384, 488]


def test_no_images_still_count_one(spark):
    images = spark.createDataFrame([], "image_id bigint, width int, height int")
    assert tiling.total_tiles(images, 64, 8).first().total == 1


def test_all_ignored_mask(spark):
    rows = spark.createDataFrame([(1, y, 8, 4, [255] * 8) for y in range(4)], "image_id bigint, y int, width int, height int, cls array<int>")
    r = tiling.patch_ratios(tiling.patch_counts(rows, 8, 0)).first()
    assert (r.ignore_ratio, r.interior_ratio, r.cropland_ratio) == (1.0, 0.0, 0.0)
    scores = metrics.seg_metrics(rows.select(F.explode("cls").alias("truth"), F.lit(1).alias("pred")), [], 3).first()
    assert scores.pixel_accuracy == 0.0 and scores.miou == 0.0


def test_empty_vector_layer(spark):
    empty = spark.createDataFrame([], "feature_id bigint, image_id bigint, ring array<struct<x:double,y:double>>, width int, height int")
    images = spark.createDataFrame([(1, "a.tif", 10, 10, 1.0, 0.0, 0.0, 0.0, -1.0, 10.0)], "image_id bigint, image_name string, width int, height int, a double, b double, c double, d double, e double, f double")
    assert V.rasterize_field_boundary(empty).count() == 0
    report = V.overlap_report(images, empty.drop("image_id", "width", "height"), 16.0).first()
    assert (report.overlap_polygon_count, report.has_overlap) == (0, False)


def test_polygon_outside_the_image(spark):
    ring = [{"x": x, "y": y} for x, y in ((50.0, 50.0), (60.0, 50.0), (60.0, 60.0), (50.0, 50.0))]
    df = spark.createDataFrame([(1, ring, 10, 10)], "feature_id bigint, ring array<struct<x:double,y:double>>, width int, height int")
    assert V.rasterize_binary(df, ["feature_id"]).count() == 0


def test_all_touched_adds_edge_cells(spark):
    ring = [{"x": x, "y": y} for x, y in ((1.6, 1.6), (3.4, 1.6), (3.4, 3.4), (1.6, 3.4), (1.6, 1.6))]
    df = spark.createDataFrame([(1, ring, 10, 10)], "image_id bigint, ring array<struct<x:double,y:double>>, width int, height int")
    cells = lambda touched: {(r.y, x) for r in V.rasterize_binary(df, ["image_id"], touched).collect() for x in range(r.x_start, r.x_end + 1)}
    assert cells(False) == {(2, 2)} and cells(True) == {(y, x) for y in (1, 2, 3) for x in (1, 2, 3)}


def test_split_sizes_and_repeatability(spark):
    units = spark.range(13).withColumnRenamed("id", "unit")
    one = {r.unit: r.split for r in splits.split_assign_round(units, "unit").collect()}
    two = {r.unit: r.split for r in splits.split_assign_round(units.repartition(7), "unit").collect()}
    assert one == two and sorted(one.values()).count("train") == 10 and list(one.values()).count("val") == 1


def test_quantile_pick_middle_and_short_lists(spark):
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "id bigint, v double")
    assert [r.id for r in selection.quantile_pick(rows, "v", "id", 1).collect()] == [2]
    assert selection.quantile_pick(rows, "v", "id", 9).count() == 5


def test_eval_rows_fall_back_to_all(spark):
    rows = spark.createDataFrame([(i, "train") for i in range(6)], "sample_id bigint, split string")
    assert selection.select_eval_rows(rows, "sample_id", 4).count() == 4


def test_weighted_sample_prefers_heavy_buckets(spark):
    rows = spark.createDataFrame([(i, "boundary_rich" if i % 2 else "near_background", 1) for i in range(400)], "sample_id bigint, bucket string, use_for_train int")
    drawn = selection.weighted_sample(rows, "sample_id")
    share = drawn.filter("bucket = 'boundary_rich'").count() / drawn.count()
    assert drawn.count() == 400 and 0.8 < share < 1.0


def test_manifest_and_index_files(spark, tmp_path):
    (tmp_path / "m.csv").write_text("image_path,mask_path,split,country,sample_id\nfr/a.tif,,Train,,\n/abs/b.tif,m/b.tif,odd,de,s2\n")
    rows = {r.sample_id: r for r in files.read_manifest(spark, str(tmp_path / "m.csv"), "/root/x").collect()}
    assert rows["a"].image_path == "/root/x/fr/a.tif" and rows["a"].country == "fr" and rows["a"].split == "train" and rows["a"].mask_path is None
    assert rows["s2"].split is None and rows["s2"].mask_path == "/root/x/m/b.tif"
    (tmp_path / "p.csv").write_text("patch_name,x,cropland_ratio,ignore_ratio\np1,7.0,0.5,bad\n")
    r = files.read_patch_index(spark, str(tmp_path / "p.csv"), "/d").first()
    assert (r.sample_id, r.x, r.fg_ratio, r.ignore_ratio, r.bucket) == ("p1", 7, 0.5, 0.0, "mid_fg")


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_write_index_partitions_by_split(spark, tmp_path, fmt):
    rows = spark.createDataFrame([("a", 1, "train"), ("b", 2, "val")], "patch_name string, x int, split string")
    files.write_index(rows, str(tmp_path / "out"), ("patch_name", "x", "split"), fmt)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["split=train", "split=val"]


def test_label_files_and_geojson(spark, tmp_path):
    (tmp_path / "t_0000_0001.txt").write_text("1 0.5 0.5 0.25 0.25\n\nshort 1\n")
    r = files.read_label_files(spark, str(tmp_path)).collect()
    assert [(x.label_file, x.class_id, x.w) for x in r] == [("t_0000_0001.txt", 1, 0.25)]
    ring = [[0, 0], [4, 0], [4, 4], [0, 0]]
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"id": 3}, "geometry": {"type": "Polygon", "coordinates": [ring]}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(doc))
    f = files.read_geojson(spark, str(tmp_path / "f.geojson")).first()
    assert f.properties["id"] == "3" and len(f.ring) == 4


def test_listing_skips_masks(spark, tmp_path):
    for name in ("a.tif", "a_mask.tif", "b.PNG", "c.txt"):
        (tmp_path / name).write_text("x")
    assert [r.path.rsplit("/", 1)[1] for r in files.list_files(spark, str(tmp_path)).collect()] == ["a.tif", "b.PNG"]


def test_streams_over_many_batches_equal_batch(spark, tmp_path):
    """Events arrive out of order over four files; state and progress equal the batch forms."""
    rows = [(i, i % 3, ["running", "completed", "running", "failed", "queued"][(i * 7) % 5], float(i % 11)) for i in range(60)]
    schema = "seq bigint, job_id bigint, status string, current double"
    for part in (2, 0, 3, 1):
        spark.createDataFrame(rows[part::4], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ready = lambda df: df.withColumn("total", F.lit(10.0)).withColumn("event_time", F.timestamp_seconds("seq"))
    batch = ready(spark.createDataFrame(rows, schema))
    states = J.run_available(J.stream_job_state_machine(ready(stream)), "t-states", "update")
    key = lambda df: sorted((r.job_id, r.status, r.seq) for r in df.collect())
    assert key(states) == key(J.final_state(batch))
    progress = J.run_available(J.latest_state(ready(stream)), "t-progress", "update")
    assert sorted(map(tuple, progress.select("job_id", "seq", "progress").collect())) == sorted(map(tuple, J.latest_state(batch).select("job_id", "seq", "progress").collect()))


def test_closed_jobs_leave_the_state(spark, tmp_path):
    """Over batches: closed jobs are removed by their timers, late events before that are absorbed, open jobs stay."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    hours = lambda h: start + dt.timedelta(hours=h)
    batches = [
        [(1, 1, "running", hours(0)), (2, 1, "queued", hours(0)), (3, 1, "failed", hours(0))],
        [(1, 3, "completed", hours(1)), (1, 2, "failed", hours(0.9)), (2, 2, "running", hours(1))],
        [(4, 1, "running", hours(60))],
        [(5, 1, "running", hours(61)), (1, 4, "running", hours(2))],  # job 1 is closed and gone: its late event is ignored
        [(2, 3, "completed", hours(62))],
    ]
    folder = tmp_path / "log"
    folder.mkdir()
    schema = "job_id long, seq long, status string, event_time timestamp"
    import os

    for k, rows in enumerate(batches):
        file = folder / f"{k}.parquet"
        spark.createDataFrame(rows, schema).toPandas().to_parquet(file, coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(file, (1_700_000_000 + k, 1_700_000_000 + k))  # read in this order
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withColumn("current", F.lit(1.0)).withColumn("total", F.lit(4.0))
    seen = {}

    def note(df, batch):
        for r in df.collect():
            seen[r.job_id] = (r.seq, r.status, r.final_status, r.final_seq)

    run = J.stream_job_states(stream).writeStream.outputMode("update").foreachBatch(note).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert seen == {1: (3, "completed", "failed", 2), 2: (3, "completed", "completed", 3), 3: (1, "failed", "failed", 1), 4: (1, "running", "running", 1), 5: (1, "running", "running", 1)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in run.recentProgress if p["stateOperators"]]
    assert max(held) >= 3 and held[-1] <= 3  # jobs 1 and 3 are gone; 4 and 5 are open, 2 has just closed
