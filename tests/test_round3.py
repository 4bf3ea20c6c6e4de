"""Cases of the third round: keys beyond one part, generated sides, overlapping layers, distinct values with weights."""

import shutil
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry
from oracle_check import compare, duck
from parcelworks.operators import components as C, masks as M, raster as RA
from parcelworks.operators.quantiles import exact_quantiles

SMALL = "/root/testdata/sf0.001"
KEYS = {"orders": ["o_orderkey"], "customer": ["c_custkey"]}


@pytest.fixture(scope="module")
def shifted(spark, tmp_path_factory):
    """Tables of sf0.001 whose orders and customers lie on both sides of key 50,000."""
    folder = tmp_path_factory.mktemp("shifted")
    for path in Path(SMALL).glob("*.parquet"):
        keys = KEYS.get(path.stem)
        if keys:
            df = spark.read.parquet(str(path))
            df.withColumns({k: F.col(k) + 49950 for k in keys}).write.parquet(str(folder / path.name))
        else:
            shutil.copy(path, folder / path.name)
    return str(folder)


@pytest.mark.parametrize("name", ["detections_json", "geojson_features"])
def test_parts_end_where_the_sql_ends_them(spark, shifted, name):
    con = duck(SMALL)
    for table in KEYS:
        con.execute(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{shifted}/{table}.parquet/*.parquet'")
    outcome = compare(name, spark, con, shifted, entry.queries(), entry.oracle_sql())
    assert outcome.startswith("ok"), outcome


def joins(df):
    """Names of the joins in the plan that Spark would run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {name for name in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") if name in plan}


def runs(spark, rows, *columns):
    return spark.createDataFrame(rows, ", ".join(["image_id bigint", "y int", "x_start int", "x_end int", *columns]))


def test_painting_broadcasts_no_runs(spark):
    """The cuts of a row were joined to its runs, which Spark took for small; now painting joins nothing."""
    painted = M.paint(runs(spark, [(1, 0, 0, 9, 1), (1, 0, 4, 70, 2), (1, 0, 4, 5, 7), (1, 0, 80, 81, None)], "v int"), "v")
    assert not joins(painted)
    assert sorted(tuple(r) for r in painted.collect()) == [(1, 0, 0, 3, 1), (1, 0, 4, 5, 7), (1, 0, 6, 9, 2), (1, 0, 10, 63, 2), (1, 0, 64, 70, 2), (1, 0, 80, 81, None)]


def test_painted_runs_meet_their_labels_by_merge(spark):
    mask_runs = runs(spark, [(1, 0, 0, 9, 5), (1, 0, 4, 12, 6)], "mask_id bigint")
    masks = spark.createDataFrame([(1, 5, 10, 2, 0), (1, 6, 9, 2, 1)], "image_id bigint, mask_id bigint, area bigint, n bigint, rank0 bigint")
    painted = M.paint_order_unique_area(mask_runs, masks)
    assert joins(painted) == {"SortMergeJoin"}
    assert sorted(tuple(r) for r in painted.collect()) == [(1, 0, 0, 3, 2), (1, 0, 4, 9, 1), (1, 0, 10, 12, 1)]


def test_region_intensity_opens_scanlines_not_a_pixel_join(spark):
    labelled = runs(spark, [(1, 0, 1, 3, 9), (1, 1, 0, 0, 9)], "region bigint")
    rows = spark.createDataFrame([(1, 0, [5, 1, 2, 9]), (1, 1, [4, 0, 0, 0])], "image_id bigint, y int, `values` array<int>")
    assert tuple(C.region_intensity(labelled, rows).select("v_min", "v_mean", "v_max", "v_median").first()) == (1.0, 4.0, 9.0, 3.0)


def test_stretched_scanlines_are_not_broadcast(spark):
    rows = spark.createDataFrame([(1, y, [[x, 2 * x] for x in range(30)]) for y in range(3)], "image_id bigint, y int, bands array<array<int>>")
    stretched = RA.stretch_rows(rows)
    top = stretched._jdf.queryExecution().executedPlan().toString().split("SortMergeJoin")
    assert len(top) > 1 and "BroadcastHashJoin" not in top[0]


def test_reprojected_pixels_are_not_broadcast(spark):
    found = entry.queries()["reproject_nearest"](spark, SMALL)
    assert joins(found) == {"SortMergeJoin"}


def test_weighted_values_stand_for_rows(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), ((F.col("id") * 37) % 11).cast("double").alias("v"))
    folded = df.groupBy("k", "v").agg(F.count("*").alias("n"))
    probs = {"a": 0.02, "b": 0.5, "c": 0.98}
    assert sorted(exact_quantiles(df, ["k"], F.col("v"), probs).collect()) == sorted(exact_quantiles(folded, ["k"], F.col("v"), probs, weight=F.col("n")).collect())
    shown = RA.stretch_2_98(folded, ["k"], F.col("n")).groupBy("k", "level").agg(F.sum("n").alias("n"))
    assert sorted(shown.collect()) == sorted(RA.stretch_2_98(df, ["k"]).groupBy("k", "level").agg(F.count("*").alias("n")).collect())


def test_equal_boxes_and_rings_meet_once(spark, monkeypatch):
    """Ten images on one place and twenty copies of a ring were 200 pairs of the join; now they are one."""
    from parcelworks.operators import vector as V

    images = spark.range(11).select(F.col("id").alias("image_id"), F.concat(F.lit("i"), "id").alias("image_name"), F.lit(10).alias("width"), F.lit(10).alias("height"),
                                    F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.when(F.col("id") < 10, 0.0).otherwise(500.0).alias("c"), F.lit(0.0).alias("d"), F.lit(-1.0).alias("e"), F.lit(10.0).alias("f"))
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 1.0), (4.0, 1.0), (4.0, 14.0), (1.0, 1.0))))
    features = spark.range(21).select(F.col("id").alias("feature_id"), F.when(F.col("id") < 20, ring).alias("ring"))
    pairs, plain = [], V.ring_box_join
    monkeypatch.setattr(V, "ring_box_join", lambda *a: pairs.append(plain(*a)) or pairs[-1])
    found = {r.image_id: (r.overlap_polygon_count, r.has_overlap) for r in V.overlap_report(images, features, 64.0).collect()}
    assert found == {i: (20, True) for i in range(10)} | {10: (0, False)}
    assert pairs[0].count() == 1


def test_folded_join_opens_every_pair(spark, monkeypatch):
    from parcelworks.operators import vector as V

    boxes = spark.createDataFrame([(k, 0.0, 0.0, 10.0, 10.0) for k in range(6)] + [(9, 90.0, 90.0, 99.0, 99.0)], "box bigint, x1 double, y1 double, x2 double, y2 double")
    ring = F.array(*(F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 1.0), (4.0, 1.0), (4.0, 14.0), (1.0, 1.0))))
    features = spark.range(6).select(F.col("id").alias("feature_id"), F.when(F.col("id") < 5, ring).alias("ring"))
    pairs, plain = [], V.ring_box_join
    monkeypatch.setattr(V, "ring_box_join", lambda *a: pairs.append(plain(*a)) or pairs[-1])
    found = sorted(tuple(r) for r in V.folded_ring_box_join(features, boxes, "box", 64.0).collect())
    assert found == [(f, b) for f in range(5) for b in range(6)]
    assert pairs[0].count() == 1
