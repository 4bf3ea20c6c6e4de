"""NULL keys, limits, empty selections, corner-connected regions, large proposal lists."""

import random

from pyspark.sql import functions as F

from parcelworks.functions import paths as P
from parcelworks.operators import annotations, catalog, greedy, ordering, quantiles, raster
from parcelworks.operators import vector as V
from parcelworks.streaming.jobs import log_tail


def test_null_keys_keep_their_rows(spark):
    df = spark.createDataFrame([(1, "a", 5), (None, "a", 6), (3, None, 7), (4, None, 8)], "id long, k string, v long")
    assert sorted(r.rank0 for r in ordering.rank_by_draw(df, 1, "id").collect()) == [0, 1, 2, 3]
    assert sorted((r.rank0, r.id) for r in ordering.rank_by_id(df, "id").collect())[0] == (0, None)
    assert {(r.k, r.v, r.low) for r in ordering.running_before(df, "k", "v", {"low": ("min", F.col("v"))}).collect()} == {("a", 5, None), ("a", 6, 5), (None, 7, None), (None, 8, 7)}
    assert {(r.v, r.previous) for r in ordering.previous_value(df, "k", "v", "v").collect()} == {(5, None), (6, 5), (7, None), (8, 7)}
    assert {(r.k, r.m) for r in quantiles.exact_quantiles(df, ["k"], F.col("v"), {"m": 0.5}).collect()} == {("a", 5.5), (None, 7.5)}


def test_reports_are_complete(spark):
    ids = spark.range(70).select(F.col("id").alias("sample"), F.lit("x").alias("image_path"), F.lit("y").alias("mask_path"))
    nothing = spark.createDataFrame([], "path string")
    assert catalog.missing_paths(ids, nothing, "sample").count() == 70 and catalog.missing_paths(ids, nothing, "sample", 3).count() == 3
    assert raster.invalid_labels(spark.range(100, 160).select(F.col("id").alias("cls")), 3).count() == 60
    events = spark.createDataFrame([(j, s, f"m{s}") for j in (1, None) for s in range(200)], "job_id long, seq long, line string")
    assert log_tail(events).count() == 400 and log_tail(events, 5).count() == 10


def test_long_phrases_and_names(spark):
    captions = spark.createDataFrame([(1, "a big red round barn stands")], "id long, text string")
    words = spark.createDataFrame([("big red round barn", "barn4"), ("cat", "cat")], "phrase string, name string")
    assert annotations.caption_features(captions, "id", "text", words).first()["features"] == ["barn4"]
    names = spark.createDataFrame([("n" * 90 + "a",), ("n" * 90 + "b",), ("short",)], "n string").select(P.safe_name(F.col("n"), 80).alias("s")).collect()
    assert len({r.s for r in names}) == 3 and max(len(r.s) for r in names) == 80 and names[2].s == "short"


def test_empty_selections(spark):
    none = spark.createDataFrame([], "image_id long, key long, x1 double, y1 double, x2 double, y2 double, base double, score double, area double, area_score double, center_distance double")
    assert greedy.diverse_select(none, "image_id", 3).collect() == []
    assert greedy.spatially_diverse_select(none, "image_id", 3, 10.0, 10.0).collect() == []


def test_corner_connected_region_stays_one(spark):
    runs = [(1, 1, y, 0, 5) for y in range(6)] + [(1, 1, y, 6, 11) for y in range(6, 12)]
    labelled = spark.createDataFrame(runs, "image_id long, region long, y int, x_start int, x_end int")
    assert [r.ring_index for r in V.vectorize(labelled, 8).collect()] == [0]
    assert sorted(r.ring_index for r in V.vectorize(labelled, 4).collect()) == [0, 1]
    sizes = spark.createDataFrame([(1, 12, 12)], "image_id long, width int, height int")
    assert sum(r.x_end - r.x_start + 1 for r in V.polygonize_mask(labelled, sizes, 64, 0.0).collect()) >= 66


def test_proposal_groups_of_any_number(spark):
    """1,500 proposals in one image; a smaller list against the plain pair loop."""

    def loop(boxes, width, height):
        groups = [(list(b), [k]) for k, b in enumerate(boxes)]
        while True:
            best = None
            for i in range(len(groups)):
                for j in range(i + 1, len(groups)):
                    a, b = groups[i][0], groups[j][0]
                    u = [min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])]
                    w, h = u[2] - u[0], u[3] - u[1]
                    gap = max(0, max(a[0], b[0]) - min(a[2], b[2]), max(a[1], b[1]) - min(a[3], b[3]))
                    touch = min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])
                    reach = lambda c: max(1.0, ((c[2] - c[0]) ** 2 + (c[3] - c[1]) ** 2) ** 0.5)
                    if (touch or gap <= 0.8 * (reach(a) + reach(b)) / 2) and w / width <= 0.35 and h / height <= 0.35 and w * h / (width * height) <= 0.12 and (best is None or gap < best[0]):
                        best = (gap, i, j, u)
            if best is None:
                return sorted(",".join(map(str, sorted(m))) for _, m in groups)
            _, i, j, u = best
            groups[i] = (u, groups[i][1] + groups[j][1])
            del groups[j]

    rng = random.Random(3)
    box = lambda: (x := rng.uniform(0, 950), y := rng.uniform(0, 950), x + rng.uniform(2, 40), y + rng.uniform(2, 40))
    for seed in range(3):
        boxes = [box() for _ in range(60)]
        df = spark.createDataFrame([(1, k, *b) for k, b in enumerate(boxes)], "image_id long, key long, x1 double, y1 double, x2 double, y2 double")
        assert sorted(r.ids for r in greedy.group_proposals(df, "image_id", 1000.0, 1000.0).collect()) == loop(boxes, 1000.0, 1000.0), seed
    many = spark.createDataFrame([(1, k, *box()) for k in range(1500)], "image_id long, key long, x1 double, y1 double, x2 double, y2 double")
    assert sum(r.members for r in greedy.group_proposals(many, "image_id", 1000.0, 1000.0).collect()) == 1500


def test_kept_boxes_up_to_a_number(spark):
    rng = random.Random(5)
    rows = [(i % 3, i, x := rng.uniform(0, 50), y := rng.uniform(0, 50), x + 10, y + 10, rng.random()) for i in range(90)]
    df = spark.createDataFrame(rows, "image_id long, det_id long, x1 double, y1 double, x2 double, y2 double, score double")

    def iou(a, b):
        w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
        return w * h / (200 - w * h) if w > 0 and h > 0 else 0.0

    want = set()
    for image in range(3):
        chosen = []
        for r in sorted((r for r in rows if r[0] == image), key=lambda r: (-r[6], r[1])):
            if len(chosen) < 4 and all(iou(r, c) < 0.35 for c in chosen):
                chosen.append(r)
        want |= {r[1] for r in chosen}
    kept = greedy.suppress_boxes(df, ["image_id"], "det_id", F.col("score"), 0.35)
    assert {r.det_id for r in greedy.first_kept(kept, df, ["image_id"], "det_id", F.col("score"), 4).collect()} == want
