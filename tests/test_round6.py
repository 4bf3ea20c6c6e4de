"""Cases of the sixth round: odd prices, and joins and stitches that shuffled what need not travel."""

import math
import random
import shutil
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from oracle_check import compare, duck
from parcelworks.operators import masks as M, raster as RA, tiling as TI, vector as V
from parcelworks.operators.sweeps import binaries, contents

SMALL = "/root/testdata/sf0.001"


def test_scores_between_two_thousandths(spark, tmp_path):
    """Odd multiples of 250 are scores in the middle of two thousandths; 0.5015 as a number is a little less, and the SQL rounds it down."""
    for path in Path(SMALL).iterdir():
        if path.name == "orders.parquet":
            spark.read.parquet(str(path)).withColumn("o_totalprice", 250.0 + 500.0 * F.pmod("o_orderkey", F.lit(1000))).write.parquet(str(tmp_path / path.name))
        else:
            shutil.copy(path, tmp_path / path.name)
    con = duck(SMALL)
    con.execute(f"CREATE OR REPLACE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert con.execute("SELECT COUNT(*) FROM orders WHERE o_totalprice = 250750").fetchone()[0]
    outcome = compare("detections_json", spark, con, str(tmp_path), entry.queries(), entry.oracle_sql())
    assert outcome.startswith("ok"), outcome


def test_windows_are_stitched_where_their_scanline_is(spark):
    """Windows of uneven number, narrow images and several batches give the means that a plain loop gives; no pixel is shuffled."""
    sizes = [(1, 70, 9), (2, 5, 3), (None, 33, 40), (4, 16, 16)]
    lines = spark.createDataFrame([(i, w, h, y) for i, w, h in sizes for y in range(h)] + [(5, None, None, 0)], "image_id long, width int, height int, y int").repartition(2)

    def predict(batch, row, x, y0, x0):
        y = batch.column("y").to_numpy()[row]
        return np.stack([(x * (c + 2) + y * (c + 3) + x0 + y0) % 11 / 11.0 for c in range(3)], 1)

    def starts(length, tile, stride):
        last = max(length - tile, 0)
        return sorted({*range(0, last + 1, stride), last})

    want = {}
    for image, width, height in sizes:
        for y in range(height):
            for x in range(width):
                sums = [0.0] * 4
                for y0 in starts(height, 16, 8):
                    for x0 in starts(width, 16, 8):
                        if y0 <= y < y0 + 16 and x0 <= x < x0 + 16:
                            w = math.exp(-((x - x0 - 7.5) ** 2 + (y - y0 - 7.5) ** 2) / 32.0)
                            for c in range(3):
                                sums[c] += w * ((x * (c + 2) + y * (c + 3) + x0 + y0) % 11) / 11.0
                            sums[3] += w
                means = [round(s / sums[3], 9) for s in sums[:3]]
                want[image, y, x] = (means.index(max(means)), max(means))
    for few in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
        stitched = RA.gaussian_stitch(lines, predict, 16, 4, 4.0, 3)
        found = {(r.image_id, r.y, x): (c, p) for r in stitched.collect() for x, (c, p) in enumerate(zip(r.cls, r.prob, strict=True))}
        assert found.keys() == want.keys()
        assert all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 2e-9 for k in want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    # before, every pixel of every window went through a shuffle
    plan = entry.queries()["gaussian_stitch"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(image_id" in plan and ", x#" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


def test_lists_of_equal_rings_go_to_the_boxes(spark):
    """Keys that share a ring go to the boxes as lists, whatever cells of keys they lie in; before, each went there in a row of its own."""
    square = lambda x: [(x, 0.0), (x + 2.0, 0.0), (x + 2.0, 2.0), (x, 2.0), (x, 0.0)]
    keys = [1, 2, -5, (1 << 20) - 1, 1 << 20, 7 << 40]
    features = spark.createDataFrame([(k, square(x)) for x in (0.0, 50.0, 90.0) for k in [int(10 * x) + key for key in keys]] + [(99, None), (None, square(0.0))], "feature_id long, ring array<struct<x:double,y:double>>")
    boxes = spark.createDataFrame([("a", -1.0, -1.0, 1.0, 1.0), ("b", -1.0, -1.0, 1.0, 1.0), ("c", 0.0, 0.0, 60.0, 60.0), ("d", 70.0, 0.0, 80.0, 9.0)], "box string, x1 double, y1 double, x2 double, y2 double")
    met = V.folded_ring_box_join(features, boxes, "box", 4.0)
    want = [(k, b) for b in "abc" for k in [*keys, None]] + [(500 + k, "c") for k in keys]
    assert sorted(map(repr, ((r.feature_id, r.box) for r in met.collect()))) == sorted(map(repr, want))
    sent = [line for line in met._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert len(sent) == 1 and "_places" in met._jdf.queryExecution().optimizedPlan().toString()


def test_tiles_merge_in_order(spark):
    """Cores overwrite, overlaps fill zeros, a missing value stays missing, for scanlines cut by batches; before, a scanline's pieces were one list."""
    rng = random.Random(3)
    rows, want = [], {}
    for image, width in ((1, 40), (None, 17), (2, 9)):
        for y in range(12):
            line = [0] * width
            for t, x0 in enumerate(range(0, max(width - 12, 0) + 1, 7)):
                w = min(12, width - x0)
                vals = [rng.choice([0, 0, 1, 2, None]) for _ in range(w)]
                rows.append((image, width, t, 0, t, 1, 5, x0, 0, w, 12, y, vals))
                for k, v in enumerate(vals):
                    core = k >= (4 if t > 0 else 0) and k < w - (4 if t < 4 else 0)
                    if core or line[x0 + k] == 0:
                        line[x0 + k] = v
            want[image, y] = line
    rng.shuffle(rows)
    columns = "image_id long, width int, tile_index int, row int, col int, n_rows int, n_cols int, x0 int, y0 int, tile_width int, tile_height int, y int, vals array<int>"
    tiles = spark.createDataFrame(rows, columns).repartition(3)
    for few in ("5", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
        merged = TI.merge_tiles_core(tiles, 8)
        assert {(r.image_id, r.y): list(r.cls) for r in merged.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "collect_list" not in merged._jdf.queryExecution().toString()


def test_the_mean_goes_to_the_scanlines(spark):
    """The mean of an image is joined to its scanlines; before, every pixel went through a shuffle to meet it."""
    plan = entry.queries()["augment_photometric"](spark, SMALL)._jdf.queryExecution().optimizedPlan()
    text = plan.toString()
    joined = text[text.index("Join Inner") :]
    left = joined[: joined.index("Aggregate")]
    assert "_b1" not in left and " x#" not in left


def test_packets_are_short():
    """A row of a packet takes the bytes that its values need beside the least ones; before, four for each column. Any part of a column can be read."""
    rng = np.random.default_rng(0)
    for width in (3, 4):
        for most in (1, 200, 70000, 2**31 - 1):
            table = rng.integers(-most, most, (1000, width)).astype(np.int32)
            table[:300, 0] = 5
            first = np.unique(np.append(0, rng.integers(0, 1000, 50)))
            packed = binaries(table, first)
            ends = np.append(first, 1000)
            mixed = pa.concat_arrays([packed.slice(3, 10), pa.array([b"", None], pa.binary()), binaries(table[:5] * 0, np.array([0, 2])), packed.slice(20, 5)]).slice(1)
            found, at = contents(mixed, width)
            assert (found == np.concatenate([table[ends[4] : ends[13]], table[:5] * 0, table[ends[20] : ends[25]]])).all()
            assert at[0] == 0 and at[-1] == len(mixed) - 1 and (np.diff(at) >= 0).all()
            assert (contents(packed, width)[0] == table).all()
    rows = np.stack([np.arange(6400) // 100, np.arange(6400) % 100 * 3, np.tile([1, -1], 3200)], 1)
    assert sum(len(b) for b in binaries(rows, np.zeros(1, np.int64)).to_pylist()) < 5 * 6400


def test_painting_on_packets(spark, monkeypatch):
    """The winner of every pixel, null images and values included, whatever parts a crowded cell is cut into; before, the pieces of a cell were gathered in lists."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 2, None]), y, x, x + rng.randint(0, 90), rng.choice([None, *range(40)])) for y in (0, 3, 63, 64, 130) for x in [rng.randint(0, 100) for _ in range(60)]]
    runs = spark.createDataFrame(rows, "image_id long, y int, x_start int, x_end int, v int").repartition(3)
    for highest in (True, False):
        want = {}
        for image, y, start, end, v in rows:
            for x in range(start, end + 1):
                old = want.setdefault((image, y, x), v)
                if v is not None and (old is None or (v > old if highest else v < old)):
                    want[image, y, x] = v
        for few in (3, 512):
            monkeypatch.setattr(M, "PAINTED", few)
            painted = M.paint(runs, "v", highest)
            found = [((r.image_id, r.y, x), r.v) for r in painted.collect() for x in range(r.x_start, r.x_end + 1)]
            assert len(found) == len(want) and dict(found) == want
        assert "collect_list" not in painted._jdf.queryExecution().toString()
