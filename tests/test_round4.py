"""Cases of the fourth round: the registry without a session, and what large inputs must keep."""

import random
import subprocess
import sys
from pathlib import Path

from parcelworks.operators import greedy as G, masks as M

ROOT = Path(__file__).resolve().parents[1]


def test_registry_needs_no_session():
    """A driver reads the names before it starts Spark, so no column may be built while a module is loaded."""
    code = "import __spark_entry__ as e; assert len(e.queries()) > 200 and len(e.oracle_sql()) > 150"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_grouping_of_many_small_images(spark, monkeypatch):
    """Plain numbers and arrays give the same groups, whatever batch an image is cut by; no call for each image."""
    rng = random.Random(11)
    rows = []
    for image in [None, *range(60)]:
        for key in range(1 + (image or 0) % 45):
            x, y = rng.randint(0, 200), rng.randint(0, 200)
            rows.append((image, 1000 * (image or 0) + key, float(x), float(y), float(x + rng.randint(4, 40)), float(y + rng.randint(4, 40))))
    boxes = spark.createDataFrame(rows, "image_id long, key long, x1 double, y1 double, x2 double, y2 double")
    grouped = lambda: G.group_proposals(boxes, "image_id", 256.0, 256.0)
    assert "FlatMapGroups" not in grouped()._jdf.queryExecution().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    found = []
    for few in (0, 20, 1000):
        monkeypatch.setattr(G, "FEW", few)
        found.append(sorted(map(repr, grouped().collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] == found[2] and len(found[0]) > 200


def test_overlaps_travel_as_packets(spark):
    """Masks with gaps, across cells, at negative places and in several batches share the pixels that a plain loop counts; runs are not shuffled."""
    rng = random.Random(5)
    rows = [(image, mask, y, x, x + rng.randint(0, 90)) for image in (1, 2) for mask in range(12) for y in range(-70, 140, 3) for x in (rng.randint(-200, -120), rng.randint(0, 40), rng.randint(140, 180)) if rng.random() < 0.7]
    rows += [(None, 1, 0, 0, 5), (1, None, 0, 0, 5), (1, 3, 500, 9, 4)]
    runs = spark.createDataFrame(rows, "image_id long, mask_id long, y int, x_start int, x_end int").repartition(3)
    want = {}
    for i, a, y, s, e in rows[:-3]:
        for j, b, z, u, v in rows[:-3]:
            if i == j and a < b and y == z and (common := min(e, v) - max(s, u) + 1) > 0:
                want[i, a, b] = want.get((i, a, b), 0) + common
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    pairs = M.mask_overlap_join(runs)
    assert {(r.image_id, r.id_a, r.id_b): r.common for r in pairs.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "_runs" in pairs._jdf.queryExecution().toString()
