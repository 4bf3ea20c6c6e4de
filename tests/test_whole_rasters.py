"""Queries over every band and every class; their SQL twins are compared in test_queries."""

import __spark_entry__ as entry
from parcelworks.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"


def test_every_band_is_stretched_and_merged(spark):
    pixels = Tables(spark, FOLDER).rgb_pixels.count()
    rows = entry.queries()["stretch_2_98_bands"](spark, FOLDER).groupBy("band").sum("n").collect()
    assert {r["band"]: r["sum(n)"] for r in rows} == {b: pixels for b in (1, 2, 3)}
    assert {r.band for r in entry.queries()["mosaic_bands"](spark, FOLDER).select("band").distinct().collect()} == {1, 2, 3}


def test_every_class_is_joined(spark):
    classes = {v for r in Tables(spark, FOLDER).mask_rows.select("cls").collect() for v in r.cls}
    assert {r.cls for r in entry.queries()["pixel_grid_classes"](spark, FOLDER).select("cls").distinct().collect()} == classes
