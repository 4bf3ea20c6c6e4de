"""Set operations on layers, passes, sources and pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelworks.functions import projection as PJ


def union_layers(layers: list[tuple[DataFrame, str]], ring: str = "ring") -> DataFrame:
    """Concatenate polygon layers in the CRS of the first one; columns are unioned.

    ``layers`` pairs each table with its CRS name; empty layers may be left out by the caller.
    """
    target = layers[0][1]

    def align(layer: DataFrame, crs: str) -> DataFrame:
        if crs == target:
            return layer

        def move(p: Column) -> Column:
            x, y = PJ.crs_transform(crs, target, p["x"], p["y"])
            return F.struct(x.alias("x"), y.alias("y"))

        return layer.withColumn(ring, F.transform(ring, move))

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (align(d, c) for d, c in layers))


def union_passes(second: DataFrame, first: DataFrame) -> DataFrame:
    """Second-pass additions below, first-pass masks on top (painted last)."""
    return second.withColumn("paint_pass", F.lit(0)).unionByName(first.withColumn("paint_pass", F.lit(1)))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    tagged = [df.withColumn("source", F.lit(name)) for name, df in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def vocab_except(candidates: DataFrame, excluded: DataFrame, name: str) -> DataFrame:
    return candidates.join(excluded.select(name).distinct(), name, "left_anti")
