"""Closed polygon rings (ARRAY<STRUCT<x, y>>, first point repeated at the end)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ring_of(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*(F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points))


def edges(ring: Column) -> Column:
    """ARRAY<STRUCT<ax, ay, bx, by>> of consecutive points."""
    head = F.slice(ring, 1, F.size(ring) - 1)
    tail = F.slice(ring, 2, F.size(ring) - 1)
    return F.zip_with(
        head, tail, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"))
    )


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def signed_area(ring: Column) -> Column:
    return _total(F.transform(edges(ring), lambda g: g["ax"] * g["by"] - g["bx"] * g["ay"])) / 2.0


def area(ring: Column) -> Column:
    return F.abs(signed_area(ring))


def perimeter(ring: Column) -> Column:
    return _total(F.transform(edges(ring), edge_length))


def edge_length(g: Column) -> Column:
    dx, dy = g["bx"] - g["ax"], g["by"] - g["ay"]
    return F.sqrt(dx * dx + dy * dy)


def centroid(ring: Column) -> tuple[Column, Column]:
    """Area centroid; the mean of the points when the area is 0."""
    cross = lambda g: g["ax"] * g["by"] - g["bx"] * g["ay"]
    six = signed_area(ring) * 6.0
    gx = _total(F.transform(edges(ring), lambda g: (g["ax"] + g["bx"]) * cross(g))) / six
    gy = _total(F.transform(edges(ring), lambda g: (g["ay"] + g["by"]) * cross(g))) / six
    count = F.greatest(F.size(ring) - 1, F.lit(1))
    mean = lambda axis: _total(F.transform(F.slice(ring, 1, F.size(ring) - 1), lambda p: p[axis])) / count
    return F.when(six == 0, mean("x")).otherwise(gx), F.when(six == 0, mean("y")).otherwise(gy)


def bounds(ring: Column) -> dict[str, Column]:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "ymin": F.array_min(ys), "xmax": F.array_max(xs), "ymax": F.array_max(ys)}


def rotate_local(ring: Column, cx: Column, cy: Column, degrees: Column, back: bool = False) -> Column:
    """Into axes turned by ``degrees`` around (cx, cy); ``back`` undoes it."""
    cos, sin = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    if back:
        return F.transform(
            ring, lambda p: F.struct((p["x"] * cos - p["y"] * sin + cx).alias("x"), (p["x"] * sin + p["y"] * cos + cy).alias("y"))
        )
    return F.transform(
        ring,
        lambda p: F.struct(
            ((p["x"] - cx) * cos + (p["y"] - cy) * sin).alias("x"), ((p["y"] - cy) * cos - (p["x"] - cx) * sin).alias("y")
        ),
    )


def scale_points(ring: Column, sx: Column, sy: Column) -> Column:
    whole = lambda v: F.bround(v, 0).cast("int")
    return F.transform(ring, lambda p: F.struct(whole(p["x"] * sx).alias("x"), whole(p["y"] * sy).alias("y")))


def long_edge_angle(ring: Column) -> Column:
    """Degrees of the longest edge; the first one wins a tie."""
    ranked = F.transform(
        edges(ring),
        lambda g, i: F.struct(
            ((g["bx"] - g["ax"]) * (g["bx"] - g["ax"]) + (g["by"] - g["ay"]) * (g["by"] - g["ay"])).alias("squared"),
            (-i).alias("order"),
            F.degrees(F.atan2(g["by"] - g["ay"], g["bx"] - g["ax"])).alias("angle"),
        ),
    )
    return F.array_max(ranked)["angle"]


def circle_similar(ring: Column) -> Column:
    """2A/P against P/2pi within (0.9, 1.05)."""
    size, length = area(ring), perimeter(ring)
    ratio = (size * 2.0 / length) / (length / (2.0 * math.pi))
    return (size > 0) & (ratio > 0.9) & (ratio < 1.05)


def circle_ring(ring: Column) -> Column:
    """36-point circle of the same perimeter around the centroid, closed."""
    cx, cy = centroid(ring)
    measured = F.struct(cx.alias("cx"), cy.alias("cy"), (perimeter(ring) / (2.0 * math.pi)).alias("r"))
    degrees = F.concat(F.sequence(F.lit(0), F.lit(350), F.lit(10)), F.array(F.lit(0)))

    def around(m: Column) -> Column:
        angle = lambda deg: F.radians(deg.cast("double"))
        return F.transform(
            degrees, lambda d: F.struct((m["cx"] + m["r"] * F.cos(angle(d))).alias("x"), (m["cy"] + m["r"] * F.sin(angle(d))).alias("y"))
        )

    # a one-element transform binds the measures once for all points
    return F.get(F.transform(F.array(measured), around), F.lit(0))


def dominant_direction(ring: Column) -> Column:
    """Degree 0..89 whose axes the edges follow best (length-weighted), first minimum wins."""

    def misfit(theta: Column) -> Column:
        tx, ty = F.cos(F.radians(theta.cast("double"))), F.sin(F.radians(theta.cast("double")))

        def one(g: Column) -> Column:
            length = edge_length(g)
            cosine = ((g["bx"] - g["ax"]) * tx + (g["by"] - g["ay"]) * ty) / length
            angle = F.degrees(F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0))))
            return F.least(F.abs(F.lit(90.0) - angle), F.abs(F.lit(180.0) - angle), F.abs(angle)) / 90.0 * length

        return _total(F.transform(F.filter(edges(ring), lambda g: edge_length(g) > 0), one))

    scored = F.transform(
        F.sequence(F.lit(0), F.lit(89)), lambda d: F.struct(F.round(misfit(d), 6).alias("weight"), d.alias("degree"))
    )
    return F.array_min(scored)["degree"]


def area_control(before: Column, after: Column) -> Column:
    """May ``after`` replace ``before``? Small area change and centroid shift, laxer for large areas."""
    old, new = area(before), area(after)
    (ox, oy), (nx, ny) = centroid(before), centroid(after)
    shift = F.sqrt((ox - nx) * (ox - nx) + (oy - ny) * (oy - ny))
    change = F.abs(old - new) / old
    return (
        F.when(old == 0, True)
        .when((old > 1000) & (change < 0.25), True)
        .when((change >= 0.25) | (shift > 1), False)
        .otherwise(True)
    )


def crossings_inside(ring: Column, px: Column, py: Column) -> Column:
    """Even-odd test of a point; edges are half open, [low, high)."""

    def crosses(g: Column) -> Column:
        straddles = (g["ay"] <= py) != (g["by"] <= py)
        at = g["ax"] + (py - g["ay"]) * (g["bx"] - g["ax"]) / (g["by"] - g["ay"])
        return straddles & (px < at)

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def touches_box(ring: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Exact ring/box intersection: an edge meets the box, or the ring encloses it."""

    def meets(g: Column) -> Column:
        dx, dy = g["bx"] - g["ax"], g["by"] - g["ay"]
        reach = (F.least(g["ax"], g["bx"]) <= x2) & (F.greatest(g["ax"], g["bx"]) >= x1)
        reach = reach & (F.least(g["ay"], g["by"]) <= y2) & (F.greatest(g["ay"], g["by"]) >= y1)
        side = lambda x, y: dx * (y - g["ay"]) - dy * (x - g["ax"])
        corners = [side(x1, y1), side(x2, y1), side(x2, y2), side(x1, y2)]
        split = (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)
        return reach & split

    return F.exists(edges(ring), meets) | crossings_inside(ring, x1, y1)
