"""Axis-aligned boxes as Column expressions.

A box is any four columns (x1, y1, x2, y2); ``Box`` only bundles them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelworks.functions.numbers import clamp, half_even, lit_or_col


class Box:
    def __init__(self, x1: Column, y1: Column, x2: Column, y2: Column):
        self.x1, self.y1, self.x2, self.y2 = x1, y1, x2, y2

    @staticmethod
    def of(prefix: str = "") -> "Box":
        return _NamedBox(prefix)

    @property
    def width(self) -> Column:
        return F.greatest(self.x2 - self.x1, F.lit(0.0))

    @property
    def height(self) -> Column:
        return F.greatest(self.y2 - self.y1, F.lit(0.0))

    @property
    def area(self) -> Column:
        return self.width * self.height

    @property
    def diagonal(self) -> Column:
        return F.sqrt(self.width * self.width + self.height * self.height)

    @property
    def center_x(self) -> Column:
        return (self.x1 + self.x2) / F.lit(2.0)

    @property
    def center_y(self) -> Column:
        return (self.y1 + self.y2) / F.lit(2.0)

    def columns(self) -> list[Column]:
        return [self.x1.alias("x1"), self.y1.alias("y1"), self.x2.alias("x2"), self.y2.alias("y2")]


class _NamedBox(Box):
    """Box over columns by name; the columns are made on use, so it needs no session."""

    def __init__(self, prefix: str):
        self._prefix = prefix

    x1 = property(lambda self: F.col(f"{self._prefix}x1"))
    y1 = property(lambda self: F.col(f"{self._prefix}y1"))
    x2 = property(lambda self: F.col(f"{self._prefix}x2"))
    y2 = property(lambda self: F.col(f"{self._prefix}y2"))


def union(a: Box, b: Box) -> Box:
    return Box(F.least(a.x1, b.x1), F.least(a.y1, b.y1), F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2))


def intersection_area(a: Box, b: Box) -> Column:
    wide = F.greatest(F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1), F.lit(0.0))
    tall = F.greatest(F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1), F.lit(0.0))
    return wide * tall


def iou(a: Box, b: Box, floor: float = 1.0) -> Column:
    """Intersection over union; the union is kept at least ``floor`` (integer boxes use 1)."""
    common = intersection_area(a, b)
    return common / F.greatest(a.area + b.area - common, F.lit(floor))


def iou_exact(a: Box, b: Box) -> Column:
    """Intersection over union for real-valued boxes, 0 when the union is empty."""
    common = intersection_area(a, b)
    whole = a.area + b.area - common
    return F.when((common <= 0) | (whole <= 0), F.lit(0.0)).otherwise(common / whole)


def containment(a: Box, b: Box) -> Column:
    """Share of the smaller box that lies inside the other one."""
    smaller = F.least(F.greatest(a.area, F.lit(1.0)), F.greatest(b.area, F.lit(1.0)))
    return intersection_area(a, b) / smaller


def gap(a: Box, b: Box) -> Column:
    """Chebyshev distance between two boxes, 0 when they touch."""
    dx = F.greatest(b.x1 - a.x2, a.x1 - b.x2, F.lit(0.0))
    dy = F.greatest(b.y1 - a.y2, a.y1 - b.y2, F.lit(0.0))
    return F.greatest(dx, dy)


def pad(box: Box, width, height, amount: Column) -> Box:
    """Grow by ``amount`` on every side, clipped to the image."""
    return Box(
        F.greatest(box.x1 - amount, F.lit(0.0)),
        F.greatest(box.y1 - amount, F.lit(0.0)),
        F.least(box.x2 + amount, lit_or_col(width)),
        F.least(box.y2 + amount, lit_or_col(height)),
    )


def pad_amount(box: Box, ratio: float, minimum: float) -> Column:
    longest = F.greatest(box.x2 - box.x1, box.y2 - box.y1, F.lit(1.0))
    return F.greatest(F.lit(float(minimum)), half_even(longest * F.lit(ratio)))


def center_distance(a: Box, b: Box) -> Column:
    dx, dy = a.center_x - b.center_x, a.center_y - b.center_y
    return F.sqrt(dx * dx + dy * dy)


def image_center_distance(box: Box, width, height) -> Column:
    """Distance to the image centre divided by the half diagonal, at most 1."""
    half_w, half_h = lit_or_col(width) / F.lit(2.0), lit_or_col(height) / F.lit(2.0)
    dx, dy = box.center_x - half_w, box.center_y - half_h
    longest = F.greatest(F.sqrt(half_w * half_w + half_h * half_h), F.lit(1.0))
    return F.least(F.sqrt(dx * dx + dy * dy) / longest, F.lit(1.0))


def normalized_center_form(box: Box, width, height) -> dict[str, Column]:
    """(cx, cy, w, h) relative to the image, sides at least one pixel."""
    w, h = F.greatest(box.x2 - box.x1, F.lit(1.0)), F.greatest(box.y2 - box.y1, F.lit(1.0))
    wide = F.greatest(lit_or_col(width).cast("double"), F.lit(1.0))
    tall = F.greatest(lit_or_col(height).cast("double"), F.lit(1.0))
    return {
        "cx": (box.x1 + w / 2.0) / wide,
        "cy": (box.y1 + h / 2.0) / tall,
        "w": w / wide,
        "h": h / tall,
    }


def from_center_form(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    return Box(cx - w / 2.0, cy - h / 2.0, cx + w / 2.0, cy + h / 2.0)


def area_ramp(ratio: Column, low: float = 0.08, high: float = 0.20, top: float = 0.55) -> Column:
    """Rises to 1 at ``low``, stays 1 up to ``high``, falls to 0 at ``top``."""
    return (
        F.when(ratio < low, ratio / F.lit(low))
        .when(ratio <= high, F.lit(1.0))
        .otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (ratio - high) / F.lit(max(top - high, 1e-9))))
    )


def proposal_score(box: Box, width, height, quality: Column) -> Column:
    """Rank score of a prompt proposal: central, well sized, then good."""
    image_area = F.greatest(lit_or_col(width) * lit_or_col(height), F.lit(1)).cast("double")
    sized = area_ramp(F.least(box.area / image_area, F.lit(1.0)))
    central = F.lit(1.0) - image_center_distance(box, width, height)
    gated = central * (F.lit(0.35) + F.lit(0.65) * sized)
    return F.lit(0.60) * gated + F.lit(0.30) * sized + F.lit(0.10) * clamp(quality, 0.0, 1.0)
