"""Affine transforms between pixel and map space (x = a*col + b*row + c, y = d*col + e*row + f)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelworks.functions.bbox import Box

COEFFICIENTS = ("a", "b", "c", "d", "e", "f")


def forward(col: Column, row: Column, offset: float = 0.0) -> tuple[Column, Column]:
    """Map position of a pixel corner (offset 0) or centre (offset 0.5)."""
    a, b, c, d, e, f = (F.col(n) for n in COEFFICIENTS)
    px, py = col + F.lit(offset), row + F.lit(offset)
    return a * px + b * py + c, d * px + e * py + f


def inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """(col, row) of the pixel that holds a map position."""
    a, b, c, d, e, f = (F.col(n) for n in COEFFICIENTS)
    det = a * e - b * d
    dx, dy = x - c, y - f
    return F.floor((e * dx - b * dy) / det).cast("int"), F.floor((a * dy - d * dx) / det).cast("int")


def box_to_map(box: Box, offset: float = 0.5) -> Box:
    """Pixel box (left, top, right, bottom) to map box (x1, y_bottom, x2, y_top)."""
    left, top = forward(box.x1, box.y1, offset)
    right, bottom = forward(box.x2, box.y2, offset)
    return Box(left, bottom, right, top)


def box_to_pixel(box: Box) -> Box:
    """Map box (minx, miny, maxx, maxy) to pixel box (left, top, right, bottom)."""
    left, bottom = inverse(box.x1, box.y1)
    right, top = inverse(box.x2, box.y2)
    return Box(left, top, right, bottom)


def inside(box: Box, width: Column, height: Column) -> Column:
    """All four sides inside [0, width) x [0, height)."""
    across = (box.x1 >= 0) & (box.x2 >= 0) & (box.x1 < width) & (box.x2 < width)
    down = (box.y1 >= 0) & (box.y2 >= 0) & (box.y1 < height) & (box.y2 < height)
    return across & down
