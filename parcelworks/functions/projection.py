"""Map projections and web map tiles as Column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid, UTM scale and offsets, web map resolution at zoom 0.
EQUATOR_RADIUS = 6378137.0
FLATTENING = 1 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING = 10000000.0
ZOOM0_RESOLUTION = 156543.03392804097

_n = FLATTENING / (2 - FLATTENING)
_RECTIFYING = EQUATOR_RADIUS / (1 + _n) * (1 + _n**2 / 4 + _n**4 / 64)
_ALPHA = (_n / 2 - 2 * _n**2 / 3 + 5 * _n**3 / 16, 13 * _n**2 / 48 - 3 * _n**3 / 5, 61 * _n**3 / 240)
_BETA = (_n / 2 - 2 * _n**2 / 3 + 37 * _n**3 / 96, _n**2 / 48 + _n**3 / 15, 17 * _n**3 / 480)
_DELTA = (2 * _n - 2 * _n**2 / 3 - 2 * _n**3, 7 * _n**2 / 3 - 8 * _n**3 / 5, 56 * _n**3 / 15)
_CONFORMAL = 2 * math.sqrt(_n) / (1 + _n)


def mercator_forward(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * EQUATOR_RADIUS, F.log(F.tan(F.radians(F.lit(45.0) + lat / 2.0))) * EQUATOR_RADIUS


def mercator_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    lat = F.degrees(F.atan(F.exp(y / EQUATOR_RADIUS))) * 2.0 - 90.0
    return F.degrees(x / EQUATOR_RADIUS), lat


def slippy_tile(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional web tile position."""
    count = float(2**zoom)
    phi = F.radians(lat)
    y = (F.lit(1.0) - F.log(F.tan(phi) + F.lit(1.0) / F.cos(phi)) / math.pi) / 2.0 * count
    return (lon + 180.0) / 360.0 * count, y


def zoom_for_resolution(metres: Column) -> Column:
    return F.log2(F.lit(ZOOM0_RESOLUTION) / metres).cast("int")


def tile_url(template: str, zoom: Column, x: Column, y: Column) -> Column:
    url = F.lit(template)
    for mark, value in (("{z}", zoom), ("{x}", x), ("{y}", y)):
        url = F.replace(url, F.lit(mark), value.cast("string"))
    return url


def utm_zone(lon: Column) -> Column:
    return F.least(F.greatest(F.floor((lon + 180.0) / 6.0) + 1, F.lit(1)), F.lit(60)).cast("int")


def _central_meridian(zone: Column) -> Column:
    return F.radians(zone * 6.0 - 183.0)


def utm_forward(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Transverse Mercator by the third-order Krueger series (sub-millimetre)."""
    sin_phi, away = F.sin(F.radians(lat)), F.radians(lon) - _central_meridian(zone)
    t = F.sinh(F.atanh(sin_phi) - F.lit(_CONFORMAL) * F.atanh(F.lit(_CONFORMAL) * sin_phi))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(F.lit(1.0) + t * t))
    east, north = eta, xi
    for j, alpha in enumerate(_ALPHA, start=1):
        east = east + F.lit(alpha) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
        north = north + F.lit(alpha) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
    scale = UTM_SCALE * _RECTIFYING
    y = north * scale
    return east * scale + FALSE_EASTING, F.when(y < 0, y + FALSE_NORTHING).otherwise(y)


def utm_inverse(x: Column, y: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    scale = UTM_SCALE * _RECTIFYING
    xi = F.when(south, y - FALSE_NORTHING).otherwise(y) / scale
    eta = (x - FALSE_EASTING) / scale
    xi0, eta0 = xi, eta
    for j, beta in enumerate(_BETA, start=1):
        xi0 = xi0 - F.lit(beta) * F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j))
        eta0 = eta0 - F.lit(beta) * F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j))
    chi = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, delta in enumerate(_DELTA, start=1):
        phi = phi + F.lit(delta) * F.sin(chi * (2.0 * j))
    return F.degrees(_central_meridian(zone) + F.atan2(F.sinh(eta0), F.cos(xi0))), F.degrees(phi)


def crs_transform(source: str, target: str, x: Column, y: Column, zone: Column | None = None, south: Column | None = None):
    """4326, 3857 and UTM only; the UTM zone comes from the longitude unless given."""
    names = {"EPSG:4326", "EPSG:3857", "UTM"}
    if source not in names or target not in names:
        raise ValueError(f"unsupported transform {source} to {target}")
    if source == target:
        return x, y
    if source == "EPSG:3857":
        x, y = mercator_inverse(x, y)
    elif source == "UTM":
        if zone is None or south is None:
            raise ValueError("UTM input needs zone and hemisphere")
        x, y = utm_inverse(x, y, zone, south)
    if target == "EPSG:4326":
        return x, y
    if target == "EPSG:3857":
        return mercator_forward(x, y)
    return utm_forward(x, y, utm_zone(x) if zone is None else zone)
