"""Geometry helpers on plain columns: bboxes, rings, UTM zones, grids, projections.

Spark 4.1 ships geospatial types disabled, and no geometry library is
available, so geometry stays as doubles and arrays and every function here is
a closed-form Column expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS 84 ellipsoid and projection constants.
WGS84_A = 6378137.0
WGS84_F = 1 / 298.257223563
UTM_K0 = 0.9996
UTM_FALSE_EASTING = 500000.0
UTM_FALSE_NORTHING_SOUTH = 10000000.0
EASE2_STD_PARALLEL = 30.0          # EPSG:6933 standard parallel
SECONDS_PER_DEGREE_LON = 240       # solar time: 24 h / 360 degrees
ANTIMERIDIAN_BAND = (175.0, 185.0)  # boxes reaching into this longitude band wrap


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bbox_overlaps(minx, miny, maxx, maxy, aoi) -> Column:
    """Box columns intersect ``aoi = (x1, y1, x2, y2)`` (closed edges)."""
    x1, y1, x2, y2 = aoi
    return (_c(minx) <= x2) & (_c(maxx) >= x1) & (_c(miny) <= y2) & (_c(maxy) >= y1)


def bbox_contains(minx, miny, maxx, maxy, inner) -> Column:
    """Box columns contain the box ``inner`` entirely."""
    x1, y1, x2, y2 = inner
    return (_c(minx) <= x1) & (_c(miny) <= y1) & (_c(maxx) >= x2) & (_c(maxy) >= y2)


def crosses_antimeridian(minx, maxx) -> Column:
    lo, hi = ANTIMERIDIAN_BAND
    return (_c(minx) < hi) & (_c(maxx) > lo)


def bbox_ring(left, bottom, right, top) -> Column:
    """closed ring UL -> UR -> LR -> LL -> UL as ``array<array<double>>``."""
    lt = F.array(_c(left), _c(top))
    return F.array(lt, F.array(_c(right), _c(top)), F.array(_c(right), _c(bottom)),
                   F.array(_c(left), _c(bottom)), lt)


def utm_zone(lon) -> Column:
    """UTM zone 1..60 (longitude 180 folds into zone 60)."""
    z = F.floor((_c(lon) + 180.0) / 6.0) + 1
    return F.when(z.isNotNull(), F.least(z, F.lit(60))).cast("int")  # least() would skip a null


def utm_epsg(lat, lon) -> Column:
    """F8: EPSG code of the UTM zone at (lat, lon): 326zz north, 327zz south."""
    base = F.when(_c(lat) >= 0, F.lit(32600)).otherwise(F.lit(32700))
    return (base + utm_zone(lon)).cast("int")


def degree_to_zoom(l1, l2, margin: float = 0.0) -> Column:
    """zoom level showing the span |l1 - l2| widened by ``margin``:
    ``log2(360 / degree)`` truncated toward zero, 18 for an empty span."""
    degree = F.abs(_c(l1) - _c(l2)) * F.lit(1.0 + margin)
    z = F.log2(F.lit(360.0) / degree)
    return F.when(degree == 0, F.lit(18)).otherwise(
        F.when(z >= 0, F.floor(z)).otherwise(F.ceil(z)).cast("int"))


def zoom_level(minx, miny, maxx, maxy, margin: float = 0.0) -> Column:
    """zoom fitting both axes of an extent (the smaller of the two)."""
    return F.least(degree_to_zoom(miny, maxy, margin), degree_to_zoom(minx, maxx, margin))


def grid_transform(left, bottom, right, top, width, height) -> Column:
    """affine ``[(r-l)/w, 0, l, 0, -(t-b)/h, t]`` of a north-up image."""
    w, h = _c(width).cast("double"), _c(height).cast("double")
    return F.array((_c(right) - _c(left)) / w, F.lit(0.0), _c(left).cast("double"),
                   F.lit(0.0), -(_c(top) - _c(bottom)) / h, _c(top).cast("double"))


def solar_day(t, lon) -> Column:
    """local solar date, ``to_date(t + floor(lon * 240) seconds)``."""
    shift = F.floor(_c(lon) * SECONDS_PER_DEGREE_LON).cast("int")
    return F.to_date(F.timestamp_add("SECOND", shift, _c(t)))


def ring_is_valid(ring) -> Column:
    """ring is non-null, has >= 4 points, is closed and has non-zero area
    (shoelace sum over consecutive point pairs)."""
    r = _c(ring)
    n = F.size(r)
    pairs = F.zip_with(F.slice(r, 1, F.greatest(n - 1, F.lit(1))), F.slice(r, 2, F.greatest(n - 1, F.lit(1))),
                       lambda p, q: p[0] * q[1] - q[0] * p[1])
    area2 = F.aggregate(pairs, F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    first, last = F.get(r, 0), F.get(r, n - 1)
    closed = (first[0] == last[0]) & (first[1] == last[1])
    return F.coalesce(r.isNotNull() & (n >= 4) & closed & (F.abs(area2) > 0), F.lit(False))


# --- F27: closed-form projections -------------------------------------------------

def _e2() -> float:
    return WGS84_F * (2 - WGS84_F)


def to_ease2(lon, lat) -> tuple[Column, Column]:
    """EPSG:6933 (equal-area cylindrical, WGS 84, standard parallel 30 deg)."""
    e2 = _e2()
    e = math.sqrt(e2)
    s0 = math.sin(math.radians(EASE2_STD_PARALLEL))
    k0 = math.cos(math.radians(EASE2_STD_PARALLEL)) / math.sqrt(1 - e2 * s0 * s0)
    phi = F.radians(_c(lat))
    s = F.sin(phi)
    q = (1 - e2) * (s / (1 - e2 * s * s) - (1 / (2 * e)) * F.log((1 - e * s) / (1 + e * s)))
    x = F.lit(WGS84_A * k0) * F.radians(_c(lon))
    y = F.lit(WGS84_A / (2 * k0)) * q
    return x, y


def to_utm(lon, lat, zone) -> tuple[Column, Column]:
    """Ellipsoidal transverse Mercator (Snyder 1987 series), UTM false origin."""
    a, e2 = WGS84_A, _e2()
    ep2 = e2 / (1 - e2)
    phi = F.radians(_c(lat))
    lam0 = F.radians(_c(zone).cast("double") * 6 - 183)
    lam = F.radians(_c(lon))
    n = F.lit(a) / F.sqrt(1 - e2 * F.sin(phi) ** 2)
    t = F.tan(phi) ** 2
    c = F.lit(ep2) * F.cos(phi) ** 2
    aa = F.cos(phi) * (lam - lam0)
    m = a * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi
             - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * F.sin(2 * phi)
             + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * F.sin(4 * phi)
             - (35 * e2 ** 3 / 3072) * F.sin(6 * phi))
    x = UTM_K0 * n * (aa + (1 - t + c) * aa ** 3 / 6
                      + (5 - 18 * t + t ** 2 + 72 * c - 58 * ep2) * aa ** 5 / 120)
    y = UTM_K0 * (m + n * F.tan(phi) * (aa ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * aa ** 4 / 24
                                         + (61 - 58 * t + t ** 2 + 600 * c - 330 * ep2) * aa ** 6 / 720))
    north = F.when(_c(lat) >= 0, F.lit(0.0)).otherwise(F.lit(UTM_FALSE_NORTHING_SOUTH))
    return x + UTM_FALSE_EASTING, y + north


def from_ease2(x, y) -> tuple[Column, Column]:
    """(lon, lat) of EPSG:6933 coordinates: the authalic latitude and its series."""
    e2 = _e2()
    e = math.sqrt(e2)
    s0 = math.sin(math.radians(EASE2_STD_PARALLEL))
    k0 = math.cos(math.radians(EASE2_STD_PARALLEL)) / math.sqrt(1 - e2 * s0 * s0)
    pole = 1 - (1 - e2) / (2 * e) * math.log((1 - e) / (1 + e))
    beta = F.asin(_c(y) * F.lit(2 * k0 / WGS84_A / pole))
    lat = (beta + F.lit(e2 / 3 + 31 * e2 ** 2 / 180 + 517 * e2 ** 3 / 5040) * F.sin(2 * beta)
           + F.lit(23 * e2 ** 2 / 360 + 251 * e2 ** 3 / 3780) * F.sin(4 * beta)
           + F.lit(761 * e2 ** 3 / 45360) * F.sin(6 * beta))
    return F.degrees(_c(x) / F.lit(WGS84_A * k0)), F.degrees(lat)


def utm_line(y, south: bool = False) -> dict[str, Column]:
    """What ``from_utm`` takes from y alone (the footpoint latitude and its series), by name:
    the cells of one line of a grid share it."""
    a, e2 = WGS84_A, _e2()
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    north = UTM_FALSE_NORTHING_SOUTH if south else 0.0
    mu = (_c(y) - north) / (UTM_K0 * a * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256))
    foot = (mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * F.sin(2 * mu) + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * F.sin(4 * mu)
            + (151 * e1 ** 3 / 96) * F.sin(6 * mu) + (1097 * e1 ** 4 / 512) * F.sin(8 * mu))
    c, t = ep2 * F.cos(foot) ** 2, F.tan(foot) ** 2
    w = 1 - e2 * F.sin(foot) ** 2
    n, r = a / F.sqrt(w), a * (1 - e2) / (w * F.sqrt(w))
    return {"foot": foot, "unit": n * UTM_K0, "lat2": n * F.tan(foot) / r,
            "lat4": 5 + 3 * t + 10 * c - 4 * c ** 2 - 9 * ep2,
            "lat6": 61 + 90 * t + 298 * c + 45 * t ** 2 - 252 * ep2 - 3 * c ** 2,
            "lon1": F.cos(foot), "lon3": 1 + 2 * t + c, "lon5": 5 - 2 * c + 28 * t - 3 * c ** 2 + 8 * ep2 + 24 * t ** 2}


def from_utm(x, y, zone, south: bool = False, line: dict[str, Column] | None = None) -> tuple[Column, Column]:
    """(lon, lat) of UTM coordinates: the inverse series at the footpoint latitude. ``line``
    is what ``utm_line`` gives for y, where that is at hand."""
    k = line or utm_line(y, south)
    d = (_c(x) - UTM_FALSE_EASTING) / k["unit"]
    # Products, not powers: a power costs more than all the rest of a cell.
    d2 = d * d
    d4 = d2 * d2
    lat = k["foot"] - k["lat2"] * (d2 / 2 - k["lat4"] * d4 / 24 + k["lat6"] * (d4 * d2) / 720)
    lon = (d - k["lon3"] * (d2 * d) / 6 + k["lon5"] * (d4 * d) / 120) / k["lon1"]
    return F.degrees(lon) + (_c(zone).cast("double") * 6 - 183), F.degrees(lat)
