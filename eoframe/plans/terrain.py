"""Elevation and grid queries: hillshade, dilation, regridding, tiled export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import terrain
from ..sources.fixtures import oracle_with, view
from . import register
from .common import iso_day, r9

LX, LY, LZ = terrain.light_vector()


def _grad_sql(z: str, part: str, order: str, h: float) -> str:
    line = f"OVER (PARTITION BY {part} ORDER BY {order})"
    prev = f"CASE WHEN LAG({order}) {line} = {order} - 1 THEN LAG({z}) {line} END"
    nxt = f"CASE WHEN LEAD({order}) {line} = {order} + 1 THEN LEAD({z}) {line} END"
    prev, nxt = f"({prev})", f"({nxt})"
    return (f"CASE WHEN {prev} IS NULL AND {nxt} IS NULL THEN 0.0 "
            f"WHEN {prev} IS NULL THEN ({nxt} - {z}) / {h!r} "
            f"WHEN {nxt} IS NULL THEN ({z} - {prev}) / {h!r} "
            f"ELSE ({nxt} - {prev}) / {2.0 * h!r} END")


_HILL = dict(
    z="SELECT x, y, elevation, CAST(elevation AS DOUBLE) * 0.5 AS z FROM dem",
    g=f"SELECT x, y, elevation, {_grad_sql('z', 'y', 'x', 30.0)} AS gx, {_grad_sql('z', 'x', 'y', -30.0)} AS gy FROM z",
    n="SELECT x, y, elevation, gx, gy, SQRT(gx * gx + gy * gy + 1.0) AS nrm FROM g",
    i=f"""SELECT x, y, elevation, (-gx / nrm) * {LX!r} + (-gy / nrm) * {LY!r} + (1.0 / nrm) * {LZ!r} AS i FROM n""",
    s="""SELECT x, y, elevation,
           GREATEST(0.0, LEAST(1.0, CASE WHEN (SELECT MAX(i) - MIN(i) FROM i) > 1e-6
             THEN (i * 1.0 - (SELECT MIN(i) FROM i)) / ((SELECT MAX(i) FROM i) - (SELECT MIN(i) FROM i))
             ELSE i * 1.0 END)) AS shade FROM i""")


@register("hillshade", operators=("W4",), oracle=oracle_with("""
SELECT x, y, elevation, ROUND(shade, 9) AS shade, ROUND(elevation * shade, 6) AS shaded FROM s""",
    "dem", **_HILL))
def hillshade(spark, sf):
    h = terrain.hillshade(view(spark, sf, "dem"))
    return h.select("x", "y", "elevation", r9("shade").alias("shade"),
                    F.round(F.col("elevation") * F.col("shade"), 6).alias("shaded"))


DILATE_RADIUS = 3
BAD_ELEVATION = 100


def _disk_sql(r: int) -> str:
    return (f"SELECT a.range AS dx, b.range AS dy FROM range({-r}, {r + 1}) a, range({-r}, {r + 1}) b "
            f"WHERE a.range * a.range + b.range * b.range <= {(r + 0.5) ** 2!r}")


@register("dilate", operators=("J14",), oracle=oracle_with("""
SELECT g.x, g.y, NOT EXISTS (SELECT 1 FROM hit h WHERE h.x = g.x AND h.y = g.y) AS valid FROM dem g""",
    "dem", k=_disk_sql(DILATE_RADIUS),
    hit=f"SELECT DISTINCT d.x + k.dx AS x, d.y + k.dy AS y FROM dem d, k WHERE d.elevation < {BAD_ELEVATION}"))
def dilate(spark, sf):
    cells = view(spark, sf, "dem").select("x", "y", (F.col("elevation") >= BAD_ELEVATION).alias("valid"))
    return terrain.dilate(cells, "valid", DILATE_RADIUS, invert=True).select("x", "y", "valid")


# Source grid: cell (x, y) centred at lon 10 + 0.01 x, lat 45 - 0.01 y; target EPSG:6933 at 2 km.
REGRID_RES = 2000.0
REGRID_X0, REGRID_Y0 = 960000.0, 5500000.0


def _ease_sql() -> str:
    import math
    e2 = geo.WGS84_F * (2 - geo.WGS84_F)
    e = math.sqrt(e2)
    s0 = math.sin(math.radians(geo.EASE2_STD_PARALLEL))
    k0 = math.cos(math.radians(geo.EASE2_STD_PARALLEL)) / math.sqrt(1 - e2 * s0 * s0)
    s = "SIN(RADIANS(45.0 - 0.01 * y))"
    q = f"{1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - {1 / (2 * e)!r} * LN((1 - {e!r} * {s}) / (1 + {e!r} * {s})))"
    return (f"SELECT x, y, elevation, {geo.WGS84_A * k0!r} * RADIANS(10.0 + 0.01 * x) AS px, "
            f"{geo.WGS84_A / (2 * k0)!r} * ({q}) AS py FROM dem")


@register("regrid", operators=("F27",), oracle=oracle_with(f"""
SELECT row, col, first(elevation ORDER BY d2, y, x) AS elevation, COUNT(*) AS n_src FROM (
  SELECT *, (px - ({REGRID_X0!r} + (col + 0.5) * {REGRID_RES!r})) * (px - ({REGRID_X0!r} + (col + 0.5) * {REGRID_RES!r}))
          + (py - ({REGRID_Y0!r} - (row + 0.5) * {REGRID_RES!r})) * (py - ({REGRID_Y0!r} - (row + 0.5) * {REGRID_RES!r})) AS d2
  FROM (SELECT *, CAST(FLOOR((px - {REGRID_X0!r}) / {REGRID_RES!r}) AS BIGINT) AS col,
               CAST(FLOOR(({REGRID_Y0!r} - py) / {REGRID_RES!r}) AS BIGINT) AS row FROM p) c) z
GROUP BY row, col""", "dem", p=_ease_sql()))
def regrid(spark, sf):
    dem = view(spark, sf, "dem")
    lon = F.lit(10.0) + F.lit(0.01) * F.col("x")
    lat = F.lit(45.0) - F.lit(0.01) * F.col("y")
    px, py = geo.to_ease2(lon, lat)
    return terrain.regrid_nearest(dem, px, py, "elevation", REGRID_X0, REGRID_Y0, REGRID_RES)


# The same grid gathered into finer target cells: every target cell has a value.
FINE_RES, FINE_X0, FINE_Y0 = 700.0, 960000.0, 5500000.0
UTM_ZONE, UTM_RES, UTM_X0, UTM_Y0 = 32, 600.0, 570000.0, 4990000.0
_E2 = geo.WGS84_F * (2 - geo.WGS84_F)


def _unproject_ease_sql() -> str:
    """SQL of (lon, lat) from (tx, ty), the latitude by Newton steps on the authalic function."""
    import math
    e = math.sqrt(_E2)
    s0 = math.sin(math.radians(geo.EASE2_STD_PARALLEL))
    k0 = math.cos(math.radians(geo.EASE2_STD_PARALLEL)) / math.sqrt(1 - _E2 * s0 * s0)

    def better(f):
        s = f"SIN({f})"
        w = f"(1 - {_E2!r} * {s} * {s})"
        return (f"{f} + {w} * {w} / (2 * COS({f})) * (q / {1 - _E2!r} - {s} / {w} "
                f"+ {1 / (2 * e)!r} * LN((1 - {e!r} * {s}) / (1 + {e!r} * {s})))")
    steps = "SELECT *, ASIN(q / 2) AS f0 FROM (SELECT *, ty * " + repr(2 * k0 / geo.WGS84_A) + " AS q FROM tc) z0"
    for i in range(5):
        steps = f"SELECT *, {better(f'f{i}')} AS f{i + 1} FROM ({steps}) z{i + 1}"
    return f"SELECT row, col, DEGREES(tx / {geo.WGS84_A * k0!r}) AS lon, DEGREES(f5) AS lat FROM ({steps}) z"


def _utm_sql() -> str:
    """SQL of the projected centres (px, py) of the source."""
    a, ep2 = geo.WGS84_A, _E2 / (1 - _E2)
    m = (f"{a!r} * ({1 - _E2 / 4 - 3 * _E2 ** 2 / 64 - 5 * _E2 ** 3 / 256!r} * f - {3 * _E2 / 8 + 3 * _E2 ** 2 / 32 + 45 * _E2 ** 3 / 1024!r}"
         f" * SIN(2 * f) + {15 * _E2 ** 2 / 256 + 45 * _E2 ** 3 / 1024!r} * SIN(4 * f) - {35 * _E2 ** 3 / 3072!r} * SIN(6 * f))")
    return f"""SELECT x, y, elevation,
      0.9996 * n * (aa + (1 - t + c) * aa ** 3 / 6 + (5 - 18 * t + t * t + 72 * c - {58 * ep2!r}) * aa ** 5 / 120) + 500000 AS px,
      0.9996 * (m + n * TAN(f) * (aa ** 2 / 2 + (5 - t + 9 * c + 4 * c * c) * aa ** 4 / 24
                + (61 - 58 * t + t * t + 600 * c - {330 * ep2!r}) * aa ** 6 / 720)) AS py
    FROM (SELECT *, {a!r} / SQRT(1 - {_E2!r} * SIN(f) ** 2) AS n, TAN(f) ** 2 AS t, {ep2!r} * COS(f) ** 2 AS c,
                 COS(f) * (l - RADIANS({UTM_ZONE * 6 - 183})) AS aa, {m} AS m
          FROM (SELECT *, RADIANS(45.0 - 0.01 * y) AS f, RADIANS(10.0 + 0.01 * x) AS l FROM dem) z) z2"""


def _unproject_utm_sql() -> str:
    """SQL of (lon, lat) from (tx, ty): the footpoint latitude by fixed-point steps on the
    meridian arc, then the series around it."""
    a, ep2 = geo.WGS84_A, _E2 / (1 - _E2)
    k = 1 - _E2 / 4 - 3 * _E2 ** 2 / 64 - 5 * _E2 ** 3 / 256
    steps = f"SELECT *, ty / {0.9996 * a * k!r} AS f0 FROM tc"
    for i in range(12):
        steps = (f"SELECT *, (ty / {0.9996 * a!r} + {3 * _E2 / 8 + 3 * _E2 ** 2 / 32 + 45 * _E2 ** 3 / 1024!r} * SIN(2 * f{i})"
                 f" - {15 * _E2 ** 2 / 256 + 45 * _E2 ** 3 / 1024!r} * SIN(4 * f{i}) + {35 * _E2 ** 3 / 3072!r} * SIN(6 * f{i}))"
                 f" / {k!r} AS f{i + 1} FROM ({steps}) z{i}")
    return f"""SELECT row, col, {UTM_ZONE * 6 - 183} + DEGREES((d - (1 + 2 * t + c) * d ** 3 / 6
        + (5 - 2 * c + 28 * t - 3 * c * c + {8 * ep2!r} + 24 * t * t) * d ** 5 / 120) / COS(f)) AS lon,
      DEGREES(f - TAN(f) * (1 - {_E2!r} * SIN(f) ** 2) / {1 - _E2!r} * (d ** 2 / 2 - (5 + 3 * t + 10 * c - 4 * c * c - {9 * ep2!r}) * d ** 4 / 24
        + (61 + 90 * t + 298 * c + 45 * t * t - {252 * ep2!r} - 3 * c * c) * d ** 6 / 720)) AS lat
    FROM (SELECT *, f12 AS f, TAN(f12) ** 2 AS t, {ep2!r} * COS(f12) ** 2 AS c,
                 (tx - 500000) * SQRT(1 - {_E2!r} * SIN(f12) ** 2) / {0.9996 * a!r} AS d FROM ({steps}) z) z2"""


def _gather_oracle(project: str, unproject: str, x0: float, y0: float, res: float) -> str:
    return oracle_with("""
SELECT c.row, c.col, CAST(d.elevation AS DOUBLE) AS elevation FROM ll c
LEFT JOIN dem d ON d.x = CAST(FLOOR((c.lon - 10.0) / 0.01 + 0.5) AS BIGINT) AND d.y = CAST(FLOOR((45.0 - c.lat) / 0.01 + 0.5) AS BIGINT)""",
        "dem", p=project,
        tc=f"""SELECT row, col, {x0!r} + (col + 0.5) * {res!r} AS tx, {y0!r} - (row + 0.5) * {res!r} AS ty
FROM (SELECT unnest(range(CAST(FLOOR(({y0!r} - MAX(py)) / {res!r}) AS BIGINT), CAST(FLOOR(({y0!r} - MIN(py)) / {res!r}) AS BIGINT) + 1)) AS row FROM p) a,
     (SELECT unnest(range(CAST(FLOOR((MIN(px) - {x0!r}) / {res!r}) AS BIGINT), CAST(FLOOR((MAX(px) - {x0!r}) / {res!r}) AS BIGINT) + 1)) AS col FROM p) b""",
        ll=unproject)


@register("regrid_fine", operators=("F27",),
          oracle=_gather_oracle(_ease_sql(), _unproject_ease_sql(), FINE_X0, FINE_Y0, FINE_RES))
def regrid_fine(spark, sf):
    """Elevation on an equal-area grid finer than its own."""
    fine = terrain.regrid(view(spark, sf, "dem"), ["elevation"], geo.to_ease2, geo.from_ease2, 10.0, 45.0, 0.01,
                          FINE_X0, FINE_Y0, FINE_RES)
    return fine.withColumn("elevation", F.col("elevation").cast("double"))


@register("regrid_utm", operators=("F27",),
          oracle=_gather_oracle(_utm_sql(), _unproject_utm_sql(), UTM_X0, UTM_Y0, UTM_RES))
def regrid_utm(spark, sf):
    """Elevation on a UTM grid."""
    zone = F.lit(UTM_ZONE)
    utm = terrain.regrid(view(spark, sf, "dem"), ["elevation"], lambda lon, lat: geo.to_utm(lon, lat, zone),
                         lambda x, y, line: geo.from_utm(x, y, zone, line=line), 10.0, 45.0, 0.01, UTM_X0, UTM_Y0, UTM_RES,
                         geo.utm_line)
    return utm.withColumn("elevation", F.col("elevation").cast("double"))


EXPORT_TILE = 16


@register("tile_export", operators=("K4", "W8", "P19"), oracle=oracle_with(f"""
SELECT CAST(t AS VARCHAR) AS t, CAST(FLOOR(y / {EXPORT_TILE}) AS BIGINT) AS tile_y,
       CAST(FLOOR(x / {EXPORT_TILE}) AS BIGINT) AS tile_x, band,
       list(v ORDER BY y, x, v) AS "values",
       list(CAST(y % {EXPORT_TILE} * {EXPORT_TILE} + x % {EXPORT_TILE} AS BIGINT) ORDER BY y, x, v) AS places, COUNT(*) AS n_cells
FROM (SELECT t, y, x, 'red' AS band, CAST(COALESCE(red, 0) AS FLOAT) AS v FROM m
      UNION ALL SELECT t, y, x, 'nir' AS band, CAST(COALESCE(nir, 0) AS FLOAT) AS v FROM m) u
GROUP BY 1, 2, 3, 4""", "pixels",
    m="""SELECT t, y, x, CASE WHEN red <> 0 THEN red END AS red, CASE WHEN red <> 0 THEN nir END AS nir
         FROM pixels"""))
def tile_export(spark, sf):
    from ..operators import cube
    px = view(spark, sf, "pixels")
    px = cube.hide_nodata(px.select("t", "y", "x", "red", "nir"), ["red", "nir"], 0)
    tiles = terrain.tile_rows(px, ["red", "nir"], {"red": 0, "nir": 0}, EXPORT_TILE, keys=["t"])
    return tiles.withColumn("t", iso_day("t"))
