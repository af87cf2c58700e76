"""Time reductions: solar-day mosaics, fusers, first/last/nearest, weekly NDVI, cube joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import qa
from ..functions.radiometry import normalized_difference
from ..operators import cube, timeseries
from ..sources.fixtures import oracle_with, view
from . import register
from .common import iso_day, iso_ts, r9, sql_iso_ts

CLOUDY = ["cloud", "cloud_shadow", "dilated_cloud", "cirrus", "nodata"]
ORDER = ("t", "scene_id", "seq", "lon")

_OBS_SQL = """
  SELECT scene_id, seq, x, y, t, lon, wofs,
         CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 THEN red END AS red,
         CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 THEN nir END AS nir,
         CAST(t + to_seconds(CAST(FLOOR(lon * 240) AS BIGINT)) AS DATE) AS solar_day
  FROM pixel_obs"""


def _masked_obs(spark, sf):
    obs = view(spark, sf, "pixel_obs")
    return cube.mask_bands(obs, qa.qa_pixel_any("qa_pixel", CLOUDY), ["red", "nir"])


@register("solar_day_mosaic", operators=("A4", "F26", "P10"), oracle=oracle_with(f"""
SELECT CAST(solar_day AS VARCHAR) AS solar_day, y, x, {sql_iso_ts('MIN(t)')} AS t,
       CAST(first(red ORDER BY t, scene_id, seq, lon, red) FILTER (WHERE red IS NOT NULL) AS DOUBLE) AS red,
       CAST(first(nir ORDER BY t, scene_id, seq, lon, nir) FILTER (WHERE nir IS NOT NULL) AS DOUBLE) AS nir
FROM o GROUP BY solar_day, y, x""", "pixel_obs", o=_OBS_SQL))
def solar_day_mosaic(spark, sf):
    m = timeseries.solar_day_mosaic(_masked_obs(spark, sf), ["red", "nir"], ORDER)
    return m.select(iso_day("solar_day").alias("solar_day"), "y", "x", iso_ts("t").alias("t"),
                    F.col("red").cast("double").alias("red"), F.col("nir").cast("double").alias("nir"))


@register("water_fuse", operators=("A5", "F26"), oracle=oracle_with("""
SELECT CAST(solar_day AS VARCHAR) AS solar_day, y, x,
       COALESCE(bit_or(wofs) FILTER (WHERE wofs % 2 = 0), last(wofs ORDER BY t, scene_id, seq, lon, wofs)) AS wofs
FROM o GROUP BY solar_day, y, x""", "pixel_obs", o=_OBS_SQL))
def water_fuse(spark, sf):
    obs = timeseries.with_solar_day(view(spark, sf, "pixel_obs"))
    f = timeseries.water_fuse(obs, ["solar_day", "y", "x"], "wofs", ORDER)
    return f.withColumn("solar_day", iso_day("solar_day"))


_CUBE_SQL = "SELECT t, y, x, CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 THEN red END AS red FROM pixels"
_TIMES_SQL = "SELECT t, DENSE_RANK() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT t FROM m) d"


def _masked_cube(spark, sf):
    px = view(spark, sf, "pixels")
    return cube.mask_bands(px, qa.qa_pixel_any("qa_pixel", CLOUDY), ["red"]).select("t", "y", "x", "red")


@register("first_valid", operators=("W1", "W7"), oracle=oracle_with("""
SELECT g.y, g.x, CAST(g.red AS DOUBLE) AS red, CAST(COALESCE(g.ft, (SELECT MIN(t) FROM m)) AS VARCHAR) AS t,
       COALESCE(times.idx, 0) AS idx
FROM g LEFT JOIN times ON g.ft = times.t""", "pixels", m=_CUBE_SQL, times=_TIMES_SQL,
    g="""SELECT y, x, arg_min(red, t) FILTER (WHERE red IS NOT NULL) AS red,
         MIN(t) FILTER (WHERE red IS NOT NULL) AS ft FROM m GROUP BY y, x"""))
def first_valid(spark, sf):
    f = timeseries.first_valid(_masked_cube(spark, sf), "red")
    return f.select("y", "x", F.col("red").cast("double").alias("red"), iso_day("t").alias("t"), "idx")


@register("last_valid", operators=("W2", "W7"), oracle=oracle_with("""
SELECT g.y, g.x, CAST(g.red AS DOUBLE) AS red, CAST(COALESCE(g.lt, (SELECT MAX(t) FROM m)) AS VARCHAR) AS t,
       COALESCE(times.idx - (SELECT COUNT(*) FROM times), -1) AS idx
FROM g LEFT JOIN times ON g.lt = times.t""", "pixels", m=_CUBE_SQL, times=_TIMES_SQL,
    g="""SELECT y, x, arg_max(red, t) FILTER (WHERE red IS NOT NULL) AS red,
         MAX(t) FILTER (WHERE red IS NOT NULL) AS lt FROM m GROUP BY y, x"""))
def last_valid(spark, sf):
    f = timeseries.last_valid(_masked_cube(spark, sf), "red")
    return f.select("y", "x", F.col("red").cast("double").alias("red"), iso_day("t").alias("t"), "idx")


NEAREST_TARGET = datetime(1997, 6, 16)  # equidistant from 1 June and 1 July: exercises the tie rule


@register("nearest_valid", operators=("W3",), oracle=oracle_with("""
SELECT y, x,
  CAST(first(red ORDER BY d, b) FILTER (WHERE red IS NOT NULL) AS DOUBLE) AS red,
  CAST(first(t ORDER BY d, b) FILTER (WHERE red IS NOT NULL) AS VARCHAR) AS t
FROM n GROUP BY y, x""", "pixels", m=_CUBE_SQL,
    n="""SELECT y, x, red, t,
           abs(epoch_us(CAST(t AS TIMESTAMP)) - epoch_us(TIMESTAMP '1997-06-16')) AS d,
           CASE WHEN CAST(t AS TIMESTAMP) < TIMESTAMP '1997-06-16' THEN 1 ELSE 0 END AS b
         FROM m"""))
def nearest_valid(spark, sf):
    n = timeseries.nearest_valid(_masked_cube(spark, sf), "red", NEAREST_TARGET)
    return n.select("y", "x", F.col("red").cast("double").alias("red"), iso_day("t").alias("t"))


@register("ndvi_weekly", operators=("A7", "F7", "F3"), oracle=oracle_with("""
SELECT CAST(CAST(date_trunc('week', t) AS DATE) AS VARCHAR) AS week, y, x,
       ROUND(MIN(ndvi), 9) AS ndvi_min, ROUND(AVG(ndvi), 9) AS ndvi_mean, ROUND(MAX(ndvi), 9) AS ndvi_max
FROM n GROUP BY 1, 2, 3""", "pixel_obs",
    n="""SELECT t, y, x, CASE WHEN scl IN (4, 5, 6, 7, 11)
           THEN (CAST(nir AS DOUBLE) - red) / NULLIF(CAST(nir AS DOUBLE) + red, 0) END AS ndvi
         FROM pixel_obs"""))
def ndvi_weekly(spark, sf):
    obs = view(spark, sf, "pixel_obs")
    n = obs.select("t", "y", "x", F.when(qa.scl_mask("scl"), normalized_difference("nir", "red")).alias("ndvi"))
    w = timeseries.weekly_stats(n, "ndvi")
    return w.select(iso_day("week").alias("week"), "y", "x", r9("ndvi_min").alias("ndvi_min"),
                    r9("ndvi_mean").alias("ndvi_mean"), r9("ndvi_max").alias("ndvi_max"))


@register("mask_from_product", operators=("J2", "P10", "P14"), oracle=oracle_with("""
SELECT CAST(p.t AS VARCHAR) AS t, p.y, p.x,
       CASE WHEN COALESCE(q.cloudy, false) THEN NULL ELSE CAST(p.red AS DOUBLE) END AS red
FROM pixels p LEFT JOIN q ON p.t = q.t AND p.y = q.y AND p.x = q.x""", "pixels", "pixel_obs",
    q="""SELECT CAST(date_trunc('month', t) AS DATE) AS t, y, x, bool_or((COALESCE(qa_pixel, 0) & 24) <> 0) AS cloudy
         FROM pixel_obs GROUP BY 1, 2, 3"""))
def mask_from_product(spark, sf):
    data = view(spark, sf, "pixels").select("t", "y", "x", "red")
    obs = view(spark, sf, "pixel_obs")
    pq = (obs.groupBy(F.date_trunc("month", "t").cast("date").alias("t"), "y", "x")
             .agg(F.bool_or(qa.qa_pixel_any("qa_pixel", ["cloud", "cloud_shadow"])).alias("cloudy")))
    j = cube.mask_from(data, pq)
    out = cube.mask_bands(j, F.coalesce(F.col("cloudy"), F.lit(False)), ["red"])
    return out.select(iso_day("t").alias("t"), "y", "x", F.col("red").cast("double").alias("red"))


@register("merge_cubes", operators=("J3", "P11"), oracle=oracle_with("""
SELECT CAST(COALESCE(a.t, b.t) AS VARCHAR) AS t, COALESCE(a.y, b.y) AS y, COALESCE(a.x, b.x) AS x,
       CAST(a.red AS DOUBLE) AS red, CAST(b.n_valid AS DOUBLE) AS n_valid
FROM a FULL OUTER JOIN b ON a.t = b.t AND a.y = b.y AND a.x = b.x""", "pixels", "pixel_obs",
    a="SELECT t, y, x, red FROM pixels WHERE red BETWEEN 7273 AND 43636",
    b="""SELECT CAST(date_trunc('month', t) AS DATE) AS t, y, x, COUNT(*) AS n_valid
         FROM pixel_obs WHERE scl IN (4, 5, 6, 7, 11) GROUP BY 1, 2, 3"""))
def merge_cubes(spark, sf):
    a = view(spark, sf, "pixels").select("t", "y", "x", "red").filter(F.col("red").between(7273, 43636))
    obs = view(spark, sf, "pixel_obs").filter(qa.scl_mask("scl"))
    b = obs.groupBy(F.date_trunc("month", "t").cast("date").alias("t"), "y", "x").agg(
        F.count(F.lit(1)).alias("n_valid"))
    m = cube.merge_cubes(a, b)
    return m.select(iso_day("t").alias("t"), "y", "x", F.col("red").cast("double").alias("red"),
                    F.col("n_valid").cast("double").alias("n_valid"))


@register("frame_index", operators=("W7", "F38", "F13"), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, idx AS frame, idx = (SELECT COUNT(*) FROM d) // 2 AS is_midway,
       strftime(t, '%d %b %Y') AS caption, CAST(year(t) AS INTEGER) AS yr
FROM (SELECT t, DENSE_RANK() OVER (ORDER BY t) - 1 AS idx FROM d) r""", "pixels",
    d="SELECT DISTINCT t FROM pixels"))
def frame_index(spark, sf):
    from ..operators.overlay import frame_table
    frames = frame_table(view(spark, sf, "pixels"), "t")
    return frames.select(iso_day("t").alias("t"), "frame", "is_midway", "caption",
                         F.year("t").alias("yr"))


TILE_EDGE = 16


@register("tile_assign", operators=("W8",), oracle=oracle_with(f"""
SELECT CAST(t AS VARCHAR) AS t, CAST(FLOOR(y / {TILE_EDGE}) AS BIGINT) AS tile_y,
       CAST(FLOOR(x / {TILE_EDGE}) AS BIGINT) AS tile_x, COUNT(*) AS n_cells, COUNT(red) AS n_red
FROM pixels GROUP BY 1, 2, 3""", "pixels"))
def tile_assign(spark, sf):
    px = cube.repartition_by_tile(view(spark, sf, "pixels"), TILE_EDGE)
    return (px.groupBy("t", "tile_y", "tile_x")
              .agg(F.count(F.lit(1)).alias("n_cells"), F.count("red").alias("n_red"))
              .withColumn("t", iso_day("t")))


@register("time_slice", operators=("P15", "W7"), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, y, x, red FROM pixels
WHERE t = (SELECT MIN(t) FROM pixels) OR t = (SELECT MAX(t) FROM pixels)""", "pixels"))
def time_slice(spark, sf):
    px = view(spark, sf, "pixels").select("t", "y", "x", "red")
    return cube.isel_time(px, [0, -1]).withColumn("t", iso_day("t"))


@register("water_fuse_fold", operators=("X3", "A5"), oracle=oracle_with("""
SELECT CAST(solar_day AS VARCHAR) AS solar_day, y, x,
       COALESCE(bit_or(wofs) FILTER (WHERE wofs % 2 = 0), last(wofs ORDER BY t, scene_id, seq, lon, wofs)) AS wofs
FROM o GROUP BY solar_day, y, x""", "pixel_obs", o=_OBS_SQL))
def water_fuse_fold(spark, sf):
    # The user-fuser path: each (solar day, cell) group holds the few scenes
    # covering that cell that day, folded in scene order inside one task.
    obs = timeseries.with_solar_day(view(spark, sf, "pixel_obs"))
    f = timeseries.custom_fuse(obs, ["solar_day", "y", "x"], "wofs", ORDER, timeseries.wofs_fuser_np)
    return f.withColumn("solar_day", iso_day("solar_day"))
