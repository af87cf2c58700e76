"""Statistics and display preparation: band stats, histograms, stretches, legends."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import qa
from ..operators import cube, stats
from ..sources.fixtures import oracle_with, view
from ..sources.products import WORLDCOVER_LEGEND
from . import register
from .common import iso_day, r9, sql_str
from .landsat import CLOUDY, SR_BANDS, _MASKED_SR_SQL, _masked_sr

RGB = ["red", "green", "blue"]


def _union_bands(src: str, bands, keys="") -> str:
    k = f"{keys}, " if keys else ""
    return " UNION ALL ".join(f"SELECT {k}'{b}' AS band, CAST({b} AS DOUBLE) AS value FROM {src} "
                              f"WHERE {b} IS NOT NULL" for b in bands)


@register("band_stats", operators=("A8", "F5", "P10", "P11"), oracle=oracle_with("""
SELECT band, ROUND(VAR_POP(value), 12) AS var, ROUND(MIN(value), 9) AS min, ROUND(MAX(value), 9) AS max,
       COUNT(value) AS n
FROM lb GROUP BY band""", "pixels", m=_MASKED_SR_SQL, lb=_union_bands("m", SR_BANDS)))
def band_stats(spark, sf):
    s = stats.band_stats(_masked_sr(spark, sf), SR_BANDS)
    return s.select("band", F.round("var", 12).alias("var"), r9("min").alias("min"), r9("max").alias("max"), "n")


_MASKED_DN_SQL = """
  SELECT t, y, x,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 THEN red END AS red,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 THEN green END AS green,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 THEN blue END AS blue
  FROM pixels"""


def _masked_dn(spark, sf):
    px = view(spark, sf, "pixels")
    return cube.mask_bands(px, qa.qa_pixel_any("qa_pixel", CLOUDY), RGB).select("t", "y", "x", *RGB)


@register("histogram", operators=("A9", "P10"), oracle=oracle_with("""
SELECT band, bin, COUNT(*) AS n, ROUND(MIN(lo + bin * (hi - lo) / 50), 6) AS bin_lo FROM (
  SELECT lb.band, lo, hi,
         CAST(CASE WHEN hi = lo THEN 0 ELSE LEAST(FLOOR((value - lo) / (hi - lo) * 50), 49) END AS INTEGER) AS bin
  FROM lb JOIN r ON lb.band = r.band) z
GROUP BY band, bin""", "pixels", m=_MASKED_DN_SQL, lb=_union_bands("m", RGB),
    r="SELECT band, MIN(value) AS lo, MAX(value) AS hi FROM lb GROUP BY band"))
def histogram(spark, sf):
    h = stats.histogram(_masked_dn(spark, sf), RGB)
    return h.select("band", "bin", "n", F.round("bin_lo", 6).alias("bin_lo"))


@register("stretch", operators=("A10",), oracle=oracle_with("""
SELECT ROUND(q[1], 6) AS p_low, ROUND(q[2], 6) AS p_high, n
FROM (SELECT quantile_cont(value, [0.02, 0.98]) AS q, COUNT(*) AS n FROM lb) z""",
    "pixels", m=_MASKED_DN_SQL, lb=_union_bands("m", RGB)))
def stretch(spark, sf):
    """Robust (2-98 %) bounds of all RGB values pooled over bands and times."""
    dn = _masked_dn(spark, sf)
    b = stats.percentile_bounds(dn, RGB)
    n = stats.long_bands(dn, RGB).filter(F.col("value").isNotNull()).agg(F.count(F.lit(1))).scalar()
    return b.select(F.round("p_low", 6).alias("p_low"), F.round("p_high", 6).alias("p_high"), n.alias("n"))


@register("stretch_by_time", operators=("A10", "F5"), oracle=oracle_with("""
SELECT CAST(CAST(t AS DATE) AS VARCHAR) AS t, ROUND(q[1], 9) AS p_low, ROUND(q[2], 9) AS p_high
FROM (SELECT t, quantile_cont(value, [0.02, 0.98]) AS q FROM lb GROUP BY t) z""",
    "pixels", m=_MASKED_SR_SQL, lb=_union_bands("m", SR_BANDS, "t")))
def stretch_by_time(spark, sf):
    """Robust bounds of the scaled reflectances (fractions, not counts) of each time step."""
    b = stats.percentile_bounds(_masked_sr(spark, sf), SR_BANDS, keys=["t"])
    return b.select(iso_day("t").alias("t"), r9("p_low").alias("p_low"), r9("p_high").alias("p_high"))


@register("rgb_stretch", operators=("F12", "A10"), oracle=oracle_with("""
SELECT CAST(m.t AS VARCHAR) AS t, m.y, m.x,
  ROUND(CASE WHEN (m.red - q[1]) / NULLIF(q[2] - q[1], 0) IS NOT NULL
              THEN GREATEST(0.0, LEAST(1.0, (m.red - q[1]) / NULLIF(q[2] - q[1], 0))) END, 9) AS red,
  ROUND(CASE WHEN (m.green - q[1]) / NULLIF(q[2] - q[1], 0) IS NOT NULL
              THEN GREATEST(0.0, LEAST(1.0, (m.green - q[1]) / NULLIF(q[2] - q[1], 0))) END, 9) AS green,
  ROUND(CASE WHEN (m.blue - q[1]) / NULLIF(q[2] - q[1], 0) IS NOT NULL
              THEN GREATEST(0.0, LEAST(1.0, (m.blue - q[1]) / NULLIF(q[2] - q[1], 0))) END, 9) AS blue
FROM m, (SELECT quantile_cont(value, [0.02, 0.98]) AS q FROM lb) z""",
    "pixels", m=_MASKED_DN_SQL, lb=_union_bands("m", RGB)))
def rgb_stretch(spark, sf):
    """F12 with one pair of bounds for the whole selection (scalar subqueries, no join)."""
    dn = _masked_dn(spark, sf)
    bounds = stats.percentile_bounds(dn, RGB)
    s = stats.stretch(dn, RGB, bounds)
    return s.select(iso_day("t").alias("t"), "y", "x", *[r9(b).alias(b) for b in RGB])


@register("cube_extent", operators=("A27",), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, MIN(x) AS xmin, MAX(x) AS xmax, MIN(y) AS ymin, MAX(y) AS ymax,
       MIN(x) - 0.5 AS edge_xmin, MAX(x) + 0.5 AS edge_xmax, MIN(y) - 0.5 AS edge_ymin, MAX(y) + 0.5 AS edge_ymax
FROM pixels GROUP BY t""", "pixels"))
def cube_extent(spark, sf):
    px = view(spark, sf, "pixels")
    e = stats.extent(px, ["t"])
    return stats.with_edges(e, 1.0, "edge_").withColumn("t", iso_day("t"))


def _legend_sql():
    rows = ", ".join(f"({i}, {v}, {c[0]}, {c[1]}, {c[2]}, {sql_str(lab)})"
                     for i, (v, c, lab) in enumerate(WORLDCOVER_LEGEND))
    return f"SELECT * FROM (VALUES {rows}) AS v(idx, value, r, g, b, label)"


@register("landcover_legend", operators=("J6", "X5"), oracle=oracle_with("""
SELECT CAST(l.yr AS BIGINT) AS yr, l.y, l.x, l.cls, CAST(g.idx AS DOUBLE) AS idx, CAST(g.r AS DOUBLE) AS r,
       CAST(g.g AS DOUBLE) AS g, CAST(g.b AS DOUBLE) AS b, g.label
FROM landcover l LEFT JOIN legend g ON l.cls = g.value""", "landcover", legend=_legend_sql()))
def landcover_legend(spark, sf):
    lc = view(spark, sf, "landcover")
    j = stats.apply_legend(lc, "cls", stats.legend_table(spark, WORLDCOVER_LEGEND))
    return j.select(F.col("yr").cast("long").alias("yr"), "y", "x", "cls",
                    *[F.col(c).cast("double").alias(c) for c in ("idx", "r", "g", "b")], "label")


@register("class_codes", operators=("A23",), oracle=oracle_with("""
SELECT f.fid, f.attr, CAST(c.code AS INTEGER) AS code FROM features f JOIN (
  SELECT attr, ROW_NUMBER() OVER (ORDER BY MIN(fid), attr) - 1 AS code FROM features GROUP BY attr) c
ON f.attr = c.attr""", "features"))
def class_codes(spark, sf):
    f = view(spark, sf, "features").select("fid", "attr")
    return stats.class_codes(f, "attr", "fid")
