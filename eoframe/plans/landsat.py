"""Landsat surface-reflectance workflow: QA masks, valid ranges, scaling.

Minimum slice: pixels -> QA_PIXEL OR-mask (cloud, cloud shadow, dilated
cloud, cirrus, nodata) -> null out -> drop empty times -> valid range ->
reflectance -> monthly red and NDVI statistics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import qa, radiometry
from ..functions.radiometry import (SR_GAIN, SR_OFFSET, ST_GAIN, ST_OFFSET, KELVIN_TO_CELSIUS, SR_VALID_RANGE,
                                    ST_VALID_RANGE, normalized_difference, to_celsius, to_reflectance)
from ..operators import cube
from ..sources.fixtures import oracle_with, view
from . import register

SR_BANDS = ["red", "green", "blue", "nir"]
CLOUDY = ["cloud", "cloud_shadow", "dilated_cloud", "cirrus", "nodata"]


def grid_cells(spark, sf):
    """Number of cells of the fixture grid: one per part."""
    return view(spark, sf, "dem").agg(F.count(F.lit(1))).scalar()


def r9(c):
    """Round aggregates of scaled values: finer than their exact decimals, so
    engines never meet a rounding tie, coarser than summation-order noise."""
    return F.round(c, 9)


def iso_day(c):
    return F.col(c).cast("date").cast("string")


def _masked_sr(spark, sf):
    px = view(spark, sf, "pixels")
    bad = qa.qa_pixel_any("qa_pixel", CLOUDY)
    px = cube.mask_bands(px, bad, SR_BANDS).drop("qa_pixel")
    lo, hi = SR_VALID_RANGE
    px = cube.within_range(px, SR_BANDS, lo, hi)
    return px.select("t", "y", "x", *[to_reflectance(b).alias(b) for b in SR_BANDS])


_MASKED_DN_SQL_SR = """
  SELECT t, y, x,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND red BETWEEN 7273 AND 43636 THEN red END AS red,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND green BETWEEN 7273 AND 43636 THEN green END AS green,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND blue BETWEEN 7273 AND 43636 THEN blue END AS blue,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND nir BETWEEN 7273 AND 43636 THEN nir END AS nir
  FROM pixels
"""


def _masked_dn_sr(spark, sf):
    """Cloud-masked DN inside the reflectance valid range (still integers)."""
    px = view(spark, sf, "pixels")
    bad = qa.qa_pixel_any("qa_pixel", CLOUDY)
    px = cube.mask_bands(px, bad, SR_BANDS).drop("qa_pixel")
    lo, hi = SR_VALID_RANGE
    return cube.within_range(px, SR_BANDS, lo, hi).select("t", "y", "x", *SR_BANDS)


_MASKED_SR_SQL = """
  SELECT t, y, x,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND red BETWEEN 7273 AND 43636 THEN red * 2.75e-5 - 0.2 END AS red,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND green BETWEEN 7273 AND 43636 THEN green * 2.75e-5 - 0.2 END AS green,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND blue BETWEEN 7273 AND 43636 THEN blue * 2.75e-5 - 0.2 END AS blue,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND nir BETWEEN 7273 AND 43636 THEN nir * 2.75e-5 - 0.2 END AS nir
  FROM pixels
"""


def _sr_of(c):
    """Reflectance of a DN-valued Column (the scaling is linear, so it commutes with mean/min/max)."""
    return F.col(c).cast("double") * F.lit(SR_GAIN) + F.lit(SR_OFFSET)


@register("landsat_sr_monthly", operators=("F1", "F2", "U5", "P10", "P12", "P11", "F5", "F7", "A8", "P21", "K8"),
          oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, COUNT(red) AS n_red,
       ROUND((CAST(SUM(red) AS DOUBLE) / COUNT(red)) * 2.75e-5 + -0.2, 9) AS red_mean,
       ROUND(MIN(red) * 2.75e-5 + -0.2, 9) AS red_min, ROUND(MAX(red) * 2.75e-5 + -0.2, 9) AS red_max,
       ROUND(AVG(ndvi), 9) AS ndvi_mean, ROUND(MIN(ndvi), 9) AS ndvi_min, ROUND(MAX(ndvi), 9) AS ndvi_max
FROM s GROUP BY t
HAVING COUNT(red) + COUNT(green) + COUNT(blue) + COUNT(nir) > 0""", "pixels", m=_MASKED_DN_SQL_SR,
              s="""SELECT t, red, green, blue, nir,
                     ((nir * 2.75e-5 - 0.2) - (red * 2.75e-5 - 0.2)) / NULLIF((nir * 2.75e-5 - 0.2) + (red * 2.75e-5 - 0.2), 0) AS ndvi
                   FROM m"""))
def landsat_sr_monthly(spark, sf):
    px = _masked_dn_sr(spark, sf)
    ndvi = normalized_difference(to_reflectance("nir"), to_reflectance("red"))
    # Reflectance statistics come from exact integer DN aggregates (count, sum,
    # min, max), scaled afterwards: order-independent, so every engine and
    # every partitioning gives the same bits. Dropping all-empty time steps is
    # a HAVING on the per-time aggregate (no second pass over the pixels).
    g = (px.withColumn("ndvi", ndvi).groupBy("t")
           .agg(F.count("red").alias("n_red"), F.sum("red").alias("_s"), F.min("red").alias("_lo"),
                F.max("red").alias("_hi"), F.avg("ndvi").alias("_nm"), F.min("ndvi").alias("_nl"),
                F.max("ndvi").alias("_nh"), F.max(cube.any_not_null(SR_BANDS).cast("int")).alias("_any"))
           .filter(F.col("_any") == 1))
    mean_dn = F.col("_s").cast("double") / F.col("n_red")
    return g.select(iso_day("t").alias("t"), "n_red",
                    r9(mean_dn * F.lit(SR_GAIN) + F.lit(SR_OFFSET)).alias("red_mean"),
                    r9(_sr_of("_lo")).alias("red_min"), r9(_sr_of("_hi")).alias("red_max"),
                    r9("_nm").alias("ndvi_mean"), r9("_nl").alias("ndvi_min"), r9("_nh").alias("ndvi_max"))


QA_TYPES = ["nodata", "dilated_cloud", "cirrus", "cloud", "cloud_shadow", "snow", "clear", "water",
            "cloud_confidence:low", "cloud_confidence:medium", "cloud_confidence:high",
            "cirrus_confidence:low", "cirrus_confidence:high",
            "snow_ice_confidence:low", "snow_ice_confidence:high",
            "cloud_shadow_confidence:low", "cloud_shadow_confidence:high"]


def _qa_name(m):
    return "n_" + m.replace(":", "_")


def _bit_sql(b):
    return f"(COALESCE(qa_pixel, 0) // {1 << b}) % 2 = 1"


def _qa_sql(m):
    single = {"nodata": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3, "cloud_shadow": 4,
              "snow": 5, "clear": 6, "water": 7}
    pairs = {"cloud_confidence": (8, 9), "cloud_shadow_confidence": (10, 11),
             "snow_ice_confidence": (12, 13), "cirrus_confidence": (14, 15)}
    if m in single:
        return _bit_sql(single[m])
    main, sub = m.split(":")
    lo, hi = pairs[main]
    return {"low": f"{_bit_sql(lo)} AND NOT ({_bit_sql(hi)})",
            "medium": f"NOT ({_bit_sql(lo)}) AND {_bit_sql(hi)}",
            "high": f"{_bit_sql(lo)} AND {_bit_sql(hi)}"}[sub]


@register("qa_masks", operators=("F1", "F2"), oracle=oracle_with(
    "SELECT CAST(t AS VARCHAR) AS t, COUNT(*) AS n_cells, "
    + ", ".join(f"COUNT(*) FILTER (WHERE {_qa_sql(m)}) AS {_qa_name(m)}" for m in QA_TYPES)
    + " FROM pixels GROUP BY t", "pixels"))
def qa_masks(spark, sf):
    px = view(spark, sf, "pixels")
    return (px.groupBy("t")
              .agg(F.count(F.lit(1)).alias("n_cells"),
                   *[F.count_if(qa.qa_pixel_mask("qa_pixel", m)).alias(_qa_name(m)) for m in QA_TYPES])
              .withColumn("t", iso_day("t")))


ARD_S2_LABELS = ["vegetation", "snow or ice", "water", "bare soils", "unclassified", "dark area pixels"]


@register("scl_mask", operators=("F3", "J7"), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, COUNT(*) AS n_cells,
       COUNT(*) FILTER (WHERE scl IN (4, 5, 6, 7, 11)) AS n_valid_default,
       COUNT(*) FILTER (WHERE scl IN (2, 4, 5, 6, 7, 11)) AS n_valid_ard
FROM pixels GROUP BY t""", "pixels"))
def scl_mask(spark, sf):
    px = view(spark, sf, "pixels")
    ard_codes = qa.scl_codes(ARD_S2_LABELS)
    return (px.groupBy("t")
              .agg(F.count(F.lit(1)).alias("n_cells"),
                   F.count_if(qa.scl_mask("scl")).alias("n_valid_default"),
                   F.count_if(qa.scl_mask("scl", ard_codes)).alias("n_valid_ard"))
              .withColumn("t", iso_day("t")))


@register("flag_mask", operators=("F4",), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t,
  COUNT(*) FILTER (WHERE (COALESCE(qa_pixel,0) // 8) % 2 = 0 AND (COALESCE(qa_pixel,0) // 16) % 2 = 0
                         AND COALESCE(qa_pixel,0) % 2 = 0) AS n_clear_flags,
  COUNT(*) FILTER (WHERE (COALESCE(qa_pixel,0) // 256) % 4 = 3) AS n_cloud_conf_high,
  COUNT(*) FILTER (WHERE (COALESCE(qa_pixel,0) // 128) % 2 = 1 AND (COALESCE(qa_pixel,0) // 64) % 2 = 0) AS n_water_not_clear
FROM pixels GROUP BY t""", "pixels"))
def flag_mask(spark, sf):
    px = view(spark, sf, "pixels")
    p, b = "ls89_c2l2_sp", "qa_pixel"
    clear = qa.make_mask("qa_pixel", p, b, cloud="not_high_confidence",
                         cloud_shadow="not_high_confidence", nodata=False)
    conf = qa.make_mask("qa_pixel", p, b, cloud_confidence="high")
    water = qa.make_mask("qa_pixel", p, b, water="water", clear=False)
    return (px.groupBy("t")
              .agg(F.count_if(clear).alias("n_clear_flags"),
                   F.count_if(conf).alias("n_cloud_conf_high"),
                   F.count_if(water).alias("n_water_not_clear"))
              .withColumn("t", iso_day("t")))


_FLAG_BANDS_SQL = "SELECT t, qa_pixel % 4096 AS qa_radsat, qa_pixel // 16 % 256 AS qa_aerosol, qa_pixel // 8 % 64 AS cloud_qa FROM pixels"


@register("quality_flags", operators=("F4",), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t,
  COUNT(*) FILTER (WHERE qa_radsat & 8 = 8 AND qa_radsat & 2048 = 0) AS n_red_saturated,
  COUNT(*) FILTER (WHERE qa_radsat & 2048 = 2048 AND qa_radsat & 1 = 0) AS n_occluded,
  COUNT(*) FILTER (WHERE qa_aerosol & 2 = 2 AND qa_aerosol & 1 = 0 AND qa_aerosol // 64 = 3) AS n_high_aerosol,
  COUNT(*) FILTER (WHERE qa_aerosol // 64 = 0 AND qa_aerosol & 4 = 4 AND qa_aerosol & 32 = 0) AS n_water_climatology,
  COUNT(*) FILTER (WHERE cloud_qa & 6 = 0 AND cloud_qa & 8 = 8) AS n_beside_cloud,
  COUNT(*) FILTER (WHERE cloud_qa & 49 = 48) AS n_snow_water
FROM q GROUP BY t""", "pixels", q=_FLAG_BANDS_SQL))
def quality_flags(spark, sf):
    q = F.coalesce(F.col("qa_pixel"), F.lit(0))
    px = view(spark, sf, "pixels").where("qa_pixel is not null").select(
        "t", (q % 4096).alias("qa_radsat"), (F.floor(q / 16) % 256).alias("qa_aerosol"), (F.floor(q / 8) % 64).alias("cloud_qa"))
    ls89, ls7 = "ls89_c2l2_sp", "ls7_c2l2_sp"
    masks = {
        "n_red_saturated": qa.make_mask("qa_radsat", ls89, "qa_radsat", red_saturation=True, terrain_occlusion=False),
        "n_occluded": qa.make_mask("qa_radsat", ls89, "qa_radsat", terrain_occlusion=True, band_1_saturation=False),
        "n_high_aerosol": qa.make_mask("qa_aerosol", ls89, "qa_aerosol", valid_aerosol_retrieval=True, nodata=False,
                                       aerosol_level="high"),
        "n_water_climatology": qa.make_mask("qa_aerosol", ls89, "qa_aerosol", aerosol_level="climatology", water=True,
                                            interpolated_aerosol=False),
        "n_beside_cloud": qa.make_mask("cloud_qa", ls7, "cloud_qa", cloud=False, cloud_shadow=False, adjacent_to_cloud=True),
        "n_snow_water": qa.make_mask("cloud_qa", ls7, "cloud_qa", snow=True, water=True, dark_dense_vegetation=False),
    }
    return px.groupBy("t").agg(*[F.count_if(m).alias(n) for n, m in masks.items()]).withColumn("t", iso_day("t"))


@register("s2_reflectance", operators=("F5",), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, y, x, CAST(red AS DOUBLE) / 10000 AS red, CAST(nir AS DOUBLE) / 10000 AS nir, scl,
       lwir11 % 1000 AS aerosol_optical_thickness
FROM pixels""", "pixels"))
def s2_reflectance(spark, sf):
    px = view(spark, sf, "pixels").withColumn("aerosol_optical_thickness", F.col("lwir11") % 1000)
    bands = ["red", "nir", "scl", "aerosol_optical_thickness"]
    return px.select(iso_day("t").alias("t"), "y", "x", *[radiometry.s2_reflectance(b).alias(b) for b in bands])


@register("good_fraction", operators=("A1",), oracle=oracle_with(f"""
SELECT CAST(t AS VARCHAR) AS t,
       ROUND(CAST(COUNT(*) FILTER (WHERE (COALESCE(qa_pixel, 0) & 31) = 0) AS DOUBLE) / (SELECT COUNT(*) FROM part), 9) AS good_frac
FROM pixels GROUP BY t""", "pixels"))
def good_fraction(spark, sf):
    px = view(spark, sf, "pixels")
    good = ~qa.qa_pixel_any("qa_pixel", CLOUDY)
    return (cube.good_fraction(px, good, grid_cells(spark, sf))
                .select(iso_day("t").alias("t"), r9("good_frac").alias("good_frac")))


MIN_GOOD = 0.2


@register("min_gooddata", operators=("P13", "A1", "P10", "P14"), oracle=oracle_with(f"""
SELECT CAST(p.t AS VARCHAR) AS t, p.y, p.x,
       CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND red <> 0 THEN CAST(red AS FLOAT) END AS red,
       CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND nir <> 0 THEN CAST(nir AS FLOAT) END AS nir
FROM pixels p JOIN keep k ON p.t = k.t""", "pixels", keep=f"""
  SELECT t FROM pixels GROUP BY t
  HAVING CAST(COUNT(*) FILTER (WHERE (COALESCE(qa_pixel, 0) & 31) = 0) AS DOUBLE) / (SELECT COUNT(*) FROM part) >= {MIN_GOOD}"""))
def min_gooddata(spark, sf):
    px = view(spark, sf, "pixels")
    good = ~qa.qa_pixel_any("qa_pixel", CLOUDY)
    kept = cube.min_gooddata(px, good, MIN_GOOD, grid_cells(spark, sf))
    out = cube.keep_good_only(kept.withColumn("_good", good), F.col("_good"),
                              {"red": 0.0, "nir": 0.0})
    return out.select(iso_day("t").alias("t"), "y", "x", "red", "nir")


@register("valid_range", operators=("P11", "P10", "P12"), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, y, x, CAST(red AS DOUBLE) AS red, CAST(green AS DOUBLE) AS green,
       CAST(blue AS DOUBLE) AS blue FROM m
WHERE t IN (SELECT t FROM nn) AND y IN (SELECT y FROM nn) AND x IN (SELECT x FROM nn)""", "pixels", m="""
  SELECT t, y, x,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND red BETWEEN 7273 AND 43636 THEN red END AS red,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND green BETWEEN 7273 AND 43636 THEN green END AS green,
    CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND blue BETWEEN 7273 AND 43636 THEN blue END AS blue
  FROM pixels""", nn="SELECT * FROM m WHERE red IS NOT NULL OR green IS NOT NULL OR blue IS NOT NULL"))
def valid_range(spark, sf):
    px = view(spark, sf, "pixels")
    bands = ["red", "green", "blue"]
    bad = qa.qa_pixel_any("qa_pixel", CLOUDY)
    px = cube.mask_bands(px, bad, bands).select("t", "y", "x", *bands)
    lo, hi = SR_VALID_RANGE
    out = cube.valid_range(px, bands, lo, hi, drop=True, axes=("t", "y", "x"))
    return out.select(iso_day("t").alias("t"), "y", "x", *[F.col(b).cast("double").alias(b) for b in bands])


@register("surface_temp", operators=("F6", "P10", "P11", "P12", "A8"), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, COUNT(st) AS n_st,
       ROUND(((CAST(SUM(st) AS DOUBLE) / COUNT(st)) * 0.00341802 + 149.0) + -273.15, 9) AS st_mean,
       ROUND((MIN(st) * 0.00341802 + 149.0) + -273.15, 9) AS st_min,
       ROUND((MAX(st) * 0.00341802 + 149.0) + -273.15, 9) AS st_max
FROM m GROUP BY t HAVING COUNT(st) > 0""", "pixels", m="""
  SELECT t, CASE WHEN (COALESCE(qa_pixel, 0) & 31) = 0 AND lwir11 BETWEEN 293 AND 61440 THEN lwir11 END AS st
  FROM pixels"""))
def surface_temp(spark, sf):
    px = view(spark, sf, "pixels")
    bad = qa.qa_pixel_any("qa_pixel", CLOUDY)
    px = cube.mask_bands(px, bad, ["lwir11"])
    lo, hi = ST_VALID_RANGE
    dn = cube.within_range(px, ["lwir11"], lo, hi).select("t", F.col("lwir11").alias("st"))
    # Celsius statistics from exact integer DN aggregates, converted afterwards.
    g = dn.groupBy("t").agg(F.count("st").alias("n_st"), F.sum("st").alias("_s"), F.min("st").alias("_lo"),
                            F.max("st").alias("_hi")).filter(F.col("n_st") > 0)
    mean_dn = F.col("_s").cast("double") / F.col("n_st")
    return g.select(iso_day("t").alias("t"), "n_st", r9(to_celsius(mean_dn)).alias("st_mean"),
                    r9(to_celsius("_lo")).alias("st_min"), r9(to_celsius("_hi")).alias("st_max"))
