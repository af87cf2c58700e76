"""Catalogue search and load: scenes, product metadata, extents, CRS, indexing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import catalog
from ..sources.fixtures import oracle_with, view
from . import register
from .common import bands_values_sql, iso_ts, sql_iso_ts

def _summary_sql():
    from ..sources.products import PRODUCTS
    from .common import sql_str
    rows = []
    for name, (desc, _, _, bands) in PRODUCTS.items():
        names = [b[0] for b in bands]
        rows.append(f"({sql_str(name)}, {sql_str(desc or 'Not specified')}, 'eo3', {len(bands)}, "
                    f"{sql_str(', '.join(names[:3]))}, {max(len(bands) - 3, 0)})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows)
            + ") AS v(name, description, metadata_type, n_bands, first_bands, n_more)")


SEARCH_PRODUCTS = ["ls89_c2l2_sp", "ls7_c2l2_sp"]
SEARCH_BBOX = (-20.0, -40.0, 60.0, 40.0)
SEARCH_DAYS = ("1996-01-01", "1998-12-31")


@register("scene_search", operators=("S1", "U1", "P3", "P4", "P6", "P7", "P8"), oracle=oracle_with(f"""
SELECT id, product, {sql_iso_ts('t')} AS t, cloud_cover, region_code
FROM scenes
WHERE product IN ('ls89_c2l2_sp', 'ls7_c2l2_sp')
  AND minx <= 60 AND maxx >= -20 AND miny <= 40 AND maxy >= -40
  AND t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '1999-01-01'
  AND (product <> 'ls7_c2l2_sp' OR t < TIMESTAMP '2003-05-31')
  AND cloud_cover < 50""", "scenes"))
def scene_search(spark, sf):
    sc = view(spark, sf, "scenes")
    found = catalog.find_scenes(sc, SEARCH_PRODUCTS, SEARCH_BBOX, temporal.day_range(*SEARCH_DAYS),
                                predicate=F.col("cloud_cover") < 50,
                                slc_off_products=["ls7_c2l2_sp"], slc_off=False)
    return found.select("id", "product", iso_ts("t").alias("t"), "cloud_cover", "region_code")


AOI = (10.0, 10.0, 20.0, 20.0)


@register("product_bbox", operators=("A3", "P16", "A24"), oracle=oracle_with("""
SELECT product, MIN(minx) AS minx, MIN(miny) AS miny, MAX(maxx) AS maxx, MAX(maxy) AS maxy,
       COUNT(*) AS n_scenes,
       MIN(minx) <= 10 AND MIN(miny) <= 10 AND MAX(maxx) >= 20 AND MAX(maxy) >= 20 AS aoi_inside
FROM scenes GROUP BY product""", "scenes"))
def product_bbox(spark, sf):
    from ..functions.geo import bbox_contains
    b = catalog.product_bbox(view(spark, sf, "scenes"))
    return b.withColumn("aoi_inside", bbox_contains("minx", "miny", "maxx", "maxy", AOI))


@register("time_extent", operators=("A6", "A24", "F24"), oracle=oracle_with(f"""
SELECT product, {sql_iso_ts('MIN(t)')} AS first_time, {sql_iso_ts('MAX(t)')} AS last_time
FROM scenes GROUP BY product""", "scenes"))
def time_extent(spark, sf):
    e = catalog.time_extent(view(spark, sf, "scenes"))
    return e.select("product", iso_ts("first_time").alias("first_time"), iso_ts("last_time").alias("last_time"))


_UTM_SQL = ("'epsg:' || CAST(CAST(CASE WHEN (miny + maxy) / 2 >= 0 THEN 32600 ELSE 32700 END "
            "+ LEAST(FLOOR(((minx + maxx) / 2 + 180) / 6) + 1, 60) AS INTEGER) AS VARCHAR)")


@register("common_crs", operators=("A2", "O2", "F8"), oracle=oracle_with("""
SELECT product, crs, n, n_values, n_values > 1 AS several FROM r WHERE rn = 1""", "scenes",
    sc=f"SELECT id, product, {_UTM_SQL} AS crs FROM scenes",
    c="SELECT product, crs, COUNT(*) AS n, MIN(id) AS first_id FROM sc GROUP BY product, crs",
    r="""SELECT *, ROW_NUMBER() OVER (PARTITION BY product ORDER BY n DESC, first_id) AS rn,
         COUNT(*) OVER (PARTITION BY product) AS n_values FROM c"""))
def common_crs(spark, sf):
    sc = catalog.with_utm_crs(view(spark, sf, "scenes"))
    top = catalog.most_common(sc, ["product"], "crs", "id")
    return top.select("product", "crs", "n", "n_values", (F.col("n_values") > 1).alias("several"))


FAMILY_ORDER = ["ls89_c2l2_sp", "ls7_c2l2_sp", "ls45_c2l2_sp"]


@register("common_bands", operators=("P2", "U3", "S11", "A24"), oracle=oracle_with("""
SELECT band, pos FROM b
WHERE product = (SELECT product FROM present ORDER BY rk LIMIT 1)
  AND band IN (SELECT band FROM b GROUP BY band HAVING COUNT(DISTINCT product) = (SELECT COUNT(*) FROM present))""",
    "scenes",
    present="""SELECT DISTINCT product, CASE product WHEN 'ls89_c2l2_sp' THEN 1 WHEN 'ls7_c2l2_sp' THEN 2
               WHEN 'ls45_c2l2_sp' THEN 3 END AS rk
               FROM scenes WHERE product IN ('ls89_c2l2_sp', 'ls7_c2l2_sp', 'ls45_c2l2_sp')""",
    bands=bands_values_sql(),
    b="SELECT bands.product, pos, band FROM bands JOIN present ON bands.product = present.product"))
def common_bands(spark, sf):
    present = catalog.distinct_products(view(spark, sf, "scenes"))
    m = catalog.product_measurements(spark, present)
    return catalog.common_bands(m, FAMILY_ORDER)


@register("measurements", operators=("S11", "A24"), oracle=oracle_with("""
SELECT bands.product, pos, band, dtype, nodata, units, aliases FROM bands
WHERE bands.product IN (SELECT product FROM scenes WHERE minx <= 60 AND maxx >= -20 AND miny <= 40 AND maxy >= -40)""",
    "scenes", bands=bands_values_sql()))
def measurements(spark, sf):
    sc = catalog.find_scenes(view(spark, sf, "scenes"), bbox=SEARCH_BBOX)
    m = catalog.product_measurements(spark, catalog.distinct_products(sc))
    return m.withColumn("aliases", F.array_join("aliases", ","))


@register("product_summary", operators=("S12", "A24"), oracle=oracle_with("""
SELECT s.name, s.description, s.metadata_type, s.n_bands, s.first_bands, s.n_more, c.n_scenes
FROM summary s JOIN (SELECT product, COUNT(*) AS n_scenes FROM scenes GROUP BY product) c ON s.name = c.product""",
    "scenes", summary=_summary_sql()))
def product_summary(spark, sf):
    counts = view(spark, sf, "scenes").groupBy("product").agg(F.count(F.lit(1)).alias("n_scenes"))
    summ = catalog.product_summary(spark)
    return summ.join(counts.withColumnRenamed("product", "name"), "name")


LOAD_DAYS = ("1996-01-01", "1996-12-31")
LOAD_BANDS = ["SR_B4", "band_5", "pq"]


@register("band_alias_load", operators=("S2", "J1", "P1", "P14", "S1"), oracle=oracle_with(f"""
SELECT p.scene_id, p.seq, {sql_iso_ts('p.t')} AS t, p.y, p.x, p.red AS SR_B4, p.nir AS band_5, p.qa_pixel AS pq
FROM pixel_obs p
WHERE p.scene_id IN (SELECT id FROM scenes WHERE product = 'ls89_c2l2_sp'
                     AND t >= TIMESTAMP '1996-01-01' AND t < TIMESTAMP '1997-01-01')""", "pixel_obs", "scenes"))
def band_alias_load(spark, sf):
    found = catalog.find_scenes(view(spark, sf, "scenes"), ["ls89_c2l2_sp"],
                                time=temporal.day_range(*LOAD_DAYS)).select(F.col("id").alias("scene_id"))
    obs = view(spark, sf, "pixel_obs").withColumnRenamed("nir", "nir08")
    loaded = obs.join(found, "scene_id", "left_semi")
    out = catalog.resolve_bands(loaded, "ls89_c2l2_sp", LOAD_BANDS, keep=["scene_id", "seq", "t", "y", "x"])
    return out.withColumn("t", iso_ts("t"))


INDEX_BBOX = (-60.0, -60.0, 60.0, 60.0)
INDEX_DAYS = ("1997-01-01", "1997-12-31")


@register("index_by_spec", operators=("S4", "P8"), oracle=oracle_with(f"""
SELECT i.item_id, i.collection, i.platform, {sql_iso_ts('i.datetime')} AS datetime,
       COALESCE(s.rename, s.collection) AS product
FROM stac_items i JOIN spec s
  ON i.collection = s.collection
 AND (s.platforms IS NULL OR list_contains(s.platforms, i.platform))
 AND (NOT s.uses_datetime OR (i.datetime >= TIMESTAMP '1997-01-01' AND i.datetime < TIMESTAMP '1998-01-01'))
WHERE i.minx <= 60 AND i.maxx >= -60 AND i.miny <= 60 AND i.maxy >= -60""", "stac_items",
    spec="""SELECT * FROM (VALUES ('sentinel-2-l2a', NULL, 's2_l2a', true),
        ('io-lulc-annual-v02', NULL, NULL, false), ('nasadem', NULL, NULL, false),
        ('landsat-c2-l2', ['landsat-4', 'landsat-5'], 'ls45_c2l2_sp', true),
        ('landsat-c2-l2', ['landsat-7'], 'ls7_c2l2_sp', true),
        ('landsat-c2-l2', ['landsat-8', 'landsat-9'], 'ls89_c2l2_sp', true),
        ('sentinel-1-rtc', NULL, NULL, true), ('esa-worldcover', NULL, NULL, false))
        AS v(collection, platforms, rename, uses_datetime)"""))
def index_by_spec(spark, sf):
    items = view(spark, sf, "stac_items")
    out = catalog.index_by_spec(items, catalog.index_spec_table(spark), INDEX_BBOX, INDEX_DAYS)
    return out.withColumn("datetime", iso_ts("datetime"))


@register("stac_assets", operators=("P9", "P8", "F16"), oracle=oracle_with("""
SELECT a.scene_id, a.asset_key, a.url FROM assets a
WHERE a.scene_id IN (SELECT item_id FROM stac_items WHERE collection = 'landsat-c2-l2'
        AND minx <= 90 AND maxx >= -90 AND miny <= 60 AND maxy >= -60
        AND datetime >= TIMESTAMP '1996-01-01' AND datetime < TIMESTAMP '1997-01-01'
        AND platform IN ('landsat-8', 'landsat-9'))
  AND a.scene_id IN (SELECT scene_id FROM assets WHERE asset_key = 'mtl.txt')
  AND a.url NOT LIKE '%api%'
  AND NOT (lower(regexp_extract(split_part(a.url, '?', 1), '\\.([A-Za-z0-9]+)$', 1)) = 'tif'
           AND a.asset_key NOT IN ('red', 'green', 'qa_pixel'))
  AND a.url LIKE '%\\_T1\\_%' ESCAPE '\\'""", "stac_items", "assets"))
def stac_assets(spark, sf):
    from datetime import datetime
    return catalog.stac_assets(view(spark, sf, "stac_items"), view(spark, sf, "assets"), "landsat-c2-l2",
                               (-90.0, -60.0, 90.0, 60.0), (datetime(1996, 1, 1), datetime(1997, 1, 1)),
                               layers=["red", "green", "qa_pixel"], t1_only=True,
                               platforms=["landsat-8", "landsat-9"]).select("scene_id", "asset_key", "url")


@register("product_family", operators=("A26", "A24"), oracle=oracle_with("""
SELECT region_code, string_agg(DISTINCT product, ',' ORDER BY product) AS products,
       CASE WHEN bool_and(product LIKE '%level2%') THEN 'c2' WHEN bool_and(product LIKE '%sr%') THEN 'c1'
            WHEN bool_and(product LIKE '%s2%') THEN 's2' WHEN bool_and(product LIKE '%fractional_cover%') THEN 'fc'
       END AS family
FROM scenes GROUP BY region_code""", "scenes"))
def product_family(spark, sf):
    # collect_set is bounded by the number of products (a handful), never by rows.
    per = view(spark, sf, "scenes").groupBy("region_code").agg(F.sort_array(F.collect_set("product")).alias("p"))
    return per.select("region_code", F.array_join("p", ",").alias("products"),
                      catalog.classify_family(F.col("p")).alias("family"))
