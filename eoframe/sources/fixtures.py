"""Derived raster/catalogue views over the driver tables.

The test data has no raster files, so cubes, scenes, asset URLs and file
listings are derived from the TPC-H-like tables by deterministic SQL. The same
texts feed Spark (``spark.sql`` with DataFrame parameters, no global temp
views) and the DuckDB oracle (inlined as CTEs), so both engines start from
identical inputs. Everything derived here grows with the source tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .tables import read_table

# The view definitions of the fixture contract (FIXTURES.md §3).
# ``{name}`` marks a driver table. The grid has a cell per part, laid out in columns of
# 64 rows, so it grows with the data.
VIEW_SQL: dict[str, str] = {
    "pixel_obs": """
SELECT l_orderkey AS scene_id, l_linenumber AS seq, CAST(FLOOR(CAST(l_partkey AS DOUBLE) / 64) AS BIGINT) AS x, l_partkey % 64 AS y,
       l_shipdate AS t, CAST(l_suppkey % 12 AS DOUBLE) * 15 - 90 AS lon,
       (l_orderkey * 131 + l_linenumber * 977) % 45000 AS red,
       (l_partkey * 211 + l_linenumber * 577) % 45000 AS nir,
       CASE WHEN month(l_shipdate) = 2 THEN (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536 - (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536 % 2 + 1
            WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536
            ELSE (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536 - (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536 % 32 END AS qa_pixel,
       l_suppkey % 12 AS scl, (l_partkey + l_linenumber) % 256 AS wofs
FROM {lineitem}
""",
    "pixels": """
SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS t, l_partkey % 64 AS y, CAST(FLOOR(CAST(l_partkey AS DOUBLE) / 64) AS BIGINT) AS x,
       MIN(CASE WHEN (l_orderkey + l_partkey) % 41 = 0 THEN 0 ELSE (l_orderkey * 131 + l_linenumber * 977) % 45000 END) AS red,
       MIN((l_orderkey * 17 + l_linenumber * 313) % 45000) AS green,
       MIN((l_partkey * 19 + l_linenumber * 71) % 45000) AS blue,
       MIN((l_partkey * 211 + l_linenumber * 577) % 45000) AS nir,
       MIN((l_partkey * 401 + l_suppkey * 7) % 65000) AS lwir11,
       MIN(CASE WHEN month(l_shipdate) = 2 THEN (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536 - (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536 % 2 + 1
                WHEN (l_orderkey + l_linenumber) % 3 = 0 THEN (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536
                ELSE (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536 - (l_orderkey * 797 + l_suppkey * 64 + l_linenumber * 2053) % 65536 % 32 END) AS qa_pixel,
       MIN(l_suppkey % 12) AS scl
FROM {lineitem} GROUP BY 1, 2, 3
""",
    "dem": """
SELECT CAST(FLOOR(CAST(p.p_partkey AS DOUBLE) / 64) AS BIGINT) AS x, p.p_partkey % 64 AS y, COALESCE(e.elevation, 0) AS elevation
FROM {part} p
LEFT JOIN (SELECT l_partkey, MIN(CAST(FLOOR(l_extendedprice) AS BIGINT)) % 3000 AS elevation
           FROM {lineitem} GROUP BY 1) e ON e.l_partkey = p.p_partkey
""",
    "landcover": """
SELECT y.yr, p.p_partkey % 64 AS y, p.p_partkey AS x,
       CASE (p.p_partkey * 7 + p.p_size * 13 + y.yr) % 13 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN 20 WHEN 3 THEN 30
         WHEN 4 THEN 40 WHEN 5 THEN 50 WHEN 6 THEN 60 WHEN 7 THEN 70 WHEN 8 THEN 80 WHEN 9 THEN 90 WHEN 10 THEN 95
         WHEN 11 THEN 100 ELSE 77 END AS cls
FROM {part} p CROSS JOIN (SELECT DISTINCT year(o_orderdate) AS yr FROM {orders}) y
""",
    "scenes": """
SELECT o_orderkey AS id,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'ls89_c2l2_sp' WHEN '2-HIGH' THEN 'ls7_c2l2_sp'
         WHEN '3-MEDIUM' THEN 's2_l2a' WHEN '4-NOT SPECIFIED' THEN 'sentinel_1_rtc' ELSE 'nasadem' END AS product,
       o_orderdate AS t,
       CAST((o_custkey * 37) % 36000 AS DOUBLE) / 100 - 180 AS minx,
       CAST((o_custkey * 53) % 16000 AS DOUBLE) / 100 - 80 AS miny,
       CAST((o_custkey * 37) % 36000 AS DOUBLE) / 100 - 180 + 1.75 AS maxx,
       CAST((o_custkey * 53) % 16000 AS DOUBLE) / 100 - 80 + 1.75 AS maxy,
       concat(lpad(CAST(o_custkey % 233 + 1 AS VARCHAR(8)), 3, '0'), lpad(CAST(o_custkey % 248 + 1 AS VARCHAR(8)), 3, '0')) AS region_code,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_orderstatus END AS geom,
       CAST(FLOOR(o_totalprice) AS BIGINT) % 100 AS cloud_cover
FROM {orders}
""",
    "assets": """
SELECT o.o_orderkey AS scene_id, b.asset_key,
       concat('https://blob.example.com/', CASE WHEN o.o_orderkey % 50 = 0 THEN 'api/' ELSE '' END,
              'landsat-c2/level-2/', CAST(year(o.o_orderdate) AS VARCHAR(8)), '/', CAST(o.o_custkey % 40 AS VARCHAR(8)),
              '/LC08_', CAST(o.o_orderkey AS VARCHAR(12)), '/LC08_', CAST(o.o_orderkey AS VARCHAR(12)),
              CASE WHEN o.o_orderstatus = 'P' THEN '_T2_' ELSE '_T1_' END, b.suffix, '?sig=', CAST(o.o_orderkey % 7 AS VARCHAR(8))) AS url
FROM {orders} o CROSS JOIN (VALUES ('red', 'SR_B4.TIF'), ('green', 'SR_B3.TIF'), ('blue', 'SR_B2.TIF'),
                                 ('qa_pixel', 'QA_PIXEL.TIF'), ('mtl.txt', 'MTL.txt')) AS b(asset_key, suffix)
WHERE NOT (o.o_orderkey % 11 = 0 AND b.asset_key = 'mtl.txt')
""",
    "files": """
SELECT concat('landsat-c2/level-2/', CAST(year(o.o_orderdate) AS VARCHAR(8)), '/', CAST(o.o_custkey % 40 AS VARCHAR(8)),
              '/LC08_', CAST(o.o_orderkey AS VARCHAR(12)), '/LC08_', CAST(o.o_orderkey AS VARCHAR(12)),
              CASE WHEN o.o_orderstatus = 'P' THEN '_T2_' ELSE '_T1_' END, b.suffix) AS path,
       CAST(FLOOR(o.o_totalprice) AS BIGINT) + b.extra AS length
FROM {orders} o CROSS JOIN (VALUES ('SR_B4.TIF', 1), ('SR_B3.TIF', 2), ('QA_PIXEL.TIF', 3)) AS b(suffix, extra)
WHERE o.o_orderkey % 3 <> 0 AND NOT (o.o_orderkey % 5 = 0 AND b.suffix = 'SR_B3.TIF')
""",
    # All files of every landed scene; ``files`` above is what a partial download left.
    "listing": """
SELECT concat('landsat-c2/level-2/', CAST(year(o.o_orderdate) AS VARCHAR(8)), '/', CAST(o.o_custkey % 40 AS VARCHAR(8)),
              '/LC08_', CAST(o.o_orderkey AS VARCHAR(12)), '/LC08_', CAST(o.o_orderkey AS VARCHAR(12)),
              CASE WHEN o.o_orderstatus = 'P' THEN '_T2_' ELSE '_T1_' END, b.suffix) AS path,
       CAST(FLOOR(o.o_totalprice) AS BIGINT) + b.extra AS length
FROM {orders} o CROSS JOIN (VALUES ('SR_B4.TIF', 1), ('SR_B3.TIF', 2), ('QA_PIXEL.TIF', 3)) AS b(suffix, extra)
""",
    "features": """
SELECT o_orderkey AS fid, o_orderstatus AS attr,
       CAST((o_custkey * 37) % 36000 AS DOUBLE) / 100 - 180 AS minx, CAST((o_custkey * 53) % 16000 AS DOUBLE) / 100 - 80 AS miny,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate END AS start_time,
       CASE WHEN o_orderkey % 15 = 0 THEN NULL ELSE o_orderdate + INTERVAL 30 DAY END AS end_time
FROM {orders}
""",
    "series": """
SELECT event_type AS series, ts AS t, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value FROM {events}
""",
    # Our extension: one catalogue (STAC) item per order, with collection and
    # platform as a remote catalogue reports them; assets come from ``assets``.
    "stac_items": """
SELECT o_orderkey AS item_id,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'landsat-c2-l2'
            WHEN o_orderpriority = '3-MEDIUM' THEN 'sentinel-2-l2a'
            WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'sentinel-1-rtc'
            WHEN o_orderkey % 3 = 0 THEN 'nasadem'
            WHEN o_orderkey % 3 = 1 THEN 'esa-worldcover' ELSE 'io-lulc-annual-v02' END AS collection,
       CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN concat('landsat-', CAST(4 + o_custkey % 6 AS VARCHAR(4)))
            WHEN o_orderpriority = '3-MEDIUM' THEN CASE WHEN o_custkey % 2 = 0 THEN 'sentinel-2a' ELSE 'sentinel-2b' END
            ELSE NULL END AS platform,
       o_orderdate AS datetime,
       CAST((o_custkey * 37) % 36000 AS DOUBLE) / 100 - 180 AS minx,
       CAST((o_custkey * 53) % 16000 AS DOUBLE) / 100 - 80 AS miny,
       CAST((o_custkey * 37) % 36000 AS DOUBLE) / 100 - 180 + 1.75 AS maxx,
       CAST((o_custkey * 53) % 16000 AS DOUBLE) / 100 - 80 + 1.75 AS maxy
FROM {orders}
""",
    # Our extension: the sidecar metadata XML of each landed scene folder,
    # written from the order row; a few documents lack the scene time.
    "mtl_xml": """
SELECT o_orderkey AS scene_id,
       concat('landsat-c2/level-2/', CAST(year(o_orderdate) AS VARCHAR(8)), '/', CAST(o_custkey % 40 AS VARCHAR(8)),
              '/LC08_', CAST(o_orderkey AS VARCHAR(12))) AS folder,
       concat('<?xml version="1.0" encoding="UTF-8"?><LANDSAT_METADATA_FILE><PRODUCT_CONTENTS>',
              '<DIGITAL_OBJECT_IDENTIFIER>10.5066/P9OGBGM6</DIGITAL_OBJECT_IDENTIFIER>',
              '<PROCESSING_LEVEL>L2SP</PROCESSING_LEVEL><COLLECTION_NUMBER>02</COLLECTION_NUMBER>',
              '<COLLECTION_CATEGORY>', CASE WHEN o_orderstatus = 'P' THEN 'T2' ELSE 'T1' END, '</COLLECTION_CATEGORY>',
              '<FILE_NAME_BAND_2>LC08_', CAST(o_orderkey AS VARCHAR(12)), CASE WHEN o_orderstatus = 'P' THEN '_T2_' ELSE '_T1_' END, 'SR_B2.TIF</FILE_NAME_BAND_2>',
              '<FILE_NAME_BAND_3>LC08_', CAST(o_orderkey AS VARCHAR(12)), CASE WHEN o_orderstatus = 'P' THEN '_T2_' ELSE '_T1_' END, 'SR_B3.TIF</FILE_NAME_BAND_3>',
              '<FILE_NAME_BAND_4>LC08_', CAST(o_orderkey AS VARCHAR(12)), CASE WHEN o_orderstatus = 'P' THEN '_T2_' ELSE '_T1_' END, 'SR_B4.TIF</FILE_NAME_BAND_4>',
              '<FILE_NAME_QUALITY_L1_PIXEL>LC08_', CAST(o_orderkey AS VARCHAR(12)), CASE WHEN o_orderstatus = 'P' THEN '_T2_' ELSE '_T1_' END, 'QA_PIXEL.TIF</FILE_NAME_QUALITY_L1_PIXEL>',
              '</PRODUCT_CONTENTS><IMAGE_ATTRIBUTES><SPACECRAFT_ID>LANDSAT_', CASE WHEN o_custkey % 2 = 0 THEN '8' ELSE '9' END, '</SPACECRAFT_ID>',
              '<SENSOR_ID>OLI_TIRS</SENSOR_ID><WRS_TYPE>2</WRS_TYPE>',
              '<WRS_PATH>', CAST(o_custkey % 233 + 1 AS VARCHAR(8)), '</WRS_PATH>',
              '<WRS_ROW>', CAST(o_custkey % 248 + 1 AS VARCHAR(8)), '</WRS_ROW>',
              '<DATE_ACQUIRED>', CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), '</DATE_ACQUIRED>',
              CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE concat('<SCENE_CENTER_TIME>',
                   lpad(CAST(o_orderkey % 24 AS VARCHAR(2)), 2, '0'), ':', lpad(CAST(o_custkey % 60 AS VARCHAR(2)), 2, '0'),
                   ':07.1234560Z</SCENE_CENTER_TIME>') END,
              '<CLOUD_COVER>', CAST(CAST(FLOOR(o_totalprice) AS BIGINT) % 100 AS VARCHAR(4)), '.',
                   lpad(CAST(o_orderkey % 100 AS VARCHAR(4)), 2, '0'), '</CLOUD_COVER>',
              '<CLOUD_COVER_LAND>', CAST(CAST(FLOOR(o_totalprice / 7) AS BIGINT) % 100 AS VARCHAR(4)), '.00</CLOUD_COVER_LAND>',
              '<SUN_AZIMUTH>', CAST(o_custkey % 360 AS VARCHAR(4)), '.25</SUN_AZIMUTH>',
              '<SUN_ELEVATION>', CAST(o_orderkey % 90 AS VARCHAR(4)), '.5</SUN_ELEVATION>',
              '</IMAGE_ATTRIBUTES><PROJECTION_ATTRIBUTES><GRID_CELL_SIZE_REFLECTIVE>30.00</GRID_CELL_SIZE_REFLECTIVE>',
              '</PROJECTION_ATTRIBUTES><LEVEL1_PROCESSING_RECORD><LANDSAT_SCENE_ID>LC8', CAST(o_orderkey AS VARCHAR(12)),
              'LGN00</LANDSAT_SCENE_ID></LEVEL1_PROCESSING_RECORD><LEVEL2_PROCESSING_RECORD><DATE_PRODUCT_GENERATED>',
              CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 20 DAY AS DATE) AS VARCHAR(10)), 'T01:02:03Z</DATE_PRODUCT_GENERATED>',
              '</LEVEL2_PROCESSING_RECORD></LANDSAT_METADATA_FILE>') AS xml
FROM {orders}
""",
}

VIEW_TABLES: dict[str, tuple[str, ...]] = {
    "pixel_obs": ("lineitem",),
    "pixels": ("lineitem",),
    "dem": ("part", "lineitem"),
    "landcover": ("part", "orders"),
    "scenes": ("orders",),
    "assets": ("orders",),
    "files": ("orders",),
    "listing": ("orders",),
    "features": ("orders",),
    "series": ("events",),
    "stac_items": ("orders",),
    "mtl_xml": ("orders",),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view ``name`` as a lazy DataFrame over ``sf_dir``."""
    tables = {t: read_table(spark, sf_dir, t) for t in VIEW_TABLES[name]}
    return spark.sql(VIEW_SQL[name], **tables)


def oracle_with(sql: str, *views: str, **ctes: str) -> str:
    """Prefix ``sql`` with the named views, then ``ctes`` (in order), as CTEs."""
    parts = []
    for v in views:
        body = VIEW_SQL[v].format(**{t: t for t in VIEW_TABLES[v]}).strip()
        parts.append(f"{v} AS (\n{body}\n)")
    parts += [f"{k} AS (\n{body.strip()}\n)" for k, body in ctes.items()]
    if not parts:
        return sql.strip()
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()
