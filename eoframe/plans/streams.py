"""Streaming re-aim (incremental indexing) and user-hook queries."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geo
from ..operators import catalog, explore, imaging
from ..sources.fixtures import oracle_with, view
from ..streaming import incremental
from ..streaming.key_index import KeyIndex
from . import register
from .common import iso_day, iso_ts, sql_iso_ts

DOC_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("product", T.StringType()),
    T.StructField("t", T.TimestampNTZType()), T.StructField("geom", T.StringType()),
    T.StructField("minx", T.DoubleType()), T.StructField("miny", T.DoubleType()),
    T.StructField("maxx", T.DoubleType()), T.StructField("maxy", T.DoubleType())])


@register("incremental_index", operators=("T1", "K1"), oracle=oracle_with(f"""
SELECT id, product, {sql_iso_ts('t')} AS t FROM scenes
WHERE t < TIMESTAMP '1998-01-01' OR (t >= TIMESTAMP '1997-01-01' AND geom IS NOT NULL)""", "scenes"))
def incremental_index(spark, sf):
    run, index, arrivals = _arrivals(spark, sf)
    # One landing per acquisition year, all drained at once.
    incremental.land(arrivals, os.path.join(run, "landing"), "_arrival")
    incremental.run_incremental_index(spark, os.path.join(run, "landing"), index, os.path.join(run, "checkpoint"), _valid())
    return index.read().select("id", "product", iso_ts("t").alias("t"))


def _valid():
    return F.col("geom").isNotNull() & geo.ring_is_valid(geo.bbox_ring("minx", "miny", "maxx", "maxy"))


def _arrivals(spark, sf):
    """A new index of the scenes before 1998, and those from 1997 on by year of arrival;
    the documents of 1999 arrive a second time, as 3000."""
    sc = view(spark, sf, "scenes").select(*DOC_SCHEMA.fieldNames())
    run = incremental.new_run_folder(spark, "incremental-index")
    index = KeyIndex(spark, os.path.join(run, "index"), DOC_SCHEMA)
    index.add(sc.filter(F.col("t") < F.lit("1998-01-01").cast("timestamp_ntz")))
    incoming = sc.filter(F.col("t") >= F.lit("1997-01-01").cast("timestamp_ntz")).withColumn("_arrival", F.year("t"))
    return run, index, incoming.unionByName(incoming.filter("_arrival = 1999").withColumn("_arrival", F.lit(3000)))


@register("incremental_log", operators=("T1", "K1"), oracle=oracle_with("""
SELECT arrival, COUNT(*) FILTER (WHERE status = 'added') AS added, COUNT(*) FILTER (WHERE status = 'already') AS already,
       COUNT(*) FILTER (WHERE status = 'failed') AS failed
FROM (SELECT CAST(year(t) AS BIGINT) AS arrival, CASE WHEN year(t) = 1997 THEN 'already' WHEN geom IS NULL THEN 'failed' ELSE 'added' END AS status
      FROM scenes WHERE t >= TIMESTAMP '1997-01-01' AND t < TIMESTAMP '2000-01-01'
      UNION ALL
      SELECT 3000, CASE WHEN geom IS NULL THEN 'failed' ELSE 'already' END FROM scenes WHERE year(t) = 1999) z
GROUP BY arrival""", "scenes"))
def incremental_log(spark, sf):
    """What each landing added when drained on its own: 1997 is indexed already, 3000 is a
    replay of 1999."""
    run, index, arrivals = _arrivals(spark, sf)
    rows = []
    for year in (1997, 1998, 1999, 3000):
        landing = os.path.join(run, f"landing-{year}")
        incremental.land(arrivals.filter(F.col("_arrival") == year), landing, "_arrival")
        for epoch in incremental.run_incremental_index(spark, landing, index, os.path.join(run, f"checkpoint-{year}"), _valid()):
            rows.append((year, *[int(epoch.get(k, 0)) for k in ("added", "already", "failed")]))
    return spark.createDataFrame(rows, "arrival bigint, added bigint, already bigint, failed bigint")


@register("image_proc", operators=("X2", "W8", "F12"), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, x, y,
       ROUND(CASE WHEN hi > lo THEN GREATEST(0.0, LEAST(1.0, SQRT((red - lo) / (hi - lo)))) END, 9) AS red
FROM (SELECT t, x, y, CAST(red AS DOUBLE) AS red,
             MIN(red) OVER (PARTITION BY t, y // 16, x // 16) AS lo,
             MAX(red) OVER (PARTITION BY t, y // 16, x // 16) AS hi FROM pixels) z""", "pixels"))
def image_proc(spark, sf):
    px = view(spark, sf, "pixels").select("t", "x", "y", "red")
    out = imaging.apply_image_funcs(px, "red", [imaging.tile_stretch, imaging.gamma(0.5)], keys=["t"], tile=16)
    return out.select(iso_day("t").alias("t"), "x", "y", F.round("red", 9).alias("red"))


FIELD_REQUEST = {"cloud_cover-begin": "40", "cloud_cover-end": "10", "product": "s2_l2a", "region_code": ""}


@register("field_search", operators=("P5",), oracle=oracle_with("""
SELECT id, product, cloud_cover FROM scenes WHERE cloud_cover BETWEEN 10 AND 40 AND product = 's2_l2a'""",
    "scenes"))
def field_search(spark, sf):
    sc = view(spark, sf, "scenes")
    pred = catalog.field_predicate(FIELD_REQUEST, {"cloud_cover": "long", "product": "string",
                                                   "region_code": "string"})
    return sc.filter(pred).select("id", "product", "cloud_cover")


@register("scene_sample", operators=("O5", "A3"))
def scene_sample(spark, sf):
    sc = view(spark, sf, "scenes")
    return catalog.product_bbox(catalog.sample_scenes(sc, 0.2, seed=7))


@register("summary_refresh", operators=("K6", "A13", "A14", "A15", "A16"), oracle=oracle_with("""
SELECT product, CAST(year(t) AS DOUBLE) AS year, CAST(month(t) AS DOUBLE) AS month, CAST(day(t) AS DOUBLE) AS day,
       COUNT(*) AS n, GROUPING(product, year(t), month(t), day(t)) AS level
FROM scenes GROUP BY ROLLUP (product, year(t), month(t), day(t)) HAVING product IS NOT NULL""", "scenes"))
def summary_refresh(spark, sf):
    sc = view(spark, sf, "scenes")
    out = incremental.new_run_folder(spark, "summaries")
    explore.refresh_summaries(sc, out)
    r = explore.summary_table(spark, out, "period_rollup").read()
    return r.select("product", *[F.col(c).cast("double").alias(c) for c in ("year", "month", "day")],
                    "n", F.col("level").cast("long").alias("level"))


_SUMMARY_ROWS = {
    "timeline": ("key", "n", "0.0"),
    "period_rollup": ("concat_ws('-', CAST({y} AS {s}), CAST({m} AS {s}), CAST({d} AS {s}))", "n", "CAST(level AS DOUBLE)"),
    "footprint": ("'all'", "n_cells", "minx + 2 * miny + 4 * maxx + 8 * maxy + 16 * area_deg2"),
    "regions": ("region_code", "n", "minx + 2 * miny + 4 * maxx + 8 * maxy")}


@register("summary_tables", operators=("K6", "A13", "A14", "A15", "A16"), oracle=oracle_with("""
SELECT 'timeline' AS summary, product, strftime(CAST(CAST(t AS DATE) AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS key, COUNT(*) AS n, 0.0 AS sum
FROM current GROUP BY product, CAST(t AS DATE)
UNION ALL
SELECT 'period_rollup', product, concat_ws('-', CAST(year(t) AS VARCHAR), CAST(month(t) AS VARCHAR), CAST(day(t) AS VARCHAR)), COUNT(*),
       CAST(GROUPING(product, year(t), month(t), day(t)) AS DOUBLE)
FROM current GROUP BY ROLLUP (product, year(t), month(t), day(t)) HAVING product IS NOT NULL
UNION ALL
SELECT 'footprint', product, 'all', n, ROUND(x0 + 2 * y0 + 4 * x1 + 8 * y1 + 16 * (n * 0.0625), 6)
FROM (SELECT product, MIN(minx) AS x0, MIN(miny) AS y0, MAX(maxx) AS x1, MAX(maxy) AS y1 FROM current GROUP BY product) b
JOIN (SELECT product, COUNT(*) AS n FROM (
        SELECT DISTINCT product, ci, unnest(range(CAST(FLOOR(miny / 0.25) AS BIGINT), CAST(FLOOR(maxy / 0.25) AS BIGINT) + 1)) AS cj
        FROM (SELECT product, miny, maxy, unnest(range(CAST(FLOOR(minx / 0.25) AS BIGINT), CAST(FLOOR(maxx / 0.25) AS BIGINT) + 1)) AS ci
              FROM current) a) c GROUP BY product) k USING (product)
UNION ALL
SELECT 'regions', product, region_code, COUNT(*), ROUND(MIN(minx) + 2 * MIN(miny) + 4 * MAX(maxx) + 8 * MAX(maxy), 6)
FROM current WHERE region_code IS NOT NULL GROUP BY product, region_code""", "scenes",
    current="""SELECT * FROM scenes WHERE t < TIMESTAMP '1998-01-01' OR (t < TIMESTAMP '2000-01-01' AND product IN ('s2_l2a', 'nasadem'))"""))
def summary_tables(spark, sf):
    """All four stored summaries after a full refresh and a later one of two products, whose
    scenes had gone on by then."""
    sc = view(spark, sf, "scenes")
    out = incremental.new_run_folder(spark, "summaries")
    explore.refresh_summaries(sc.filter(F.col("t") < F.lit("1998-01-01").cast("timestamp_ntz")), out)
    explore.refresh_summaries(sc.filter(F.col("t") < F.lit("2000-01-01").cast("timestamp_ntz")), out, ["s2_l2a", "nasadem"])
    parts = []
    for name, (key, n, total) in _SUMMARY_ROWS.items():
        rows = explore.summary_table(spark, out, name).read()
        parts.append(rows.select(F.lit(name).alias("summary"), "product", F.expr(key.format(y="year", m="month", d="day", s="STRING")).alias("key"),
                                 F.expr(n).cast("bigint").alias("n"), F.round(F.expr(total).cast("double"), 6).alias("sum")))
    return reduce(lambda a, b: a.unionByName(b), parts)


@register("cube_store_load", operators=("S2", "W8", "P3", "P4", "K4"), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, y, x, red, nir FROM pixels
WHERE t >= DATE '1996-03-01' AND t < DATE '1997-09-01' AND x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 50""",
    "pixels"))
def cube_store_load(spark, sf):
    from datetime import datetime
    from ..sources import cube_store
    path = os.path.join(incremental.new_run_folder(spark, "cube"), "pixels")
    px = view(spark, sf, "pixels").withColumn("t", F.col("t").cast("timestamp_ntz"))
    cube_store.write_cube(px, path, product="ls89_c2l2_sp", tile=16)
    c = cube_store.load_cube(spark, path, "ls89_c2l2_sp", (datetime(1996, 3, 1), datetime(1997, 9, 1)),
                             (10, 5, 40, 50), ["red", "nir"])
    return c.select(iso_day("t").alias("t"), "y", "x", "red", "nir")


@register("scl_blocks", operators=("X4", "F3"), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, y, x, scl IN (4, 5, 6, 7, 11) AS valid FROM pixels""", "pixels"))
def scl_blocks(spark, sf):
    """The class mask as a user's function on each Arrow batch."""
    import numpy as np
    from ..functions.qa import SCL_VALID_DEFAULT

    def block(pdf):
        out = pdf[["t", "y", "x"]].copy()
        out["valid"] = np.isin(pdf["scl"].to_numpy(), list(SCL_VALID_DEFAULT))
        return out

    px = view(spark, sf, "pixels").select(F.col("t").cast("string").alias("t"), "y", "x", "scl")
    return imaging.map_blocks(px, block, "t string, y long, x long, valid boolean")


@register("geojson_roundtrip", operators=("S13", "K5"), oracle=oracle_with("""
SELECT fid, attr, minx, miny, minx + 1.0 AS maxx, miny + 1.0 AS maxy FROM features""", "features"))
def geojson_roundtrip(spark, sf):
    """Features written as GeoJSON FeatureCollection files (at most 5,000 features each)
    and read back with the vector overlay reader."""
    from ..operators.ranking import consecutive_index
    from ..sources import landed
    f = view(spark, sf, "features").select("fid", "attr", "minx", "miny")
    feat = explore.geojson_feature(explore.bbox_geometry("minx", "miny", F.col("minx") + 1.0, F.col("miny") + 1.0),
                                   {"fid": F.col("fid"), "attr": F.col("attr")})
    numbered = consecutive_index(f.select("fid", feat.alias("feature")), ["fid"], "i")
    per_file = (numbered.groupBy(F.floor(F.col("i") / 5000).alias("file"))
                        .agg(F.concat(F.lit('{"type":"FeatureCollection","features":['),
                                      F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value")))
    root = os.path.join(incremental.new_run_folder(spark, "geojson"), "features")
    per_file.write.partitionBy("file").text(root)
    g = landed.read_geojson(spark, root + "/*/*.txt")
    props = F.from_json("properties", "fid long, attr string")
    return g.select(props["fid"].alias("fid"), props["attr"].alias("attr"), "minx", "miny", "maxx", "maxy")
