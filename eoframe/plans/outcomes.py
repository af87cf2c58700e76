"""Queries whose rows reach every outcome of an operator: gaps, errors, fallbacks, modes."""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import catalog, documents, explore, harvest, overlay, terrain, timeseries
from ..session import cut_lineage
from ..sources import landed
from ..sources.fixtures import VIEW_SQL, oracle_with, view
from ..sources.products import products as product_table
from ..sources.tables import read_table
from ..streaming.incremental import new_run_folder
from . import register
from .common import iso_day, iso_ts, sql_iso_ts
from .documents import _defs_sql, _tag
from .harvest import _A2, _MISSING

# --- landed files -----------------------------------------------------------------

SCENES_A_FOLDER = 400
# Tasks put their files in place, not the driver one after the other (the folder is new).
COMMIT_BY_TASK = ("mapreduce.fileoutputcommitter.algorithm.version", "2")


@register("sidecar_outcomes", operators=("S7", "F22"), oracle=oracle_with(f"""
SELECT 'f=' || f AS folder,
       CASE f % 6 WHEN 0 THEN 'not found' WHEN 1 THEN 'several sidecar files' WHEN 2 THEN 'not an XML document'
                  WHEN 3 THEN 'broken XML document' END AS error,
       CASE WHEN f % 6 > 3 THEN {_tag('WRS_PATH')} END AS wrs_path
FROM (SELECT scene_id // {SCENES_A_FOLDER} AS f, arg_min(xml, scene_id) AS xml FROM mtl_xml GROUP BY 1) z""", "mtl_xml"))
def sidecar_outcomes(spark, sf):
    """Folders as a download leaves them: without a sidecar, with two, with a page that is
    no XML, with one cut off, and whole ones; read folder by folder."""
    from ..functions import documents as fdocs
    # The first scene of each folder is found by key; only its sidecar is written out, once
    # for both writers below.
    of = F.floor(F.col("o_orderkey") / SCENES_A_FOLDER)
    orders = read_table(spark, sf, "orders")
    first = orders.groupBy(of.alias("f")).agg(F.min("o_orderkey").alias("o_orderkey"))
    picked = spark.sql(VIEW_SQL["mtl_xml"], orders=orders.join(first, "o_orderkey", "left_semi"))
    per = (picked.groupBy(F.floor(F.col("scene_id") / SCENES_A_FOLDER).cast("long").alias("f"))
           .agg(F.min_by("xml", "scene_id").alias("xml")))
    # A file takes its time however small it is: folders are dealt over all cores.
    per = cut_lineage(per.repartition(4 * spark.sparkContext.defaultParallelism, "f"))
    kind = F.col("f") % 6
    body = F.when(kind == 2, F.lit("404 not found")).when(kind == 3, F.substring("xml", 1, 700)).otherwise(F.col("xml"))
    copies = F.explode(F.array_repeat(body, F.when(kind == 1, F.lit(2)).otherwise(F.lit(1))))
    root = new_run_folder(spark, "sidecars")
    (per.filter(kind != 0).select("f", copies.alias("value"))
        .write.option("maxRecordsPerFile", 1).option(*COMMIT_BY_TASK).partitionBy("f").text(root))
    (per.filter(kind == 0).select("f", F.lit(1).alias("x")).write.mode("append").option(*COMMIT_BY_TASK)
        .partitionBy("f").csv(root))
    found = fdocs.extract_mtl(landed.read_mtl(spark, root, suffix=".txt"), "xml", "m", deal=False)
    return found.select(text.basename("folder").alias("folder"), "error", F.col("m.landsat_wrs_path").alias("wrs_path"))


@register("landed_sizes", operators=("S10", "S5", "A20"), oracle=oracle_with("""
SELECT 'product=' || product AS folder, SUM(strlen(value) + 1)::BIGINT AS size FROM d GROUP BY product
UNION ALL
SELECT 'product=' || product || '/yr=' || yr, SUM(strlen(value) + 1)::BIGINT FROM d GROUP BY product, yr""", "scenes",
    d="SELECT product, year(t) AS yr, id || ';' || COALESCE(geom, 'ü') || ';' || region_code AS value FROM scenes"))
def landed_sizes(spark, sf):
    """Folder sizes from the listing of real files."""
    sc = view(spark, sf, "scenes")
    line = F.concat_ws(";", F.col("id").cast("string"), F.coalesce("geom", F.lit("ü")), "region_code")
    root = new_run_folder(spark, "sizes")
    sc.select("product", F.year("t").alias("yr"), line.alias("value")).write.partitionBy("product", "yr").text(root)
    files = landed.list_files(spark, root, "**.txt").select(F.col("rel_path").alias("path"), "length")
    return harvest.folder_sizes(files).select("folder", "size")


@register("result_exports", operators=("K5", "S1", "P4", "P18"), oracle=oracle_with(f"""
SELECT id, to_json({{'type': 'Feature',
                     'geometry': {{'type': 'Polygon', 'coordinates': [[[minx, miny], [maxx, miny], [maxx, maxy], [minx, maxy], [minx, miny]]]}},
                     'properties': {{'product': product, 'region_code': region_code}}}}) AS feature,
       product AS product_csv, {sql_iso_ts('t')} AS t_csv, COALESCE(geom, '') AS geom_csv
FROM scenes WHERE product IN ('ls89_c2l2_sp', 's2_l2a')""", "scenes"))
def result_exports(spark, sf):
    """All matches of a search written as features (JSON lines) and as CSV, both read back."""
    found = catalog.find_scenes(view(spark, sf, "scenes"), ["ls89_c2l2_sp", "s2_l2a"])
    root = new_run_folder(spark, "exports")
    feature = explore.geojson_feature(explore.bbox_geometry("minx", "miny", "maxx", "maxy"),
                                      {"product": F.col("product"), "region_code": F.col("region_code")})
    explore.export(found.select("id", feature.alias("feature")), os.path.join(root, "json"), "json")
    explore.export(found.select("id", F.col("product").alias("product_csv"), iso_ts("t").alias("t_csv"), F.col("geom").alias("geom_csv")),
                   os.path.join(root, "csv"), "csv")
    a = spark.read.schema("id long, feature string").json(os.path.join(root, "json"))
    b = spark.read.option("header", "true").schema("id long, product_csv string, t_csv string, geom_csv string").csv(os.path.join(root, "csv"))
    return a.join(b, "id").withColumn("geom_csv", F.coalesce("geom_csv", F.lit("")))


GRID_TILE, GRID_X0, GRID_Y0, GRID_RES = 32, 300000.0, 5000000.0, 30.0


@register("grid_export", operators=("K4", "W8"), oracle=oracle_with(f"""
SELECT CAST(t AS VARCHAR) AS t, band, y, x, {GRID_X0!r} + x * {GRID_RES!r} + 15 AS px, {GRID_Y0!r} - y * {GRID_RES!r} - 15 AS py,
       CAST(CASE WHEN v <> nd THEN v END AS DOUBLE) AS value
FROM (SELECT t, y, x, 'red' AS band, CASE WHEN red <> 0 THEN red END AS v, 0 AS nd FROM pixels
      UNION ALL SELECT t, y, x, 'scl', CASE WHEN scl <> 3 THEN scl END, 3 FROM pixels) z""", "pixels"))
def grid_export(spark, sf):
    """Two bands written as tiles with their grid, read back and put on their cells."""
    px = view(spark, sf, "pixels").select("t", "y", "x", F.when(F.col("red") != 0, F.col("red")).alias("red"),
                                         F.when(F.col("scl") != 3, F.col("scl")).alias("scl"))
    nodata = {"red": 0, "scl": 3}
    tiles = terrain.with_grid(terrain.tile_rows(px, list(nodata), nodata, GRID_TILE, keys=["t"]), GRID_TILE, GRID_X0, GRID_Y0, GRID_RES,
                              "epsg:32632", nodata)
    root = new_run_folder(spark, "tiles")
    terrain.write_tiles(tiles.withColumn("product", F.lit("p")), root)
    back = spark.read.parquet(root).filter("product = 'p' and projection = 'epsg:32632'")
    return terrain.untile(back, ["t"]).select(iso_day("t").alias("t"), "band", "y", "x", "px", "py", F.col("value").cast("double").alias("value"))


# --- harvest ----------------------------------------------------------------------

@register("asset_folders", operators=("A11", "F16"), oracle=oracle_with("SELECT dir, url FROM a2", "assets", **_A2))
def asset_folders(spark, sf):
    return harvest.assets_by_folder(view(spark, sf, "assets"))


@register("signature_folders", operators=("A12", "F17"), oracle=oracle_with("""
SELECT string_agg(part, ',' ORDER BY part) AS sig, parent AS folder FROM parts GROUP BY parent""",
    "assets", "files", **_A2, miss=_MISSING,
    parts="""SELECT regexp_extract(rel, '([^/]*)/[^/]*$', 1) AS parent,
                    CASE WHEN regexp_matches(fname, '_T\\d_') THEN regexp_extract(fname, '^.*_T\\d_(.*)$', 1) ELSE fname END AS part
             FROM miss"""))
def signature_folders(spark, sf):
    miss = harvest.missing_assets(view(spark, sf, "assets"), view(spark, sf, "files"))
    return harvest.folders_by_signature(miss.select("url")).select(F.array_join("sig", ",").alias("sig"), "folder")


@register("harvest_modes", operators=("J5", "J4"), oracle=oracle_with("""
SELECT 'overwrite' AS mode, scene_id, asset_key, fname FROM a2
UNION ALL SELECT 'complete', scene_id, asset_key, fname FROM miss
UNION ALL SELECT 'both', scene_id, asset_key, fname FROM a2""", "assets", "files", **_A2, miss=_MISSING))
def harvest_modes(spark, sf):
    """What each mode would fetch; overwriting wins over completing."""
    a, f = view(spark, sf, "assets"), view(spark, sf, "files")
    modes = {"overwrite": dict(overwrite=True), "complete": dict(complete=True), "both": dict(overwrite=True, complete=True)}
    return reduce(lambda x, y: x.unionByName(y), [
        harvest.harvest_plan(a, f, **m).select(F.lit(n).alias("mode"), "scene_id", "asset_key", "fname") for n, m in modes.items()])


@register("representative_any", operators=("A25",), oracle=oracle_with("""
SELECT folder, COALESCE(MIN(path) FILTER (WHERE e IN ('tif', 'tiff')), MIN(path) FILTER (WHERE e IN ('jpg', 'jpeg', 'png', 'jp2'))) AS file,
       CASE WHEN COUNT(*) FILTER (WHERE e IN ('tif', 'tiff', 'jpg', 'jpeg', 'png', 'jp2')) = 0 THEN 'no image file' END AS error
FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS e
      FROM renamed) z GROUP BY folder""", "listing",
    renamed="""SELECT regexp_replace(path, 'TIF$', CASE length % 5 WHEN 0 THEN 'txt' WHEN 1 THEN 'JPG' WHEN 2 THEN 'png' WHEN 3 THEN 'txt' ELSE 'tiff' END) AS path
               FROM listing"""))
def representative_any(spark, sf):
    """Listings in which some folders have no TIFF and some no image at all."""
    ending = (F.when(F.col("length") % 5 == 0, "txt").when(F.col("length") % 5 == 1, "JPG").when(F.col("length") % 5 == 2, "png")
              .when(F.col("length") % 5 == 3, "txt").otherwise("tiff"))
    files = view(spark, sf, "listing").select(F.concat(F.regexp_replace("path", "TIF$", ""), ending).alias("path"))
    return harvest.representative_file(files)


# --- catalogue --------------------------------------------------------------------

@register("scanner_cutoff", operators=("P6", "P7"), oracle=oracle_with(f"""
SELECT id, product, {sql_iso_ts('t')} AS t FROM (SELECT id, product, t + INTERVAL 5 YEAR AS t FROM scenes) s
WHERE product IN ('ls89_c2l2_sp', 'ls7_c2l2_sp') AND (product <> 'ls7_c2l2_sp' OR t < TIMESTAMP '2003-05-31')""", "scenes"))
def scanner_cutoff(spark, sf):
    """Scenes on both sides of the day on which one sensor's scanner failed."""
    later = view(spark, sf, "scenes").withColumn("t", (F.col("t") + F.expr("INTERVAL 5 YEAR")).cast("timestamp_ntz"))
    found = catalog.find_scenes(later, ["ls89_c2l2_sp", "ls7_c2l2_sp"], slc_off_products=["ls7_c2l2_sp"], slc_off=False)
    return found.select("id", "product", iso_ts("t").alias("t"))


@register("predicate_search", operators=("X1", "S1"), oracle=oracle_with("""
SELECT id, cloud_cover FROM scenes WHERE (cloud_cover * 7 + length(region_code)) % 10 < 4""", "scenes"))
def predicate_search(spark, sf):
    """A search with a user's predicate over batches of scenes."""
    def wanted(rows):
        return (rows["cloud_cover"] * 7 + rows["region_code"].str.len()) % 10 < 4
    test = catalog.predicate_udf(wanted)(F.struct("cloud_cover", "region_code"))
    return catalog.find_scenes(view(spark, sf, "scenes"), predicate=test).select("id", "cloud_cover")


@register("modified_assets", operators=("X6", "P9"), oracle=oracle_with("""
SELECT a.scene_id, a.asset_key, replace(split_part(a.url, '?', 1), 'https://blob.example.com/', 's3://mirror/') AS url
FROM assets a JOIN stac_items i ON a.scene_id = i.item_id
WHERE i.collection = 'landsat-c2-l2' AND i.minx <= 90 AND i.maxx >= -90 AND i.miny <= 60 AND i.maxy >= -60
  AND i.datetime >= TIMESTAMP '1996-01-01' AND i.datetime < TIMESTAMP '1998-01-01' AND a.url NOT LIKE '%api%'
  AND a.scene_id IN (SELECT scene_id FROM assets WHERE asset_key = 'mtl.txt')""", "stac_items", "assets"))
def modified_assets(spark, sf):
    """Assets of a search with a URL modifier: signatures dropped, a mirror in place of the host."""
    from datetime import datetime
    return catalog.stac_assets(
        view(spark, sf, "stac_items"), view(spark, sf, "assets"), "landsat-c2-l2", (-90.0, -60.0, 90.0, 60.0),
        (datetime(1996, 1, 1), datetime(1998, 1, 1)), t1_only=False,
        modifier=lambda u: F.replace(F.substring_index(u, "?", 1), F.lit("https://blob.example.com/"), F.lit("s3://mirror/"))
    ).select("scene_id", "asset_key", "url")


@register("family_outcomes", operators=("A26",), oracle=oracle_with("""
SELECT region_code, CASE WHEN n > 0 AND n = c2 THEN 'c2' WHEN n > 0 AND n = s2 THEN 's2' END AS family,
       CASE WHEN n = c2 OR n = s2 THEN NULL WHEN c2 + s2 > 0 THEN 'products of several families' ELSE 'products of no known family' END AS error
FROM (SELECT region_code, COUNT(*) AS n, COUNT(*) FILTER (WHERE name LIKE '%level2%') AS c2, COUNT(*) FILTER (WHERE name LIKE '%s2%') AS s2
      FROM (SELECT DISTINCT region_code, CASE WHEN cloud_cover < 95 THEN CASE product WHEN 's2_l2a' THEN 's2_l2a' ELSE CASE WHEN right(region_code, 1) < '5' THEN 'landsat_level2' ELSE product END END
                                         ELSE 'other' END AS name FROM scenes) d GROUP BY region_code) z""", "scenes"))
def family_outcomes(spark, sf):
    """The family of each region's products, or why there is none."""
    name = F.when(F.col("cloud_cover") < 95, F.when(F.col("product") == "s2_l2a", F.lit("s2_l2a"))
                  .otherwise(F.when(F.substring("region_code", -1, 1) < "5", F.lit("landsat_level2")).otherwise(F.col("product")))).otherwise(F.lit("other"))
    per = view(spark, sf, "scenes").groupBy("region_code").agg(F.collect_set(name).alias("p"))  # a handful of names
    return per.select("region_code", F.inline(F.array(catalog.family_or_error(F.col("p")))))


@register("product_sources", operators=("U2", "J13", "W5"), oracle=oracle_with("""
SELECT r.name, d.description, CAST(d.source_pos AS DOUBLE) AS source_pos, CASE WHEN d.description IS NULL THEN 'no document named ' || r.name END AS error
FROM (SELECT DISTINCT product AS name FROM scenes UNION SELECT DISTINCT collection FROM stac_items UNION SELECT DISTINCT name FROM defs) r
LEFT JOIN (SELECT name, arg_min(description, k) AS description, arg_min(source_pos, k) AS source_pos
           FROM (SELECT name, description, 1 AS source_pos, [1, pos] AS k FROM defs
                 UNION ALL SELECT name, description, 0, [0, pos] FROM seen) u GROUP BY name) d ON r.name = d.name""",
    "scenes", "stac_items", defs=_defs_sql(),
    seen="""SELECT name, 'seen in ' || yr AS description, ROW_NUMBER() OVER (ORDER BY yr DESC, name) - 1 AS pos
            FROM (SELECT DISTINCT product AS name, year(t) AS yr FROM scenes WHERE product <> 'nasadem') z"""))
def product_sources(spark, sf):
    """Definitions from two sources in order, with names that both have and that one has
    several times; each request gets the first."""
    from ..operators.ranking import consecutive_index
    seen = (view(spark, sf, "scenes").filter("product <> 'nasadem'").select(F.col("product").alias("name"), F.year("t").alias("yr")).distinct()
            .select("name", F.concat(F.lit("seen in "), F.col("yr").cast("string")).alias("description"), (-F.col("yr")).alias("_order")))
    seen = consecutive_index(seen, ["_order", "name"], "pos").drop("_order")
    known = product_table(spark).select("name", "description").withColumn("pos", F.monotonically_increasing_id())
    both = documents.union_sources([seen, known]).withColumn("_place", F.struct("source_pos", "pos"))
    req = (view(spark, sf, "scenes").select(F.col("product").alias("name")).unionByName(view(spark, sf, "stac_items").select(F.col("collection").alias("name")))
           .unionByName(product_table(spark).select("name")).distinct())
    both = both.withColumn("_found", F.struct("description", "source_pos"))
    got = documents.lookup_first(req, both, "name", "_place", "_found")
    return got.select("name", F.col("_found.description").alias("description"), F.col("_found.source_pos").cast("double").alias("source_pos"), "error")


@register("footprint_validity", operators=("F36",), oracle=oracle_with("""
SELECT id, id % 6 IN (1, 5) AS valid, COALESCE(minx < 185 AND maxx > 175, false) AS wraps FROM scenes""", "scenes"))
def footprint_validity(spark, sf):
    """Footprints that are missing, open, too short or without area beside valid ones."""
    sc, kind = view(spark, sf, "scenes"), F.col("id") % 6
    ring = geo.bbox_ring("minx", "miny", "maxx", "maxy")
    ring = (F.when(kind == 0, F.lit(None)).when(kind == 2, F.slice(ring, 1, 4)).when(kind == 3, F.concat(F.slice(ring, 1, 2), F.slice(ring, 1, 1)))
            .when(kind == 4, geo.bbox_ring("minx", "miny", "minx", "maxy")).otherwise(ring))
    return sc.select("id", geo.ring_is_valid(ring).alias("valid"), geo.crosses_antimeridian("minx", "maxx").alias("wraps"))


@register("public_urls", operators=("F31",), oracle=oracle_with("""
SELECT id, CASE id % 5 WHEN 0 THEN '/explorer/api/data/' || product || '/' || id || '.yaml'
                       WHEN 1 THEN 'https://data.example.org/' || product || '/' || id || '/meta.yaml'
                       WHEN 2 THEN 'https://other.s3.af-south-1.amazonaws.com/' || product || '/' || id || '.yaml'
                       WHEN 3 THEN 'https://h.example.com/' || id ELSE product || '/' || id END AS url,
       CASE id % 5 WHEN 0 THEN '/explorer/api/data/' || product || '/' || id || '.yaml'
                   WHEN 1 THEN 'https://data.example.org/?prefix=' || product || '/' || id || '/'
                   WHEN 2 THEN 'https://other.s3.af-south-1.amazonaws.com/' || product || '/' || id || '.yaml'
                   WHEN 3 THEN 'https://h.example.com/' || id ELSE product || '/' || id END AS base
FROM scenes""", "scenes"))
def public_urls(spark, sf):
    """Local, mapped, regional, plain and relative locations as public addresses."""
    sc, kind = view(spark, sf, "scenes"), F.col("id") % 5
    i = F.col("id").cast("string")
    u = (F.when(kind == 0, F.concat(F.lit("file:///local_data/"), "product", F.lit("/"), i, F.lit(".yaml")))
         .when(kind == 1, F.concat(F.lit("s3://mapped/"), "product", F.lit("/"), i, F.lit("/meta.yaml")))
         .when(kind == 2, F.concat(F.lit("s3://other/"), "product", F.lit("/"), i, F.lit(".yaml")))
         .when(kind == 3, F.concat(F.lit("https://h.example.com/"), i)).otherwise(F.concat("product", F.lit("/"), i)))
    hosts = {"mapped": "data.example.org"}
    return sc.select("id", explore.external_url(u, "af-south-1", hosts).alias("url"), explore.external_url(u, "af-south-1", hosts, is_base=True).alias("base"))


# --- cubes ------------------------------------------------------------------------

_GAPS = "SELECT t, y, x, CASE WHEN (x * 64 + y) % 9 <> 0 AND red <> 0 THEN red END AS red FROM pixels"


def _gap_sql(pick: str, edge: str, index: str) -> str:
    return oracle_with(f"""
SELECT g.y, g.x, CAST(g.red AS DOUBLE) AS red, CAST(COALESCE(g.ft, (SELECT {edge}(t) FROM m)) AS VARCHAR) AS t, {index} AS idx
FROM g LEFT JOIN times ON g.ft = times.t""", "pixels", m=_GAPS, times="SELECT t, ROW_NUMBER() OVER (ORDER BY t) - 1 AS idx FROM (SELECT DISTINCT t FROM m) z",
        g=f"SELECT y, x, {pick}(red, t) FILTER (WHERE red IS NOT NULL) AS red, {edge}(t) FILTER (WHERE red IS NOT NULL) AS ft FROM m GROUP BY y, x")


def _gaps(spark, sf):
    red = F.when(((F.col("x") * 64 + F.col("y")) % 9 != 0) & (F.col("red") != 0), F.col("red"))
    return view(spark, sf, "pixels").select("t", "y", "x", red.alias("red"))


@register("first_valid_gaps", operators=("W1",), oracle=_gap_sql("arg_min", "MIN", "COALESCE(times.idx, 0)"))
def first_valid_gaps(spark, sf):
    """First valid values of a cube in which some cells never have one."""
    f = timeseries.first_valid(_gaps(spark, sf), "red")
    return f.select("y", "x", F.col("red").cast("double").alias("red"), iso_day("t").alias("t"), "idx")


@register("last_valid_gaps", operators=("W2",), oracle=_gap_sql("arg_max", "MAX", "COALESCE(times.idx - (SELECT COUNT(*) FROM times), -1)"))
def last_valid_gaps(spark, sf):
    f = timeseries.last_valid(_gaps(spark, sf), "red")
    return f.select("y", "x", F.col("red").cast("double").alias("red"), iso_day("t").alias("t"), "idx")


@register("frame_captions", operators=("F13", "W7"), oracle=oracle_with("""
SELECT CAST(t AS VARCHAR) AS t, CASE WHEN n % 2 = 0 THEN strftime(t, '%d %b %Y') ELSE strftime(t, '%d %b %Y') || chr(10) || n || ' cells' END AS caption
FROM (SELECT t, COUNT(*) AS n FROM pixels GROUP BY t) z""", "pixels"))
def frame_captions(spark, sf):
    """A caption per frame: its date and, where there is one, its own text."""
    per = view(spark, sf, "pixels").groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    own = F.when(F.col("n") % 2 == 1, F.concat(F.col("n").cast("string"), F.lit(" cells")))
    return per.select(iso_day("t").alias("t"), overlay.frame_caption(F.col("t"), own).alias("caption"))
