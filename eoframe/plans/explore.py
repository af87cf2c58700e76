"""Catalogue browsing (timelines, roll-ups, footprints, regions, labels, GeoJSON)
and vector overlays joined in time and space."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..functions import text
from ..operators import catalog, explore, overlay
from ..sources.fixtures import oracle_with, view
from ..sources.products import PRODUCTS, products as product_table
from . import register
from .common import iso_day, iso_ts, sql_iso_ts, sql_str


@register("timeline", operators=("A13", "F24", "P4"), oracle=oracle_with("""
SELECT product, strftime(CAST(CAST(t AS DATE) AS TIMESTAMP), '%Y-%m-%dT%H:%M:%S') AS key, COUNT(*) AS n
FROM scenes WHERE t >= TIMESTAMP '1997-01-01' AND t < TIMESTAMP '1998-01-01' GROUP BY 1, 2""", "scenes"))
def timeline(spark, sf):
    tl = explore.timeline(view(spark, sf, "scenes"), temporal.as_time_range(1997))
    return tl.select("product", "key", "n")


@register("period_rollup", operators=("A14",), oracle=oracle_with("""
SELECT product, CAST(year(t) AS DOUBLE) AS year, CAST(month(t) AS DOUBLE) AS month, CAST(day(t) AS DOUBLE) AS day,
       COUNT(*) AS n, GROUPING(product, year(t), month(t), day(t)) AS level
FROM scenes GROUP BY ROLLUP (product, year(t), month(t), day(t)) HAVING product IS NOT NULL""", "scenes"))
def period_rollup(spark, sf):
    r = explore.period_rollup(view(spark, sf, "scenes"))
    return r.select("product", *[F.col(c).cast("double").alias(c) for c in ("year", "month", "day")],
                    "n", F.col("level").cast("long").alias("level"))


@register("footprint", operators=("A15",), oracle=oracle_with("""
SELECT b.product, minx, miny, maxx, maxy, n_cells, n_cells * 0.0625 AS area_deg2
FROM (SELECT product, MIN(minx) AS minx, MIN(miny) AS miny, MAX(maxx) AS maxx, MAX(maxy) AS maxy
      FROM scenes GROUP BY product) b
JOIN (SELECT product, COUNT(*) AS n_cells FROM (
        SELECT DISTINCT product, ci, unnest(range(CAST(FLOOR(miny / 0.25) AS BIGINT), CAST(FLOOR(maxy / 0.25) AS BIGINT) + 1)) AS cj
        FROM (SELECT product, miny, maxy,
                     unnest(range(CAST(FLOOR(minx / 0.25) AS BIGINT), CAST(FLOOR(maxx / 0.25) AS BIGINT) + 1)) AS ci
              FROM scenes) a) c
      GROUP BY product) n ON b.product = n.product""", "scenes"))
def footprint(spark, sf):
    return explore.footprint(view(spark, sf, "scenes"))


@register("regions", operators=("A16",), oracle=oracle_with("""
SELECT product, region_code, COUNT(*) AS n, MIN(minx) AS minx, MIN(miny) AS miny, MAX(maxx) AS maxx,
       MAX(maxy) AS maxy
FROM scenes WHERE region_code IS NOT NULL GROUP BY product, region_code""", "scenes"))
def regions(spark, sf):
    return explore.regions(view(spark, sf, "scenes"))


@register("uri_prefix", operators=("A18",), oracle=oracle_with("""
SELECT scene_id, CASE WHEN lo = hi THEN lo
  ELSE regexp_extract(substr(lo, 1, COALESCE(list_filter(range(1, LEAST(length(lo), length(hi)) + 1),
                                                          lambda i: substr(lo, i, 1) <> substr(hi, i, 1))[1],
                                             LEAST(length(lo), length(hi)) + 1) - 1), '^(.*/)[^/]*$', 1) END AS prefix
FROM (SELECT scene_id, MIN(url) AS lo, MAX(url) AS hi FROM assets GROUP BY scene_id) g""", "assets"))
def uri_prefix(spark, sf):
    return explore.uri_prefix(view(spark, sf, "assets"), "url", ["scene_id"])


_DOC_URI_SQL = ("CASE WHEN geom IS NULL THEN NULL ELSE concat('s3://eo-archive/', product, '/', region_code, '/', "
                "CASE geom WHEN 'F' THEN 'ga-metadata.yaml' WHEN 'O' THEN CAST(id AS VARCHAR) || '.odc-metadata.yaml' "
                "ELSE CAST(id AS VARCHAR) || '.json' END) END")


def _doc_uri():
    return F.when(F.col("geom").isNull(), F.lit(None).cast("string")).otherwise(F.concat(
        F.lit("s3://eo-archive/"), F.col("product"), F.lit("/"), F.col("region_code"), F.lit("/"),
        F.when(F.col("geom") == "F", F.lit("ga-metadata.yaml"))
         .when(F.col("geom") == "O", F.concat(F.col("id").cast("string"), F.lit(".odc-metadata.yaml")))
         .otherwise(F.concat(F.col("id").cast("string"), F.lit(".json")))))


@register("scene_labels", operators=("F29", "F31", "F32"), oracle=oracle_with("""
SELECT id, COALESCE(regexp_replace(list_filter(cands, lambda c: c <> '' AND c NOT IN
                         ('ga-metadata.yaml', 'agdc-metadata.yaml', 'ARD-METADATA.yaml'))[1], '\\.(yaml|json)$', ''),
                    CAST(id AS VARCHAR)) AS label,
       CASE WHEN uri LIKE 's3://%' THEN 'https://' || regexp_extract(uri, '^s3://([^/]+)', 1)
            || '.s3.ap-southeast-2.amazonaws.com' || regexp_extract(uri, '^s3://[^/]+(/.*)?$', 1) ELSE uri END AS url,
       lower(regexp_replace(COALESCE(regexp_replace(list_filter(cands, lambda c: c <> '' AND c NOT IN
                         ('ga-metadata.yaml', 'agdc-metadata.yaml', 'ARD-METADATA.yaml'))[1], '\\.(yaml|json)$', ''),
                    CAST(id AS VARCHAR)), '[^0-9a-zA-Z]+', '-', 'g')) AS slug
FROM (SELECT id, uri, CASE WHEN len(p) >= 4 THEN [p[len(p)], p[len(p) - 1], p[len(p) - 2],
                                                  array_to_string(p[1:len(p) - 3], '/')]
                           ELSE list_reverse(p) END AS cands
      FROM (SELECT id, uri, string_split(uri, '/') AS p FROM d) z) y""", "scenes",
    d=f"SELECT id, {_DOC_URI_SQL} AS uri FROM scenes"))
def scene_labels(spark, sf):
    s = view(spark, sf, "scenes").select("id", _doc_uri().alias("uri"))
    label = explore.dataset_label(F.lit(None).cast("string"), "uri", "id")
    return s.select("id", label.alias("label"), explore.external_url("uri").alias("url"),
                    text.slug(label).alias("slug"))


@register("combined_bounds", operators=("A22", "F9"), oracle=oracle_with("""
SELECT product, minx, miny, maxx, maxy, (minx + maxx) / 2 AS mid_x, (miny + maxy) / 2 AS mid_y,
       ROUND(ax / a, 9) AS centroid_x, ROUND(ay / a, 9) AS centroid_y,
       LEAST(CASE WHEN maxy - miny = 0 THEN 18 ELSE CAST(TRUNC(LOG2(360.0 / ABS(miny - maxy))) AS INTEGER) END,
             CASE WHEN maxx - minx = 0 THEN 18 ELSE CAST(TRUNC(LOG2(360.0 / ABS(minx - maxx))) AS INTEGER) END) AS zoom
FROM (SELECT product, MIN(minx) AS minx, MIN(miny) AS miny, MAX(maxx) AS maxx, MAX(maxy) AS maxy,
             SUM((maxx - minx) * (maxy - miny)) AS a,
             SUM((maxx - minx) * (maxy - miny) * (minx + maxx) / 2) AS ax,
             SUM((maxx - minx) * (maxy - miny) * (miny + maxy) / 2) AS ay
      FROM scenes GROUP BY product) g""", "scenes"))
def combined_bounds(spark, sf):
    b = explore.combined_bounds(view(spark, sf, "scenes"), ["product"])
    return b.select("product", "minx", "miny", "maxx", "maxy", "mid_x", "mid_y",
                    F.round("centroid_x", 9).alias("centroid_x"), F.round("centroid_y", 9).alias("centroid_y"), "zoom")


API_LIMIT = 100  # the request of this query; below the number of matches at every scale


@register("datasets_geojson", operators=("S1", "P4", "O1", "P18", "K5", "F33", "F24"), oracle=oracle_with(f"""
SELECT id, to_json({{'type': 'Feature',
                     'geometry': {{'type': 'Polygon', 'coordinates': [[[minx, miny], [maxx, miny], [maxx, maxy],
                                                                      [minx, maxy], [minx, miny]]]}},
                     'properties': {{'id': id, 'product': product, 'datetime': {sql_iso_ts('t')},
                                     'region_code': region_code}}}}) AS feature,
       'ls89_c2l2_sp-1996-datasets' AS file_prefix
FROM (SELECT * FROM scenes WHERE product = 'ls89_c2l2_sp' AND t >= TIMESTAMP '1996-01-01'
      AND t < TIMESTAMP '1997-01-01' ORDER BY t, id LIMIT {API_LIMIT}) s
WHERE geom IS NOT NULL""", "scenes"))
def datasets_geojson(spark, sf):
    found = catalog.find_scenes(view(spark, sf, "scenes"), ["ls89_c2l2_sp"], time=temporal.as_time_range(1996))
    top = explore.limited(found, API_LIMIT).filter(F.col("geom").isNotNull())
    feat = explore.geojson_feature(
        explore.bbox_geometry("minx", "miny", "maxx", "maxy"),
        {"id": F.col("id"), "product": F.col("product"), "datetime": iso_ts("t"),
         "region_code": F.col("region_code")})
    return top.select("id", feat.alias("feature"),
                      explore.api_file_prefix(F.lit("/api/datasets/ls89_c2l2_sp/1996")).alias("file_prefix"))


def _license_sql():
    rows = ", ".join(f"({sql_str(n)}, {sql_str(lic)})" for n, (_, lic, _, _) in PRODUCTS.items())
    return f"SELECT * FROM (VALUES {rows}) AS v(name, license)"


@register("group_products", operators=("A17", "A24"), oracle=oracle_with("""
SELECT COALESCE(license, '') AS license, string_agg(name, ',' ORDER BY name) AS items, COUNT(*) AS n
FROM lic WHERE name IN (SELECT DISTINCT product FROM scenes) GROUP BY 1""", "scenes", lic=_license_sql()))
def group_products(spark, sf):
    present = catalog.distinct_products(view(spark, sf, "scenes")).withColumnRenamed("product", "name")
    p = product_table(spark).join(present, "name", "left_semi")
    g = explore.group_sorted(p.select("name", "license"), "license", "name")
    return g.select("license", F.array_join("items", ",").alias("items"), F.col("n").cast("long").alias("n"))


@register("overlay_active", operators=("J9",), oracle=oracle_with("""
SELECT CAST(CAST(fr.t AS DATE) AS VARCHAR) AS t, f.fid, f.attr
FROM fr JOIN features f
  ON COALESCE(f.start_time, (SELECT MIN(t) FROM fr)) <= fr.t
 AND fr.t <= COALESCE(f.end_time, (SELECT MAX(t) FROM fr))""", "pixels", "features",
    fr="SELECT DISTINCT CAST(t AS TIMESTAMP) AS t FROM pixels"))
def overlay_active(spark, sf):
    frames = view(spark, sf, "pixels").select(F.col("t").cast("timestamp_ntz").alias("t")).distinct()
    feats = view(spark, sf, "features").select("fid", "attr", "start_time", "end_time")
    a = overlay.active_features(frames, feats)
    return a.select(iso_day("t").alias("t"), "fid", "attr")


@register("overlay_counts", operators=("J9", "J11"), oracle=oracle_with("""
SELECT strftime(fr.t, '%Y-%m-%dT%H:%M:%S') AS t, COUNT(f.fid) AS n_active
FROM fr LEFT JOIN features f
  ON COALESCE(f.start_time, (SELECT MIN(t) FROM fr)) <= fr.t
 AND fr.t <= COALESCE(f.end_time, (SELECT MAX(t) FROM fr)) GROUP BY 1""", "features",
    fr="SELECT DISTINCT l_shipdate + INTERVAL 8 HOUR * (l_orderkey % 3) AS t FROM lineitem"))
def overlay_counts(spark, sf):
    """How many features are active at each observation time (three a day)."""
    from ..sources.tables import read_table
    frames = read_table(spark, sf, "lineitem").select(F.timestamp_add(
        "HOUR", (F.col("l_orderkey") % 3 * 8).cast("int"), F.col("l_shipdate").cast("timestamp_ntz")).alias("t")).distinct()
    counts = overlay.active_counts(frames, view(spark, sf, "features"))
    return counts.select(iso_ts("t").alias("t"), "n_active")


@register("bbox_overlaps", operators=("J10",), oracle=oracle_with("""
SELECT a.id AS id_a, b.id AS id_b, GREATEST(a.minx, b.minx) AS minx, GREATEST(a.miny, b.miny) AS miny,
       LEAST(a.maxx, b.maxx) AS maxx, LEAST(a.maxy, b.maxy) AS maxy
FROM scenes a JOIN scenes b
  ON a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy
WHERE a.product = 'ls89_c2l2_sp' AND b.product = 's2_l2a'""", "scenes"))
def bbox_overlaps(spark, sf):
    sc = view(spark, sf, "scenes")
    a = sc.filter(F.col("product") == "ls89_c2l2_sp")
    b = sc.filter(F.col("product") == "s2_l2a")
    return overlay.overlapping_boxes(a, b)


@register("bbox_overlap_counts", operators=("J10",), oracle=oracle_with("""
SELECT a.id, COUNT(b.id) AS n_overlaps, MIN(b.id) AS first_overlap
FROM a LEFT JOIN b ON a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy
GROUP BY a.id""", "scenes", a="SELECT * FROM scenes WHERE product = 'ls89_c2l2_sp'",
    b="SELECT * FROM scenes WHERE product <> 'ls89_c2l2_sp'"))
def bbox_overlap_counts(spark, sf):
    """For every scene of one product how many scenes of the others overlap it."""
    sc = view(spark, sf, "scenes")
    return overlay.overlap_counts(sc.filter(F.col("product") == "ls89_c2l2_sp"), sc.filter(F.col("product") != "ls89_c2l2_sp"))


@register("bbox_overlap_footprints", operators=("J10",), oracle=oracle_with("""
SELECT a.id AS id_a, b.id AS id_b, a.n AS n_a, b.n AS n_b, GREATEST(a.minx, b.minx) AS minx, GREATEST(a.miny, b.miny) AS miny,
       LEAST(a.maxx, b.maxx) AS maxx, LEAST(a.maxy, b.maxy) AS maxy
FROM a JOIN b ON a.minx <= b.maxx AND b.minx <= a.maxx AND a.miny <= b.maxy AND b.miny <= a.maxy""", "scenes",
    **{s: f"""SELECT MIN(id) AS id, COUNT(*) AS n, minx, miny, maxx, maxy FROM scenes WHERE product = '{p}'
              GROUP BY minx, miny, maxx, maxy""" for s, p in (("a", "ls89_c2l2_sp"), ("b", "s2_l2a"))}))
def bbox_overlap_footprints(spark, sf):
    """Overlapping pairs of different footprints, each with the number of its scenes."""
    sc = view(spark, sf, "scenes")
    pairs = overlay.overlapping_distinct_boxes(sc.filter(F.col("product") == "ls89_c2l2_sp"), sc.filter(F.col("product") == "s2_l2a"))
    return pairs.select("id_a", "id_b", "n_a", "n_b", "minx", "miny", "maxx", "maxy")


CLIP_AOI = (-20.0, -40.0, 60.0, 40.0)


@register("clip_to_aoi", operators=("J10", "P3"), oracle=oracle_with("""
SELECT id, GREATEST(minx, -20.0) AS minx, GREATEST(miny, -40.0) AS miny, LEAST(maxx, 60.0) AS maxx,
       LEAST(maxy, 40.0) AS maxy
FROM scenes WHERE minx <= 60 AND maxx >= -20 AND miny <= 40 AND maxy >= -40""", "scenes"))
def clip_to_aoi(spark, sf):
    from ..functions.geo import bbox_overlaps as overlaps
    sc = view(spark, sf, "scenes").filter(overlaps("minx", "miny", "maxx", "maxy", CLIP_AOI))
    return sc.select("id", *overlay.clip_box("minx", "miny", "maxx", "maxy", CLIP_AOI))


@register("paired_series", operators=("J12",), oracle=oracle_with("""
SELECT a.pos, a.t AS t_a, a.value AS value_a, b.t AS t_b, b.value AS value_b
FROM (SELECT ROW_NUMBER() OVER (ORDER BY t, series, value NULLS FIRST) - 1 AS pos, strftime(t, '%Y-%m-%dT%H:%M:%S.%f') AS t, value
      FROM series WHERE series = 'click') a
JOIN (SELECT ROW_NUMBER() OVER (ORDER BY t, series, value NULLS FIRST) - 1 AS pos, strftime(t, '%Y-%m-%dT%H:%M:%S.%f') AS t, value
      FROM series WHERE series = 'view') b ON a.pos = b.pos""", "series"))
def paired_series(spark, sf):
    s = view(spark, sf, "series")

    def side(name, tag):
        return s.filter(F.col("series") == name).select(
            F.col("t").alias(f"t_{tag}"), F.col("series").alias(f"s_{tag}"), F.col("value").alias(f"value_{tag}"))

    p = overlay.pair_by_position(side("click", "a"), side("view", "b"),
                                 ["t_a", "s_a", "value_a"], ["t_b", "s_b", "value_b"])
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return p.select("pos", F.date_format("t_a", fmt).alias("t_a"), "value_a",
                    F.date_format("t_b", fmt).alias("t_b"), "value_b")


@register("series_upto", operators=("J11",), oracle=oracle_with("""
SELECT CAST(CAST(fr.d AS DATE) AS VARCHAR) AS t, s.series, COUNT(*) AS n_points, ROUND(SUM(s.value), 6) AS value_sum,
       strftime(MAX(s.t), '%Y-%m-%dT%H:%M:%S.%f') AS last_time, arg_max(s.value, s.t) AS last_value
FROM fr JOIN series s ON s.t <= fr.d + INTERVAL 23 HOUR + INTERVAL 59 MINUTE
WHERE s.value IS NOT NULL AND NOT isnan(s.value)
GROUP BY 1, 2""", "series", fr="SELECT DISTINCT CAST(CAST(t AS DATE) AS TIMESTAMP) AS d FROM series"))
def series_upto(spark, sf):
    s = view(spark, sf, "series")
    frames = s.select(F.to_date("t").cast("timestamp_ntz").alias("t")).distinct()
    r = overlay.series_up_to_frames(frames, s.select("series", "t", "value"))
    fmt = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return r.select(iso_day("t").alias("t"), "series", "n_points", F.round("value_sum", 6).alias("value_sum"),
                    F.date_format("last_time", fmt).alias("last_time"), "last_value")
