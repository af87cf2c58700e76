"""Documents and indexing: sidecar extraction, scene documents, upserts, names, templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import documents as fdocs
from ..functions import geo, temporal, text
from ..operators import catalog, documents, explore, harvest
from ..session import cut_lineage
from ..sources.fixtures import oracle_with, view
from ..sources.products import PRODUCTS, products as product_table
from . import register
from .common import iso_ts, sql_iso_ts, sql_str


def _tag(tag: str) -> str:
    return f"NULLIF(TRIM(regexp_extract(xml, '<{tag}>([^<]*)</{tag}>', 1)), '')"


_MTL_ORACLE_COLS = {name: (path if "+" not in path else None) for name, path in fdocs.MTL_VARIABLES.items()}


def _mtl_sql_cols() -> str:
    cols = []
    for name, path in fdocs.MTL_VARIABLES.items():
        if "+" in path:
            a, b = [p.strip().split("/")[1] for p in path.split("+")]
            cols.append(f"CASE WHEN {_tag(a)} IS NOT NULL AND {_tag(b)} IS NOT NULL THEN {_tag(a)} || 'T' || "
                        f"regexp_replace({_tag(b)}, 'Z+$', '') || 'Z' END AS {name}")
        else:
            cols.append(f"{_tag(path.split('/')[1])} AS {name}")
    return ", ".join(cols)


@register("mtl_extract", operators=("F22", "F18"), oracle=oracle_with(f"""
SELECT scene_id, folder, {_mtl_sql_cols()},
       (CASE WHEN {_tag('FILE_NAME_BAND_4')} LIKE '%\\_SR\\_B4.TIF' ESCAPE '\\' THEN 1 ELSE 0 END
        + CASE WHEN {_tag('FILE_NAME_BAND_3')} LIKE '%\\_SR\\_B3.TIF' ESCAPE '\\' THEN 1 ELSE 0 END
        + CASE WHEN {_tag('FILE_NAME_BAND_2')} LIKE '%\\_SR\\_B2.TIF' ESCAPE '\\' THEN 1 ELSE 0 END
        + CASE WHEN {_tag('FILE_NAME_QUALITY_L1_PIXEL')} LIKE '%\\_QA\\_PIXEL.TIF' ESCAPE '\\' THEN 1 ELSE 0 END)
         AS n_band_files,
       {_tag('FILE_NAME_BAND_4')} AS red_file,
       substr({_tag('DATE_PRODUCT_GENERATED')}, 1, 10) || 'T00:00:00Z' AS first_date
FROM mtl_xml""", "mtl_xml"))
def mtl_extract(spark, sf):
    m = fdocs.extract_mtl(view(spark, sf, "mtl_xml"), "xml", "m")
    return m.select("scene_id", "folder", *[F.col(f"m.{n}").alias(n) for n in fdocs.MTL_VARIABLES],
                    F.size("m.bands").cast("int").alias("n_band_files"), F.col("m.bands")["red"].alias("red_file"),
                    temporal.date_in_text("m.created").alias("first_date"))


@register("mtl_errors", operators=("F22", "S7"), oracle=oracle_with(f"""
SELECT scene_id, CASE WHEN xml IS NULL OR TRIM(xml) = '' THEN 'no document' WHEN NOT starts_with(LTRIM(xml), '<') THEN 'not an XML document'
                 WHEN kind IN (3, 4) THEN 'broken XML document' END AS error,
       CASE WHEN kind IN (5, 6, 7) THEN {_tag('SPACECRAFT_ID')} END AS platform, CASE WHEN kind IN (5, 6, 7) THEN {_tag('CLOUD_COVER')} END AS cloud_cover
FROM landed""", "mtl_xml",
    landed="""SELECT scene_id, scene_id % 8 AS kind, CASE scene_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'status: 404' WHEN 3 THEN substr(xml, 1, 900)
                     WHEN 4 THEN replace(xml, '</IMAGE_ATTRIBUTES>', '') WHEN 5 THEN '  ' || xml ELSE xml END AS xml FROM mtl_xml"""))
def mtl_errors(spark, sf):
    """Sidecars as they land, some missing, no XML, cut off or with a tag left open."""
    kind, xml = F.col("scene_id") % 8, F.col("xml")
    landed = view(spark, sf, "mtl_xml").select("scene_id", F.when(kind == 0, F.lit(None)).when(kind == 1, F.lit("  "))
        .when(kind == 2, F.lit("status: 404")).when(kind == 3, F.substring(xml, 1, 900))
        .when(kind == 4, F.replace(xml, F.lit("</IMAGE_ATTRIBUTES>"), F.lit(""))).when(kind == 5, F.concat(F.lit("  "), xml)).otherwise(xml).alias("xml"))
    m = fdocs.extract_mtl(landed, "xml", "m", error="error")
    return m.select("scene_id", F.regexp_replace("error", ": .*$", "").alias("error"), F.col("m.eo_platform").alias("platform"),
                    F.col("m.eo_cloud_cover").alias("cloud_cover"))


IMG_W, IMG_H = 7601, 7721
PUBLISH_ROOT = "/published"


def _scene_docs(spark, sf):
    # The parsed sidecars feed two branches (band lookup and document): written once.
    mtl = cut_lineage(fdocs.extract_mtl(view(spark, sf, "mtl_xml"), "xml", "m").select("scene_id", "folder", "m"))
    files = view(spark, sf, "listing").select(text.dirname("path").alias("folder"), "path",
                                            text.basename("path").alias("fname"))
    # Band paths: the folder's file whose name equals the sidecar's file name (an
    # equi-join on (folder, name)); per-folder maps hold a scene's few bands.
    # Scenes, files and their maps grow with the catalogue: their sizes are underrated before
    # the texts are made, so a broadcast of one would go through the driver. All are merged.
    wanted = mtl.select("folder", F.explode("m.bands").alias("band", "fname"))
    found = (wanted.join(files.hint("merge"), ["folder", "fname"])
                   .groupBy("folder").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("band", "path"))))
                                          .alias("bands")))
    # Accessories: one path per (folder, accessory key) first, so each folder's
    # map is bounded by the kinds of side files, not by how many there are.
    others = (files.filter(~text.extension("path").isin("tif", "tiff"))
                   .groupBy("folder", documents.accessory_key("fname").alias("key"))
                   .agg(F.min("path").alias("path"))
                   .groupBy("folder").agg(F.map_from_entries(F.collect_list(F.struct("key", "path")))
                                          .alias("accessories")))
    sc = view(spark, sf, "scenes").select(F.col("id").alias("scene_id"), "product", "minx", "miny", "maxx", "maxy")
    j = (mtl.join(sc.hint("merge"), "scene_id").join(found.hint("merge"), "folder", "left").join(others.hint("merge"), "folder", "left")
            .withColumn("bands", F.coalesce("bands", F.create_map().cast("map<string,string>")))
            .withColumn("accessories", F.coalesce("accessories", F.create_map().cast("map<string,string>"))))
    lat = (F.col("miny") + F.col("maxy")) / 2
    lon = (F.col("minx") + F.col("maxx")) / 2
    doc = documents.scene_document("folder", "product", "m", "bands", "accessories", "minx", "miny", "maxx", "maxy",
                                   F.lit(IMG_W), F.lit(IMG_H), geo.utm_epsg(lat, lon))
    return j.select("scene_id", "folder", "product", "bands", doc.alias("doc"))


@register("scene_docs", operators=("F23", "J8", "F10", "F11", "F34", "F39", "F25", "F28", "K7", "F8"),
          oracle=oracle_with(f"""
SELECT x.scene_id, md5(x.folder) AS md5_id,
       substr(regexp_extract(x.folder, '[^/]*$', 0), 1, 25) || substr(regexp_extract(x.folder, '[^/]*$', 0), -6, 6) AS label,
       'epsg:' || CAST(CAST(CASE WHEN (s.miny + s.maxy) / 2 >= 0 THEN 32600 ELSE 32700 END
                 + LEAST(FLOOR(((s.minx + s.maxx) / 2 + 180) / 6) + 1, 60) AS INTEGER) AS VARCHAR) AS crs,
       lpad({_tag('WRS_PATH')}, 3, '0') || lpad({_tag('WRS_ROW')}, 3, '0') AS region_code,
       CAST({_tag('CLOUD_COVER')} AS DOUBLE) / 100 AS cloud_cover,
       replace(lower({_tag('SPACECRAFT_ID')}), '_', '-') AS platform,
       COALESCE(b.n, 0) AS n_bands, b.red_path,
       ROUND((s.maxx - s.minx) / {IMG_W}, 12) AS gsd,
       '{PUBLISH_ROOT}/' || s.product || '/' || regexp_extract(x.folder, '[^/]*$', 0) AS publish_to,
       true AS is_eo3,
       strftime(COALESCE(strptime(CASE WHEN {_tag('SCENE_CENTER_TIME')} IS NOT NULL THEN {_tag('DATE_ACQUIRED')} || ' '
                 || substr({_tag('SCENE_CENTER_TIME')}, 1, 8) END, '%Y-%m-%d %H:%M:%S'), s.t), '%Y-%m-%dT%H:%M:%S') AS center_time,
       strftime(strptime(substr({_tag('DATE_PRODUCT_GENERATED')}, 1, 19), '%Y-%m-%dT%H:%M:%S'), '%Y-%m-%dT%H:%M:%S') AS created
FROM mtl_xml x JOIN scenes s ON x.scene_id = s.id
LEFT JOIN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, COUNT(*) AS n,
                  MAX(CASE WHEN ends_with(path, '_SR_B4.TIF') THEN path END) AS red_path
           FROM listing WHERE regexp_matches(path, '_(SR_B[2-4]|QA_PIXEL)\\.TIF$') GROUP BY 1) b ON b.folder = x.folder""",
    "mtl_xml", "scenes", "listing"))
def scene_docs(spark, sf):
    d = _scene_docs(spark, sf)
    doc = F.col("doc")
    scenes_t = view(spark, sf, "scenes").select(F.col("id").alias("scene_id"), F.col("t").cast("timestamp_ntz").alias("_t"))
    d = d.join(scenes_t.hint("merge"), "scene_id")
    # A sidecar without a scene time: the scene's own range starts at its day.
    center = temporal.representative_time(
        F.try_to_timestamp(F.regexp_replace(doc["properties"]["datetime"], r"\.\d+Z$", ""),
                           F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz"), F.col("_t"), F.col("_t"))
    created = temporal.creation_time(F.lit(None).cast("timestamp_ntz"),
                                     F.regexp_replace(doc["properties"]["created"], "Z$", ""), F.col("_t"))
    return d.select(
        "scene_id", F.replace(doc["id"], F.lit("-"), F.lit("")).alias("md5_id"), doc["label"].alias("label"),
        doc["crs"].alias("crs"), doc["properties"]["odc:region_code"].alias("region_code"),
        doc["properties"]["eo:cloud_cover"].alias("cloud_cover"), doc["properties"]["eo:platform"].alias("platform"),
        F.size(fdocs.file_offsets(doc["measurements"], doc["accessories"])).cast("long").alias("n_bands"),
        F.col("bands")["red"].alias("red_path"),
        F.round(doc["grids"]["default"]["transform"][0], 12).alias("gsd"),
        documents.publish_path(PUBLISH_ROOT, "product", text.basename("folder")).alias("publish_to"),
        fdocs.is_eo3(doc["$schema"]).alias("is_eo3"),
        iso_ts(center).alias("center_time"),
        iso_ts(created).alias("created"))


INDEXED_BEFORE = "1998-01-01"
INCOMING_FROM = "1997-01-01"


def _upsert(spark, sf):
    sc = view(spark, sf, "scenes")
    index = sc.filter(F.col("t") < F.lit(INDEXED_BEFORE).cast("timestamp_ntz"))
    incoming = sc.filter(F.col("t") >= F.lit(INCOMING_FROM).cast("timestamp_ntz"))
    ring = geo.bbox_ring("minx", "miny", "maxx", "maxy")
    valid = F.col("geom").isNotNull() & geo.ring_is_valid(ring)
    return documents.upsert_outcomes(incoming, index, "id", valid, F.lit("invalid footprint"))


_UPSERT_SQL = dict(
    o="""SELECT i.id, i.product,
           CASE WHEN i.id IN (SELECT id FROM scenes WHERE t < TIMESTAMP '1998-01-01') THEN 'already'
                WHEN i.geom IS NULL THEN 'failed' ELSE 'added' END AS status
         FROM scenes i WHERE i.t >= TIMESTAMP '1997-01-01'""")


@register("dataset_upsert", operators=("K1", "F36", "F10"), oracle=oracle_with("""
SELECT id, status, CASE WHEN status = 'failed' THEN 'invalid footprint' END AS error FROM o""", "scenes",
    **_UPSERT_SQL))
def dataset_upsert(spark, sf):
    return _upsert(spark, sf).select("id", "status", "error")


@register("upsert_summary", operators=("A19", "K1"), oracle=oracle_with("""
SELECT product, COUNT(*) AS total, COUNT(*) FILTER (WHERE status <> 'failed') AS successful,
       COUNT(*) FILTER (WHERE status = 'failed') AS failed,
       CASE WHEN COUNT(*) FILTER (WHERE status = 'failed') > 0 THEN 'invalid footprint' END AS errors
FROM o GROUP BY product""", "scenes", **_UPSERT_SQL))
def upsert_summary(spark, sf):
    s = harvest.run_summary(_upsert(spark, sf), keys=["product"])
    return s.select("product", "total", "successful", "failed", F.array_join("errors", ";").alias("errors"))


@register("unique_names", operators=("W5", "F29"), oracle=oracle_with("""
SELECT id, CASE WHEN rn = 1 THEN base ELSE base || ' (' || CAST(rn AS VARCHAR) || ')' END AS unique_name
FROM (SELECT id, base, ROW_NUMBER() OVER (PARTITION BY base ORDER BY id) AS rn
      FROM (SELECT id, product || ' - ' || COALESCE(regexp_replace(list_filter(cands, lambda c: c <> '' AND c NOT IN
                         ('ga-metadata.yaml', 'agdc-metadata.yaml', 'ARD-METADATA.yaml'))[1], '\\.(yaml|json)$', ''),
                    CAST(id AS VARCHAR)) AS base
            FROM (SELECT id, product, CASE WHEN len(p) >= 4 THEN [p[len(p)], p[len(p) - 1], p[len(p) - 2],
                                                  array_to_string(p[1:len(p) - 3], '/')]
                           ELSE list_reverse(p) END AS cands
                  FROM (SELECT id, product, string_split(uri, '/') AS p FROM d) z) y) w) v""", "scenes",
    d=("SELECT id, product, CASE WHEN geom IS NULL THEN NULL ELSE concat('s3://eo-archive/', product, '/', region_code, "
       "'/', CASE geom WHEN 'F' THEN 'ga-metadata.yaml' WHEN 'O' THEN CAST(id AS VARCHAR) || '.odc-metadata.yaml' "
       "ELSE CAST(id AS VARCHAR) || '.json' END) END AS uri FROM scenes")))
def unique_names(spark, sf):
    from .explore import _doc_uri
    s = view(spark, sf, "scenes").select("id", "product", _doc_uri().alias("uri"))
    lab = s.select("id", "product", explore.dataset_label(F.lit(None).cast("string"), "uri", "id").alias("label"))
    return documents.unique_names(lab, "product", "label", ["id"]).select("id", "unique_name")


def _defs_sql():
    rows = ", ".join(f"({sql_str(n)}, {i}, {sql_str(d[0])})" for i, (n, d) in enumerate(PRODUCTS.items()))
    return f"SELECT * FROM (VALUES {rows}) AS v(name, pos, description)"


@register("product_lookup", operators=("J13", "A24"), oracle=oracle_with("""
SELECT r.name, d.description, CASE WHEN d.description IS NULL THEN 'no document named ' || r.name END AS error
FROM (SELECT DISTINCT collection AS name FROM stac_items UNION SELECT DISTINCT product FROM scenes) r
LEFT JOIN (SELECT name, arg_min(description, pos) AS description FROM defs GROUP BY name) d ON r.name = d.name""",
    "stac_items", "scenes", defs=_defs_sql()))
def product_lookup(spark, sf):
    req = (view(spark, sf, "stac_items").select(F.col("collection").alias("name"))
           .unionByName(catalog.distinct_products(view(spark, sf, "scenes")).select(F.col("product").alias("name")))
           .distinct())
    defs = documents.union_sources([product_table(spark).select("name", "description")])
    defs = defs.withColumn("pos", F.col("source_pos") * 1000 + F.lit(0))
    return documents.lookup_first(req, defs, "name", "pos", "description").select("name", "description", "error")


TEMPLATE = ("id: <id>  # dataset id\nproduct: <product>\ndatetime: <datetime>\n"
            "properties:\n  eo:cloud_cover: <cloud_cover>\n  odc:region_code: <region_code>\n  status: <status>\n")


@register("fill_templates", operators=("F19", "U4"), oracle=oracle_with(f"""
SELECT id,
  array_to_string(list_sort(list_filter(['cloud_cover', 'datetime', 'id', 'product', 'region_code', 'status'],
                                        lambda k: (k = 'status' AND geom IS NULL))), ',') AS missing,
  CASE WHEN geom IS NULL THEN NULL ELSE
    replace(replace(replace(replace(replace(replace(
      regexp_replace({sql_str(TEMPLATE)}, '\\s*#[^\\n]*', '', 'g'),
      '<id>', CAST(id AS VARCHAR)), '<product>', product), '<datetime>', {sql_iso_ts('t')}),
      '<cloud_cover>', CAST(cloud_cover AS VARCHAR)), '<region_code>', region_code), '<status>', geom) END AS filled
FROM scenes""", "scenes"))
def fill_templates(spark, sf):
    sc = view(spark, sf, "scenes")
    vals = F.map_filter(F.create_map(
        F.lit("id"), F.col("id").cast("string"), F.lit("product"), F.col("product"),
        F.lit("datetime"), iso_ts("t"), F.lit("cloud_cover"), F.col("cloud_cover").cast("string"),
        F.lit("region_code"), F.col("region_code"), F.lit("status"), F.col("geom")), lambda k, v: v.isNotNull())
    tpl = F.lit(TEMPLATE)
    return sc.select("id", F.array_join(fdocs.missing_placeholders(tpl, vals), ",").alias("missing"),
                     fdocs.fill_template(tpl, vals).alias("filled"))


@register("docs_roundtrip", operators=("K3", "S5", "S6", "X7", "F21", "F37"), oracle=oracle_with(f"""
SELECT id, product, {sql_iso_ts('t')} AS t, 1 AS n_sources FROM scenes""", "scenes"))
def docs_roundtrip(spark, sf):
    import os
    from ..sources import landed
    from ..streaming.incremental import new_run_folder
    sc = view(spark, sf, "scenes")
    lineage = F.create_map(F.lit("source"), F.struct(F.concat(F.lit("order-"), F.col("id").cast("string")).alias("id")))
    doc = F.struct(F.col("id"), F.col("t"), F.struct(F.col("product").alias("name")).alias("product"),
                   fdocs.lineage_ids(lineage).alias("lineage"))
    root = new_run_folder(spark, "scene-docs")
    documents.write_documents(sc.select("product", doc.alias("doc")), root, yaml_stream=True)
    listed = landed.list_files(spark, root, "**.txt")
    docs_df = landed.read_documents(spark, root, "*.txt").join(listed.select("path"), "path", "left_semi")
    parsed = docs_df.filter(F.col("error").isNull()).select(
        F.from_json("doc", "id long, t string, product struct<name string>, lineage map<string,array<string>>")
         .alias("d"))
    return parsed.select(F.col("d.id").alias("id"), F.col("d.product.name").alias("product"),
                         F.col("d.t").alias("t"), F.size(F.col("d.lineage")["source"]).cast("int").alias("n_sources"))


# Four kinds of documents made from the scenes, as one catalogue folder holds them: by id,
# current and older dataset documents with missing or broken times, and items; product
# definitions with the license in either place, null, or missing; a document without a name.
_CATALOGUE = f"""
SELECT 'yaml' AS form, to_json(named_struct('$schema', '{fdocs.EO3_SCHEMA_URL}', 'id', CAST(id AS STRING),
    'product', named_struct('name', product),
    'properties', map_filter(map('datetime', CASE WHEN id % 3 <> 0 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'") END,
        'dtr:start_datetime', CASE WHEN id % 3 = 0 THEN date_format(t + INTERVAL 1 HOUR, "yyyy-MM-dd'T'HH:mm:ss'+02:00'") END,
        'odc:processing_datetime', CASE WHEN id % 2 = 0 THEN date_format(t + INTERVAL 9 DAY, "yyyy-MM-dd'T'HH:mm:ss") END,
        'eo:cloud_cover', CAST(cloud_cover AS STRING), 'eo:platform', 'p', 'proj:epsg', '32632'), (k, v) -> v IS NOT NULL),
    'measurements', map('red', map_filter(map('path', CASE WHEN id % 4 <> 0 THEN 'red.tif' END), (k, v) -> v IS NOT NULL), 'nir', map('path', 'nir.tif')),
    'accessories', map('nir', map('path', 'other.tif'), 'mtl', map('path', 'mtl.xml')),
    'lineage', map('level1', array(CONCAT('l1-', id), CONCAT('l1b-', id))))) AS doc
FROM {{scenes}} WHERE id % 5 IN (0, 1)
UNION ALL
SELECT 'yaml', to_json(named_struct('id', CAST(id AS STRING), 'product_type', product,
    'creation_dt', CASE id % 3 WHEN 0 THEN date_format(t + INTERVAL 3 DAY, "yyyy-MM-dd HH:mm:ss") WHEN 1 THEN 'no date' END,
    'extent', named_struct('from_dt', date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), 'to_dt', date_format(t + INTERVAL 2 HOUR, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    'image', named_struct('bands', map('10', map('path', 'b10.tif'), '20', map('path', 'b20.tif'))),
    'lineage', named_struct('source_datasets', map('ortho', named_struct('id', CONCAT('src-', id), 'x', 1)))))
FROM {{scenes}} WHERE id % 5 = 2
UNION ALL
SELECT 'json', to_json(named_struct('type', 'Feature', 'stac_version', '1.0.0', 'id', CAST(id AS STRING), 'collection', product,
    'properties', map_filter(map('datetime', CASE WHEN id % 2 = 0 THEN date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'") END,
        'start_datetime', date_format(t + INTERVAL 5 MINUTE, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        'end_datetime', date_format(t + INTERVAL 15 MINUTE, "yyyy-MM-dd'T'HH:mm:ss'Z'"), 'EO:cloud_cover', '5'), (k, v) -> v IS NOT NULL),
    'assets', map('red', map('href', CONCAT('https://h/', id, '/red.tif')))))
FROM {{scenes}} WHERE id % 5 = 3
UNION ALL
SELECT 'json', CASE WHEN id % 2 = 0 THEN CONCAT('{{{{"id": ', id) ELSE CONCAT('[', id, ']') END FROM {{scenes}} WHERE id % 5 = 4 AND id % 100 < 50
UNION ALL
SELECT 'yaml', CASE pos WHEN 0 THEN CONCAT('{{{{"metadata_type": "eo3", "name": "', product, '", "license": "CC-BY-4.0", "metadata": {{{{"product": {{{{"name": "', product, '_v2"}}}}}}}}}}}}')
    WHEN 1 THEN CONCAT('{{{{"metadata_type": "eo3", "name": "', product, '", "license": "CC0", "metadata": {{{{"license": null}}}}}}}}')
    WHEN 2 THEN '{{{{"metadata_type": "eo3", "description": "nameless"}}}}' ELSE CONCAT('{{{{"metadata_type": "eo3", "name": "', product, '"}}}}') END
FROM (SELECT product, MIN(id) % 4 AS pos FROM {{scenes}} GROUP BY product)
"""


@register("mixed_documents", operators=("S3", "S6", "S9", "F39", "F25", "F28", "F30", "F34", "F37", "P20"), oracle=oracle_with("""
SELECT 'eo3' AS kind, CAST(id AS VARCHAR) AS id, product,
       strftime(CASE WHEN id % 3 <> 0 THEN t ELSE t - INTERVAL 1 HOUR END, '%Y-%m-%dT%H:%M:%S') AS center_time,
       CASE WHEN id % 2 = 0 THEN strftime(t + INTERVAL 9 DAY, '%Y-%m-%dT%H:%M:%S') ELSE '2024-05-06T07:08:09' END AS created,
       CASE WHEN id % 4 <> 0 THEN 'mtl=mtl.xml,nir=other.tif,red=red.tif' ELSE 'mtl=mtl.xml,nir=other.tif' END AS files,
       'l1-' || id || ',' || 'l1b-' || id AS sources, 'cloud_cover,platform' AS eo, NULL AS license, NULL AS error
FROM scenes WHERE id % 5 IN (0, 1)
UNION ALL
SELECT 'legacy', CAST(id AS VARCHAR), product, strftime(t + INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%S'),
       CASE WHEN id % 3 = 0 THEN strftime(t + INTERVAL 3 DAY, '%Y-%m-%dT%H:%M:%S') ELSE '2024-05-06T07:08:09' END,
       '10=b10.tif,20=b20.tif', 'src-' || id, '', NULL, NULL
FROM scenes WHERE id % 5 = 2
UNION ALL
SELECT 'item', CAST(id AS VARCHAR), product, strftime(CASE WHEN id % 2 = 0 THEN t ELSE t + INTERVAL 5 MINUTE END, '%Y-%m-%dT%H:%M:%S'),
       '2024-05-06T07:08:09', 'red=https://h/' || id || '/red.tif', '', 'cloud_cover', NULL, NULL
FROM scenes WHERE id % 5 = 3
UNION ALL
SELECT NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN id % 2 = 0 THEN 'not a JSON document' ELSE 'not an object' END
FROM scenes WHERE id % 5 = 4 AND id % 100 < 50
UNION ALL
SELECT 'product', CASE pos WHEN 0 THEN product || '_v2' ELSE product END, CASE pos WHEN 0 THEN product || '_v2' ELSE product END,
       NULL, '2024-05-06T07:08:09', '', '', '', CASE pos WHEN 0 THEN 'CC-BY-4.0' WHEN 3 THEN 'default-license' END, NULL
FROM (SELECT product, MIN(id) % 4 AS pos FROM scenes GROUP BY product) p WHERE pos <> 2""", "scenes"))
def mixed_documents(spark, sf):
    """A catalogue folder of all kinds of documents, read back with one reader."""
    import os
    from ..functions import mixed
    from ..sources import landed
    from ..streaming.incremental import new_run_folder
    made = spark.sql(_CATALOGUE, scenes=view(spark, sf, "scenes"))
    root = new_run_folder(spark, "catalogue")
    (made.select("form", F.when(F.col("form") == "yaml", F.concat(F.lit("---\n"), F.col("doc"))).otherwise(F.col("doc")).alias("value"))
         .write.option("maxRecordsPerFile", 10000).partitionBy("form").text(root))
    docs = landed.read_mixed(spark, os.path.join(root, "form=yaml"), os.path.join(root, "form=json"), "*.txt", "*.txt")
    v, kind = F.col("v"), F.col("kind")
    indexed = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")

    def listed(m):
        return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    rows = docs.select(
        "kind", mixed.document_id(v, kind).alias("id"), mixed.product_of(v, kind).alias("product"),
        iso_ts(F.when(kind != "product", mixed.center_time(v, kind))).alias("center_time"),
        iso_ts(F.when(kind.isNotNull(), mixed.created_time(v, indexed))).alias("created"),
        F.when(kind.isNotNull(), listed(mixed.file_paths(v, kind))).alias("files"),
        F.when(kind.isNotNull(), F.array_join(F.flatten(F.map_values(mixed.source_ids(v, kind))), ",")).alias("sources"),
        F.when(kind.isNotNull(), F.array_join(F.array_sort(F.map_keys(mixed.prefixed_properties(v, "eo:", False))), ",")).alias("eo"),
        F.when(kind == "product", mixed.license_of(v, "default-license")).alias("license"), "error")
    # Definitions without a name are skipped.
    return rows.filter((F.col("kind") != "product") | F.col("id").isNotNull() | F.col("error").isNotNull())


@register("product_csv", operators=("S8", "A24"), oracle=oracle_with("""
SELECT product, product || '/' || CAST(MAX(year(t)) AS VARCHAR) || '.odc-product.yaml' AS url
FROM scenes GROUP BY product""", "scenes"))
def product_csv(spark, sf):
    """A product list written as CSV (one row per product and year, years ascending)
    and read back: for a repeated product the last row wins."""
    import os
    from ..sources import landed
    from ..streaming.incremental import new_run_folder
    rows = (view(spark, sf, "scenes").select("product", F.year("t").alias("yr")).distinct()
            .select("product", F.concat("product", F.lit("/"), F.col("yr").cast("string"),
                                        F.lit(".odc-product.yaml")).alias("definition"), "yr"))
    path = os.path.join(new_run_folder(spark, "product-csv"), "products.csv")
    # A product list is a small dimension file (products x years), written as one ordered file.
    rows.orderBy("product", "yr").drop("yr").coalesce(1).write.option("header", "true").csv(path)
    return landed.read_product_csv(spark, path)


@register("product_upsert", operators=("K2",), oracle=oracle_with("""
SELECT i.product AS name, CASE WHEN e.product IS NULL THEN 'added' ELSE 'failed' END AS status,
       CASE WHEN e.product IS NOT NULL THEN 'product already exists' END AS error
FROM (SELECT DISTINCT product FROM scenes WHERE t >= TIMESTAMP '1998-01-01') i
LEFT JOIN (SELECT DISTINCT product FROM scenes WHERE t < TIMESTAMP '1996-01-01'
           AND product IN ('ls89_c2l2_sp', 's2_l2a')) e ON i.product = e.product""", "scenes"))
def product_upsert(spark, sf):
    """Products defined from early scenes (two families) vs products seen later: add the new
    ones, report the existing ones (no update requested)."""
    sc = view(spark, sf, "scenes")
    existing = (sc.filter((F.col("t") < F.lit("1996-01-01").cast("timestamp_ntz"))
                          & F.col("product").isin("ls89_c2l2_sp", "s2_l2a"))
                  .select(F.col("product").alias("name")).distinct())
    incoming = sc.filter(F.col("t") >= F.lit("1998-01-01").cast("timestamp_ntz")).select(
        F.col("product").alias("name")).distinct()
    outcomes, _ = documents.product_upsert(existing, incoming, update=False)
    return outcomes


@register("product_update", operators=("K2",), oracle=oracle_with("""
SELECT COALESCE(n.name, o.name) AS name, COALESCE(n.family, o.family) AS family, COALESCE(n.n_scenes, o.n_scenes) AS n_scenes,
       CASE WHEN n.name IS NULL THEN NULL WHEN o.name IS NULL THEN 'added' ELSE 'updated' END AS status
FROM o FULL JOIN n ON o.name = n.name""", "scenes",
    o="""SELECT product || '_' || region_code AS name, product AS family, COUNT(*) AS n_scenes FROM scenes
         WHERE t < TIMESTAMP '1996-06-01' GROUP BY ALL""",
    n="""SELECT product || '_' || region_code AS name, product || '+' AS family, COUNT(*) AS n_scenes FROM scenes
         WHERE t >= TIMESTAMP '2000-06-01' AND product IN ('s2_l2a', 'nasadem') GROUP BY ALL"""))
def product_update(spark, sf):
    """Definitions updated in place: those sent again are replaced (and move to another
    family's partition), new ones added, the others kept from the old version."""
    from ..sources.versions import VersionedTable
    from ..streaming.incremental import new_run_folder

    def defined(df, family):
        return (df.groupBy(F.concat_ws("_", "product", "region_code").alias("name"), family.alias("family"))
                  .agg(F.count(F.lit(1)).alias("n_scenes")))
    sc = view(spark, sf, "scenes")
    old = defined(sc.filter(F.col("t") < F.lit("1996-06-01").cast("timestamp_ntz")), F.col("product"))
    new = defined(sc.filter((F.col("t") >= F.lit("2000-06-01").cast("timestamp_ntz")) & F.col("product").isin("s2_l2a", "nasadem")),
                  F.concat("product", F.lit("+")))
    table = VersionedTable(spark, new_run_folder(spark, "products"), "family")
    table.replace(old)
    outcomes = documents.update_products(table, new, update=True)
    return table.read().join(outcomes.select("name", "status"), "name", "left")


# Display order of dataset properties (known keys first, others last).
PROPERTY_PRIORITY = ["datetime", "eo:cloud_cover", "odc:region_code", "odc:product", "status"]


@register("property_order", operators=("O4",), oracle=oracle_with("""
SELECT id, array_to_string(list_transform(list_sort(list_transform(
         list_filter([['status', geom], ['datetime', strftime(t, '%Y-%m-%dT%H:%M:%S')],
                      ['zz:extra', 'x'], ['odc:region_code', region_code],
                      ['eo:cloud_cover', CAST(cloud_cover AS VARCHAR)]], lambda kv: kv[2] IS NOT NULL),
         lambda kv: [lpad(CAST(COALESCE(NULLIF(list_position(['datetime', 'eo:cloud_cover', 'odc:region_code',
                                                               'odc:product', 'status'], kv[1]), 0), 999) AS VARCHAR), 3, '0'),
                     kv[1]])), lambda p: p[2]), ',') AS keys
FROM scenes""", "scenes"))
def property_order(spark, sf):
    """Present (non-null) properties of each scene listed in display priority order."""
    sc = view(spark, sf, "scenes")
    props = F.map_filter(F.create_map(
        F.lit("status"), F.col("geom"), F.lit("datetime"), iso_ts("t"), F.lit("zz:extra"), F.lit("x"),
        F.lit("odc:region_code"), F.col("region_code"), F.lit("eo:cloud_cover"), F.col("cloud_cover").cast("string")),
        lambda k, v: v.isNotNull())
    ranked = F.transform(F.map_keys(props), lambda k: F.struct(explore.priority_rank(k, PROPERTY_PRIORITY).alias("r"),
                                                              k.alias("k")))
    return sc.select("id", F.array_join(F.transform(F.array_sort(ranked), lambda e: e["k"]), ",").alias("keys"))
