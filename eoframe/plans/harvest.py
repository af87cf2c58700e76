"""Harvest planning: missing assets, folder groupings, sizes, trees, batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import harvest
from ..sources.fixtures import oracle_with, view
from . import register

_A2 = dict(
    a1="""SELECT scene_id, asset_key, url,
              regexp_replace(split_part(url, '?', 1), '^[a-z]+://[^/]+/', '') AS rel FROM assets""",
    a2="""SELECT *, regexp_extract(rel, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(rel, '[^/]*$', 0) AS fname
          FROM a1""")
_MISSING = """SELECT * FROM a2 WHERE NOT EXISTS (
    SELECT 1 FROM files f WHERE starts_with(f.path, a2.dir || '/')
                            AND regexp_extract(f.path, '[^/]*$', 0) = a2.fname)"""


@register("missing_assets", operators=("J4", "F16"), oracle=oracle_with("""
SELECT scene_id, asset_key, url FROM miss""", "assets", "files", **_A2, miss=_MISSING))
def missing_assets(spark, sf):
    return harvest.missing_assets(view(spark, sf, "assets"), view(spark, sf, "files")).select(
        "scene_id", "asset_key", "url")


# The listing as a second provider leaves it: some names with a prefix or an ending, some
# scenes without files of their own but with a folder called like the file.
_RELABELLED = """SELECT CASE CAST(hash_no AS INT) WHEN 0 THEN path WHEN 1 THEN concat(path, '.aux.xml') WHEN 2 THEN concat(dir, '/copy/old-', fname)
             WHEN 3 THEN concat(dir, '/', fname, '/part.bin') ELSE concat(dir, '/', lower(fname)) END AS path
      FROM (SELECT path, length % 5 AS hash_no, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '([^/]*)$', 1) AS fname FROM {files}) z"""


@register("missing_by_substring", operators=("J4", "F16"), oracle=oracle_with("""
SELECT scene_id, asset_key, url FROM a2 WHERE NOT EXISTS (
  SELECT 1 FROM relabelled f WHERE starts_with(f.path, a2.dir || '/') AND contains(f.path, a2.fname))""",
    "assets", "files", **_A2, relabelled=_RELABELLED.format(files="files")))
def missing_by_substring(spark, sf):
    files = spark.sql(_RELABELLED, files=view(spark, sf, "files"))
    return harvest.missing_by_substring(view(spark, sf, "assets"), files).select("scene_id", "asset_key", "url")


@register("harvest_summary", operators=("J5", "J4"), oracle=oracle_with("""
SELECT COUNT(*) AS n_missing, COUNT(DISTINCT dir) AS n_folders FROM miss""", "assets", "files", **_A2,
    miss=_MISSING))
def harvest_summary(spark, sf):
    return harvest.harvest_plan(view(spark, sf, "assets"), view(spark, sf, "files"), dry_run=True)


@register("asset_groups", operators=("A11", "F16", "O3"), oracle=oracle_with("""
SELECT dir, COUNT(*) AS n_assets, MIN(url) AS first_url, MAX(url) AS last_url FROM a2 GROUP BY dir""",
    "assets", **_A2))
def asset_groups(spark, sf):
    return harvest.folder_summary(view(spark, sf, "assets"))


@register("signatures", operators=("A12", "F17", "F16", "J4"), oracle=oracle_with("""
SELECT sig, COUNT(*) AS n_folders, MIN(parent) AS first_folder, MAX(parent) AS last_folder
FROM (SELECT parent, string_agg(part, ',' ORDER BY part) AS sig FROM parts GROUP BY parent) z GROUP BY sig""",
    "assets", "files", **_A2, miss=_MISSING,
    parts="""SELECT regexp_extract(rel, '([^/]*)/[^/]*$', 1) AS parent,
                    CASE WHEN regexp_matches(fname, '_T\\d_') THEN regexp_extract(fname, '^.*_T\\d_(.*)$', 1)
                         ELSE fname END AS part
             FROM miss"""))
def signatures(spark, sf):
    miss = harvest.missing_assets(view(spark, sf, "assets"), view(spark, sf, "files"))
    s = harvest.signatures(miss.select("url"))
    return s.select(F.array_join("sig", ",").alias("sig"), "n_folders", "first_folder", "last_folder")


_ANC = """SELECT array_to_string(list_slice(string_split(path, '/'), 1, i), '/') AS folder, path, length
          FROM listing, LATERAL (SELECT unnest(generate_series(1, len(string_split(path, '/')) - 1)) AS i) s"""


def _human_sql(c: str) -> str:
    steps = " ".join(f"WHEN {c} < {1024 ** (k + 1)} THEN printf('%.1f {u}', {c} / {float(1024 ** k)!r})"
                     for k, u in enumerate(text.SIZE_UNITS[:-1]) if k > 0)
    return (f"CASE WHEN {c} = 0 THEN '0 B' WHEN {c} < 1024 THEN CAST({c} AS VARCHAR) || ' B' {steps} "
            f"ELSE printf('%.1f PB', {c} / {float(1024 ** 5)!r}) END")


def _human2_sql(c: str) -> str:
    steps = " ".join(f"WHEN {c} < {1024 ** (k + 1)} THEN printf('%.2f {u}', {c} / {float(1024 ** k)!r})"
                     for k, u in enumerate(text.SIZE_UNITS[:-1]))
    return f"CASE {steps} ELSE printf('%.2f PB', {c} / {float(1024 ** 5)!r}) END"


@register("folder_sizes", operators=("A20", "F14"), oracle=oracle_with(f"""
SELECT folder, size, n_files, {_human_sql('size')} AS human, {_human2_sql('size')} AS human2 FROM (
  SELECT folder, CAST(SUM(length) AS BIGINT) AS size, COUNT(*) AS n_files FROM anc GROUP BY folder) z""",
    "listing", anc=_ANC))
def folder_sizes(spark, sf):
    s = harvest.folder_sizes(view(spark, sf, "listing"))
    return s.select("folder", "size", "n_files", text.human_bytes("size").alias("human"),
                    text.human_bytes_2("size").alias("human2"))


TREE_DEPTH = 3


@register("tree_listing", operators=("A21", "A20", "F14"), oracle=oracle_with(f"""
SELECT path, depth, is_dir, size, is_dir AND depth = {TREE_DEPTH} AS truncated, {_human2_sql('size')} AS human2
FROM (SELECT folder AS path, CAST(SUM(length) AS BIGINT) AS size, true AS is_dir,
             len(string_split(folder, '/')) - 1 AS depth FROM anc GROUP BY folder
      UNION ALL
      SELECT path, length AS size, false AS is_dir, len(string_split(path, '/')) - 1 AS depth FROM listing) z
WHERE depth <= {TREE_DEPTH}""", "listing", anc=_ANC))
def tree_listing(spark, sf):
    t = harvest.tree(view(spark, sf, "listing"), TREE_DEPTH)
    return t.select("path", F.col("depth").cast("long").alias("depth"), "is_dir", "size", "truncated",
                    text.human_bytes_2("size").alias("human2"))


LEAF_GLOB = "landsat-c2/*/199[5-7]/*/LC08_1*"


@register("leaf_folders", operators=("P17", "F20"), oracle=oracle_with(f"""
SELECT DISTINCT folder FROM anc a
WHERE folder NOT IN (SELECT regexp_extract(folder, '^(.*)/[^/]*$', 1) FROM anc)
  AND regexp_full_match(folder, 'landsat-c2/.*/199[5-7]/.*/LC08_1.*')""", "listing", anc=_ANC))
def leaf_folders(spark, sf):
    return harvest.leaf_folders(view(spark, sf, "listing"), LEAF_GLOB)


@register("representative_file", operators=("A25",), oracle=oracle_with("""
SELECT folder, COALESCE(MIN(path) FILTER (WHERE ext IN ('tif', 'tiff')),
                        MIN(path) FILTER (WHERE ext IN ('jpg', 'jpeg', 'png', 'jp2'))) AS file,
       CASE WHEN COALESCE(MIN(path) FILTER (WHERE ext IN ('tif', 'tiff')),
                          MIN(path) FILTER (WHERE ext IN ('jpg', 'jpeg', 'png', 'jp2'))) IS NULL
            THEN 'no image file' END AS error
FROM (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, path,
             lower(regexp_extract(regexp_extract(path, '[^/]*$', 0), '\\.([^.]*)$', 1)) AS ext FROM listing) z
GROUP BY folder""", "listing"))
def representative_file(spark, sf):
    return harvest.representative_file(view(spark, sf, "listing"))


# Band -> file-name suffix of the Landsat Collection 2 surface-reflectance files.
BAND_SUFFIXES = [("red", "SR_B4"), ("green", "SR_B3"), ("blue", "SR_B2"), ("qa_pixel", "QA_PIXEL")]


@register("band_files", operators=("J8",), oracle=oracle_with("""
SELECT regexp_extract(f.path, '^(.*)/[^/]*$', 1) AS folder, s.band, MIN(f.path) AS path
FROM listing f JOIN sfx s ON ends_with(f.path, s.suffix || '.TIF') GROUP BY 1, 2""", "listing",
    sfx="SELECT * FROM (VALUES " + ", ".join(f"('{b}', '{x}')" for b, x in BAND_SUFFIXES)
        + ") AS v(band, suffix)"))
def band_files(spark, sf):
    suffixes = spark.createDataFrame(BAND_SUFFIXES, "band string, suffix string").coalesce(1)
    return harvest.band_files(view(spark, sf, "listing"), suffixes)


BATCH_FOLDERS = 5


@register("batches", operators=("W6", "A11"), oracle=oracle_with(f"""
SELECT dir, ROW_NUMBER() OVER (ORDER BY dir) - 1 AS folder_idx,
       (ROW_NUMBER() OVER (ORDER BY dir) - 1) // {BATCH_FOLDERS} AS batch
FROM (SELECT DISTINCT dir FROM a2) d""", "assets", **_A2))
def batches(spark, sf):
    return harvest.batches(view(spark, sf, "assets"), BATCH_FOLDERS)


@register("page_refs", operators=("F15", "F16"), oracle=oracle_with(f"""
SELECT page_id, NULLIF(regexp_extract(url, '{text.URL_PATTERN}', 0), '') AS first_url,
       NULLIF(regexp_extract(html, '{text.PATH_PATTERN}', 0), '') AS first_path,
       regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/', '') AS path,
       regexp_extract(regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/', ''), '[^/]*$', 0)
         AS basename
FROM pages"""))
def page_refs(spark, sf):
    from ..sources.tables import read_table
    p = read_table(spark, sf, "pages")
    path = text.url_path("url")
    return p.select("page_id", text.first_url("url").alias("first_url"), text.first_path("html").alias("first_path"),
                    path.alias("path"), text.basename(path).alias("basename"))
