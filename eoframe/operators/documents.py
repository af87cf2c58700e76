"""Dataset and product documents: assembly, upsert outcomes, unique names, lookups, sinks.

Documents are rows (nested structs/maps). Indexing decisions are joins on the
document key: an incoming batch is compared with the index by a left join,
so re-running a batch is idempotent (everything already present reports
``already``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import documents as docs
from ..functions import geo, text
from ..session import cut_lineage
from ..sources.versions import VersionedTable
from .ranking import consecutive_index

LABEL_HEAD, LABEL_TAIL = 25, 6


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def stable_uuid(key) -> Column:
    """Repeatable document id: an MD5 of the key laid out as a UUID."""
    h = F.md5(_c(key).cast("string"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                       F.substring(h, 17, 4), F.substring(h, 21, 12))


def scene_label(folder_name) -> Column:
    """first 25 and last 6 characters of the scene folder name."""
    n = _c(folder_name)
    return F.concat(F.substring(n, 1, LABEL_HEAD), F.substring(n, -LABEL_TAIL, LABEL_TAIL))


def zfill3(s) -> Column:
    return F.lpad(_c(s), 3, "0")


def scene_document(folder, product, mtl, bands, accessories, left, bottom, right, top, width, height,
                   epsg) -> Column:
    """an EO3 dataset document for a landed scene folder (struct column).

    ``mtl`` is the ``extract_mtl`` struct, ``bands``/``accessories`` map names
    to paths. Cloud cover is given in percent and stored as a fraction; land
    cloud cover is kept in percent.
    """
    m = _c(mtl)
    path, row = zfill3(m["landsat_wrs_path"]), zfill3(m["landsat_wrs_row"])
    ring = geo.bbox_ring(left, bottom, right, top)
    transform = geo.grid_transform(left, bottom, right, top, width, height)
    props = F.struct(
        m["created"].alias("created"), m["datetime"].alias("datetime"),
        F.lit(docs.MTL_GENERAL["description"]).alias("description"),
        (m["eo_cloud_cover"].cast("double") / 100).alias("eo:cloud_cover"),
        m["eo_gsd"].alias("eo:gsd"), m["eo_instrument"].alias("eo:instrument"),
        F.replace(F.lower(m["eo_platform"]), F.lit("_"), F.lit("-")).alias("eo:platform"),
        m["eo_sun_azimuth"].cast("double").alias("eo:sun_azimuth"),
        m["eo_sun_elevation"].cast("double").alias("eo:sun_elevation"),
        m["landsat_cloud_cover_land"].cast("double").alias("landsat:cloud_cover_land"),
        m["landsat_collection_category"].alias("landsat:collection_category"),
        m["landsat_collection_number"].alias("landsat:collection_number"),
        m["landsat_correction"].alias("landsat:correction"),
        m["landsat_scene_id"].alias("landsat:scene_id"),
        path.alias("landsat:wrs_path"), row.alias("landsat:wrs_row"),
        m["landsat_wrs_type"].alias("landsat:wrs_type"),
        F.lit(docs.MTL_GENERAL["file_format"]).alias("odc:file_format"),
        m["created"].alias("odc:processing_datetime"), _c(product).alias("odc:product"),
        F.concat(path, row).alias("odc:region_code"), _c(epsg).alias("proj:epsg"),
        F.array(_c(width), _c(height)).alias("proj:shape"), transform.alias("proj:transform"),
        m["sci_doi"].alias("sci:doi"))
    return F.struct(
        F.lit(docs.MTL_GENERAL["schema"]).alias("$schema"),
        stable_uuid(folder).alias("id"),
        scene_label(text.basename(folder)).alias("label"),
        F.struct(_c(product).alias("name")).alias("product"),
        F.concat(F.lit("epsg:"), _c(epsg).cast("string")).alias("crs"),
        F.struct(F.lit(docs.MTL_GENERAL["geometry_type"]).alias("type"), F.array(ring).alias("coordinates"))
         .alias("geometry"),
        F.struct(F.struct(F.array(_c(width), _c(height)).alias("shape"), transform.alias("transform"))
                 .alias("default")).alias("grids"),
        props.alias("properties"),
        F.transform_values(_c(bands), lambda k, v: F.struct(v.alias("path"))).alias("measurements"),
        F.transform_values(_c(accessories), lambda k, v: F.struct(v.alias("path"))).alias("accessories"),
        F.create_map().cast("map<string,array<string>>").alias("lineage"))


def accessory_key(file_name) -> Column:
    """accessory key = lower-case text after the last '_' of the file name."""
    return F.lower(F.substring_index(_c(file_name), "_", -1))


def upsert_outcomes(incoming: DataFrame, index: DataFrame, key: str = "id",
                    valid: Column | None = None, error: Column | None = None) -> DataFrame:
    """K1: per incoming document: ``already`` (key in the index), ``failed`` (invalid)
    or ``added``. A left join on the key; rerunning gives no new ``added``. Of several
    incoming documents with one key the first (by all columns) counts; the others are
    ``already`` there."""
    # Only index keys that occur in the batch matter.
    batch_keys = incoming.select(key).distinct()
    present = (index.select(key).join(batch_keys, key, "left_semi").distinct()
                    .withColumn("_present", F.lit(True)))
    ok = valid if valid is not None else F.lit(True)
    order = [F.xxhash64(*[F.col(c) for c in incoming.columns]), F.struct(*[F.col(c).cast("string") for c in incoming.columns])]
    first = F.row_number().over(Window.partitionBy(key, ok).orderBy(*order)) > 1
    j = incoming.withColumn("_again", first & ok).join(present, key, "left")
    status = (F.when(F.col("_present") | F.col("_again"), F.lit("already"))
               .when(~ok, F.lit("failed"))
               .otherwise(F.lit("added")))
    err = F.when(status == "failed", error if error is not None else F.lit("invalid document"))
    return j.withColumn("status", status).withColumn("error", err).drop("_present", "_again")


def append_added(outcomes: DataFrame, index_path: str) -> None:
    """K1 sink: append the ``added`` documents to the index table (Parquet)."""
    outcomes.filter(F.col("status") == "added").drop("status", "error").write.mode("append").parquet(index_path)


def product_upsert(existing: DataFrame, incoming: DataFrame, update: bool = False,
                   name: str = "name") -> tuple[DataFrame, DataFrame]:
    """K2: add products not yet defined; replace defined ones when ``update``, else
    report an error. Returns (outcomes, resulting table)."""
    have = existing.select(name).withColumn("_have", F.lit(True))
    j = incoming.join(have, name, "left")
    status = F.when(F.col("_have").isNull(), F.lit("added")).when(F.lit(update), F.lit("updated")) \
              .otherwise(F.lit("failed"))
    outcomes = j.select(name, status.alias("status"),
                        F.when(status == "failed", F.lit("product already exists")).alias("error"))
    keep_new = j.filter(status != "failed").drop("_have")
    kept_old = existing.join(keep_new.select(name), name, "left_anti")
    return outcomes, kept_old.unionByName(keep_new, allowMissingColumns=True)


def update_products(table: VersionedTable, incoming: DataFrame, update: bool = False, name: str = "name") -> DataFrame:
    """K2 on a stored table: the outcomes of ``product_upsert``, and a new version with the
    accepted definitions. Only partitions that change are written; the old version stays
    readable."""
    incoming = cut_lineage(incoming)
    # The outcomes are those against the version before the merge.
    outcomes = cut_lineage(product_upsert(table.read(), incoming, update, name)[0])
    table.merge(incoming.join(outcomes.filter("status <> 'failed'").select(name), name, "left_semi"), name)
    return outcomes


def write_documents(doc_df: DataFrame, path: str, doc: str = "doc", partition_cols=("product",),
                    yaml_stream: bool = False, max_docs_per_file: int = 10000) -> None:
    """K3: documents as JSON text (JSON is valid YAML), stale output replaced.

    Default: one document per line. ``yaml_stream`` writes each file as a
    multi-document YAML stream (``---`` before every document). Files hold
    at most ``max_docs_per_file`` documents, so any reader's per-file work is
    bounded.
    """
    body = docs.to_iso_json(F.col(doc))
    if yaml_stream:
        body = F.concat(F.lit("---\n"), body)
    out = doc_df.select(*partition_cols, body.alias("value"))
    (out.write.mode("overwrite").option("maxRecordsPerFile", max_docs_per_file)
        .partitionBy(*partition_cols).text(path))


def publish_path(dest: str, product, scene) -> Column:
    """K7: destination folder of a scene, ``dest/product/scene``."""
    return F.concat_ws("/", F.lit(dest), _c(product), _c(scene))


def unique_names(df: DataFrame, source, name, order_cols, out: str = "unique_name") -> DataFrame:
    """``source - name`` keys made unique with `` (2)``, `` (3)`` ... in order.

    The rank within each key comes from the parallel consecutive numbering,
    so a very common key is still ranked across many tasks.
    """
    base = F.concat(_c(source).cast("string"), F.lit(" - "), _c(name))
    b = df.withColumn("_base", base)
    r = consecutive_index(b, list(order_cols), "_rank", partition_cols=["_base"])
    return (r.withColumn(out, F.when(F.col("_rank") == 0, F.col("_base"))
                               .otherwise(F.concat(F.col("_base"), F.lit(" ("), (F.col("_rank") + 1).cast("string"),
                                                   F.lit(")"))))
             .drop("_base", "_rank"))


def lookup_first(requests: DataFrame, catalogue: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """First catalogue entry (by ``order``) for each requested key; none -> error row.

    The first match is a ``min_by`` aggregate (partial per task), not a
    ranked window over the matches.
    """
    firsts = catalogue.groupBy(key).agg(F.min_by(value, order).alias(value))
    j = requests.join(firsts, key, "left")
    return j.withColumn("error", F.when(F.col(value).isNull(), F.concat(F.lit("no document named "), F.col(key))))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Union of product sources in order, tagged with ``source_pos``; empty -> error."""
    if not frames:
        raise ValueError("no product definitions found")
    tagged = [f.withColumn("source_pos", F.lit(i)) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
