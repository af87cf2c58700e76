"""Landed files: listings, YAML/JSON documents, sidecar XML, product CSVs, GeoJSON, STAC items.

Remote catalogues and object stores are out of scope: these readers take
files already landed on shared storage. Each file is one task's input (no
driver-side reads); per-file parsing that Spark cannot express (multi-document
YAML) runs in ``mapInArrow`` over the file contents.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

# Column pairs accepted in a product list CSV, in preference order.
CSV_COLUMN_PAIRS = [("product", "definition"), ("product_name", "product_url"),
                    ("product", "product_url"), ("name", "url")]


def list_files(spark: SparkSession, root: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """``(path, length, modificationTime)`` of the files under ``root``.

    The file contents are never read (the content column is pruned).
    ``glob`` is matched on the path relative to ``root`` (``*`` spans '/'),
    after the listing has been restricted to the fixed prefix of the glob.
    """
    prefix = glob.split("*")[0] if glob else ""
    base = root.rstrip("/") + ("/" + prefix.rsplit("/", 1)[0] if "/" in prefix else "")
    r = (spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(base)
              .select("path", "length", "modificationTime"))
    r = r.withColumn("rel_path", F.regexp_extract("path", _root_pattern(root) + "(.*)$", 1))
    if glob:
        r = r.filter(text.matches_glob("rel_path", glob))
    return r


def _root_pattern(root: str) -> str:
    # A path without a host is listed with one slash after its scheme, however it was given.
    plain = re.sub(r"^\w+:(/|///)(?!/)", "/", root.rstrip("/"))
    return re.escape(plain) + "/"


def explicit_list(spark: SparkSession, names: str) -> DataFrame:
    """A comma-separated list given by the user overrides the listing."""
    return spark.createDataFrame([(names,)], "s string").select(
        F.explode(F.split("s", ",")).alias("path")).select(F.trim("path").alias("path")).filter("path <> ''")


_DOC_SCHEMA = T.StructType([T.StructField("path", T.StringType()), T.StructField("doc_pos", T.IntegerType()),
                            T.StructField("doc", T.StringType()), T.StructField("error", T.StringType())])


ROWS_OUT = 1000  # documents handed on at a time
_PLAIN_FLOAT = re.compile(r"-?[0-9]+\.[0-9]+(?:[eE][-+][0-9]+)?")


def _loader():
    import yaml
    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)  # the same rules, in C where it is built


def _as_yaml_float(token: str):
    """A JSON number with a fraction or exponent, as YAML reads it (``1e5`` is text there)."""
    return float(token) if _PLAIN_FLOAT.fullmatch(token) else token


def _json_object(line: str):
    """A line's document where JSON and YAML read the same (printable ASCII, no escapes,
    short keys), else None."""
    if not (line.isascii() and line.isprintable()) or "\\" in line:
        return None
    try:
        doc = json.loads(line, parse_float=_as_yaml_float, parse_constant=str,
                         object_hook=_short_keys if len(line) > 1000 else None)
    except (ValueError, RecursionError):
        return None
    return doc if isinstance(doc, dict) else None


def _short_keys(found: dict) -> dict:
    if any(len(k) > 500 for k in found):
        raise ValueError("YAML does not read keys that long")
    return found


def _line_documents(text: str):
    """The documents of a stream of one-line mappings, each after a line ``---`` (before the
    first it may be missing); ValueError where the text is no such stream."""
    import yaml

    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    if lines and lines[0] != "---":
        lines.insert(0, "---")
    if len(lines) % 2 or any(x != "---" for x in lines[::2]) or not all(x.startswith("{") for x in lines[1::2]):
        raise ValueError("other text between the documents")
    for line in lines[1::2]:
        doc = _json_object(line)
        if doc is not None:
            yield doc
        else:
            yield from yaml.load_all(line, Loader=_loader())


def _mappings(found) -> tuple[list, str | None]:
    """(JSON texts of the mappings of a stream, error of the first that has none)."""
    texts: list = []
    failed = None
    for d in found:
        if failed is None and isinstance(d, dict):  # non-mapping documents are dropped
            try:
                texts.append(json.dumps(d, default=str))
            except Exception as e:  # noqa: BLE001 - those before it stay
                failed = f"{type(e).__name__}: {e}"
    return texts, failed


def _parse_stream(content: bytes) -> tuple[list, str | None]:
    """(JSON text of each mapping document of a file, error). One document at a time is
    an object; a file that cannot be read to its end has no documents."""
    import yaml

    try:
        text = content.decode("utf-8")
        try:
            return _mappings(_line_documents(text))
        except Exception:  # noqa: BLE001 - a stream of another form, or an error that YAML words
            return _mappings(yaml.load_all(text, Loader=_loader()))
    except Exception as e:  # noqa: BLE001 - a bad file becomes an error row
        return [], f"{type(e).__name__}: {e}"


def _parse_yaml_files(batches):
    """Files one by one, their documents ``ROWS_OUT`` at a time: what a task holds is
    bounded by a file, not by how many files it has."""
    import pyarrow as pa

    schema = pa.schema([("path", pa.string()), ("doc_pos", pa.int32()), ("doc", pa.string()), ("error", pa.string())])
    for b in batches:
        for path, content in zip(b.column(0), b.column(1)):
            path = path.as_py()
            texts, error = _parse_stream(content.as_py())
            for i in range(0, len(texts), ROWS_OUT):
                part = texts[i:i + ROWS_OUT]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(range(i, i + len(part)), pa.int32()),
                                                  pa.array(part, pa.string()), pa.nulls(len(part), pa.string())], schema=schema)
            if error is not None:
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((path, None, None, error), schema)], schema=schema)


def read_documents(spark: SparkSession, path: str, glob: str = "*.y*ml") -> DataFrame:
    """Every mapping document of every (multi-document) YAML or JSON file,
    as JSON text with its position; unreadable files give an error row."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
                  .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    return files.mapInArrow(_parse_yaml_files, _DOC_SCHEMA)


def read_json_documents(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """JSON documents, one a line, read and checked in the JVM, in the columns of
    ``read_documents``; a line that is no JSON object gives an error row. Positions are
    not known (a large file is read by several tasks)."""
    lines = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true").text(path)
             .select(F.input_file_name().alias("path"), F.col("value").alias("doc")).filter(F.trim("doc") != ""))
    bad = F.schema_of_variant(F.try_parse_json("doc"))
    bad = F.when(bad.isNull(), F.lit("not a JSON document")).when(~bad.startswith("OBJECT"), F.lit("not an object"))
    return lines.select("path", F.lit(None).cast("int").alias("doc_pos"), F.when(bad.isNull(), F.col("doc")).alias("doc"),
                        bad.alias("error"))


def read_mixed(spark: SparkSession, yaml_path: str | None = None, json_path: str | None = None, yaml_glob: str = "*.y*ml",
               json_glob: str = "*.json") -> DataFrame:
    """Documents of any kind as VARIANT: (path, doc_pos, v, kind, error)."""
    from ..functions.mixed import kind_of

    parts = ([read_documents(spark, yaml_path, yaml_glob)] if yaml_path else []) + (
        [read_json_documents(spark, json_path, json_glob)] if json_path else [])
    if not parts:
        raise ValueError("no folder of documents given")
    docs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    docs = docs.select("path", "doc_pos", F.try_parse_json("doc").alias("v"), "error")
    return docs.withColumn("kind", F.when(F.col("error").isNull(), kind_of(F.col("v"))))


def product_index(docs: DataFrame) -> DataFrame:
    """Product definitions from documents: name from ``metadata.product.name`` or
    ``name``; nameless documents skipped; ordered by file name then position."""
    name = F.coalesce(F.get_json_object("doc", "$.metadata.product.name"), F.get_json_object("doc", "$.name"))
    return (docs.filter(F.col("error").isNull()).withColumn("name", name).filter(F.col("name").isNotNull())
                .withColumn("file", text.basename("path")))


def read_mtl(spark: SparkSession, root: str, suffix: str = "_MTL.xml") -> DataFrame:
    """The sidecar XML of every folder that holds files: exactly one is expected
    (none -> 'not found', several -> an error), it must start with '<' and be closed by
    its first element. Only files named like a sidecar are opened; the folders come from
    the listing alone."""
    folders = list_files(spark, root, "**").select(text.dirname("path").alias("folder")).distinct()
    raw = (spark.read.option("wholetext", "true").option("recursiveFileLookup", "true")
                .option("pathGlobFilter", f"*{suffix}").text(root)
                .select(F.input_file_name().alias("path"), F.col("value").alias("xml")))
    # The two readers write a local path with one slash or three.
    plain = lambda c: F.regexp_replace(c, r"^(\w+:)/+", "$1/")
    folders = folders.select(plain("folder").alias("folder")).distinct()
    raw = raw.withColumn("folder", text.dirname(plain("path")))
    per = raw.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min_by("xml", "path").alias("xml"),
                                    F.min("path").alias("path"))
    per = folders.join(per, "folder", "left")
    element = F.regexp_extract("xml", r"<([A-Za-z_][\w.-]*)", 1)
    return per.select("folder", "path", F.when(F.col("n") == 1, F.col("xml")).alias("xml"),
                      F.when(F.col("n").isNull(), F.lit("not found"))
                       .when(F.col("n") > 1, F.lit("several sidecar files"))
                       .when(~F.ltrim(F.col("xml")).startswith("<"), F.lit("not an XML document"))
                       .when(~F.rtrim(F.col("xml")).endswith(F.concat(F.lit("</"), element, F.lit(">"))),
                             F.lit("broken XML document"))
                       .alias("error"))


def read_product_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(product, url)`` from a product list CSV; the first known column pair is
    used; for a repeated product the last row wins."""
    df = spark.read.option("header", "true").csv(path)
    cols = set(df.columns)
    pair = next(((a, b) for a, b in CSV_COLUMN_PAIRS if a in cols and b in cols), None)
    if pair is None:
        raise ValueError(f"CSV needs one of the column pairs {CSV_COLUMN_PAIRS}, found {sorted(cols)}")
    a, b = pair
    rows = df.select(F.col(a).alias("product"), F.col(b).alias("url"),
                     F.monotonically_increasing_id().alias("_pos"))
    return rows.groupBy("product").agg(F.max_by("url", "_pos").alias("url"))


def read_geojson(spark: SparkSession, paths) -> DataFrame:
    """Features of one or several GeoJSON files: ring coordinates, bbox and
    properties (as JSON text), unioned over the paths."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    raw = spark.read.option("multiLine", "true").json(paths)
    feats = raw.select(F.input_file_name().alias("source"), F.posexplode("features").alias("pos", "f"))
    ring = F.col("f.geometry.coordinates")[0]
    xs = F.transform(ring, lambda p: p[0])
    ys = F.transform(ring, lambda p: p[1])
    return feats.select("source", "pos", ring.alias("ring"), F.array_min(xs).alias("minx"),
                        F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"),
                        F.to_json("f.properties").alias("properties"))


STAC_ITEM_SCHEMA = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("collection", T.StringType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("properties", T.StructType([T.StructField("datetime", T.StringType()),
                                              T.StructField("platform", T.StringType())])),
    T.StructField("assets", T.MapType(T.StringType(), T.StructType([T.StructField("href", T.StringType())])))])


def read_stac_items(spark: SparkSession, path: str) -> DataFrame:
    """S3: landed STAC items (one JSON object per line) flattened for search."""
    items = spark.read.schema(STAC_ITEM_SCHEMA).json(path)
    return items.select(F.col("id").alias("item_id"), "collection",
                        F.to_timestamp("properties.datetime").cast("timestamp_ntz").alias("datetime"),
                        F.col("properties.platform").alias("platform"),
                        F.col("bbox")[0].alias("minx"), F.col("bbox")[1].alias("miny"),
                        F.col("bbox")[2].alias("maxx"), F.col("bbox")[3].alias("maxy"), "assets")


def stac_item_assets(items: DataFrame) -> DataFrame:
    """One row per (item, asset key, href)."""
    return items.select(F.col("item_id").alias("scene_id"), F.explode("assets").alias("asset_key", "a")).select(
        "scene_id", "asset_key", F.col("a.href").alias("url"))
