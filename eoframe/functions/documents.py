"""Document functions: sidecar XML extraction, templates, nested-field helpers.

Column expressions over one document per row (maps and structs by higher-order functions);
sidecar XML is read by one pass over each document of an Arrow batch.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..session import spread

# Sidecar (MTL) variables as GROUP/ELEMENT paths, the general
# document settings, and the band -> file-name suffix table of Landsat 8/9
# Collection 2 Level-2 scenes. "A + B" joins a date and a time.
MTL_GENERAL = {
    "mtl_format": ".xml",
    "schema": "https://schemas.opendatacube.org/dataset",
    "geometry_type": "Polygon",
    "description": "Landsat Collection 2 Level-2",
    "file_format": "GeoTIFF",
}
MTL_VARIABLES = {
    "created": "LEVEL2_PROCESSING_RECORD/DATE_PRODUCT_GENERATED",
    "datetime": "IMAGE_ATTRIBUTES/DATE_ACQUIRED + IMAGE_ATTRIBUTES/SCENE_CENTER_TIME",
    "eo_cloud_cover": "IMAGE_ATTRIBUTES/CLOUD_COVER",
    "landsat_cloud_cover_land": "IMAGE_ATTRIBUTES/CLOUD_COVER_LAND",
    "eo_gsd": "PROJECTION_ATTRIBUTES/GRID_CELL_SIZE_REFLECTIVE",
    "eo_instrument": "IMAGE_ATTRIBUTES/SENSOR_ID",
    "eo_platform": "IMAGE_ATTRIBUTES/SPACECRAFT_ID",
    "eo_sun_azimuth": "IMAGE_ATTRIBUTES/SUN_AZIMUTH",
    "eo_sun_elevation": "IMAGE_ATTRIBUTES/SUN_ELEVATION",
    "landsat_collection_category": "PRODUCT_CONTENTS/COLLECTION_CATEGORY",
    "landsat_collection_number": "PRODUCT_CONTENTS/COLLECTION_NUMBER",
    "landsat_correction": "PRODUCT_CONTENTS/PROCESSING_LEVEL",
    "landsat_scene_id": "LEVEL1_PROCESSING_RECORD/LANDSAT_SCENE_ID",
    "landsat_wrs_path": "IMAGE_ATTRIBUTES/WRS_PATH",
    "landsat_wrs_row": "IMAGE_ATTRIBUTES/WRS_ROW",
    "landsat_wrs_type": "IMAGE_ATTRIBUTES/WRS_TYPE",
    "sci_doi": "PRODUCT_CONTENTS/DIGITAL_OBJECT_IDENTIFIER",
}
MTL_BAND_SUFFIXES = {
    "coastal": "_SR_B1", "blue": "_SR_B2", "green": "_SR_B3", "red": "_SR_B4", "nir08": "_SR_B5",
    "swir16": "_SR_B6", "swir22": "_SR_B7", "qa_pixel": "_QA_PIXEL", "qa_radsat": "_QA_RADSAT",
    "qa_aerosol": "_QA_AEROSOL", "qa": "_ST_QA", "drad": "_ST_DRAD", "emis": "_ST_EMIS",
    "emsd": "_ST_EMSD", "lwir11": "_ST_B10", "trad": "_ST_TRAD", "urad": "_ST_URAD",
    "atran": "_ST_ATRAN", "cdist": "_ST_CDIST",
}
# File-name elements of PRODUCT_CONTENTS scanned for band files.
MTL_FILE_ELEMENTS = ["FILE_NAME_BAND_1", "FILE_NAME_BAND_2", "FILE_NAME_BAND_3", "FILE_NAME_BAND_4",
                     "FILE_NAME_BAND_5", "FILE_NAME_BAND_6", "FILE_NAME_BAND_7", "FILE_NAME_BAND_ST_B10",
                     "FILE_NAME_QUALITY_L1_PIXEL", "FILE_NAME_QUALITY_L1_RADIOMETRIC_SATURATION",
                     "FILE_NAME_QUALITY_L2_AEROSOL", "FILE_NAME_QUALITY_L2_SURFACE_TEMPERATURE",
                     "FILE_NAME_ATMOSPHERIC_TRANSMITTANCE", "FILE_NAME_CLOUD_DISTANCE",
                     "FILE_NAME_DOWNWELL_RADIANCE", "FILE_NAME_UPWELL_RADIANCE", "FILE_NAME_THERMAL_RADIANCE",
                     "FILE_NAME_EMISSIVITY", "FILE_NAME_EMISSIVITY_STDEV"]
EO3_SCHEMA_URL = "https://schemas.opendatacube.org/dataset"
PLACEHOLDER_PATTERN = r"<(.+?)>"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mtl_schema(groups: dict[str, list[str]]) -> str:
    """DDL of one struct per group, string leaves."""
    return ", ".join(f"{g}: struct<{', '.join(f'{e}: string' for e in es)}>" for g, es in groups.items())


def parse_xml_paths(texts: list, groups: dict[str, list[str]]) -> tuple[dict, list]:
    """One pass over each document: ({(group, element): texts}, errors).

    The value of GROUP/ELEMENT is the own text of the first ELEMENT anywhere inside the
    first GROUP anywhere in the document. A document that cannot be read to its end has
    an error and no values.
    """
    from xml.etree import ElementTree

    values = {(g, e): [] for g, es in groups.items() for e in es}
    errors = []
    for text in texts:
        found: dict = {}
        error = None
        body = "" if text is None else text.strip()
        if not body:
            error = "no document"
        elif not body.startswith("<"):
            error = "not an XML document"
        else:
            try:
                root = ElementTree.fromstring(body)
                for g in groups:
                    below = (e for e in root.iter(g) if e is not root)
                    if (top := next(below, None)) is not None:
                        inside: dict = {}
                        for e in top.iter():
                            if e is not top:
                                inside.setdefault(e.tag, e)
                        found[g] = inside
            except ElementTree.ParseError as e:
                error = f"broken XML document: {e.msg}"
        errors.append(error)
        for (g, e), column in values.items():
            at = found.get(g, {}).get(e)
            column.append(None if at is None else at.text)
    return values, errors


def mtl_groups(variables: dict = MTL_VARIABLES, files: bool = True) -> dict[str, list[str]]:
    """{group: its elements} that the variables and (``files``) the band files need."""
    groups: dict[str, list[str]] = {}
    for path in variables.values():
        for part in path.split("+"):
            g, e = part.strip().split("/")
            groups.setdefault(g, [])
            if e not in groups[g]:
                groups[g].append(e)
    if files:
        content = groups.setdefault("PRODUCT_CONTENTS", [])
        content += [e for e in MTL_FILE_ELEMENTS if e not in content]
    return groups


def band_files(elements: list, band_suffixes: dict = MTL_BAND_SUFFIXES) -> list:
    """per document its [(band, file)], from columns of file names (spaces around them
    dropped): for each band the first that ends with ``suffix + '.TIF'``."""
    ends: dict[str, list[int]] = {}
    for i, suffix in enumerate(band_suffixes.values()):
        ends.setdefault(suffix + ".TIF", []).append(i)
    sizes, bands, out = {len(e) for e in ends}, list(band_suffixes), []
    for names in zip(*elements):
        found: dict[int, str] = {}
        for name in names:
            if name is not None:
                name = name.strip(" ")
                for size in sizes:
                    for i in ends.get(name[-size:], ()):
                        found.setdefault(i, name)
        out.append([(bands[i], found[i]) for i in sorted(found)])
    return out


def extract_mtl(df, xml: str = "xml", out: str = "m", variables: dict = MTL_VARIABLES,
                band_suffixes: dict = MTL_BAND_SUFFIXES, error: str | None = None, deal: bool = True):
    """F22 on a DataFrame: one pass over each document of ``xml``, then the variables struct
    ``out``; ``error`` names a column that says why a document has none. The XML itself is
    dropped. ``deal`` spreads a small input over all cores; counting its parts runs the
    shuffles of ``df``, so what comes out of a join is better left as it is."""
    groups, leaves = mtl_groups(variables), mtl_groups(variables, files=False)
    kept = [c for c in df.columns if c != xml]
    at = df.columns.index(xml)
    taken = {c.lower() for c in df.columns}
    if {"_mtl", "_mtl_bands", "_mtl_error"} & taken:
        raise ValueError("columns _mtl, _mtl_bands and _mtl_error are the operator's own")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            values, errors = parse_xml_paths(b.column(at).to_pylist(), groups)
            parts = [pa.StructArray.from_arrays([pa.array(values[g, e], pa.string()) for e in es], es) for g, es in leaves.items()]
            bands = band_files([values["PRODUCT_CONTENTS", e] for e in MTL_FILE_ELEMENTS], band_suffixes)
            yield pa.RecordBatch.from_arrays(
                [*[b.column(i) for i in range(b.num_columns) if i != at], pa.StructArray.from_arrays(parts, list(leaves)),
                 pa.array(bands, pa.map_(pa.string(), pa.string())), pa.array(errors, pa.string())],
                [*kept, "_mtl", "_mtl_bands", "_mtl_error"])
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != xml],
                        f"_mtl struct<{mtl_schema(leaves)}>", "_mtl_bands map<string,string>", "_mtl_error string"])
    parsed = (spread(df) if deal else df).mapInArrow(run, schema).withColumn(out, mtl_variables("_mtl", "_mtl_bands", variables))
    if error is not None:
        parsed = parsed.withColumn(error, F.col("_mtl_error"))
    return parsed.drop("_mtl", "_mtl_bands", "_mtl_error")


def mtl_variables(parsed, bands, variables: dict = MTL_VARIABLES) -> Column:
    """configured variables of a parsed sidecar as a struct (missing -> null), with its
    map of band files.

    ``A + B`` paths give ``A 'T' B`` with B's trailing Z removed and one Z
    appended, null unless both parts exist.
    """
    m = _c(parsed)

    def leaf(path):
        g, e = path.strip().split("/")
        return F.nullif(F.trim(m[g][e]), F.lit(""))

    fields = []
    for name, path in variables.items():
        if "+" in path:
            a, b = [leaf(p) for p in path.split("+")]
            fields.append(F.when(a.isNotNull() & b.isNotNull(),
                                 F.concat(a, F.lit("T"), F.regexp_replace(b, "Z+$", ""), F.lit("Z"))).alias(name))
        else:
            fields.append(leaf(path).alias(name))
    return F.struct(*fields, _c(bands).alias("bands"))


def placeholders(template) -> Column:
    """U4 helper: distinct ``<name>`` placeholders of a template text, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(_c(template), F.lit(PLACEHOLDER_PATTERN), 1)))


def strip_comments(template) -> Column:
    """drop inline comments (whitespace before '#', to end of line)."""
    return F.regexp_replace(_c(template), r"\s*#[^\n]*", "")


def missing_placeholders(template, values) -> Column:
    """U4: placeholders with no value, all of them at once, sorted."""
    return F.array_sort(F.array_except(placeholders(strip_comments(template)), F.map_keys(_c(values))))


def fill_template(template, values) -> Column:
    """replace every ``<key>`` by its value (scalar form); comments stripped.

    Returns null when a placeholder has no value (see ``missing_placeholders``).
    """
    t = strip_comments(template)
    filled = F.aggregate(F.map_entries(_c(values)), t,
                         lambda acc, e: F.replace(acc, F.concat(F.lit("<"), e["key"], F.lit(">")), e["value"]))
    return F.when(F.size(missing_placeholders(template, values)) == 0, filled)


def is_eo3(schema_url) -> Column:
    """document kind by its schema URL."""
    return F.coalesce(_c(schema_url) == F.lit(EO3_SCHEMA_URL), F.lit(False))


def file_offsets(measurements, accessories) -> Column:
    """every file offset of a document: band paths (bands without a path dropped)
    then accessories; later keys win."""
    bands = F.transform_values(F.map_filter(_c(measurements), lambda k, v: v["path"].isNotNull()),
                               lambda k, v: v["path"])
    acc = F.transform_values(F.coalesce(_c(accessories), F.create_map().cast("map<string,struct<path:string>>")),
                             lambda k, v: v["path"])
    return F.map_concat(bands, acc)


def lineage_ids(source_datasets) -> Column:
    """lineage ``classifier -> source document`` flattened to ``classifier -> [id]``."""
    return F.transform_values(_c(source_datasets), lambda k, v: F.array(v["id"]))


def strip_prefix_keys(m, prefix: str, case_sensitive: bool = True) -> Column:
    """P20: keep map entries whose key starts with ``prefix``, with the prefix removed."""
    mm = _c(m)
    test = (lambda k, v: k.startswith(prefix)) if case_sensitive else \
        (lambda k, v: F.lower(k).startswith(prefix.lower()))
    return F.transform_keys(F.map_filter(mm, test), lambda k, v: k.substr(F.lit(len(prefix) + 1), F.length(k)))


def to_iso_json(struct_col, fmt: str = "yyyy-MM-dd'T'HH:mm:ss") -> Column:
    """a struct as JSON with every timestamp written as ISO text."""
    return F.to_json(_c(struct_col), {"timestampFormat": fmt, "timestampNTZFormat": fmt})
