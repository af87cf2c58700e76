"""Documents of any shape in one column (VARIANT): what kind each is, and its facts.

A catalogue folder holds product definitions, dataset documents of the current and of the
older layout, and items of remote catalogues. Nothing is known of a document's schema
before it is read, so every fact is looked up in the row by its own kind's paths.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .documents import EO3_SCHEMA_URL, is_eo3, strip_prefix_keys
from .temporal import creation_time, representative_time

KINDS = ("product", "eo3", "item", "legacy")


def text_at(v: Column, path: str) -> Column:
    """Text of a scalar at a path, null where there is none."""
    return F.try_variant_get(v, path, "string")


def has(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant").isNotNull()


def map_at(v: Column, path: str, value: str = "variant") -> Column:
    """The object at a path as a map (empty where there is none)."""
    kind = f"map<string,{value}>"
    return F.coalesce(F.try_variant_get(v, path, kind), F.create_map().cast(kind))


def first_text(v: Column, *paths: str) -> Column:
    return F.coalesce(*[text_at(v, p) for p in paths])


def kind_of(v: Column) -> Column:
    """'eo3' by its schema address, 'item' for a feature of a remote catalogue,
    'product' for a definition, 'legacy' for the older layout, else 'unknown'."""
    schema = text_at(v, "$['$schema']")
    return (F.when(is_eo3(schema), F.lit("eo3"))
             .when((text_at(v, "$.type") == "Feature") & has(v, "$.stac_version"), F.lit("item"))
             .when(has(v, "$.metadata_type"), F.lit("product"))
             .when(has(v, "$.extent") | has(v, "$.image"), F.lit("legacy"))
             .otherwise(F.lit("unknown")))


def moment(text: Column) -> Column:
    """ISO text as a wall-clock time in UTC; a time without an offset is UTC, text that is
    no time is null."""
    stamp = F.try_to_timestamp(F.when(text.rlike(r"(Z|[+-]\d\d:?\d\d)$"), text).otherwise(F.concat(text, F.lit("Z"))))
    return F.to_utc_timestamp(stamp, F.current_timezone()).cast("timestamp_ntz")


def center_time(v: Column, kind: Column) -> Column:
    """the time given; else the start of the range; documents of the older layout have
    a range only, and get its middle."""
    given = moment(F.when(kind != "legacy", text_at(v, "$.properties.datetime")))
    start = moment(F.when(kind == "legacy", text_at(v, "$.extent.from_dt"))
                   .otherwise(first_text(v, "$.properties['dtr:start_datetime']", "$.properties.start_datetime")))
    end = moment(F.when(kind == "legacy", text_at(v, "$.extent.to_dt"))
                 .otherwise(first_text(v, "$.properties['dtr:end_datetime']", "$.properties.end_datetime")))
    return representative_time(given, start, end, range_only=kind == "legacy")


def created_time(v: Column, indexed) -> Column:
    """the processing time, else a creation time that parses, else the index time."""
    return creation_time(moment(first_text(v, "$.properties['odc:processing_datetime']", "$.properties.created")),
                         moment(text_at(v, "$.creation_dt")), indexed)


def license_of(v: Column, default: str | None = None) -> Column:
    """the metadata's license field, else the definition's, else the default. A field
    that is there with a null counts as given."""
    return (F.when(F.array_contains(F.map_keys(map_at(v, "$.metadata")), "license"), text_at(v, "$.metadata.license"))
             .when(F.array_contains(F.map_keys(map_at(v, "$")), "license"), text_at(v, "$.license"))
             .otherwise(F.lit(default).cast("string")))


def document_id(v: Column, kind: Column) -> Column:
    """Products by name (``metadata.product.name`` before ``name``), the others by id."""
    return F.when(kind == "product", first_text(v, "$.metadata.product.name", "$.name")).otherwise(text_at(v, "$.id"))


def product_of(v: Column, kind: Column) -> Column:
    return (F.when(kind == "item", text_at(v, "$.collection")).when(kind == "legacy", text_at(v, "$.product_type"))
             .when(kind == "eo3", text_at(v, "$.product.name")).otherwise(document_id(v, kind)))


def file_paths(v: Column, kind: Column) -> Column:
    """{name: path} of a document's files, bands without a path left out, accessories
    over bands of the same name."""
    def paths(at, leaf):
        found = F.transform_values(map_at(v, at), lambda k, x: F.try_variant_get(x, leaf, "string"))
        return F.map_filter(found, lambda k, p: p.isNotNull())
    bands, extra = paths("$.measurements", "$.path"), paths("$.accessories", "$.path")
    both = F.map_concat(F.map_filter(bands, lambda k, p: ~F.array_contains(F.map_keys(extra), k)), extra)
    return (F.when(kind == "eo3", both).when(kind == "item", paths("$.assets", "$.href"))
             .otherwise(paths("$.image.bands", "$.path")))


def source_ids(v: Column, kind: Column) -> Column:
    """{classifier: [ids]}: lists of ids, or in the older layout whole documents."""
    nested = F.transform_values(map_at(v, "$.lineage.source_datasets"),
                                lambda k, d: F.array(F.try_variant_get(d, "$.id", "string")))
    return F.when(kind == "legacy", nested).otherwise(map_at(v, "$.lineage", "array<string>"))


def prefixed_properties(v: Column, prefix: str, case_sensitive: bool = True) -> Column:
    """P20: the properties whose name starts with a prefix, without it."""
    return strip_prefix_keys(map_at(v, "$.properties", "string"), prefix, case_sensitive)


__all__ = ["EO3_SCHEMA_URL", "KINDS", "center_time", "created_time", "document_id", "file_paths", "kind_of", "license_of",
           "moment", "prefixed_properties", "product_of", "source_ids"]
