"""Product definitions: the catalogue's table schemas.

A product is one row: name, description, license, metadata type, CRS and an
array of measurement structs (name, aliases, units, dtype, nodata, flags).
The catalogue is a small dimension table (one row per product, a few dozen
bands each); it is the one input every operator may broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Product definitions that results depend on (band names,
# aliases, dtypes, nodata values, flag bit layouts, class labels).
# ---------------------------------------------------------------------------

# (name, dtype, nodata, units, aliases)
_LS89_BANDS = [
    ("coastal", "uint16", 0, "1", ["SR_B1", "band_1", "coastal_aerosol"]),
    ("blue", "uint16", 0, "1", ["SR_B2", "band_2"]),
    ("green", "uint16", 0, "1", ["SR_B3", "band_3"]),
    ("red", "uint16", 0, "1", ["SR_B4", "band_4"]),
    ("nir08", "uint16", 0, "1", ["SR_B5", "band_5"]),
    ("swir16", "uint16", 0, "1", ["SR_B6", "band_6", "swir_1"]),
    ("swir22", "uint16", 0, "1", ["SR_B7", "band_7", "swir_2"]),
    ("qa_pixel", "uint16", 1, "bit_index", ["pixel_qa", "pq", "pixel_quality"]),
    ("qa_radsat", "uint16", 0, "bit_index", ["QA_RADSAT", "radsat", "radiometric_saturation"]),
    ("qa_aerosol", "uint8", 1, "bit_index", ["SR_QA_AEROSOL", "qa_aerosol", "aerosol_qa"]),
    ("qa", "int16", -9999, "kelvin", ["ST_QA", "surface_temperature_quality", "surface_temperature_uncertainty"]),
    ("drad", "int16", -9999, "watt/steradian/square_meter/micrometer", ["ST_DRAD", "downwell_radiance"]),
    ("emis", "int16", -9999, "1", ["ST_EMIS", "emissivity_coefficient"]),
    ("emsd", "int16", -9999, "1", ["ST_EMSD", "emissivity_standard_deviation"]),
    ("lwir11", "uint16", 0, "kelvin", ["ST_B10", "band_10", "st", "surface_temperature"]),
    ("trad", "int16", -9999, "watt/steradian/square_meter/micrometer", ["ST_TRAD", "thermal_radiance"]),
    ("urad", "int16", -9999, "watt/steradian/square_meter/micrometer", ["ST_URAD", "upwelled_radiance"]),
    ("atran", "int16", -9999, "1", ["ST_ATRAN", "atmospheric_transmittance"]),
    ("cdist", "int16", -9999, "Kilometer", ["ST_CDIST", "cloud_distance"]),
]

_LS457_BANDS = [
    ("blue", "uint16", 0, "1", ["SR_B1", "band_1"]),
    ("green", "uint16", 0, "1", ["SR_B2", "band_2"]),
    ("red", "uint16", 0, "1", ["SR_B3", "band_3"]),
    ("nir08", "uint16", 0, "1", ["SR_B4", "band_4", "nir"]),
    ("swir16", "uint16", 0, "1", ["SR_B5", "band_5", "swir_1"]),
    ("swir22", "uint16", 0, "1", ["SR_B7", "band_7", "swir_2"]),
    ("qa_pixel", "uint16", 1, "bit_index", ["QA_PIXEL", "pq", "pixel_quality"]),
    ("qa_radsat", "uint16", 0, "bit_index", ["QA_RADSAT", "radsat", "radiometric_saturation"]),
    ("atmos_opacity", "int16", -9999, "1", ["SR_ATMOS_OPACITY", "atmos_opacity"]),
    ("cloud_qa", "uint8", 0, "bit_index", ["SR_CLOUD_QA"]),
    ("qa", "int16", -9999, "kelvin", ["ST_QA", "surface_temperature_quality", "surface_temperature_uncertainty"]),
    ("drad", "int16", -9999, "watt/steradian/square_meter/micrometer", ["ST_DRAD", "downwell_radiance"]),
    ("emis", "int16", -9999, "1", ["ST_EMIS", "emissivity_coefficient"]),
    ("emsd", "int16", -9999, "1", ["ST_EMSD", "emissivity_standard_deviation"]),
    ("lwir", "uint16", 0, "kelvin", ["ST_B6", "band_6", "st", "surface_temperature"]),
    ("trad", "int16", -9999, "watt/steradian/square_meter/micrometer", ["ST_TRAD", "thermal_radiance"]),
    ("urad", "int16", -9999, "watt/steradian/square_meter/micrometer", ["ST_URAD", "upwelled_radiance"]),
    ("atran", "int16", -9999, "1", ["ST_ATRAN", "atmospheric_transmittance"]),
    ("cdist", "int16", -9999, "Kilometer", ["ST_CDIST", "cloud_distance"]),
]

_S2_BANDS = [
    ("B01", "uint16", 0, "1", ["band_01", "coastal_aerosol"]),
    ("B02", "uint16", 0, "1", ["band_02", "blue"]),
    ("B03", "uint16", 0, "1", ["band_03", "green"]),
    ("B04", "uint16", 0, "1", ["band_04", "red"]),
    ("B05", "uint16", 0, "1", ["band_05", "red_edge_1"]),
    ("B06", "uint16", 0, "1", ["band_06", "red_edge_2"]),
    ("B07", "uint16", 0, "1", ["band_07", "red_edge_3"]),
    ("B08", "uint16", 0, "1", ["band_08", "nir", "nir_1"]),
    ("B8A", "uint16", 0, "1", ["band_8a", "nir_narrow", "nir_2"]),
    ("B09", "uint16", 0, "1", ["band_09", "water_vapour"]),
    ("B11", "uint16", 0, "1", ["band_11", "swir_1", "swir_16"]),
    ("B12", "uint16", 0, "1", ["band_12", "swir_2", "swir_22"]),
    ("SCL", "uint8", 0, "1", ["mask", "qa"]),
    ("AOT", "uint16", 0, "1", ["aerosol_optical_thickness"]),
    ("WVP", "uint16", 0, "1", ["scene_average_water_vapour"]),
]

# Landsat Collection 2 QA_PIXEL bits: single-bit flags, then 2-bit confidences.
QA_PIXEL_BITS = {
    "nodata": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3,
    "cloud_shadow": 4, "snow": 5, "clear": 6, "water": 7,
}
QA_PIXEL_CONFIDENCE_BITS = {
    "cloud_confidence": (8, 9), "cloud_shadow_confidence": (10, 11),
    "snow_ice_confidence": (12, 13), "cirrus_confidence": (14, 15),
}
QA_PIXEL_CONFIDENCE_VALUES = {
    "cloud_confidence": {0: "none", 1: "low", 2: "medium", 3: "high"},
    "cloud_shadow_confidence": {0: "none", 1: "low", 2: "reserved", 3: "high"},
    "snow_ice_confidence": {0: "none", 1: "low", 2: "reserved", 3: "high"},
    "cirrus_confidence": {0: "none", 1: "low", 2: "reserved", 3: "high"},
}
QA_PIXEL_SINGLE_VALUES = {
    "nodata": {0: "false", 1: "true"},
    "dilated_cloud": {0: "not_dilated", 1: "dilated"},
    "cirrus": {0: "not_high_confidence", 1: "high_confidence"},
    "cloud": {0: "not_high_confidence", 1: "high_confidence"},
    "cloud_shadow": {0: "not_high_confidence", 1: "high_confidence"},
    "snow": {0: "not_high_confidence", 1: "high_confidence"},
    "clear": {0: "false", 1: "true"},
    "water": {0: "land_or_cloud", 1: "water"},
}

# Sentinel-2 scene classification (SCL) codes, labels of the product definition.
SCL_LABELS = {
    0: "no data", 1: "saturated or defective", 2: "dark area pixels",
    3: "cloud shadows", 4: "vegetation", 5: "bare soils", 6: "water",
    7: "unclassified", 8: "cloud medium probability",
    9: "cloud high probability", 10: "thin cirrus", 11: "snow or ice",
}

# Land-cover class legends: (value, (r, g, b), label).
WORLDCOVER_LEGEND = [
    (0, (255, 255, 255), "no data"),
    (10, (0, 100, 0), "tree cover"),
    (20, (255, 187, 34), "shrubland"),
    (30, (255, 255, 76), "grassland"),
    (40, (240, 150, 255), "cropland"),
    (50, (250, 0, 0), "built-up"),
    (60, (180, 180, 180), "bare/sparse vegetation"),
    (70, (240, 240, 240), "snow/ice"),
    (80, (0, 100, 200), "permanent water bodies"),
    (90, (0, 150, 160), "herbaceous wetland"),
    (95, (0, 207, 117), "mangroves"),
    (100, (250, 230, 160), "moss/lichen"),
]
LULC_LEGEND = [
    (0, (0, 0, 0), "no data"),
    (1, (65, 155, 223), "water"),
    (2, (57, 125, 73), "trees"),
    (4, (122, 135, 198), "flooded vegetation"),
    (5, (228, 150, 53), "crops"),
    (7, (196, 40, 27), "built area"),
    (8, (165, 155, 143), "bare ground"),
    (9, (168, 235, 255), "snow/ice"),
    (10, (97, 97, 97), "clouds"),
    (11, (227, 226, 195), "rangeland"),
]
LULC_LABELS = {
    0: "no data", 1: "water", 2: "trees", 3: "not used", 4: "flooded vegetation",
    5: "crops", 6: "not used", 7: "built area", 8: "bare ground", 9: "snow/ice",
    10: "clouds", 11: "rangeland",
}

# Product name -> (description, license, crs, bands)
PRODUCTS = {
    "ls89_c2l2_sp": ("USGS Landsat 8 and 9 Collection 2 Level-2 Science Products, consisting of atmospherically "
                     "corrected surface reflectance and surface temperature image data.", "CC-BY-4.0", None, _LS89_BANDS),
    "ls7_c2l2_sp": ("USGS Landsat 7 Collection 2 Level-2 Science Products, consisting of atmospherically "
                    "corrected surface reflectance and surface temperature image data.", "CC-BY-4.0", None, _LS457_BANDS),
    "ls45_c2l2_sp": ("USGS Landsat 4 and 5 Collection 2 Level-2 Science Products, consisting of atmospherically "
                     "corrected surface reflectance and surface temperature image data.", "CC-BY-4.0", None, _LS457_BANDS),
    "s2_l2a": ("Sentinel-2a and Sentinel-2b imagery, processed to Level 2A (Surface Reflectance) and converted "
               "to Cloud Optimized GeoTIFFs", None, None, _S2_BANDS),
    "sentinel_1_rtc": ("Sentinel-1 Radiometrically Terrain Corrected (RTC) from the Microsoft Planetary Computer.",
                       None, "EPSG:4326", [("vv", "float32", -32768.0, "1", ["VV"]), ("vh", "float32", -32768.0, "1", ["VH"])]),
    "nasadem": ("NASADEM from Microsoft's Planetary Computer", None, "EPSG:4326",
                [("elevation", "int16", -32768, "1", [])]),
    "esa_worldcover": ("The European Space Agency (ESA) WorldCover global land cover maps at 10 meter resolution.",
                       None, None, [("map", "uint8", 0, "1", ["classification"])]),
    "io_lulc_annual_v02": ("Impact Observatory (ESRI) Landcover Classification 9 Class", None, None,
                           [("data", "uint8", 0, "1", ["classification"])]),
}
# ---------------------------------------------------------------------------

FLAG_TYPE = T.StructType([
    T.StructField("bits", T.ArrayType(T.IntegerType())),
    T.StructField("values", T.MapType(T.IntegerType(), T.StringType())),
])
MEASUREMENT_TYPE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("units", T.StringType()),
    T.StructField("dtype", T.StringType()),
    T.StructField("nodata", T.DoubleType()),
    T.StructField("flags", T.MapType(T.StringType(), FLAG_TYPE)),
])
PRODUCT_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("description", T.StringType()),
    T.StructField("license", T.StringType()),
    T.StructField("metadata_type", T.StringType()),
    T.StructField("crs", T.StringType()),
    T.StructField("measurements", T.ArrayType(MEASUREMENT_TYPE)),
])


# Bit layouts of the other Landsat Collection 2 quality bands. A flag named
# here is one bit, false or true.
QA_RADSAT_BITS = {
    "band_1_saturation": 0, "band_2_saturation": 1, "band_3_saturation": 2, "band_4_saturation": 3,
    "band_5_saturation": 4, "band_6_saturation": 5, "band_7_saturation": 6,
    "blue_saturation": 1, "green_saturation": 2, "red_saturation": 3, "nir_saturation": 4,
    "swir_1_saturation": 5, "swir_2_saturation": 6, "terrain_occlusion": 11,
}
QA_AEROSOL_BITS = {"nodata": 0, "valid_aerosol_retrieval": 1, "water": 2, "interpolated_aerosol": 5}
QA_AEROSOL_LEVEL = ([6, 7], {0: "climatology", 1: "low", 2: "medium", 3: "high"})
CLOUD_QA_BITS = {"dark_dense_vegetation": 0, "cloud": 1, "cloud_shadow": 2, "adjacent_to_cloud": 3, "snow": 4, "water": 5}
BOOLEAN_VALUES = {0: "false", 1: "true"}


def _bit_flags(bits: dict[str, int]) -> dict:
    return {name: ([bit], BOOLEAN_VALUES) for name, bit in bits.items()}


def _flags(product: str, band: str):
    if product.startswith("ls"):
        if band == "qa_radsat":
            return _bit_flags(QA_RADSAT_BITS)
        if band == "qa_aerosol":
            return _bit_flags(QA_AEROSOL_BITS) | {"aerosol_level": QA_AEROSOL_LEVEL}
        if band == "cloud_qa":
            return _bit_flags(CLOUD_QA_BITS)
    if band == "qa_pixel" and product.startswith("ls"):
        out = {k: ([b], QA_PIXEL_SINGLE_VALUES[k]) for k, b in QA_PIXEL_BITS.items()}
        out.update({k: (list(b), QA_PIXEL_CONFIDENCE_VALUES[k]) for k, b in QA_PIXEL_CONFIDENCE_BITS.items()})
        return out
    if band == "SCL":
        return {"qa": (list(range(8)), SCL_LABELS)}
    if band == "map":
        return {"data": (list(range(8)), {v: lab for v, _, lab in WORLDCOVER_LEGEND})}
    if band == "data":
        return {"data": (list(range(8)), LULC_LABELS)}
    return None


def product_rows() -> list[tuple]:
    rows = []
    for name, (desc, lic, crs, bands) in PRODUCTS.items():
        ms = [(b, list(al), units, dt, float(nd), _flags(name, b)) for b, dt, nd, units, al in bands]
        rows.append((name, desc, lic, "eo3", crs, ms))
    return rows


def products(spark: SparkSession) -> DataFrame:
    """The product catalogue as a one-partition dimension table."""
    return spark.createDataFrame(product_rows(), PRODUCT_SCHEMA).coalesce(1)


def band_nodata(product: str) -> dict[str, float]:
    return {b: float(nd) for b, _, nd, _, _ in PRODUCTS[product][3]}


def band_aliases(product: str) -> dict[str, str]:
    """alias (or name) -> real band name for one product."""
    out = {}
    for b, _, _, _, al in PRODUCTS[product][3]:
        out[b] = b
        for a in al:
            out.setdefault(a, b)
    return out
