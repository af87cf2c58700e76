"""Unit vectors for scalar functions (reference doctests and hand-made edge rows)."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from eoframe.functions import geo, qa, temporal, text
from eoframe.functions.radiometry import normalized_difference, to_celsius, to_reflectance
from eoframe.operators import catalog, explore


def one(spark, col, rows=None, schema=None):
    df = spark.createDataFrame(rows, schema) if rows is not None else spark.range(1)
    return [r[0] for r in df.select(col).collect()]


def test_bits_and_qa(spark):
    rows = [(None,), (0,), (1 << 15,), (0b1100000000,), (0b0100000000,), (0b1000000000,), (31,)]
    df = spark.createDataFrame(rows, "q int")
    got = df.select(qa.bit_set("q", 15).alias("b15"), qa.qa_pixel_mask("q", "CLOUD_confidence:high").alias("hi"),
                    qa.qa_pixel_mask("q", "cloud_confidence:low").alias("lo"),
                    qa.qa_pixel_mask("q", "cloud_confidence:medium").alias("med"),
                    qa.qa_pixel_any("q", ["cloud", "nodata"]).alias("any")).collect()
    assert [r.b15 for r in got] == [False, False, True, False, False, False, False]
    assert [r.hi for r in got] == [False, False, False, True, False, False, False]
    assert [r.lo for r in got] == [False, False, False, False, True, False, False]
    assert [r.med for r in got] == [False, False, False, False, False, True, False]
    assert [r["any"] for r in got] == [False, False, False, False, False, False, True]
    with pytest.raises(ValueError):
        qa.qa_pixel_mask("q", "bogus")
    with pytest.raises(ValueError):
        qa.qa_pixel_mask("q", "cirrus_confidence:medium")


def test_make_mask_and_scl(spark):
    df = spark.createDataFrame([(0b0000011000,), (0b0001000000,)], "q int")
    m = df.select(qa.make_mask("q", "ls89_c2l2_sp", "qa_pixel", cloud="high_confidence",
                               cloud_shadow="high_confidence").alias("m")).collect()
    assert [r.m for r in m] == [True, False]
    assert qa.scl_codes(["vegetation", "snow or ice", "water", "bare soils", "unclassified",
                         "dark area pixels"]) == [4, 11, 6, 5, 7, 2]


def test_scaling(spark):
    r = spark.range(1).select(to_reflectance(F.lit(10000)).alias("sr"), to_celsius(F.lit(40000)).alias("c"),
                              normalized_difference(F.lit(0), F.lit(0)).alias("nd")).first()
    assert r.sr == pytest.approx(0.075)
    assert r.c == pytest.approx(40000 * 3.41802e-3 + 149 - 273.15)
    assert r.nd is None


def test_utm_and_zoom(spark):
    rows = [(51.5, -0.1), (-33.9, 18.4), (10.0, 180.0)]
    got = one(spark, geo.utm_epsg("lat", "lon"), rows, "lat double, lon double")
    assert got == [32630, 32734, 32660]
    z = spark.range(1).select(geo.degree_to_zoom(F.lit(0.0), F.lit(0.0)).alias("a"),
                              geo.degree_to_zoom(F.lit(10.0), F.lit(20.0)).alias("b")).first()
    assert (z.a, z.b) == (18, 5)


def test_projection_vectors(spark):
    x, y = geo.to_ease2(F.lit(180.0), F.lit(90.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert r.x == pytest.approx(17367530.445, abs=1e-3)
    assert r.y == pytest.approx(7342230.136, abs=1e-3)
    ux, uy = geo.to_utm(F.lit(9.0), F.lit(0.0), F.lit(32))
    u = spark.range(1).select(ux.alias("x"), uy.alias("y")).first()
    assert u.x == pytest.approx(500000.0, abs=1e-6) and u.y == pytest.approx(0.0, abs=1e-6)


def test_solar_day(spark):
    df = spark.createDataFrame([(datetime(2020, 1, 1, 22, 0), 45.0), (datetime(2020, 1, 1, 1, 0), -90.0)],
                               "t timestamp_ntz, lon double")
    got = [str(d) for d in one(spark, geo.solar_day("t", "lon"), df.collect(), df.schema)]
    assert got == ["2020-01-02", "2019-12-31"]


def test_time_ranges():
    assert temporal.as_time_range(2017) == (datetime(2017, 1, 1), datetime(2018, 1, 1))
    assert temporal.as_time_range(2017, 2) == (datetime(2017, 2, 1), datetime(2017, 3, 1))
    assert temporal.as_time_range(2017, 2, 28) == (datetime(2017, 2, 28), datetime(2017, 3, 1))
    assert temporal.as_time_range(2017, None, 3) == (datetime(2017, 1, 1), datetime(2018, 1, 1))
    assert temporal.as_time_range(None) is None


def test_field_names():
    assert catalog.group_field_names({"row-begin": "4", "row-end": "9", "path": 12, "cloud-end": "", "t-begin": None}) == \
        {"row": {"begin": "4", "end": "9"}, "path": {"val": 12}}
    with pytest.raises(ValueError):
        catalog.group_field_names({"a-b-c": "1"})


LABEL_VECTORS = [
    ("/data/one/scene_a.nc", "scene_a.nc"),
    ("s3://own-bucket/2020/grid7/tile_7.yaml", "tile_7"),
    ("s3://own-bucket/2020/grid7/tile_7.json", "tile_7"),
    ("s3://b/.yaml", "b"),
    ("s3://b/x/yaml", "x"),
]


def test_reasonable_label(spark):
    got = one(spark, explore.reasonable_label("u"), [(u,) for u, _ in LABEL_VECTORS], "u string")
    assert got == [want for _, want in LABEL_VECTORS]


PREFIX_VECTORS = [
    (["file:///a/thing-1.txt"], "file:///a/thing-1.txt"),
    (["file:///a/1.txt", "file:///a/2.txt", "file:///a/3.txt"], "file:///a/"),
    (["file:///a/thing-1.txt", "file:///a/thing-2.txt", "file:///a/thing-3.txt"], "file:///a/"),
    (["http://example.com/things/"], "http://example.com/things/"),
    (["http://example.com/things/"] * 4, "http://example.com/things/"),
    (["http://example.com/things/", "http://example.com/others/"], "http://example.com/"),
    (["http://example.com/things", "http://example.com/things/more"], "http://example.com/"),
]


def test_uri_prefix(spark):
    rows = [(i, u) for i, (us, _) in enumerate(PREFIX_VECTORS) for u in us]
    df = spark.createDataFrame(rows, "g int, u string")
    got = {r.g: r.prefix for r in explore.uri_prefix(df, "u", ["g"]).collect()}
    assert [got[i] for i in range(len(PREFIX_VECTORS))] == [want for _, want in PREFIX_VECTORS]


def test_slug_and_api_prefix(spark):
    r = spark.range(1).select(text.slug(F.lit("Lake o'Clear")).alias("s"),
                              explore.api_file_prefix(F.lit("/api/datasets/own_product/2019")).alias("p")).first()
    assert r.s == "lake-o-clear"
    assert r.p == "own_product-2019-datasets"


BYTE_VECTORS = [
    (0, "0 B", "0.00 B"), (1, "1 B", "1.00 B"), (1023, "1023 B", "1023.00 B"), (1024, "1.0 KB", "1.00 KB"),
    (1280, "1.2 KB", "1.25 KB"), (1331, "1.3 KB", "1.30 KB"), (1536, "1.5 KB", "1.50 KB"), (10**6, "976.6 KB", "976.56 KB"),
    (3 * 2**20, "3.0 MB", "3.00 MB"), (2**40 + 2**38, "1.2 TB", "1.25 TB"), (5 * 2**50 + 2**48, "5.2 PB", "5.25 PB"),
    (2**61, "2048.0 PB", "2048.00 PB"),
]


def test_human_bytes_exact_rounding(spark):
    got = spark.createDataFrame([(n,) for n, _, _ in BYTE_VECTORS], "n long").select(
        "n", text.human_bytes("n").alias("a"), text.human_bytes_2("n").alias("b")).collect()
    assert [tuple(r) for r in got] == BYTE_VECTORS


def test_url_and_path_extraction(spark):
    rows = [("see https://example.com/a?b=1 and more",), ("no url here",), ("path /data/x/y.tif end",)]
    got = spark.createDataFrame(rows, "s string").select(text.first_url("s").alias("u"),
                                                        text.first_path("s").alias("p")).collect()
    assert [r.u for r in got] == ["https://example.com/a?b=1", None, None]
    assert got[2].p == "/data/x/y.tif"


def test_after_last_match_and_glob(spark):
    rows = [("LC08_1_T1_SR_B4.TIF",), ("MTL.txt",), ("A_T1_B_T2_C",)]
    got = one(spark, text.after_last_match("s"), rows, "s string")
    assert got == ["SR_B4.TIF", "MTL.txt", "C"]
    got = one(spark, text.matches_glob("s", "a/*/c*"), [("a/b/x/cd",), ("a/cd",)], "s string")
    assert got == [True, False]


def test_date_in_text(spark):
    rows = [("acquired 2021/03/05 ok",), ("12-25-2020",), ("Jan 5, 2021",), ("nothing",)]
    got = one(spark, temporal.date_in_text("s"), rows, "s string")
    assert got == ["2021-03-05T00:00:00Z", "2020-12-25T00:00:00Z", "2021-01-05T00:00:00Z", None]


def test_external_url(spark):
    rows = [("s3://some-data/L2/x/ARD-METADATA.yaml",), ("file:///g/data/a.yaml",), ("some/relative/path.txt",),
            ("file:///local_data/x/y.tif",)]
    got = one(spark, explore.external_url("u"), rows, "u string")
    assert got == ["https://some-data.s3.ap-southeast-2.amazonaws.com/L2/x/ARD-METADATA.yaml",
                   "file:///g/data/a.yaml", "some/relative/path.txt", "/explorer/api/data/x/y.tif"]
    got = one(spark, explore.external_url("u", data_location={"some-data": "data.example.org"}, is_base=True),
              rows[:1], "u string")
    assert got == ["https://data.example.org/?prefix=L2/x/"]


def test_ring_validity(spark):
    rows = [([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]],), ([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0], [0.0, 0.0]],),
            ([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]],), (None,)]
    got = one(spark, geo.ring_is_valid("r"), rows, "r array<array<double>>")
    assert got == [True, False, False, False]
