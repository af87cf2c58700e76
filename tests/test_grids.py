"""Tiles with halos, inverse projections and gathered grids against whole arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from eoframe.functions import geo
from eoframe.operators import harvest, terrain


def cells_of(spark, grid, hole=()):
    rows = [("a", x, y, None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(grid) if (y, x) not in hole]
    return spark.createDataFrame(rows, "name string, x long, y long, elevation double")


@pytest.mark.parametrize("tile", [3, 5, 256])
def test_hillshade_does_not_depend_on_tiles(spark, tile):
    grid = np.random.default_rng(1).integers(0, 900, (13, 17)).astype(float)
    whole = {(r.x, r.y): r.shade for r in terrain.hillshade(cells_of(spark, grid), tile=512).collect()}
    got = terrain.hillshade(cells_of(spark, grid), tile=tile)
    assert got.columns == ["name", "x", "y", "elevation", "shade"]
    assert {(r.x, r.y): r.shade for r in got.collect()} == whole
    gy, gx = np.gradient(grid * 0.5, -30.0, 30.0)
    light = terrain.light_vector()
    want = (-gx * light[0] - gy * light[1] + light[2]) / np.sqrt(gx ** 2 + gy ** 2 + 1)
    want = (want - want.min()) / (want.max() - want.min())
    for (y, x), v in np.ndenumerate(want):
        assert abs(whole[x, y] - v) < 1e-12


def test_hillshade_gaps_and_negative_cells(spark):
    grid = np.arange(30, dtype=float).reshape(5, 6) ** 1.5
    grid[2, 2] = np.nan
    df = cells_of(spark, grid, hole={(0, 0), (3, 3)}).withColumns({"x": F.col("x") - 4, "y": F.col("y") - 3})
    small, large = ({(r.x, r.y): r.shade for r in terrain.hillshade(df, tile=t).collect()} for t in (2, 64))
    assert small == large and len(small) == 28
    assert small[-2, -1] is None and sum(v is None for v in small.values()) == 1
    keyless = df.unionByName(df.limit(1).withColumn("x", F.lit(None).cast("long")))
    assert sorted(r.shade is None for r in terrain.hillshade(keyless).collect())[-2:] == [True, True]
    assert terrain.hillshade(df.limit(0)).count() == 0


@pytest.mark.parametrize("radius, tile", [(0, 4), (1, 3), (4, 8), (4, 256), (11, 4)])
def test_dilate_does_not_depend_on_tiles(spark, radius, tile):
    rng = np.random.default_rng(radius)
    rows = [(k, x, y, bool(rng.random() > 0.05)) for k in ("p", None) for x in range(-9, 14) for y in range(-5, 20)]
    df = spark.createDataFrame(rows, "k string, x long, y long, valid boolean")
    for invert in (True, False):
        a = terrain.dilate(df, "valid", radius, invert, keys=["k"], tile=tile)
        assert a.columns == df.columns
        got = {(r.k, r.x, r.y): r.valid for r in a.collect()}
        source = [(k, x, y) for k, x, y, v in rows if v != invert]
        near = {(k, x + dx, y + dy) for k, x, y in source for dx, dy in terrain.disk_offsets(radius)}
        assert got == {(k, x, y): (k, x, y) not in near for k, x, y, _ in rows}


def test_projections_are_inverted(spark):
    rows = [(lon, lat) for lon in (6.0, 8.9, 9.0, 11.7) for lat in (-63.0, -1.0, 0.0, 44.4, 78.0)]
    df = spark.createDataFrame(rows, "lon double, lat double")
    north = F.lit(32)
    for there, back, south in (
            (geo.to_ease2("lon", "lat"), lambda x, y: geo.from_ease2(x, y), None),
            (geo.to_utm("lon", "lat", north), lambda x, y: geo.from_utm(x, y, north), False),
            (geo.to_utm("lon", "lat", north), lambda x, y: geo.from_utm(x, y, north, True), True)):
        part = df if south is None else df.filter("lat < 0" if south else "lat >= 0")
        moved = part.select("lon", "lat", there[0].alias("px"), there[1].alias("py"))
        lon, lat = back("px", "py")
        for r in moved.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
            assert math.isclose(r.lon, r.lon2, abs_tol=2e-8) and math.isclose(r.lat, r.lat2, abs_tol=2e-8)


def test_a_finer_grid_has_no_holes(spark):
    src = spark.createDataFrame([(x, y, 100 * y + x) for x in range(20) for y in range(15)], "x long, y long, v long")
    args = (geo.to_ease2, geo.from_ease2, 10.0, 45.0, 0.01, 960000.0, 5500000.0)
    got = terrain.regrid(src, ["v"], *args, 250.0).collect()
    rows, cols = {r.row for r in got}, {r.col for r in got}
    assert len(got) == len(rows) * len(cols) == len({(r.row, r.col) for r in got}) > 3 * 300
    assert all(r.v is not None for r in got)  # the extent is that of the source's centres
    assert {r.v for r in got} == set(range(0, 1500)) & {100 * y + x for x in range(20) for y in range(15)}
    line = [r.v for r in sorted(got, key=lambda r: r.col) if r.row == min(rows)]
    assert line == sorted(line)
    assert terrain.regrid(src.limit(0), ["v"], *args, 250.0).count() == 0


def test_missing_by_substring(spark):
    base = "https://h/"
    assets = [base + u for u in ("s/1/B4.TIF", "s/1/LC08_B5.TIF?sig=1", "s/1/MTL", "s/2/B4.TIF", "s/3/B4.TIF", "s/1/B", "s/1/xy",
                                 "s/1/", "s/9/", "s/1/s", "s/2/2", "s/9/9", "s/4/%_B.TIF", "s/4/ax_B.TIF", "s/1/B4.TIF", "top.txt")]
    files = ["s/1/old_B4.TIF.aux", "s/1/deep/LC08_B5.TIF/part", "s/2/b4.tif", "s/22/B4.TIF", "s/4/ax_B.TIF2", "s/3/x/B4.TIFF", "top.txt"]
    got = harvest.missing_by_substring(spark.createDataFrame([(i, "k", u) for i, u in enumerate(assets)], "scene_id int, asset_key string, url string"),
                                       spark.createDataFrame([(f, 1) for f in files], "path string, length long"))
    def missing(url):
        path = url[len(base):].split("?")[0]
        d, _, f = path.rpartition("/")
        return not any(p.startswith(d + "/") and f in p for p in files)
    assert sorted(r.scene_id for r in got.collect()) == [i for i, u in enumerate(assets) if missing(u)]
