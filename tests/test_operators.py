"""Operator invariants and edge rows (brute-force checks on small inputs)."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from eoframe.operators import catalog, cube, harvest, overlay, ranking, terrain, timeseries
from eoframe.operators.documents import unique_names, upsert_outcomes
from eoframe.sources.fixtures import view


def test_water_fuse_closed_form_equals_fold(spark):
    obs = timeseries.with_solar_day(view(spark, SF_SMALL, "pixel_obs"))
    keys, order = ["solar_day", "y", "x"], ["t", "scene_id", "seq", "lon"]
    closed = timeseries.water_fuse(obs, keys, "wofs", order)
    folded = timeseries.custom_fuse(obs, keys, "wofs", order, timeseries.wofs_fuser_np)
    a = sorted(tuple(r) for r in closed.select(*keys, "wofs").collect())
    b = sorted(tuple(r) for r in folded.select(*keys, "wofs").collect())
    assert a == b and len(a) > 0


def test_consecutive_index_matches_row_number(spark):
    df = view(spark, SF_SMALL, "scenes").select("id", "product")
    got = ranking.consecutive_index(df, ["product", "id"], "i", partitions=4).select("id", "i").collect()
    want = sorted(df.collect(), key=lambda r: (r.product, r.id))
    assert sorted((r.i, r.id) for r in got) == [(i, r.id) for i, r in enumerate(want)]
    keyed = ranking.consecutive_index(df, ["id"], "i", partition_cols=["product"], partitions=4).collect()
    per = {}
    for r in sorted(df.collect(), key=lambda r: r.id):
        per.setdefault(r.product, []).append(r.id)
    assert sorted((r.product, r.i, r.id) for r in keyed) == sorted(
        (p, i, x) for p, ids in per.items() for i, x in enumerate(ids))


def test_first_last_nearest_edges(spark):
    rows = [(datetime(2020, 1, 1), 0, 0, None), (datetime(2020, 2, 1), 0, 0, None),   # all-null cell
            (datetime(2020, 1, 1), 0, 1, 1.0), (datetime(2020, 3, 1), 0, 1, 3.0),
            (datetime(2020, 2, 1), 0, 2, 2.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, y int, x int, v double")
    f = {r.x: r for r in timeseries.first_valid(df, "v").collect()}
    assert (f[0].v, f[0].t, f[0].idx) == (None, datetime(2020, 1, 1), 0)
    assert (f[1].v, f[1].idx, f[2].idx) == (1.0, 0, 1)
    last = {r.x: r for r in timeseries.last_valid(df, "v").collect()}
    assert (last[0].v, last[0].t, last[0].idx) == (None, datetime(2020, 3, 1), -1)
    assert (last[1].v, last[1].idx, last[2].idx) == (3.0, -1, -2)
    # 2020-01-31 12:00 is 30.5 days after 1 Jan and 29.5 days before 1 Mar
    n = {r.x: r for r in timeseries.nearest_valid(df, "v", datetime(2020, 1, 31, 12)).collect()}
    assert n[1].v == 3.0 and n[2].v == 2.0 and n[0].v is None and n[0].t is None


def test_nearest_tie_goes_after(spark):
    rows = [(datetime(2020, 1, 1), 0, 0, 1.0), (datetime(2020, 1, 3), 0, 0, 3.0)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, y int, x int, v double")
    r = timeseries.nearest_valid(df, "v", datetime(2020, 1, 2)).first()
    assert (r.v, r.t) == (3.0, datetime(2020, 1, 3))


def _np_dilate(valid: np.ndarray, r: int) -> np.ndarray:
    bad = ~valid
    out = np.zeros_like(bad)
    offs = terrain.disk_offsets(r)
    H, W = bad.shape
    for yy, xx in zip(*np.nonzero(bad)):
        for dx, dy in offs:
            y2, x2 = yy + dy, xx + dx
            if 0 <= y2 < H and 0 <= x2 < W:
                out[y2, x2] = True
    return ~out


def test_dilation_equals_numpy(spark):
    dem = view(spark, SF_SMALL, "dem").select("x", "y", (F.col("elevation") >= 60).alias("valid"))
    rows = dem.collect()
    H = max(r.y for r in rows) + 1
    W = max(r.x for r in rows) + 1
    grid = np.ones((H, W), bool)
    for r in rows:
        grid[r.y, r.x] = r.valid
    want = _np_dilate(grid, 2)
    got = terrain.dilate(dem, "valid", 2).collect()
    assert all(bool(want[r.y, r.x]) == r.valid for r in got)
    for r in (1, 4, 10):
        a = sorted(tuple(x) for x in terrain.dilate(dem, "valid", r).collect())
        b = sorted(tuple(x) for x in terrain.dilate_by_kernel(dem, "valid", r).collect())
        assert a == b
    assert all(w * w + dy * dy <= (10.5) ** 2 < (w + 1) ** 2 + dy * dy for dy, w in terrain.disk_half_widths(10))


def test_hillshade_needs_neighbours(spark):
    """x = 0 and x = 2 are no neighbours: without a cell between them both slopes are 0."""
    dem = spark.createDataFrame([(0, 0, 0), (2, 0, 900), (0, 5, 0), (1, 5, 900)], "x long, y long, elevation long")
    shade = {(r.x, r.y): r.shade for r in terrain.hillshade(dem).collect()}
    assert shade[0, 0] == shade[2, 0] and shade[0, 5] != shade[0, 0]


def test_tiles_keep_positions(spark):
    px = spark.createDataFrame([(0, 0, 1.0), (3, 1, 2.0), (4, 5, 3.0)], "x long, y long, red double")
    got = {(r.tile_y, r.tile_x): (r["values"], r.places) for r in terrain.tile_rows(px, ["red"], {"red": 0}, 4).collect()}
    assert got == {(0, 0): ([1.0, 2.0], [0, 7]), (1, 1): ([3.0], [4])}


def test_one_id_twice_in_a_batch_is_added_once(spark):
    from eoframe.operators import documents
    batch = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (3, None)], "id long, doc string")
    index = spark.createDataFrame([(2, "old")], "id long, doc string")
    got = documents.upsert_outcomes(batch, index, valid=F.col("doc").isNotNull()).groupBy("id", "status").count().collect()
    assert sorted(tuple(r) for r in got) == [(1, "added", 1), (1, "already", 1), (2, "already", 1), (3, "failed", 1)]


def test_custom_fuse_nulls(spark):
    rows = [(1, 1, 4), (1, 2, None), (1, 3, 2), (None, 1, 8), (None, 2, 16), (2, 1, None)]
    df = spark.createDataFrame(rows, "k int, t int, v long")
    got = timeseries.custom_fuse(df, ["k"], "v", ["t"], lambda a, b: a | b).collect()
    assert sorted((str(r.k), r.v) for r in got) == [("1", 6), ("2", None), ("None", 24)]


def test_hillshade_equals_numpy(spark):
    dem = spark.range(20 * 17).select((F.col("id") % 17).alias("x"), F.floor(F.col("id") / 17).alias("y"),
                                      (F.col("id") * F.col("id") * 37 % 301).alias("elevation"))
    rows = dem.collect()
    H, W = max(r.y for r in rows) + 1, max(r.x for r in rows) + 1
    z = np.zeros((H, W))
    for r in rows:
        z[r.y, r.x] = r.elevation
    e_dy, e_dx = np.gradient(0.5 * z, -30.0, 30.0)
    nrm = np.sqrt(e_dx ** 2 + e_dy ** 2 + 1)
    lx, ly, lz = terrain.light_vector()
    inten = (-e_dx / nrm) * lx + (-e_dy / nrm) * ly + (1 / nrm) * lz
    imin, imax = inten.min(), inten.max()
    want = np.clip((inten - imin) / (imax - imin), 0, 1)
    got = terrain.hillshade(dem).collect()
    assert max(abs(want[r.y, r.x] - r.shade) for r in got) < 1e-9


def test_missing_assets_by_name(spark):
    assets = spark.createDataFrame([(1, "a", "https://h/x/y/A_1.TIF?s=1"), (1, "b", "https://h/x/y/B_1.TIF"),
                                    (2, "a", "https://h/x/z/A_2.TIF")], "scene_id long, asset_key string, url string")
    files = spark.createDataFrame([("x/y/sub/A_1.TIF", 3), ("x/z/other.TIF", 1)], "path string, length long")
    got = sorted(r.url for r in harvest.missing_assets(assets, files).collect())
    assert got == ["https://h/x/y/B_1.TIF", "https://h/x/z/A_2.TIF"]


def test_folder_sizes_and_tree(spark):
    files = spark.createDataFrame([("a/b/c.txt", 10), ("a/b/d.txt", 5), ("a/e.txt", 1)], "path string, length long")
    sizes = {r.folder: (r.size, r.n_files) for r in harvest.folder_sizes(files).collect()}
    assert sizes == {"a": (16, 3), "a/b": (15, 2)}
    t = {r.path: r.truncated for r in harvest.tree(files, max_depth=1).collect()}
    assert t == {"a": False, "a/b": True, "a/e.txt": False}


def test_upsert_is_idempotent(spark):
    sc = view(spark, SF_SMALL, "scenes")
    first = upsert_outcomes(sc, sc.limit(0), "id")
    assert first.filter("status = 'added'").count() == sc.count()
    again = upsert_outcomes(sc, sc, "id")
    assert again.filter("status = 'added'").count() == 0


def test_unique_names_suffixes(spark):
    df = spark.createDataFrame([(1, "s", "n"), (2, "s", "n"), (3, "s", "m"), (4, "s", "n")],
                               "pos int, src string, name string")
    got = {r.pos: r.unique_name for r in unique_names(df, "src", "name", ["pos"]).collect()}
    assert got == {1: "s - n", 2: "s - n (2)", 3: "s - m", 4: "s - n (3)"}


def test_isel_rejects_float(spark):
    px = view(spark, SF_SMALL, "pixels")
    with pytest.raises(TypeError):
        cube.isel_time(px, 0.5)


def test_interval_join_brute_force(spark):
    frames = view(spark, SF_SMALL, "pixels").select(F.col("t").cast("timestamp_ntz").alias("t")).distinct()
    feats = view(spark, SF_SMALL, "features").select("fid", "attr", "start_time", "end_time")
    got = sorted((r.t, r.fid) for r in overlay.active_features(frames, feats).collect())
    fr = [r.t for r in frames.collect()]
    lo, hi = min(fr), max(fr)
    want = sorted((t, f.fid) for f in feats.collect() for t in fr
                  if (f.start_time or lo) <= t <= (f.end_time or hi))
    assert got == want


def test_sampled_extent_inside_exact(spark):
    sc = view(spark, SF_SMALL, "scenes")
    exact = {r.product: r for r in catalog.product_bbox(sc).collect()}
    for r in catalog.product_bbox(catalog.sample_scenes(sc, 0.3, seed=3)).collect():
        e = exact[r.product]
        assert e.minx <= r.minx and e.miny <= r.miny and e.maxx >= r.maxx and e.maxy >= r.maxy


def test_incremental_index_equals_batch_upsert(spark):
    import __spark_entry__ as entry
    streamed = {r.id for r in entry.queries()["incremental_index"](spark, SF_SMALL).collect()}
    sc = view(spark, SF_SMALL, "scenes")
    index = sc.filter("t < TIMESTAMP_NTZ'1998-01-01 00:00:00'")
    incoming = sc.filter("t >= TIMESTAMP_NTZ'1997-01-01 00:00:00'")
    out = upsert_outcomes(incoming, index, "id", F.col("geom").isNotNull())
    batch = {r.id for r in index.select("id").collect()} | {r.id for r in out.filter("status = 'added'").collect()}
    assert streamed == batch


def test_keyed_hillshade_equals_single_grid(spark):
    dem = view(spark, SF_SMALL, "dem")
    single = {(r.x, r.y): r.shade for r in terrain.hillshade(dem).collect()}
    two = dem.withColumn("k", F.lit(1)).unionByName(dem.withColumn("k", F.lit(2)))
    keyed = terrain.hillshade(two, keys=["k"]).collect()
    assert all(abs(single[(r.x, r.y)] - r.shade) < 1e-12 for r in keyed)


def test_tile_sink_round_trip(spark, tmp_path):
    px = view(spark, SF_SMALL, "pixels").select("t", "y", "x", "red")
    tiles = terrain.tile_rows(px, ["red"], {"red": 0}, 16, keys=["t"]).withColumn("product", F.lit("p"))
    terrain.write_tiles(tiles, str(tmp_path / "tiles"))
    back = spark.read.parquet(str(tmp_path / "tiles"))
    assert set(back.columns) >= {"product", "t", "tile_y", "tile_x", "band", "values"}
    assert back.agg(F.sum("n_cells")).first()[0] == px.count()


def test_exports(spark, tmp_path):
    from eoframe.operators import explore
    df = view(spark, SF_SMALL, "scenes").select("id", "product")
    explore.export(df, str(tmp_path / "j"), "json")
    explore.export(df, str(tmp_path / "c"), "csv")
    assert spark.read.json(str(tmp_path / "j")).count() == df.count()
    assert spark.read.option("header", "true").csv(str(tmp_path / "c")).count() == df.count()


def test_search_guards_and_union(spark):
    sc = view(spark, SF_SMALL, "scenes")
    with pytest.raises(ValueError):
        catalog.ensure_found(catalog.find_scenes(sc, ["no_such_product"]), "datasets")
    with pytest.raises(ValueError):
        cube.require_columns(sc, ["id", "missing_col"])
    u = catalog.union_products(sc, {"ls89_c2l2_sp": F.col("cloud_cover") < 50, "s2_l2a": F.lit(True)})
    want = sc.filter("(product = 'ls89_c2l2_sp' AND cloud_cover < 50) OR product = 's2_l2a'").count()
    assert u.count() == want


def test_field_predicate_reversed_range(spark):
    sc = view(spark, SF_SMALL, "scenes")
    pred = catalog.field_predicate({"cloud_cover-begin": "60", "cloud_cover-end": "20", "product": ""},
                                   {"cloud_cover": "long", "product": "string"})
    assert sc.filter(pred).count() == sc.filter("cloud_cover BETWEEN 20 AND 60").count()
    open_end = catalog.field_predicate({"cloud_cover-begin": "90"}, {"cloud_cover": "long"})
    assert sc.filter(open_end).count() == sc.filter("cloud_cover >= 90").count()
    with pytest.raises(ValueError):
        catalog.field_predicate({"nope": "1"}, {"cloud_cover": "long"})
