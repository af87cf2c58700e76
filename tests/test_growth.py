"""Steps whose disk, memory or time grew faster than their input."""

import datetime
import glob
import json
import os

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from eoframe.functions import documents as fdocs
from eoframe.functions import geo
from eoframe.operators import harvest, imaging, terrain
from eoframe.plans import load_all
from eoframe.session import checkpoint_dir
from eoframe.sources import landed


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _orders(spark, folder, keys):
    rows = [(k, k % 7, "OFP"[k % 3], 100.0 + k, datetime.datetime(1995, 1 + k % 12, 3), "3-MEDIUM") for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
                          "o_orderpriority string").write.parquet(os.path.join(folder, "orders.parquet"))
    return str(folder)


def test_scene_docs_broadcasts_no_table(spark, tmp_path):
    docs = load_all()["scene_docs"].build(spark, _orders(spark, str(tmp_path), range(1, 30)))
    assert "BroadcastHashJoin" not in _plan(docs)  # the few band names of a listing are crossed in, no more
    assert sorted(r.scene_id for r in docs.collect()) == list(range(1, 30))
    assert {r.n_bands for r in docs.collect()} == {3}


def test_missing_by_substring_compares_within_folders(spark):
    base = "https://h/"
    names = ["B4.TIF", "xB5", "", "dir1", "MTL", "T", "zz"]
    assets = [f"{base}s/dir{d}/{n}" for d in range(4) for n in names] + ["no url", None, base + "top.txt"]
    files = [f"s/dir{d}/{p}" for d in range(3) for p in ("aB4.TIF", "deep/xB5.x/p", "deep/dir1", "MT")] + ["s/dir2/", "top.txt", None]
    a = spark.createDataFrame(list(enumerate(assets)), "scene_id int, url string")
    f = spark.createDataFrame([(p,) for p in files], "path string")

    def missing(url):
        path = (url or "no url").removeprefix(base)
        d, _, n = path.rpartition("/")
        return not any(p and d and p.startswith(d + "/") and n in p for p in files)
    want = [i for i, u in enumerate(assets) if missing(u)]
    plain = harvest.missing_by_substring(a, f)
    assert "xxhash64" not in _plan(plain)  # small folders need no posting lists
    assert sorted(r.scene_id for r in plain.collect()) == want
    # All folders, or only some, by posting lists.
    assert sorted(r.scene_id for r in harvest.missing_by_substring(a, f, pairs=0).collect()) == want
    assert sorted(r.scene_id for r in harvest.missing_by_substring(a, f, rows=11).collect()) == want


@pytest.mark.parametrize("batch", [7, 10000])
def test_image_functions_on_sorted_chunks(spark, batch):
    cells = [(d, x, y, float((31 * x + 17 * y + (d or 0)) % 97) if (x + y) % 5 else None) for d in (1, 2, None) for x in range(-3, 9) for y in range(7)
             if (x * y + (d or 0)) % 3]
    off = [(1, None, 2, 5.0), (1, 3, None, 6.0)]  # of no cell
    df = spark.createDataFrame(cells + off, "t int, x long, y long, v double")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        out = imaging.apply_image_funcs(df, "v", [imaging.tile_stretch], keys=["t"], tile=4)
        got = {(r.t, r.x, r.y): r.v for r in out.collect()}
        assert "FlatMapGroupsInPandas" not in _plan(out)  # no call a chunk
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    chunks = {}
    for t, x, y, v in cells:
        chunks.setdefault((t, x // 4, y // 4), []).append(np.nan if v is None else v)
    want = {}
    for t, x, y, v in cells:
        c = np.array(chunks[t, x // 4, y // 4])
        lo, hi = np.nanmin(c), np.nanmax(c)
        want[t, x, y] = None if v is None or hi == lo else (v - lo) / (hi - lo)
    assert got == want | {o[:3]: None for o in off}
    assert imaging.apply_image_funcs(df.limit(0), "v", [imaging.tile_stretch], keys=["t"], tile=4).count() == 0


def test_band_files_by_one_lookup_a_name(spark):
    suffixes = {"a": "_B1", "b": "X_B1", "c": "", "d": "_B1", "e": "_QA"}
    names = [["s_B1.TIF", " X_B1.TIF ", None], [None, "s_QA.TIF", "t_QA.TIF"], ["", ".TIF", "_B1.tif"], [None, None, None]]
    want = [[(b, next(n.strip(" ") for n in row if n and n.strip(" ").endswith(s + ".TIF"))) for b, s in suffixes.items()
             if any(n and n.strip(" ").endswith(s + ".TIF") for n in row)] for row in names]
    assert fdocs.band_files(list(zip(*names)), suffixes) == want
    assert fdocs.band_files([[], []], suffixes) == []
    xml = "<r><PRODUCT_CONTENTS><FILE_NAME_BAND_4> S_SR_B4.TIF </FILE_NAME_BAND_4></PRODUCT_CONTENTS></r>"
    m = fdocs.extract_mtl(spark.createDataFrame([(1, xml), (2, "<r"), (3, None)], "id int, xml string"), "xml", "m")
    assert _plan(m).count("endswith") == 0  # not every band with every file in one expression
    assert {r.id: r.m.bands for r in m.collect()} == {1: {"red": "S_SR_B4.TIF"}, 2: {}, 3: {}}


def test_files_of_documents_are_handed_on_in_slices():
    import pyarrow as pa

    n = 2 * landed.ROWS_OUT + 5
    good = "".join(f"---\n{json.dumps({'id': i})}\n" for i in range(n)).encode()
    files = pa.RecordBatch.from_pydict({"path": ["a", "b", "c"], "content": [good, b"---\n{bad\n", good]})
    out = list(landed._parse_yaml_files(iter([files])))
    assert max(b.num_rows for b in out) <= landed.ROWS_OUT  # never all documents of all files at once
    rows = [r for b in out for r in b.to_pylist()]
    assert [(r["path"], r["doc_pos"], json.loads(r["doc"])["id"]) for r in rows if r["error"] is None] == [(p, i, i) for p in "ac" for i in range(n)]
    assert [(r["path"], r["doc_pos"], r["doc"]) for r in rows if r["error"]] == [("b", None, None)]


STREAMS = ["---\n%s\n" % d for d in (
    '{"a": 1, "b": [1.5, 1e5, 1.5e3, 1.5e+3, -0, -0.0, null, true], "a": 2}', '{"a": NaN, "b": Infinity}', '{"d": "2020-01-01", "<<": "x"}',
    '{"d": 2020-01-01}', '{"u": "\\u00e9", "v": "é"}', '{"s": "\\ud83d\\ude00"}', '{"%s": 1}' % ("k" * 1100), '{"a": "%s"}' % ("v" * 1100),
    '{"a":1} {"b":2}', '{"a": 1} # said', '{"a": 1', '{"a": "x\n---\ny"}', "[1]", "text", "", "k: v", "? [1, 2]\n: 3", '{"a": 1}\r---\r{"b": 2}')]


@pytest.mark.parametrize("i", range(len(STREAMS)))
def test_one_line_documents_read_as_yaml_reads_them(i, monkeypatch):
    calls = []
    load = yaml.load_all
    monkeypatch.setattr(yaml, "load_all", lambda *a, **k: calls.append(a) or load(*a, **k))
    plain = "".join('---\n{"n": %d, "t": "x"}\n' % k for k in range(50))
    assert landed._parse_stream(plain.encode())[1] is None and not calls  # JSON's own reader does
    text = STREAMS[i] + STREAMS[0]
    try:
        want = [json.dumps(d, default=str) for d in load(text, Loader=landed._loader()) if isinstance(d, dict)], None
    except Exception as e:  # noqa: BLE001
        want = [], f"{type(e).__name__}: {e}"
    assert landed._parse_stream(text.encode()) == want


def test_listing_of_a_folder_given_with_its_scheme(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    for root in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        assert [r.rel_path for r in landed.list_files(spark, root, "**.txt").collect()] == ["a.txt"]


def test_sidecar_folders_are_written_by_many_tasks(spark, tmp_path):
    keys = [400 * f + k for f in range(18) for k in (7, 3, 300, 3)]  # the first scene of each folder comes twice
    before = set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/sidecars-*"))
    got = load_all()["sidecar_outcomes"].build(spark, _orders(spark, str(tmp_path), keys)).collect()
    kinds = ["not found", "several sidecar files", "not an XML document", "broken XML document", None, None]
    assert sorted((int(r.folder[2:]), r.error and r.error.split(":")[0], r.wrs_path) for r in got) == [
        (f, kinds[f % 6], str((400 * f + 3) % 7 + 1) if f % 6 > 3 else None) for f in range(18)]
    folder, = set(glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/sidecars-*")) - before
    written = [os.path.basename(p) for p in glob.glob(folder + "/*/part-*.txt")]
    assert len(written) == 18 and len({p.split("-")[1] for p in written}) > 3


def test_target_cells_are_made_by_many_tasks(spark):
    src = spark.createDataFrame([(x, y, x * 10 + y) for x in range(20) for y in range(5)], "x long, y long, v long")
    cells = terrain.target_cells(F.col("x") * 1.0, F.col("y") * -1.0, src, 0.0, 0.0, 0.01)
    assert cells.select(F.spark_partition_id()).distinct().count() > 2 * spark.sparkContext.defaultParallelism
    assert cells.count() == (1 + 1900) * (1 + 400)
    # Cells beside the source, or with no inverse at all, have nulls and are not joined.
    off = terrain.regrid(src, ["v"], lambda lon, lat: (lon, lat),
                         lambda x, y: (F.when(x > 15, F.lit(None)).otherwise(x + 8), y - 2), 0.0, 0.0, 1.0, -0.5, 0.5, 1.0)
    assert "Union" in _plan(off)
    got = {(r.row, r.col): r.v for r in off.collect()}
    assert got == {(r, c): (c + 8) * 10 + r + 2 if c + 8 < 20 and r + 2 < 5 else None for r in range(5) for c in range(20)}


def test_cells_of_a_grid_are_made_from_numbers(spark, monkeypatch):
    monkeypatch.setattr(terrain, "RUN", 7, raising=False)
    monkeypatch.setattr(terrain, "CELLS_A_TASK", 40, raising=False)
    src = spark.createDataFrame([(0, 0), (30, 0), (3, 600), (None, 4), (5, None)], "x long, y long")
    cells = terrain.target_cells(F.col("x") + 0.5, F.col("y") * -1.0, src, 10.0, -100.0, 1.0)
    assert "Exchange" not in _plan(cells)  # nothing is listed by one task and dealt out
    assert cells.rdd.getNumPartitions() >= 601 * 31 // 40  # tasks grow with the cells
    assert sorted((r.row, r.col) for r in cells.collect()) == [(r, c) for r in range(-100, 501) for c in range(-10, 21)]
    assert terrain.target_cells(F.col("x"), F.col("y"), src.filter("x > 30"), 0.0, 0.0, 1.0).count() == 0


def test_regrid_utm_works_out_a_line_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(terrain, "RUN", 100, raising=False)
    keys = [*range(128), *range(64 * 600, 64 * 600 + 64)]  # two pieces, six degrees apart
    spark.createDataFrame([(k,) for k in keys], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame([(k, 10.5 + k % 900) for k in keys[1:]], "l_partkey long, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    out = load_all()["regrid_utm"].build(spark, str(tmp_path))
    above = [line for line in _plan(out).split("Range (")[0].splitlines() if "Generate explode" not in line and "Project" in line and "col#" in line]
    assert above and not any(f in line for line in above for f in ("SIN(", "COS(", "TAN(", "POWER(", "SQRT("))

    # All cells of the extent, by the inverse series written out for each.
    def to_utm(lon, lat):
        phi, e2 = np.radians(lat), geo.WGS84_F * (2 - geo.WGS84_F)
        ep2, n = e2 / (1 - e2), geo.WGS84_A / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        t, c, aa = np.tan(phi) ** 2, ep2 * np.cos(phi) ** 2, np.cos(phi) * np.radians(lon - 9)
        m = geo.WGS84_A * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * np.sin(2 * phi)
                           + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * np.sin(4 * phi) - 35 * e2 ** 3 / 3072 * np.sin(6 * phi))
        return (0.9996 * n * (aa + (1 - t + c) * aa ** 3 / 6 + (5 - 18 * t + t ** 2 + 72 * c - 58 * ep2) * aa ** 5 / 120) + 500000,
                0.9996 * (m + n * np.tan(phi) * (aa ** 2 / 2 + (5 - t + 9 * c + 4 * c ** 2) * aa ** 4 / 24 + (61 - 58 * t + t ** 2 + 600 * c - 330 * ep2) * aa ** 6 / 720)))

    def from_utm(x, y):
        e2 = geo.WGS84_F * (2 - geo.WGS84_F)
        ep2, e1 = e2 / (1 - e2), (1 - np.sqrt(1 - e2)) / (1 + np.sqrt(1 - e2))
        mu = y / (0.9996 * geo.WGS84_A * (1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256))
        f = (mu + (3 * e1 / 2 - 27 * e1 ** 3 / 32) * np.sin(2 * mu) + (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) * np.sin(4 * mu)
             + 151 * e1 ** 3 / 96 * np.sin(6 * mu) + 1097 * e1 ** 4 / 512 * np.sin(8 * mu))
        c, t, w = ep2 * np.cos(f) ** 2, np.tan(f) ** 2, 1 - e2 * np.sin(f) ** 2
        n, r = geo.WGS84_A / np.sqrt(w), geo.WGS84_A * (1 - e2) / w ** 1.5
        d = (x - 500000) / (n * 0.9996)
        lat = f - n * np.tan(f) / r * (d ** 2 / 2 - (5 + 3 * t + 10 * c - 4 * c ** 2 - 9 * ep2) * d ** 4 / 24
                                       + (61 + 90 * t + 298 * c + 45 * t ** 2 - 252 * ep2 - 3 * c ** 2) * d ** 6 / 720)
        lon = (d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c ** 2 + 8 * ep2 + 24 * t ** 2) * d ** 5 / 120) / np.cos(f)
        return np.degrees(lon) + 9, np.degrees(lat)

    elevation = {(k // 64, k % 64): float((10 + k % 900) % 3000) if k else 0.0 for k in keys}
    px, py = to_utm(*(np.array([f(k) for k in keys]) for f in (lambda k: 10 + 0.01 * (k // 64), lambda k: 45 - 0.01 * (k % 64))))
    row, col = np.meshgrid(np.arange(np.floor((4990000 - py.max()) / 600), np.floor((4990000 - py.min()) / 600) + 1),
                           np.arange(np.floor((px.min() - 570000) / 600), np.floor((px.max() - 570000) / 600) + 1))
    lon, lat = from_utm(570000 + (col + 0.5) * 600, 4990000 - (row + 0.5) * 600)
    places = zip(np.floor((lon - 10) / 0.01 + 0.5).ravel(), np.floor((45 - lat) / 0.01 + 0.5).ravel(), strict=True)
    want = {(r, c): elevation.get(p) for r, c, p in zip(row.ravel(), col.ravel(), places, strict=True)}
    got = out.toArrow().to_pydict()
    assert len(got["row"]) == len(want) and sum(v is not None for v in want.values()) > 200
    assert dict(zip(zip(got["row"], got["col"], strict=True), got["elevation"], strict=True)) == want


def test_folders_are_sorted_in_parts_of_bounded_rows(spark, monkeypatch):
    monkeypatch.setattr(harvest, "ROWS_A_PART", 20, raising=False)
    urls = [f"https://h/d{i % 400}/f{i}" for i in range(4000)] + [None, "https://h/top"]
    out = harvest.assets_by_folder(spark.createDataFrame([(u,) for u in urls], "url string"))
    rows = out.select("dir", "url", F.spark_partition_id().alias("p")).collect()
    assert sorted((r.url or "") for r in rows) == sorted(u or "" for u in urls)
    parts = {}
    for r in rows:
        parts.setdefault(r.p, []).append((r.dir or "", r.url or ""))
    assert len(parts) > 100 and all(v == sorted(v) for v in parts.values())
    assert len({(d, p) for p, v in parts.items() for d, _ in v}) == len({r.dir for r in rows})  # a folder is in one part
