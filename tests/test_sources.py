"""Landed-file readers on small hand-written files."""

import json
import os

from eoframe.functions import documents as fdocs
from eoframe.sources import landed


def test_list_files_glob(spark, tmp_path):
    for p in ["a/b/x.yaml", "a/c/y.yml", "a/c/z.txt", "top.yaml"]:
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("k: 1\n")
    got = sorted(r.rel_path for r in landed.list_files(spark, str(tmp_path), "a/**.y*ml").collect())
    assert got == ["a/b/x.yaml", "a/c/y.yml"]
    assert [r.path for r in landed.explicit_list(spark, "p1, p2,").collect()] == ["p1", "p2"]


def test_yaml_documents(spark, tmp_path):
    (tmp_path / "p1.yaml").write_text("name: one\n---\n- not a mapping\n---\nmetadata:\n  product:\n    name: two\n")
    (tmp_path / "bad.yaml").write_text("key: [unclosed\n")
    docs = landed.read_documents(spark, str(tmp_path))
    rows = docs.collect()
    ok = sorted((os.path.basename(r.path), r.doc_pos) for r in rows if r.error is None)
    assert ok == [("p1.yaml", 0), ("p1.yaml", 1)]
    assert any(r.error for r in rows if r.path.endswith("bad.yaml"))
    names = sorted(r.name for r in landed.product_index(docs).collect())
    assert names == ["one", "two"]


def test_product_csv_last_wins(spark, tmp_path):
    (tmp_path / "products.csv").write_text("product,definition\na,u1\nb,u2\na,u3\n")
    got = {r.product: r.url for r in landed.read_product_csv(spark, str(tmp_path / "products.csv")).collect()}
    assert got == {"a": "u3", "b": "u2"}


def test_mtl_one_per_folder(spark, tmp_path):
    xml = ("<LANDSAT_METADATA_FILE><IMAGE_ATTRIBUTES><CLOUD_COVER>12.5</CLOUD_COVER>"
           "<DATE_ACQUIRED>2021-01-02</DATE_ACQUIRED><SCENE_CENTER_TIME>10:11:12.5Z</SCENE_CENTER_TIME>"
           "</IMAGE_ATTRIBUTES><PRODUCT_CONTENTS><FILE_NAME_BAND_4>S_SR_B4.TIF</FILE_NAME_BAND_4>"
           "</PRODUCT_CONTENTS></LANDSAT_METADATA_FILE>")
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "S_MTL.xml").write_text(xml)
    (tmp_path / "s2").mkdir()
    (tmp_path / "s2" / "A_MTL.xml").write_text(xml)
    (tmp_path / "s2" / "B_MTL.xml").write_text(xml)
    got = {os.path.basename(r.folder): r for r in landed.read_mtl(spark, str(tmp_path)).collect()}
    assert got["s1"].error is None and got["s2"].error == "several sidecar files"
    m = fdocs.extract_mtl(landed.read_mtl(spark, str(tmp_path)).filter("error IS NULL"), "xml", "m").first().m
    assert m.eo_cloud_cover == "12.5" and m.datetime == "2021-01-02T10:11:12.5Z"
    assert m.bands == {"red": "S_SR_B4.TIF"}


def test_geojson_and_stac(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"name": "a"},
         "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 1], [0, 1], [0, 0]]]}}]}
    (tmp_path / "f.geojson").write_text(json.dumps(fc))
    r = landed.read_geojson(spark, str(tmp_path / "f.geojson")).first()
    assert (r.minx, r.miny, r.maxx, r.maxy) == (0.0, 0.0, 2.0, 1.0)
    item = {"id": "i1", "collection": "landsat-c2-l2", "bbox": [1, 2, 3, 4],
            "properties": {"datetime": "2021-12-05T10:00:00Z", "platform": "landsat-8"},
            "assets": {"mtl.txt": {"href": "https://h/x_T1_MTL.txt"}, "red": {"href": "https://h/x_T1_SR_B4.TIF"}}}
    (tmp_path / "items.json").write_text(json.dumps(item) + "\n")
    items = landed.read_stac_items(spark, str(tmp_path / "items.json"))
    assert items.first().platform == "landsat-8"
    assert sorted(r.asset_key for r in landed.stac_item_assets(items).collect()) == ["mtl.txt", "red"]
