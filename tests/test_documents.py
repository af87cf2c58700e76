"""Document helpers: product upsert, JSON sink, map/key helpers, user hooks."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF_SMALL
from eoframe.functions import documents as fdocs
from eoframe.operators import catalog, explore, imaging
from eoframe.operators.documents import lookup_first, product_upsert, write_documents
from eoframe.sources.fixtures import view


def test_product_upsert(spark):
    existing = spark.createDataFrame([("a", "v1"), ("b", "v1")], "name string, d string")
    incoming = spark.createDataFrame([("b", "v2"), ("c", "v1")], "name string, d string")
    out, table = product_upsert(existing, incoming, update=False)
    assert {r.name: r.status for r in out.collect()} == {"b": "failed", "c": "added"}
    assert sorted((r.name, r.d) for r in table.collect()) == [("a", "v1"), ("b", "v1"), ("c", "v1")]
    out, table = product_upsert(existing, incoming, update=True)
    assert sorted((r.name, r.d) for r in table.collect()) == [("a", "v1"), ("b", "v2"), ("c", "v1")]


def test_write_documents_json(spark, tmp_path):
    df = spark.createDataFrame([("p", 1)], "product string, id int").select(
        "product", F.struct("id", F.lit("2020-01-02 03:04:05").cast("timestamp_ntz").alias("t")).alias("doc"))
    write_documents(df, str(tmp_path / "docs"))
    files = [os.path.join(r, f) for r, _, fs in os.walk(tmp_path / "docs") for f in fs if f.startswith("part")]
    lines = [json.loads(line) for f in files for line in open(f) if line.strip()]
    assert lines == [{"id": 1, "t": "2020-01-02T03:04:05"}]


def test_map_helpers(spark):
    df = spark.createDataFrame([({"bands_dict_red": "a", "bands_dict_nir": "b", "other": "c"},)], "m map<string,string>")
    got = df.select(fdocs.strip_prefix_keys("m", "bands_dict_").alias("x")).first().x
    assert got == {"red": "a", "nir": "b"}
    got = df.select(fdocs.strip_prefix_keys("m", "BANDS_DICT_", case_sensitive=False).alias("x")).first().x
    assert got == {"red": "a", "nir": "b"}
    lin = spark.createDataFrame([({"ard": {"id": "x1"}},)], "l map<string,struct<id:string>>")
    assert lin.select(fdocs.lineage_ids("l").alias("x")).first().x == {"ard": ["x1"]}
    meas = spark.createDataFrame([({"red": {"path": "r.tif"}, "nir": {"path": None}}, {"mtl": {"path": "m.txt"}})],
                                 "m map<string,struct<path:string>>, a map<string,struct<path:string>>")
    assert meas.select(fdocs.file_offsets("m", "a").alias("x")).first().x == {"red": "r.tif", "mtl": "m.txt"}


def test_template_fill_and_missing(spark):
    df = spark.createDataFrame([("a: <x>  # note\nb: <y>\n", {"x": "1", "y": "2"}), ("a: <x> <z>", {"x": "1"})],
                               "t string, v map<string,string>")
    got = df.select(fdocs.fill_template("t", "v").alias("f"), fdocs.missing_placeholders("t", "v").alias("m")).collect()
    assert got[0].f == "a: 1\nb: 2\n" and got[0].m == []
    assert got[1].f is None and got[1].m == ["z"]


def test_priority(spark):
    df = spark.createDataFrame([("id",), ("zzz",), ("label",)], "k string")
    ranks = [r[0] for r in df.select(explore.priority_rank("k", ["id", "label"])).collect()]
    assert ranks == [1, 999, 2]


def test_predicate_udf_and_map_blocks(spark):
    sc = view(spark, SF_SMALL, "scenes")
    pred = catalog.predicate_udf(lambda d: d.cloud_cover < 10)(F.struct("cloud_cover"))
    assert catalog.find_scenes(sc, predicate=pred).count() == sc.filter("cloud_cover < 10").count()
    doubled = imaging.map_blocks(sc.select("id"), lambda pdf: pdf.assign(id=pdf["id"] * 2), "id long")
    assert doubled.agg(F.sum("id")).first()[0] == 2 * sc.agg(F.sum("id")).first()[0]


def test_lookup_first(spark):
    req = spark.createDataFrame([("a",), ("q",)], "name string")
    cat = spark.createDataFrame([("a", 2, "second"), ("a", 1, "first")], "name string, pos int, d string")
    got = {r.name: (r.d, r.error) for r in lookup_first(req, cat, "name", "pos", "d").collect()}
    assert got == {"a": ("first", None), "q": (None, "no document named q")}
