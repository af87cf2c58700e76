"""Mixed documents, versioned tables and the bucketed key index."""

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eoframe.functions import mixed, temporal
from eoframe.operators import documents
from eoframe.sources import landed
from eoframe.sources.versions import VersionedTable
from eoframe.streaming.key_index import KeyIndex


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_versions_are_whole(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "part")
    with pytest.raises(ValueError):
        t.read()
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0), (4, None, 4.0)], "id int, part string, v double")
    assert t.replace(df) == 1
    # 2 moves from a to c, 3 changes in place, 9 is new without a partition; a and c and b and null change.
    new = spark.createDataFrame([(2, "c", 20.0), (3, "b", 30.0), (9, None, 9.0)], "id int, part string, v double")
    t.merge(new, "id")
    assert rows_of(t.read()) == sorted([(1, "a", 1.0), (2, "c", 20.0), (3, "b", 30.0), (4, None, 4.0), (9, None, 9.0)], key=repr)
    assert rows_of(t.read(1)) == rows_of(df)
    # A part that stays is listed from the version that wrote it.
    v = t.replace_partitions(spark.createDataFrame([(7, "b", 7.0)], "id int, part string, v double"), ["b", "zz"])
    assert {(r._part, r.source) for r in t._parts(v).collect()} == {("a", 2), ("b", 3), ("c", 2), ("", 2)}
    assert rows_of(t.read().filter("part = 'b'")) == [(7, "b", 7.0)]
    assert t.replace_partitions(df.limit(0), ["a"]) == 4 and t.read().filter("part = 'a'").count() == 0
    assert rows_of(t.read(2).filter("part = 'b'")) == [(3, "b", 30.0)]


def test_an_unfinished_version_does_not_count(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "part")
    t.replace(spark.createDataFrame([(1, "a")], "id int, part string"))
    os.makedirs(tmp_path / "t/parts/v=2")                      # a job that died before its list was whole
    spark.createDataFrame([(5, "x")], "id int, _part string").write.partitionBy("_part").parquet(str(tmp_path / "t/data/v=3"))
    assert t.versions() == [1] and rows_of(t.read()) == [(1, "a")]
    assert t.merge(spark.createDataFrame([(2, "b")], "id int, part string"), "id") == 4
    assert rows_of(t.read()) == [(1, "a"), (2, "b")]
    empty = VersionedTable(spark, str(tmp_path / "e"), "part")
    empty.replace(spark.createDataFrame([], "id int, part string"))
    assert empty.read().count() == 0 and empty.read().columns == ["id", "part"]


def test_update_products_reports_and_replaces(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "p"), "family")
    t.replace(spark.createDataFrame([("p1", "f", "old"), ("p2", "f", "old")], "name string, family string, d string"))
    more = spark.createDataFrame([("p2", "g", "new"), ("p3", "g", "new")], "name string, family string, d string")
    assert rows_of(documents.update_products(t, more)) == [("p2", "failed", "product already exists"), ("p3", "added", None)]
    assert rows_of(t.read()) == [("p1", "f", "old"), ("p2", "f", "old"), ("p3", "g", "new")]
    assert rows_of(documents.update_products(t, more, update=True)) == [("p2", "updated", None), ("p3", "updated", None)]
    assert rows_of(t.read()) == [("p1", "f", "old"), ("p2", "g", "new"), ("p3", "g", "new")]


SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("t", T.StringType())])


def index_of(spark, path, **kw):
    return KeyIndex(spark, str(path / "index"), SCHEMA, **kw)


def docs(spark, ids):
    return spark.createDataFrame([(i, f"t{i}") for i in ids], SCHEMA)


def test_a_batch_reads_only_buckets_it_may_hit(spark, tmp_path):
    index = index_of(spark, tmp_path, buckets=16, slices=2)
    assert index.add(docs(spark, range(400))) == {"added": 400, "suspects": 0, "buckets_read": 0}
    fresh = index.add(docs(spark, range(1000, 1050)))
    assert fresh["added"] == 50 and fresh["suspects"] <= 2 and fresh["buckets_read"] <= 2
    again = index.add(docs(spark, [3, 1001, 5000]))
    assert (again["added"], again["already"]) == (1, 2) and 1 <= again["buckets_read"] <= 3
    assert index.add(docs(spark, range(1000, 1050)))["already"] == 50  # a replay adds nothing
    assert sorted(r.id for r in index.read().collect()) == [*range(400), *range(1000, 1050), 5000]


def test_bits_without_documents_are_no_documents(spark, tmp_path):
    """As after a job that died between writing bits and documents."""
    index, other = index_of(spark, tmp_path), index_of(spark, tmp_path / "x")
    other.add(docs(spark, [1, 2]))
    spark.read.parquet(other.filters).write.partitionBy("bucket").parquet(index.filters)
    assert index.add(docs(spark, [1, 2, 3]))["added"] == 3
    assert index.add(docs(spark, [1, 2, 3]).withColumn("t", F.lit("x")), F.col("id") > 1)["already"] == 3
    assert index.add(docs(spark, []))["buckets_read"] == 0


def test_mixed_kinds_and_errors(spark, tmp_path):
    root = tmp_path / "docs"
    root.mkdir()
    (root / "a.yaml").write_text("""---
$schema: https://schemas.opendatacube.org/dataset
id: e1
properties: {datetime: 2020-01-02T03:04:05+02:00, "eo:a": 1, "EO:b": x, other: 2}
measurements: {red: {path: r.tif}, none: {}}
accessories: {red: {path: acc}}
lineage: {l1: [s1, s2]}
---
just text
---
id: l1
extent: {from_dt: "2020-01-01T00:00:00", to_dt: "2020-01-01T00:00:03"}
creation_dt: nonsense
image: {bands: {"1": {path: b1}}}
---
metadata_type: eo3
name: plain
metadata: {license: null}
license: CC0
---
something: else
""")
    (root / "b.yaml").write_text("a: [unclosed")
    (root / "c.json").write_text('{"type":"Feature","stac_version":"1","id":"i1","collection":"c","properties":{"start_datetime":"2020-05-05T00:00:00Z"}}\n\n[1]\n{"x":\n')
    got = landed.read_mixed(spark, str(root), str(root))
    v, kind = F.col("v"), F.col("kind")
    indexed = F.lit("2024-01-01").cast("timestamp_ntz")
    rows = got.select("kind", mixed.document_id(v, kind).alias("id"), mixed.center_time(v, kind).alias("t"), mixed.created_time(v, indexed).alias("c"),
                      mixed.file_paths(v, kind).alias("files"), mixed.source_ids(v, kind).alias("sources"), mixed.license_of(v, "d").alias("license"),
                      mixed.prefixed_properties(v, "eo:").alias("eo"), mixed.prefixed_properties(v, "EO:", False).alias("any"), "error").collect()
    by = {r.kind: r for r in rows if r.kind}
    assert set(by) == {"eo3", "legacy", "product", "item", "unknown"}
    assert by["eo3"].t == datetime(2020, 1, 2, 1, 4, 5) and by["eo3"].files == {"red": "acc"} and by["eo3"].sources == {"l1": ["s1", "s2"]}
    assert by["eo3"].eo == {"a": "1"} and by["eo3"]["any"] == {"a": "1", "b": "x"}
    assert by["legacy"].t == datetime(2020, 1, 1, 0, 0, 1, 500000) and by["legacy"].c == datetime(2024, 1, 1) and by["legacy"].files == {"1": "b1"}
    assert (by["product"].id, by["product"].license) == ("plain", None) and by["item"].license == "d"
    assert by["item"].t == datetime(2020, 5, 5)
    errors = [r.error for r in rows if r.error]
    assert sorted(e.split(":")[0] for e in errors) == ["ParserError", "not a JSON document", "not an object"]
    with pytest.raises(ValueError):
        landed.read_mixed(spark)


def test_times_and_their_fallbacks(spark):
    df = spark.createDataFrame([(None, "2020-01-01 00:00:00", "2020-01-03 00:00:00", "2019-05-05", True),
                                (None, "2020-01-01 00:00:00", None, "bad", True), (None, "2020-01-01 00:00:00", "2020-01-03 00:00:00", None, False),
                                ("2021-01-01 00:00:00", "2020-01-01 00:00:00", None, "", False)], "d string, s string, e string, c string, old boolean")
    ts = [F.col(c).cast("timestamp_ntz") for c in ("d", "s", "e")]
    got = df.select(temporal.representative_time(*ts, range_only=F.col("old")).alias("t"),
                    temporal.creation_time(F.lit(None).cast("timestamp_ntz"), "c", F.lit("2000-01-01").cast("timestamp_ntz")).alias("c")).collect()
    assert [r.t for r in got] == [datetime(2020, 1, 2), datetime(2020, 1, 1), datetime(2020, 1, 1), datetime(2021, 1, 1)]
    assert [r.c for r in got] == [datetime(2019, 5, 5), datetime(2000, 1, 1), datetime(2000, 1, 1), datetime(2000, 1, 1)]
