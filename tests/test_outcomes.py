"""Small rules behind the outcome queries: XML paths, families, grids, folders of a signature."""

from pyspark.sql import functions as F

from eoframe.functions import documents as fdocs
from eoframe.operators import catalog, harvest, terrain
from eoframe.session import spread

GROUPS = {"G": ["A", "B"], "H": ["A"]}


def test_xml_paths_take_the_first_descendants():
    texts = ["<r><x><G><q><A> 1 </A></q><A>2</A><B>b<i>c</i>d</B></G></x><G><A>3</A></G><H/></r>",
             "<?xml version='1.0'?><!-- A --><r><H><G><A>&lt;&#65;</A></G><A><![CDATA[x<y]]></A></H></r>",
             "<G><A>1</A></G>", "<r><G><A>1</A></r>", "<r/>trailing", "no", "", None, "<r></r>", "<r><G><A/></G></r>"]
    values, errors = fdocs.parse_xml_paths(texts, GROUPS)
    assert values["G", "A"][:2] == [" 1 ", "<A"] and values["G", "B"][0] == "b" and values["H", "A"][:2] == [None, "<A"]
    assert values["G", "A"][2:] == [None] * 8            # a root is not inside itself; an empty element has no text
    assert [e and e.split(":")[0] for e in errors] == [None, None, None, "broken XML document", "broken XML document", "not an XML document",
                                                       "no document", "no document", None, None]


def test_sidecar_columns_stay(spark):
    df = spark.createDataFrame([(1, "<r><IMAGE_ATTRIBUTES><WRS_ROW> 7 </WRS_ROW></IMAGE_ATTRIBUTES></r>", "x"), (2, "<r", "y"), (3, None, "z")],
                               "id int, xml string, element string")
    got = {r.id: r for r in fdocs.extract_mtl(df, "xml", "m", error="why").collect()}
    assert got[1].m.landsat_wrs_row == "7" and got[1].why is None and got[1].element == "x" and got[1].m.datetime is None
    assert got[2].why.startswith("broken XML document") and got[3].why == "no document" and got[2].m.landsat_wrs_row is None
    assert fdocs.extract_mtl(df.limit(0), "xml", "m").count() == 0


def test_families_and_why_there_is_none(spark):
    df = spark.createDataFrame([(["a_level2", "b_level2"],), (["a_level2", "s2_l2a"],), (["dem"],), ([],), (["s2_sr"],)], "p array<string>")
    got = [tuple(r[0]) for r in df.select(catalog.family_or_error(F.col("p"))).collect()]
    assert got == [("c2", None), (None, "products of several families"), (None, "products of no known family"), (None, "no product"), ("c1", None)]


def test_tiles_come_back_as_cells(spark, tmp_path):
    rows = [(x, y, None if x == 3 else float(10 * y + x), x) for x in range(-3, 7) for y in range(5)]
    df = spark.createDataFrame(rows, "x long, y long, a double, b long")
    tiles = terrain.with_grid(terrain.tile_rows(df, ["a", "b"], {"a": -999, "b": 5}, 4), 4, 100.0, 50.0, 10.0, "epsg:1", {"a": -999, "b": 5})
    terrain.write_tiles(tiles.withColumn("product", F.lit("p")), str(tmp_path / "t"))
    back = {(r.band, r.x, r.y): (r.px, r.py, r.value) for r in terrain.untile(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert len(back) == 2 * len(rows)
    for x, y, a, b in rows:
        place = (100 + 10 * x + 5, 50 - 10 * y - 5)
        assert back["a", x, y] == (*place, a) and back["b", x, y] == (*place, None if b == 5 else float(b))


def test_folders_of_a_signature(spark):
    urls = ["https://h/a/f1/X_T1_B4.TIF", "https://h/a/f1/X_T1_B5.TIF", "https://h/a/f2/Y_T2_B5.TIF", "https://h/a/f2/Y_T2_B4.TIF", "https://h/b/f3/Z.txt"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = sorted((",".join(r.sig), r.folder) for r in harvest.folders_by_signature(df).collect())
    assert got == [("B4.TIF,B5.TIF", "f1"), ("B4.TIF,B5.TIF", "f2"), ("Z.txt", "f3")]
    assert [(r.n_folders, r.first_folder, r.last_folder) for r in harvest.signatures(df).orderBy("n_folders").collect()] == [(1, "f3", "f3"), (2, "f1", "f2")]


def test_spread_keeps_enough_parts(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide).rdd.getNumPartitions() == 64
