import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import ways
from tilewright.sources import elevation, osm, texts

XML = """<?xml version="1.0"?>
<osm>
 <node id="1" lat="1.0" lon="2.0"><tag k="a" v="b"/></node>
 <node id="2" lat="1.0" lon="2.0"/>
 <node id="3" lat="1.5" lon="2.5"/>
 <way id="7"><nd ref="1"/><nd ref="3"/><nd ref="99"/><tag k="natural" v="water"/></way>
 <way id="8"><tag k="empty" v="yes"/></way>
 <relation id="9"><member type="way" ref="7" role="outer"/><member type="way" ref="8" role="label"/><member type="node" ref="1" role="outer"/><tag k="x" v="y"/></relation>
</osm>
"""


def test_osm(spark, tmp_path):
    path = tmp_path / "a.osm"
    path.write_text(XML)
    n, w, r = osm.nodes(spark, str(path)), osm.ways(spark, str(path)), osm.relations(spark, str(path))
    assert {x["id"]: x["tags"] for x in n.collect()} == {1: {"a": "b"}, 2: {}, 3: {}}
    assert [(x["id"], x["nodes"], x["tags"]) for x in w.collect()] == [(7, [1, 3, 99], {"natural": "water"})]
    assert [(x["id"], x["outer"], x["inner"]) for x in r.collect()] == [(9, [7], [])]
    assert {x["id"]: x["kept"] for x in osm.merged_nodes(n).collect()} == {1: 1, 2: 1, 3: 3}
    line = ways.resolve(w.select(F.col("id").alias("way"), "nodes"), n.select(F.col("id").alias("node"), F.col("lon").alias("x"), F.col("lat").alias("y"))).first()["line"]
    assert [(p.x, p.y) for p in line] == [(2.0, 1.0), (2.5, 1.5)]
    assert osm.truncated(spark, str(path)).count() == 0
    (tmp_path / "b.osm").write_text(XML[:200])
    assert osm.truncated(spark, f"{tmp_path}/*.osm").count() == 1
    osm.write(n, w, f"{tmp_path}/out")
    assert {x["id"] for x in osm.nodes(spark, f"{tmp_path}/out/node").collect()} == {1, 2, 3}
    assert osm.ways(spark, f"{tmp_path}/out/way").first()["nodes"] == [1, 3, 99]


@pytest.mark.parametrize("kind", ["hgt", "raw"])
def test_elevation(spark, tmp_path, kind):
    z = np.arange(49).reshape(7, 7).astype("i2")
    z[2, 3] = elevation.NO_DATA
    (tmp_path / f"N47W123.{kind}").write_bytes((z.astype(">i2") if kind == "hgt" else z[::-1].astype("<i2")).tobytes())
    got = {(r["row"], r["col"]): r["value"] for r in elevation.read(spark, str(tmp_path)).where("lat = 47 AND lon = -123 AND n = 7").collect()}
    assert got == {(r, c): None if (r, c) == (2, 3) else float(z[r, c]) for r in range(7) for c in range(7)}
    assert elevation.info(spark, str(tmp_path)).first()["n"] == 7


def test_catalogs(spark, tmp_path):
    (tmp_path / "one.cfg").write_text("# note\nzoom=17\nname='x=y'\n\nratio=oops\n")
    (tmp_path / "two.cfg").write_text("flag=True\n")
    found = texts.catalog(spark, f"{tmp_path}/*.cfg")
    schema = {"zoom": ("int", 16), "name": ("string", ""), "ratio": ("double", 0.5), "flag": ("boolean", False)}
    rows = {r["name"]: r for r in texts.typed(found.withColumnRenamed("name", "name"), {k: v for k, v in schema.items() if k != "name"}).collect()}
    assert (rows["one"]["zoom"], rows["one"]["ratio"], rows["two"]["flag"], rows["two"]["zoom"]) == (17, 0.5, True, 16)
    common = spark.createDataFrame([("all", {"zoom": "12"})], "name string, entries map<string,string>")
    assert {r["name"]: r["zoom"] for r in texts.typed(found, {"zoom": ("int", 16)}, common).collect()} == {"one": 17, "two": 12}
    (tmp_path / "l.comb").write_text("#x\nA def none low\n\nB ext dark  high\n")
    assert [(r["line"], r["layer"], r["rank"]) for r in texts.ordered_lines(spark, f"{tmp_path}/l.comb", ["layer", "extent", "colour", "rank"]).collect()] == [(1, "A", "low"), (3, "B", "high")]


def test_lists_and_meshes(spark, tmp_path):
    nodes = spark.range(20).select("id", (F.col("id") / 3).alias("x"), F.lit(0.5).alias("y"), F.lit(-1.0).alias("z"))
    texts.write_nodes(nodes, f"{tmp_path}/nodes")
    back = texts.read_nodes(spark, f"{tmp_path}/nodes").orderBy("id").collect()
    assert [r["id"] for r in back] == list(range(20)) and back[7]["x"] == pytest.approx(7 / 3, abs=1e-9)
    v = spark.range(4).selectExpr("CAST(id AS INT) idx", "id * 0.25D lon", "id * 0.5D lat", "id * 100D z", "0.1D nx", "0.2D ny")
    t = spark.createDataFrame([(0, 0, 1, 2, 1), (1, 1, 2, 3, 4)], "idx int, n1 int, n2 int, n3 int, kind int")
    texts.mesh_text(v, t).coalesce(1).write.text(f"{tmp_path}/mesh")
    vertices, triangles = texts.read_mesh(spark, f"{tmp_path}/mesh/*.txt")
    assert [tuple(r)[1:] for r in vertices.orderBy("idx").collect()] == [(i, i * 0.25, i * 0.5, i * 100.0, 0.1, 0.2) for i in range(4)]
    assert [tuple(r)[1:] for r in triangles.orderBy("idx").collect()] == [(0, 0, 1, 2, 1), (1, 1, 2, 3, 4)]


def test_repeated_keys_and_last_lines(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="1" lon="2"><tag k="a" v="x"/><tag k="b" v="y"/><tag k="a" v="z"/></node>\n<way id="3"><nd ref="1"/></way></osm>')
    assert osm.nodes(spark, f"{tmp_path}/a.osm").first()["tags"] == {"a": "z", "b": "y"}
    assert osm.truncated(spark, f"{tmp_path}/a.osm").count() == 0
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "one.cfg").write_text("k=1\nk=2\n")
    (tmp_path / "one.cfg").write_text("k=3\n")
    found = texts.catalog(spark, f"{tmp_path}/*/*.cfg").union(texts.catalog(spark, f"{tmp_path}/*.cfg"))
    assert sorted((r["name"], r["entries"]["k"]) for r in found.collect()) == [("one", "2"), ("one", "3")]
    none = spark.createDataFrame([], "name string, entries map<string,string>")
    assert {r["k"] for r in texts.typed(found, {"k": ("int", 0)}, none).collect()} == {2, 3}
    with pytest.raises(ValueError):
        texts.typed(found, {"k": ("int", 0)}, found)
    (tmp_path / "f.flt").write_text("# colours\nbrightness-contrast 5 -10\nsaturation 20\n")
    assert [(f["name"], f["args"]) for f in texts.filter_lists(spark, f"{tmp_path}/f.flt").first()["filters"]] == [("brightness-contrast", [5.0, -10.0]), ("saturation", [20.0])]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(5000)]
    (tmp_path / "long.txt").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    got = {r["line"]: r["value"] for r in texts.numbered_lines(spark, f"{tmp_path}/long.txt").collect()}
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == dict(enumerate(lines))


def test_large_meshes_are_written_in_parts(spark, tmp_path):
    v = spark.range(3000).selectExpr("CAST(id AS INT) idx", "id * 0.25D lon", "id * 0.5D lat", "id * 100D z", "0.1D nx", "0.2D ny")
    t = spark.range(2000).selectExpr("CAST(id AS INT) idx", "CAST(id AS INT) n1", "CAST(id + 1 AS INT) n2", "CAST(id + 2 AS INT) n3", "1 kind")
    texts.write_mesh(v, t, f"{tmp_path}/mesh")
    vertices, triangles = texts.read_mesh(spark, f"{tmp_path}/mesh", together=True)
    assert [tuple(r)[1:] for r in vertices.orderBy("idx").collect()] == [(i, i * 0.25, i * 0.5, pytest.approx(i * 100.0), 0.1, 0.2) for i in range(3000)]
    assert [tuple(r)[1:] for r in triangles.orderBy("idx").collect()] == [(i, i, i + 1, i + 2, 1) for i in range(2000)]


def test_caches_objects_and_folders(spark, tmp_path):
    from tilewright.sources import layers

    made = []
    make = lambda: made.append(1) or spark.range(3).toDF("id")
    assert [layers.cached(spark, f"{tmp_path}/t", make).count() for _ in range(2)] == [3, 3] and made == [1]
    (tmp_path / "o.obj").write_text("I ANCHOR 10.0 50.0 90\nVT 1 2 3 0 1 0 0 0\nVT 4 5 6 0 1 0 0 0\nVT 7 8 9 0 1 0 0 0\nIDX 2\nIDX 1\nIDX 0\nTRIS 0 3\n")
    o = texts.read_objects(spark, f"{tmp_path}/o.obj").withColumn("p", texts.placed_vertices(F.lit(100.0))).first()
    assert o["triangles"] == [[2, 1, 0]] and o["alt"] is None and o["heading"] == 90.0 and o["p"][0]["z"] == 102.0
    assert layers.folders(spark, str(tmp_path)).where("path LIKE '%o.obj'").count() == 1


def test_written_tables_can_be_cleared(spark, tmp_path, monkeypatch):
    import os

    from tilewright import session

    monkeypatch.setattr(session, "scratch_dir", lambda _: str(tmp_path))  # so that other tests' tables stay
    os.makedirs(f"{tmp_path}/tilewright/another")
    assert session.written(spark.range(5), "numbers").count() == 5 and len(os.listdir(f"{tmp_path}/tilewright")) == 2
    assert session.clear(spark) and os.listdir(f"{tmp_path}/tilewright") == ["another"]
    assert not session.clear(spark) and session.written(spark.range(3), "numbers").count() == 3
