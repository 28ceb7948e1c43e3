"""Queries over meshes and profiles: smoothing of levels, exports of cells, closed profiles, banking of roads, files read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import shapes as S
from tilewright.operators import meshes, ways
from tilewright.plans.fixtures import anchors, raster, sql, triangles, way_nodes
from tilewright.plans.grids import _extent
from tilewright.plans.lines import _SEG, SCALE
from tilewright.plans.lines import SQL as _LINE_SQL
from tilewright.session import scratch_path, table, written
from tilewright.sources import elevation, texts

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections)
        return f

    return add


def _corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, tri, kind, corner, x, y of all triangles."""
    t = triangles(spark, sf_dir)
    each = F.array(*[F.struct(F.lit(i).alias("corner"), F.col(f"x{i}").alias("x"), F.col(f"y{i}").alias("y")) for i in (1, 2, 3)])
    return t.select("way", "tri", "kind", F.explode(each).alias("c")).select("way", "tri", "kind", "c.corner", "c.x", "c.y")


_CORNERS = """
, k AS (SELECT way, tri, kind, 1 AS corner, x1 AS x, y1 AS y FROM triangles UNION ALL SELECT way, tri, kind, 2, x2, y2 FROM triangles UNION ALL SELECT way, tri, kind, 3, x3, y3 FROM triangles)
"""


@query(
    "levelled_water",
    _CORNERS + """
, v0 AS (SELECT DISTINCT x, y, round(x*100 + y*50, 6) AS z FROM k)
, m0 AS (SELECT way, tri, avg(z) AS m FROM k JOIN v0 USING (x, y) WHERE kind % 3 = 0 GROUP BY way, tri)
, w1 AS (SELECT x, y, avg(m) AS z FROM k JOIN m0 USING (way, tri) GROUP BY x, y)
, v1 AS (SELECT x, y, coalesce(w1.z, v0.z) AS z FROM v0 LEFT JOIN w1 USING (x, y))
, m1 AS (SELECT way, tri, avg(z) AS m FROM k JOIN v1 USING (x, y) WHERE kind % 3 = 0 GROUP BY way, tri)
, w2 AS (SELECT x, y, avg(m) AS z FROM k JOIN m1 USING (way, tri) GROUP BY x, y)
, sea AS (SELECT DISTINCT x, y, true AS s FROM k WHERE kind % 3 = 1)
SELECT x, y, round(CASE WHEN sea.s THEN 0 ELSE coalesce(w2.z, v1.z) END, 6) + 0.0 AS z FROM v1 LEFT JOIN w2 USING (x, y) LEFT JOIN sea USING (x, y)""",
    "triangles",
)
def levelled_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevations of nodes after two passes of smoothing over inland water, and with the sea at zero."""
    k = written(_corners(spark, sf_dir), "corners")  # they are read six times
    nodes = k.select("x", "y").distinct().withColumn("z", F.round(F.col("x") * 100 + F.col("y") * 50, 6))
    level = meshes.smooth_levels(nodes, k.where("kind % 3 = 0"), ["way", "tri"], passes=2)
    sea = k.where("kind % 3 = 1").select("x", "y").distinct().withColumn("sea", F.lit(True))
    out = level.join(sea, ["x", "y"], "left")
    return out.select("x", "y", (F.round(F.when(F.col("sea"), 0.0).otherwise(F.col("z")), 6) + 0.0).alias("z"))


@query(
    "object_files",
    _CORNERS + """
, n AS (SELECT way // 20 AS cell, (way * 100 + tri) * 10 + corner AS ord, way, tri, corner, x, y FROM k)
, f AS (SELECT cell, x, y, row_number() OVER (PARTITION BY cell ORDER BY min(ord)) AS idx FROM n GROUP BY cell, x, y)
, t AS (SELECT n.cell, way, tri, max(CASE WHEN corner = 1 THEN idx END) AS a, max(CASE WHEN corner = 2 THEN idx END) AS b, max(CASE WHEN corner = 3 THEN idx END) AS c FROM n JOIN f ON f.cell = n.cell AND f.x = n.x AND f.y = n.y GROUP BY ALL)
SELECT cell, 'v' AS part, idx AS number, printf('v %.6f %.6f 0.000000', x, y) AS line FROM f
UNION ALL SELECT cell, 'f', row_number() OVER (PARTITION BY cell ORDER BY way, tri), printf('f %d %d %d', a, b, c) FROM t""",
    "triangles",
)
def object_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mesh of each cell as lines of an object file: vertices in order of first appearance, then faces."""
    k = _corners(spark, sf_dir).withColumn("cell", F.floor(F.col("way") / 20)).withColumn("at", (F.col("way") * 100 + F.col("tri")) * 10 + F.col("corner"))
    v = meshes.numbered_by_appearance(k, ["x", "y"], "at", "cell", "idx")
    faces = k.join(v, ["cell", "x", "y"]).groupBy("cell", "way", "tri").agg(*[F.max(F.when(F.col("corner") == i, F.col("idx"))).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))])
    number = F.row_number().over(Window.partitionBy("cell").orderBy("way", "tri")).cast("bigint")
    vertex_lines = v.select("cell", F.lit("v").alias("part"), F.col("idx").alias("number"), F.format_string("v %.6f %.6f 0.000000", "x", "y").alias("line"))
    return vertex_lines.unionByName(faces.select("cell", F.lit("f").alias("part"), number.alias("number"), F.format_string("f %d %d %d", "a", "b", "c").alias("line")))


@query(
    "closed_profiles",
    """
, r AS (SELECT way, pos, z, count(*) OVER (PARTITION BY way) AS n FROM way_nodes)
, w AS (SELECT a.way, a.pos, sum(b.z * CASE (b.pos - a.pos + 2 + a.n) % a.n WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 1 END) AS v FROM r a JOIN r b ON a.way = b.way AND (b.pos - a.pos + 2 + a.n) % a.n <= 4 WHERE a.n >= 5 GROUP BY a.way, a.pos)
SELECT way, pos, round(v / 9.0, 6) AS z FROM w""",
    "way_nodes",
)
def closed_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevations along closed ways of five nodes or more, smoothed around the joint."""
    each = way_nodes(spark, sf_dir).groupBy("way").agg(F.sort_array(F.collect_list(F.struct("pos", "z"))).alias("p")).where(F.size("p") >= 5)
    z = S.convolve_around(F.transform("p", lambda q: q["z"].cast("double")), [1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9])
    out = each.select("way", F.posexplode(F.transform(z, lambda v: F.round(v, 6))).alias("i", "z"))
    return out.select("way", (F.col("i") + 1).cast("bigint").alias("pos"), "z")


_SHIFTED = _LINE_SQL["way_shift"].partition("\nSELECT way, round(sum(x")[0].partition("\n, seg AS")[2]


@query(
    "banked_roads",
    ", seg AS" + _SHIFTED + """
, side AS (SELECT way, pos, n, x, y, x + 900.0/111319.49079327358 * (-1/0.7009092642998509*ty/s) AS sx, y + 900.0/111319.49079327358 * (tx/s) AS sy FROM u)
, spot AS (SELECT way, pos, n, x, y, CAST(least(greatest(round_even(x*lc, 0), 0), lc) AS BIGINT) AS c, CAST(least(greatest(round_even(y*lr, 0), 0), lr) AS BIGINT) AS r,
  CAST(least(greatest(round_even(sx*lc, 0), 0), lc) AS BIGINT) AS sc, CAST(least(greatest(round_even(sy*lr, 0), 0), lr) AS BIGINT) AS sr FROM side, (SELECT max(row) AS lr, max(col) AS lc FROM raster))
, z AS (SELECT spot.way, max(abs(p.value - q.value)) AS bank FROM spot JOIN raster p ON p.row = r AND p.col = c JOIN raster q ON q.row = sr AND q.col = sc GROUP BY spot.way)
, apt AS (SELECT DISTINCT (s_suppkey*37%100) + dx AS ax, (s_suppkey*131%100) + dy AS ay FROM anchors, range(-1, 2) AS t(dx), range(-1, 2) AS v(dy))
, ends AS (SELECT way, bool_or(apt.ax IS NOT NULL) AS near FROM spot LEFT JOIN apt ON ax = CAST(round_even(x*100, 0) AS BIGINT) AND ay = CAST(round_even(y*100, 0) AS BIGINT) WHERE pos = 1 OR pos = n GROUP BY way)
SELECT way, near, bank, near OR bank >= 300 AS banked FROM ends JOIN z USING (way)""",
    "way_nodes", "raster", "anchors",
)
def banked_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads that are levelled: an end lies at an airport, or the ground falls off by much beside some node."""
    lines = ways.lines(way_nodes(spark, sf_dir)).where(F.size("line") > 1)
    both = lines.select("way", F.size("line").alias("n"), F.posexplode(F.arrays_zip(F.col("line").alias("p"), S.shift("line", F.lit(900.0), SCALE).alias("q"))).alias("i", "s"))
    cell = lambda v, most: F.least(F.greatest(F.rint(v * most), F.lit(0.0)), most.cast("double")).cast("bigint")
    at = both.crossJoin(_extent(spark, sf_dir)).select("way", "n", "i", F.col("s.p").alias("p"), *[cell(F.col(f"s.{t}.{a}"), F.col(most)).alias(t + n) for t in "pq" for a, most, n in (("x", "last_col", "c"), ("y", "last_row", "r"))])
    ground = raster(spark, sf_dir)
    here = ground.select(F.col("row").alias("pr"), F.col("col").alias("pc"), F.col("value").alias("zp"))
    beside = ground.select(F.col("row").alias("qr"), F.col("col").alias("qc"), F.col("value").alias("zq"))
    bank = at.join(here, ["pr", "pc"]).join(beside, ["qr", "qc"]).groupBy("way").agg(F.max(F.abs(F.col("zp") - F.col("zq"))).alias("bank"))
    around = F.sequence(F.lit(-1), F.lit(1))
    a = anchors(spark, sf_dir).select((F.col("s_suppkey") * 37 % 100).alias("x"), (F.col("s_suppkey") * 131 % 100).alias("y"))
    a = a.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).select((F.col("x") + F.col("dx")).alias("ax"), (F.col("y") + F.col("dy")).alias("ay"))
    a = a.distinct().withColumn("hit", F.lit(True))
    ends = at.where("i = 0 OR i = n - 1").select("way", F.rint(F.col("p.x") * 100).cast("bigint").alias("ax"), F.rint(F.col("p.y") * 100).cast("bigint").alias("ay"))
    near = ends.join(a, ["ax", "ay"], "left").groupBy("way").agg(F.bool_or(F.col("hit").isNotNull()).alias("near"))
    return near.join(bank, "way").select("way", "near", "bank", (F.col("near") | (F.col("bank") >= 300)).alias("banked"))


@query(
    "mesh_files",
    """
SELECT kind, count(*) AS n, round(sum(abs((x2-x1)*(y3-y1)-(x3-x1)*(y2-y1))/2), 6) AS area FROM triangles GROUP BY kind""",
    "triangles",
)
def mesh_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and elements of the mesh, written as text, read back and joined: triangles and area of each kind."""
    path = scratch_path(spark, "mesh")
    key = lambda i: (F.rint(F.col(f"x{i}") * 1000) * 1000 + F.rint(F.col(f"y{i}") * 1000)).cast("bigint")
    t = triangles(spark, sf_dir).withColumn("id", F.col("way") * 100 + F.col("tri"))
    nodes = _corners(spark, sf_dir).select((F.rint(F.col("x") * 1000) * 1000 + F.rint(F.col("y") * 1000)).cast("bigint").alias("id"), "x", "y", F.lit(0.0).alias("z")).distinct()
    texts.write_nodes(nodes, f"{path}/nodes")
    texts.write_elements(t.select("id", *[key(i).alias(n) for i, n in ((1, "a"), (2, "b"), (3, "c"))], "kind"), f"{path}/elements")
    n = texts.read_nodes(spark, f"{path}/nodes")
    out = texts.read_elements(spark, f"{path}/elements")
    for c in "abc":
        out = out.join(n.select(F.col("id").alias(c), F.col("x").alias(f"x_{c}"), F.col("y").alias(f"y_{c}")), c)
    twice = (F.col("x_b") - F.col("x_a")) * (F.col("y_c") - F.col("y_a")) - (F.col("x_c") - F.col("x_a")) * (F.col("y_b") - F.col("y_a"))
    return out.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(F.abs(twice) / 2), 6).alias("area"))


@query(
    "elevation_dumps",
    """
SELECT row // 64 AS block, count(*) AS cells, CAST(min(value) AS DOUBLE) AS low, CAST(max(value) AS DOUBLE) AS high, CAST(sum(value) AS DOUBLE) AS total FROM raster GROUP BY 1""",
    "raster",
)
def elevation_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster written as blocks of 32-bit floats, and read back: extremes and sum of each block of 64 rows."""
    path = scratch_path(spark, "elevations")
    elevation.write_blocks(raster(spark, sf_dir), path, rows=64)
    back = elevation.read_blocks(spark, path)
    v = F.col("value").cast("double")
    return back.groupBy(F.floor(F.col("row") / 64).alias("block")).agg(F.count("*").alias("cells"), F.min(v).alias("low"), F.max(v).alias("high"), F.sum(v).alias("total"))


@query(
    "placed_objects",
    """
, o AS (SELECT s_suppkey AS obj, lon AS lon0, lat AS lat0, s_acctbal AS alt, (s_suppkey*37) % 360 AS heading FROM anchors)
, v AS (SELECT obj, i, lon0, lat0, alt, heading, (i % 3) * 10.0 AS xo, (i % 2) * 5.0 AS yo, (i % 4) * 20.0 AS zo FROM o, range(0, 12) AS t(i))
SELECT obj, i AS vertex, round(lon0 + (xo*cos(radians(heading)) - zo*sin(radians(heading))) / 111319.49079327358 / cos(radians(lat0)), 7) AS lon,
  round(lat0 - (xo*sin(radians(heading)) + zo*cos(radians(heading))) / 111319.49079327358, 7) AS lat, round(alt + yo, 3) AS z FROM v""",
    "anchors",
)
def placed_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects written as text with their anchor and heading, read back, turned and placed on the ground."""
    path = scratch_path(spark, "objects")
    o = anchors(spark, sf_dir).select(F.col("s_suppkey").alias("obj"), "lon", "lat", F.col("s_acctbal").alias("alt"), (F.col("s_suppkey") * 37 % 360).alias("heading"))
    vertex = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.format_string("VT %.3f %.3f %.3f 0 1 0 0 0", (i % 3) * 10.0, (i % 2) * 5.0, (i % 4) * 20.0))
    head = F.format_string("#%d ANCHOR %.12f %.12f %.12f %d", "obj", "lon", "lat", "alt", "heading")
    faces = F.array(F.lit("IDX10 0 1 2 3 4 5 6 7 8 9"), F.lit("IDX 10"), F.lit("IDX 11"), F.lit("TRIS 0 12"))
    lines = o.select(F.array_join(F.concat(F.array(head), vertex, faces), "\n").alias("value"))
    lines.write.text(path, lineSep="\n\n")
    found = texts.read_objects(spark, path, separator="\n\n")
    return found.select(
        F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("obj"), F.posexplode(texts.placed_vertices()).alias("vertex", "p")
    ).select("obj", F.col("vertex").cast("bigint").alias("vertex"), F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"), F.round("p.z", 3).alias("z"))


@query(
    "run_again",
    """
SELECT CAST(o_orderkey AS BIGINT) AS request, CASE WHEN o_orderkey % 7 > 1 THEN 1 WHEN o_orderkey % 7 = 1 THEN 2 END AS run, CASE WHEN o_orderkey % 7 = 0 THEN 'incomplete' ELSE 'done' END AS state FROM orders""".strip().replace("SELECT CAST", ", o AS (SELECT 1) SELECT CAST", 1),
    "anchors",
)
def run_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in three stages: what stays incomplete in the first run is written down and run once more."""
    from tilewright.streaming.queues import with_second_run

    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("bigint").alias("request"))
    fetched = lambda df, run: df.withColumn("complete", (F.col("request") % 7 > 1) | ((F.col("request") % 7 == 1) & F.lit(run == 2)))
    return with_second_run(requests, fetched)
