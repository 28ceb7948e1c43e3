"""Queries that bring things into shape: polygons in pieces of a size, triangles in an order of places, rasters in another projection."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import shapes as S
from tilewright.operators import meshes, outlines, rasters
from tilewright.plans.areas import _CLOSED, _rings
from tilewright.plans.fixtures import raster, sql, triangles, way_nodes
from tilewright.session import written

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections)
        return f

    return add


#: The largest side of a piece.
PIECE = 0.2


@query(
    "halved_polygons",
    _CLOSED + f"""
, p0 AS (SELECT way, list([x, y] ORDER BY pos) AS ring FROM r0 GROUP BY way)
, pieces AS (WITH RECURSIVE piece(way, ring) AS (
    SELECT way, ring FROM p0
    UNION ALL
    SELECT way, CASE WHEN len(c) > 0 THEN list_append(c, c[1]) ELSE c END FROM (
      SELECT way, flatten(list_transform(range(1, len(ring)), lambda i: CASE
          WHEN (ring[i][k]-edge)*sign >= 0 AND (ring[i+1][k]-edge)*sign >= 0 THEN [ring[i+1]]
          WHEN (ring[i][k]-edge)*sign < 0 AND (ring[i+1][k]-edge)*sign < 0 THEN []
          ELSE list_concat([CASE WHEN k = 1 THEN [edge, ring[i][o]+(edge-ring[i][k])/(ring[i+1][k]-ring[i][k])*(ring[i+1][o]-ring[i][o])] ELSE [ring[i][o]+(edge-ring[i][k])/(ring[i+1][k]-ring[i][k])*(ring[i+1][o]-ring[i][o]), edge] END],
            CASE WHEN (ring[i+1][k]-edge)*sign >= 0 THEN [ring[i+1]] ELSE [] END) END)) AS c
      FROM (SELECT *, CASE WHEN w >= h THEN 1 ELSE 2 END AS k, CASE WHEN w >= h THEN 2 ELSE 1 END AS o, floor(CASE WHEN w >= h THEN x0 + x1 ELSE y0 + y1 END / 2 * 1e6 + 0.5) / 1e6 AS edge
        FROM (SELECT *, x1 - x0 AS w, y1 - y0 AS h FROM (SELECT way, ring, list_min(list_transform(ring, lambda p: p[1])) AS x0, list_max(list_transform(ring, lambda p: p[1])) AS x1,
          list_min(list_transform(ring, lambda p: p[2])) AS y0, list_max(list_transform(ring, lambda p: p[2])) AS y1 FROM piece WHERE len(ring) > 0))
        WHERE greatest(w, h) > {PIECE}), (VALUES (1), (-1)) AS t(sign))
  ) SELECT way, ring FROM piece WHERE len(ring) > 0)
, a AS (SELECT way, list_sum(list_transform(range(1, len(ring)), lambda i: ring[i][1]*ring[i+1][2]-ring[i+1][1]*ring[i][2]))/2 AS area FROM pieces
  WHERE greatest(list_max(list_transform(ring, lambda p: p[1]))-list_min(list_transform(ring, lambda p: p[1])), list_max(list_transform(ring, lambda p: p[2]))-list_min(list_transform(ring, lambda p: p[2]))) <= {PIECE})
SELECT way, count(*) AS pieces, round(abs(sum(area)), 9) AS area, round(max(abs(area)), 9) AS largest FROM a GROUP BY way""",
    "way_nodes",
)
def halved_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons cut in halves until no piece is over a size: how many pieces, their area, and the largest one's."""
    pieces = outlines.halved(_rings(spark, sf_dir), "ring", PIECE, "way").select("way", F.col("area").alias("a"))
    return pieces.groupBy("way").agg(F.count("*").alias("pieces"), F.round(F.abs(F.sum("a")), 9).alias("area"), F.round(F.max(F.abs("a")), 9).alias("largest"))


def _spread_sql(v: str) -> str:
    out = f"greatest(least(floor({v}*65536), 65535), 0)::BIGINT"
    for step, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        out = f"(({out} | ({out} << {step})) & {mask})"
    return out


_PLACED = f"""
, m AS (SELECT way, tri, (x1+x2+x3)/3 AS x, (y1+y2+y3)/3 AS y FROM triangles)
, k AS (SELECT *, {_spread_sql("x")} | ({_spread_sql("y")} << 1) AS key FROM m)
, placed AS (SELECT *, row_number() OVER (ORDER BY key, way, tri) AS place FROM k)
"""


@query("triangle_order", _PLACED + "SELECT way, tri, place FROM placed", "triangles")
def triangle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangles of a mesh numbered anew, so that those near each other lie together."""
    return meshes.by_locality(triangles(spark, sf_dir), ["way", "tri"]).select("way", "tri", "place")


@query(
    "order_jumps",
    _PLACED + """
, o AS (SELECT x, y, place, row_number() OVER (ORDER BY way, tri) AS old FROM placed)
, j AS (SELECT 'before' AS sorted, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM o WINDOW w AS (ORDER BY old)
  UNION ALL SELECT 'after', x, y, lead(x) OVER w, lead(y) OVER w FROM o WINDOW w AS (ORDER BY place))
SELECT sorted, count(*) AS jumps, round(sum(abs(x2-x)+abs(y2-y)), 6) AS way_gone FROM j WHERE x2 IS NOT NULL GROUP BY sorted""",
    "triangles",
)
def order_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far it is from each triangle to the next one in all, before and after they are sorted by place."""
    from tilewright.operators.ways import numbered

    x, y = meshes.barycentre()
    tri = triangles(spark, sf_dir)
    both = {"before": numbered(tri, [F.col("way"), F.col("tri")], "place"), "after": meshes.by_locality(tri, ["way", "tri"])}
    out = None
    for name, mesh in both.items():
        at = written(mesh.select("place", x.alias("x"), y.alias("y")), "places")
        following = at.select((F.col("place") - 1).alias("place"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        gone = F.abs(F.col("x2") - F.col("x")) + F.abs(F.col("y2") - F.col("y"))
        one = at.join(following, "place").agg(F.count("*").alias("jumps"), F.round(F.sum(gone), 6).alias("way_gone")).select(F.lit(name).alias("sorted"), "jumps", "way_gone")
        out = one if out is None else out.unionByName(one)
    return out


#: A raster of degrees from latitude TOP at its first row to the equator, and over SPAN degrees of longitude; the part of it that is taken; patches to a side.
TOP, SPAN, WEST, EAST, WIDE, PATCHES = 60.0, 10.0, 2.0, 8.0, 64, 8
_HIGH = math.asinh(math.tan(math.radians(TOP)))


@query(
    "warped_raster",
    f"""
, n AS (SELECT CAST(max(row)+1 AS BIGINT) AS n FROM raster)
, b AS (SELECT n, (k*n)//{PATCHES} AS r0, ((k+1)*n)//{PATCHES} AS r1, (l*{WIDE})//{PATCHES} AS c0, ((l+1)*{WIDE})//{PATCHES} AS c1 FROM n, range({PATCHES}) AS t(k), range({PATCHES}) AS u(l))
, s AS (SELECT r0, r1, c0, c1, """ + ", ".join(
        f"round_even(({TOP}-degrees(atan(sinh({_HIGH!r}*(1-r{i}/n)))))/{TOP}*n, 0) AS s{i}, round_even(({WEST}+c{i}/{WIDE}*{EAST - WEST})/{SPAN}*{WIDE}, 0) AS d{i}" for i in (0, 1)) + """ FROM b WHERE r1 > r0)
, g AS (SELECT *, unnest(range(r0, r1)) AS row FROM s)
, h AS (SELECT *, unnest(range(c0, c1)) AS col FROM g)
, spot AS (SELECT row, col, s0+(s1-s0)/(r1-r0)*(row-r0+0.5)-0.5 AS y, d0+(d1-d0)/(c1-c0)*(col-c0+0.5)-0.5 AS x FROM h)
, tap AS (SELECT spot.*, own.value AS own, i, j, abs(y-floor(y)-i) AS a, abs(x-floor(x)-j) AS b FROM spot JOIN raster own ON own.row = floor(y) AND own.col = floor(x), range(-1, 3) AS t(i), range(-1, 3) AS u(j))
, w AS (SELECT t.row, t.col, coalesce(z.value, own) AS v, CASE WHEN a <= 1 THEN (1.5*a-2.5)*a*a+1 WHEN a < 2 THEN ((2.5-0.5*a)*a-4)*a+2 ELSE 0 END AS wa, CASE WHEN b <= 1 THEN (1.5*b-2.5)*b*b+1 WHEN b < 2 THEN ((2.5-0.5*b)*b-4)*b+2 ELSE 0 END AS wb
  FROM tap t LEFT JOIN raster z ON z.row = floor(y)+i AND z.col = floor(x)+j)
SELECT CAST(row AS BIGINT) AS row, CAST(col AS BIGINT) AS col, round(sum(v*wa*wb), 6) + 0.0 AS value FROM w GROUP BY row, col""",
    "raster",
)
def warped_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raster of degrees brought into web mercator, by patches between exactly projected corners."""
    ground = raster(spark, sf_dir)
    c, n = F.col, F.col("n")
    side = F.explode(F.sequence(F.lit(0), F.lit(PATCHES - 1)))
    part = ground.agg((F.max("row") + 1).cast("bigint").alias("n")).select("n", side.alias("k")).select("n", "k", side.alias("l"))
    cut = lambda i, whole: F.floor(i * whole / PATCHES)
    wide = F.lit(WIDE)
    part = part.select("n", cut(c("k"), n).alias("r0"), cut(c("k") + 1, n).alias("r1"), cut(c("l"), wide).alias("c0"), cut(c("l") + 1, wide).alias("c1"))
    down = lambda r: F.rint((TOP - F.degrees(F.atan(F.sinh(_HIGH * (1 - r / n))))) / TOP * n)
    along = lambda x: F.rint((WEST + x / WIDE * (EAST - WEST)) / SPAN * WIDE)
    corner = {"nw": ("r0", "c0"), "sw": ("r1", "c0"), "se": ("r1", "c1"), "ne": ("r0", "c1")}
    patches = part.select("r0", "r1", "c0", "c1", *[F.struct(down(c(r)).alias("row"), along(c(x)).alias("col")).alias(k) for k, (r, x) in corner.items()])
    return rasters.warped(patches, ground).select("row", "col", (F.round("value", 6) + 0.0).alias("value"))
