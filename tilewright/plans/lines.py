"""Queries over ways: lines, rings, edges."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import shapes as S
from tilewright.functions.geodesy import METRES_PER_DEGREE
from tilewright.operators import rings, ways
from tilewright.plans.fixtures import sql, way_nodes

QUERIES, SQL = {}, {}
SCALE = math.cos(math.radians(45.5))
_M, _S = repr(METRES_PER_DEGREE), repr(SCALE)
_SEG = """
, seg AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY way) AS n FROM way_nodes WINDOW w AS (PARTITION BY way ORDER BY pos))
"""


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections)
        return f

    return add


@query(
    "way_measures",
    _SEG + f"""
SELECT way, max(n) AS nodes, round(coalesce(sum(sqrt(pow((x2-x)*{_S},2)+pow(y2-y,2))),0)*{_M}, 3) AS metres,
  max(n) > 2 AND arg_min(x, pos) = arg_max(x, pos) AND arg_min(y, pos) = arg_max(y, pos) AS closed, round(coalesce(sum(x*y2-x2*y),0)/2, 6) + 0.0 AS area,
  min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM seg GROUP BY way""",
    "way_nodes",
)
def way_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length, closure, area and bounds of every way."""
    return ways.lines(way_nodes(spark, sf_dir)).select(
        "way", F.size("line").cast("bigint").alias("nodes"), F.round(S.length_m("line", SCALE), 3).alias("metres"), S.is_closed("line").alias("closed"),
        (F.round(S.signed_area("line"), 6) + 0.0).alias("area"), S.bounds("line").alias("b"),
    ).select("way", "nodes", "metres", "closed", "area", "b.*")


@query(
    "way_refine",
    _SEG + f"""
, cut AS (SELECT *, floor(sqrt(pow((x-x2)*{_S},2)+pow(y-y2,2))*{_M}/5000)+1 AS k FROM seg)
SELECT way, CAST(coalesce(sum(k),0)+1 AS BIGINT) AS nodes, round(coalesce(sum(k*x+(x2-x)*(k-1)/2),0)+arg_max(x,pos), 6) AS sum_x, round(coalesce(sum(k*y+(y2-y)*(k-1)/2),0)+arg_max(y,pos), 6) AS sum_y
FROM cut GROUP BY way""",
    "way_nodes",
)
def way_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways with points put into segments longer than 5 km."""
    fine = ways.lines(way_nodes(spark, sf_dir)).select("way", S.refine("line", 5000.0, SCALE).alias("line"))
    part = lambda c: F.round(S.total(F.transform("line", lambda p: p[c])), 6)
    return fine.select("way", F.size("line").cast("bigint").alias("nodes"), part("x").alias("sum_x"), part("y").alias("sum_y"))


@query(
    "way_shift",
    _SEG + f"""
, d AS (SELECT *, (x2-x)*{_S}/(1e-6+sqrt(pow((x2-x)*{_S},2)+pow(y2-y,2))) AS ux, (y2-y)/(1e-6+sqrt(pow((x2-x)*{_S},2)+pow(y2-y,2))) AS uy FROM seg)
, e AS (SELECT *, lag(ux) OVER w AS px, lag(uy) OVER w AS py, first_value(ux) OVER a AS fx, first_value(uy) OVER a AS fy, first_value(x) OVER a AS x_first, first_value(y) OVER a AS y_first,
  last_value(x) OVER a AS x_last, last_value(y) OVER a AS y_last FROM d WINDOW w AS (PARTITION BY way ORDER BY pos), a AS (PARTITION BY way ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
, l AS (SELECT *, max(CASE WHEN pos = n - 1 THEN ux END) OVER (PARTITION BY way) AS lx, max(CASE WHEN pos = n - 1 THEN uy END) OVER (PARTITION BY way) AS ly, n > 2 AND x_first = x_last AND y_first = y_last AS closed FROM e WHERE n > 1)
, t AS (SELECT *, CASE WHEN (pos = 1 OR pos = n) AND closed THEN fx + lx WHEN pos = 1 THEN ux WHEN pos = n THEN px ELSE px + ux END AS tx,
  CASE WHEN (pos = 1 OR pos = n) AND closed THEN fy + ly WHEN pos = 1 THEN uy WHEN pos = n THEN py ELSE py + uy END AS ty, NOT closed AND (pos = 1 OR pos = n) AS plain FROM l)
, u AS (SELECT *, CASE WHEN plain THEN 1 ELSE 1e-6+sqrt(tx*tx+ty*ty) END AS s FROM t)
SELECT way, round(sum(x + 500.0/{_M} * (-1/{_S}*ty/s)), 6) AS sum_x, round(sum(y + 500.0/{_M} * (tx/s)), 6) AS sum_y FROM u GROUP BY way""",
    "way_nodes",
)
def way_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways of two nodes or more moved 500 m to the left."""
    moved = ways.lines(way_nodes(spark, sf_dir)).where(F.size("line") > 1).select("way", S.shift("line", F.lit(500.0), SCALE).alias("line"))
    part = lambda c: F.round(S.total(F.transform("line", lambda p: p[c])), 6)
    return moved.select("way", part("x").alias("sum_x"), part("y").alias("sum_y"))


@query(
    "edge_flags",
    _SEG + """
, e AS (SELECT CASE WHEN (x, y) <= (x2, y2) THEN x ELSE x2 END AS ax, CASE WHEN (x, y) <= (x2, y2) THEN y ELSE y2 END AS ay, CASE WHEN (x, y) <= (x2, y2) THEN x2 ELSE x END AS bx, CASE WHEN (x, y) <= (x2, y2) THEN y2 ELSE y END AS b_y,
  CAST(1 << (kind % 8) AS INT) AS f FROM seg WHERE x2 IS NOT NULL)
SELECT ax AS x, ay AS y, bx AS x2, b_y AS y2, bit_or(f) AS flags FROM e WHERE NOT (ax = bx AND ay = b_y) GROUP BY ax, ay, bx, b_y""",
    "way_nodes",
)
def edge_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undirected edges with the flags of all segments on them."""
    seg = ways.segments(way_nodes(spark, sf_dir), "way", "pos", "kind")
    return ways.merged_edges(seg, F.expr("shiftleft(1, kind % 8)"))


@query(
    "snapped_edges",
    _SEG + """
, r AS (SELECT round_even(x*100.0e0,0)/100.0e0 AS x, round_even(y*100.0e0,0)/100.0e0 AS y, round_even(x2*100.0e0,0)/100.0e0 AS x2, round_even(y2*100.0e0,0)/100.0e0 AS y2, CAST(1 << (kind % 8) AS INT) AS f FROM seg WHERE x2 IS NOT NULL)
, e AS (SELECT CASE WHEN (x, y) <= (x2, y2) THEN x ELSE x2 END AS ax, CASE WHEN (x, y) <= (x2, y2) THEN y ELSE y2 END AS ay, CASE WHEN (x, y) <= (x2, y2) THEN x2 ELSE x END AS bx, CASE WHEN (x, y) <= (x2, y2) THEN y2 ELSE y END AS b_y, f FROM r)
, m AS (SELECT ax, ay, bx, b_y, bit_or(f) AS flags FROM e WHERE NOT (ax = bx AND ay = b_y) GROUP BY ALL)
, node AS (SELECT round_even(x*100.0e0,0)/100.0e0 AS x, round_even(y*100.0e0,0)/100.0e0 AS y, arg_min(z, struct_pack(w := way, p := pos)) AS z FROM way_nodes GROUP BY ALL)
SELECT m.ax AS x, m.ay AS y, m.bx AS x2, m.b_y AS y2, flags, a.z AS z, b.z AS z2 FROM m JOIN node a ON a.x = m.ax AND a.y = m.ay JOIN node b ON b.x = m.bx AND b.y = m.b_y""",
    "way_nodes",
)
def snapped_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes snapped to a grid of 0.01, with the first z, and the edges between them."""
    rows = way_nodes(spark, sf_dir)
    seg = ways.segments(rows, "way", "pos", "kind").withColumn("flags", F.expr("shiftleft(1, kind % 8)"))
    node, edge = ways.snap(seg, rows, 2, ["way", "pos"])
    far = node.select(F.col("x").alias("x2"), F.col("y").alias("y2"), F.col("z").alias("z2"))
    return edge.join(node, ["x", "y"]).join(far, ["x2", "y2"]).select("x", "y", "x2", "y2", "flags", "z", "z2")


@query(
    "way_crossings",
    _SEG + """
, p AS (SELECT a.way, a.pos AS p, b.pos AS q, a.x2-a.x AS ux, a.y2-a.y AS uy, b.x-b.x2 AS vx, b.y-b.y2 AS vy, b.x-a.x AS wx, b.y-a.y AS wy, a.x AS x, a.y AS y FROM seg a JOIN seg b ON a.way = b.way AND a.pos < b.pos WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL)
, k AS (SELECT *, ux*vy-uy*vx AS det, sqrt((ux*ux+uy*uy)*(vx*vx+vy*vy)) AS size FROM p)
, c AS (SELECT *, (wx*vy-wy*vx)/det AS a, (ux*wy-uy*wx)/det AS b FROM k WHERE abs(det) > 1e-8*size AND det <> 0)
SELECT way, p, q, round(x+a*ux, 7) AS x, round(y+a*uy, 7) AS y FROM c WHERE a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND ((a > 1e-8 AND a < 1-1e-8) OR (b > 1e-8 AND b < 1-1e-8))""",
    "way_nodes",
)
def way_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where segments of one way cross each other: pairs meet in the grid cells that both pass."""
    seg = rings.in_cells(ways.segments(way_nodes(spark, sf_dir)), 0.25)
    one = seg.select("way", "cx", "cy", F.col("pos").alias("p"), S.point(F.col("x"), F.col("y")).alias("a"), S.point(F.col("x2"), F.col("y2")).alias("b"))
    two = seg.select("way", "cx", "cy", F.col("pos").alias("q"), S.point(F.col("x"), F.col("y")).alias("c"), S.point(F.col("x2"), F.col("y2")).alias("d"))
    met = one.join(two, ["way", "cx", "cy"]).where("p < q").withColumn("k", S.crossing(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).where("k IS NOT NULL")
    at = lambda c: F.round(F.col(f"a.{c}") + F.col("k.alpha") * (F.col(f"b.{c}") - F.col(f"a.{c}")), 7).alias(c)
    return met.select("way", "p", "q", at("x"), at("y")).distinct()


@query(
    "rings_around",
    """
, r AS (SELECT way, pos, x, y FROM way_nodes UNION ALL SELECT way, max(pos)+1, arg_min(x,pos), arg_min(y,pos) FROM way_nodes GROUP BY way)
, s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY way) AS n FROM r WINDOW w AS (PARTITION BY way ORDER BY pos))
, t AS (SELECT way, (x2-x)*(0.5-y)-(0.5-x)*(y2-y) AS side, y, y2 FROM s WHERE n > 3 AND x2 IS NOT NULL)
SELECT way, sum(CASE WHEN y <= 0.5 AND y2 > 0.5 AND side > 0 THEN 1 WHEN y > 0.5 AND y2 <= 0.5 AND side < 0 THEN -1 ELSE 0 END) <> 0 AS inside FROM t GROUP BY way""",
    "way_nodes",
)
def rings_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the ring of each way of three nodes or more winds around the middle of the tile."""
    rings = ways.lines(way_nodes(spark, sf_dir)).where(F.size("line") > 2).select("way", F.concat("line", F.slice("line", 1, 1)).alias("ring"))
    return rings.select("way", S.winding_contains("ring", F.lit(0.5), F.lit(0.5)).alias("inside"))


@query("clipped_rings")
def clipped_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of ways of three nodes or more, clipped to the middle quarter of the tile.

    Where a ring crosses itself, its area counts each place as often as the ring winds around it.
    """
    lines = ways.lines(way_nodes(spark, sf_dir)).where(F.size("line") > 2)
    cut = lines.select("way", S.clip(F.concat("line", F.slice("line", 1, 1)), 0.25, 0.25, 0.75, 0.75).alias("ring"))
    return cut.select("way", F.size("ring").alias("nodes"), F.round(F.abs(S.signed_area("ring")), 9).alias("area"))


@query(
    "levelled_roads",
    """
, w AS (SELECT way, count(*) AS size, max(kind) AS level, avg(z) AS z FROM way_nodes GROUP BY way)
, s AS (SELECT *, coalesce(sum(CASE WHEN z > 20 THEN size ELSE 0 END) OVER (ORDER BY way ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM w)
SELECT way, size, CASE WHEN level <= 2 THEN 'main' WHEN level <= 4 THEN 'side' ELSE 'track' END AS class, CAST(used AS BIGINT) AS used, z > 20 AND used < 20000 AS levelled FROM s""",
    "way_nodes",
)
def levelled_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roads by class, levelled while their running number of nodes stays under a limit."""
    w = way_nodes(spark, sf_dir).groupBy("way").agg(F.count("*").alias("size"), F.max("kind").alias("level"), F.avg("z").alias("z"))
    total = ways.running_total(w, "way", F.when(F.col("z") > 20, F.col("size")).otherwise(F.lit(0)), "used")
    kind = F.when(F.col("level") <= 2, "main").when(F.col("level") <= 4, "side").otherwise("track")
    return total.select("way", "size", kind.alias("class"), "used", ((F.col("z") > 20) & (F.col("used") < 20000)).alias("levelled"))


@query(
    "surface_profiles",
    """
, f AS (SELECT way, pos, z, count(*) OVER (PARTITION BY way) AS n FROM way_nodes)
SELECT way, pos, round(CASE WHEN n = 1 THEN 0 ELSE (pos-1)/(n-1) END, 9) AS r,
  round(3*pow(CASE WHEN n = 1 THEN 0 ELSE (pos-1)/(n-1) END,2)-2*pow(CASE WHEN n = 1 THEN 0 ELSE (pos-1)/(n-1) END,3), 9) AS spline, round(2*(CASE WHEN n = 1 THEN 0 ELSE (pos-1)/(n-1) END)-pow(CASE WHEN n = 1 THEN 0 ELSE (pos-1)/(n-1) END,2), 9) AS parabolic FROM f""",
    "way_nodes",
)
def surface_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transition profiles at each node's share of its way."""
    from tilewright.functions.profiles import transition

    n = F.expr("count(*) OVER (PARTITION BY way)")
    rows = way_nodes(spark, sf_dir).select("way", "pos", F.when(n == 1, F.lit(0.0)).otherwise((F.col("pos") - 1) / (n - 1)).alias("r"))
    return rows.select("way", "pos", F.round("r", 9).alias("r"), F.round(transition("r", "spline"), 9).alias("spline"), F.round(transition("r", "parabolic"), 9).alias("parabolic"))
