"""Queries that put geometry together: rings, profiles, rectangles, arrangements, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import shapes as S
from tilewright.operators import rings, ways
from tilewright.operators.spatial import with_cells
from tilewright.plans.fixtures import anchors, sites, sql, way_nodes
from tilewright.plans.lines import _SEG

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections)
        return f

    return add


@query(
    "ring_assembly",
    """
, r AS (SELECT way, pos, x, y FROM way_nodes UNION ALL SELECT way, max(pos)+1, arg_min(x,pos), arg_min(y,pos) FROM way_nodes GROUP BY way)
, s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, count(*) OVER (PARTITION BY way) AS n FROM r WINDOW w AS (PARTITION BY way ORDER BY pos))
SELECT way, CAST(max(n) AS INT) AS nodes, round(abs(sum(x*y2-x2*y))/2, 6) AS area FROM s WHERE n > 3 GROUP BY way""",
    "way_nodes",
)
def ring_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way of three nodes or more as a relation of two-node fragments, some of them turned, put together again."""
    rows = way_nodes(spark, sf_dir).withColumn("n", F.expr("count(*) OVER (PARTITION BY way)")).where("n > 2")
    here, after = F.col("pos"), F.when(F.col("pos") == F.col("n"), 1).otherwise(F.col("pos") + 1).cast("bigint")
    pair = F.when(F.col("pos") % 2 == 0, F.array(here, after)).otherwise(F.array(after, here))
    made = rings.assemble(rows.select("way", F.col("pos").alias("fragment"), pair.alias("nodes")), "way")
    each = made.select("way", F.posexplode("nodes").alias("i", "pos")).join(rows.select("way", "pos", "x", "y"), ["way", "pos"])
    line = ways.lines(each.select("way", F.col("i").alias("pos"), "x", "y"))
    return line.select("way", F.size("line").alias("nodes"), F.round(F.abs(S.signed_area("line")), 6).alias("area"))


@query(
    "smallest_rectangles",
    """
, p AS (SELECT DISTINCT way, x, y FROM way_nodes)
, e AS (SELECT a.way, a.x, a.y, b.x - a.x AS ux, b.y - a.y AS uy FROM p a JOIN p b ON a.way = b.way AND (a.x <> b.x OR a.y <> b.y))
, d AS (SELECT e.way, e.x, e.y, ux, uy, sqrt(ux*ux+uy*uy) AS n, (p.x-e.x)*ux+(p.y-e.y)*uy AS along, (p.y-e.y)*ux-(p.x-e.x)*uy AS off FROM e JOIN p ON p.way = e.way)
, r AS (SELECT way, (max(along)-min(along))/n AS l, (max(off)-min(off))/n AS w FROM d GROUP BY way, x, y, ux, uy, n HAVING min(off) >= -1e-12)
, b AS (SELECT way, arg_min(struct_pack(l := greatest(l, w), w := least(l, w)), struct_pack(a := round(l*w, 9), b := round(-greatest(l, w), 9))) AS s FROM r GROUP BY way)
SELECT way, round(coalesce(s.l*s.w, 0), 9) + 0.0 AS area, round(coalesce(s.l, 0), 9) AS length, round(coalesce(s.w, 0), 9) + 0.0 AS width FROM (SELECT DISTINCT way FROM way_nodes) LEFT JOIN b USING (way)""",
    "way_nodes",
)
def smallest_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest rotated rectangle around each way."""
    each = way_nodes(spark, sf_dir).groupBy("way").agg(F.collect_list("x").alias("x"), F.collect_list("y").alias("y"))
    out = each.select("way", rings.smallest_rectangle("x", "y").alias("r"))
    return out.select("way", *[F.round(f"r.{c}", 9).alias(c) for c in ("area", "length", "width")])


@query(
    "planar_pieces",
    _SEG + """
, p AS (SELECT a.way, a.pos AS p, b.pos AS q, a.x2-a.x AS ux, a.y2-a.y AS uy, b.x-b.x2 AS vx, b.y-b.y2 AS vy, b.x-a.x AS wx, b.y-a.y AS wy FROM seg a JOIN seg b ON a.way = b.way AND a.pos < b.pos WHERE a.x2 IS NOT NULL AND b.x2 IS NOT NULL)
, k AS (SELECT *, ux*vy-uy*vx AS det, sqrt((ux*ux+uy*uy)*(vx*vx+vy*vy)) AS size FROM p)
, c AS (SELECT way, p, q, (wx*vy-wy*vx)/det AS a, (ux*wy-uy*wx)/det AS b FROM k WHERE abs(det) > 1e-8*size AND det <> 0)
, d AS (SELECT * FROM c WHERE a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1)
, e AS (SELECT DISTINCT way, p AS pos, round(a, 9) AS a FROM d WHERE a > 1e-8 AND a < 1-1e-8 UNION SELECT way, q, round(b, 9) FROM d WHERE b > 1e-8 AND b < 1-1e-8)
, m AS (SELECT way, count(*) AS n FROM e GROUP BY way)
SELECT s.way, count(*) + coalesce(max(m.n), 0) AS pieces, round(sum(sqrt(pow(x2-x,2)+pow(y2-y,2))), 6) AS length FROM seg s LEFT JOIN m USING (way) WHERE x2 IS NOT NULL GROUP BY s.way""",
    "way_nodes",
)
def planar_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each way's segments cut where they cross each other: number of pieces and their whole length."""
    seg = ways.segments(way_nodes(spark, sf_dir), "way", "pos", "kind").select("way", F.col("pos").alias("id"), "x", "y", "x2", "y2", F.col("kind").alias("flags"))
    pieces = rings.arrangement(seg, "way", None)  # a way has few segments
    size = F.sqrt(F.pow(F.col("x2") - F.col("x"), 2) + F.pow(F.col("y2") - F.col("y"), 2))
    return pieces.groupBy("way").agg(F.count("*").alias("pieces"), F.round(F.sum(size), 6).alias("length"))


@query(
    "weight_map",
    """
, apt AS (SELECT DISTINCT CAST(cx AS BIGINT) AS cx, CAST(cy AS BIGINT) AS cy FROM anchors, range(-183, 184) AS a(cx), range(-91, 92) AS b(cy) WHERE cx BETWEEN floor(lon-1.5) AND floor(lon+1.5) AND cy BETWEEN floor(lat-1.5) AND floor(lat+1.5))
, coast AS (SELECT CAST(floor(lon) AS BIGINT) AS cx, CAST(floor(lat) AS BIGINT) AS cy, max(1 + c_custkey % 4) AS w FROM sites GROUP BY 1, 2)
SELECT cx, cy, CAST(greatest(CASE WHEN apt.cx IS NULL THEN 1 ELSE 3 END, coalesce(w, 0)) AS BIGINT) AS weight FROM apt FULL JOIN coast USING (cx, cy)""",
    "anchors", "sites",
)
def weight_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of one-degree cells: set around airports, and at least that of the coast places in a cell."""
    a = anchors(spark, sf_dir)
    c = F.col
    apt = with_cells(a, c("lon") - 1.5, c("lat") - 1.5, c("lon") + 1.5, c("lat") + 1.5, 1.0).select(c("_cx").alias("cx"), c("_cy").alias("cy"), F.lit(3).alias("set")).distinct()
    coast = sites(spark, sf_dir).groupBy(F.floor("lon").alias("cx"), F.floor("lat").alias("cy")).agg(F.max(1 + c("c_custkey") % 4).alias("w"))
    return apt.join(coast, ["cx", "cy"], "full").select("cx", "cy", F.greatest(F.coalesce("set", F.lit(1)), F.coalesce("w", F.lit(0))).cast("bigint").alias("weight"))
