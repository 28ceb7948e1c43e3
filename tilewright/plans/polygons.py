"""Queries over exact polygons: areas and rings of unions and differences, without cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import arranged, outlines, ways
from tilewright.plans.areas import _CLOSED, STEPS, _rings
from tilewright.plans.fixtures import sql, way_nodes
from tilewright.session import table

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections)
        return f

    return add


def _slab_sql(rings: str) -> str:
    """CTE ``gap`` (id, size, outer, inner): what lies between two edges in a slab of x where none cross, and in which rings it is.

    ``rings`` gives (id, way, hole). Rings are the bits of a number, which edges switch one after the other.
    """
    return f"""
, member AS (SELECT *, 1::UBIGINT << (row_number() OVER (PARTITION BY id ORDER BY way) - 1) AS bit FROM ({rings}))
, mask AS (SELECT id, bit_or(CASE WHEN hole THEN 0 ELSE bit END) AS outers, bit_or(CASE WHEN hole THEN bit ELSE 0 END) AS inners FROM member GROUP BY id)
, s AS (SELECT way, pos, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM r0 WINDOW w AS (PARTITION BY way ORDER BY pos))
, e AS (SELECT id, way, pos, bit, x, y, x2, y2 FROM member JOIN s USING (way) WHERE x <> x2)
, k AS (SELECT a.id, a.x, a.x2-a.x AS ux, a.y2-a.y AS uy, b.x2-b.x AS vx, b.y2-b.y AS vy, b.x-a.x AS wx, b.y-a.y AS wy FROM e a JOIN e b ON a.id = b.id AND (a.way, a.pos) < (b.way, b.pos))
, d AS (SELECT *, ux*vy-uy*vx AS det FROM k)
, stop AS (SELECT id, x FROM e UNION SELECT id, x2 FROM e UNION SELECT id, x+(wx*vy-wy*vx)/det*ux FROM d WHERE abs(det) > 1e-9 AND (wx*vy-wy*vx)/det BETWEEN 0 AND 1 AND (wx*uy-wy*ux)/det BETWEEN 0 AND 1)
, slab AS (SELECT id, x AS xl, lead(x) OVER (PARTITION BY id ORDER BY x) AS xr FROM stop)
, alive AS (SELECT id, xl, xr, bit, y+(xl-x)/(x2-x)*(y2-y) + y+(xr-x)/(x2-x)*(y2-y) AS h FROM slab JOIN e USING (id) WHERE xr > xl AND least(x, x2) <= xl + 1e-12 AND greatest(x, x2) >= xr - 1e-12)
, gap AS (SELECT id, (lead(h) OVER w - h)/2*(xr-xl) AS size, (bit_xor(bit) OVER w & outers) <> 0 AS outer_, (bit_xor(bit) OVER w & inners) <> 0 AS inner_
  FROM alive JOIN mask USING (id) WINDOW w AS (PARTITION BY id, xl ORDER BY h, bit ROWS UNBOUNDED PRECEDING))
"""


def _of_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """kind, id, inner, way, ring: rings of relations (outer or inner), and closed ways that no relation has."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way"), "o_custkey", "o_orderstatus")
    member = F.col("o_orderstatus") != "P"
    return orders.join(_rings(spark, sf_dir), "way").select(
        F.when(member, "relation").otherwise("way").alias("kind"), F.when(member, F.col("o_custkey")).otherwise(F.col("way")).alias("id"),
        (F.col("o_orderstatus") == "F").alias("inner"), "way", "ring")


_RELATIONS = """
SELECT CASE WHEN o_orderstatus = 'P' THEN -o_orderkey - 1 ELSE o_custkey END AS id, o_orderkey AS way, o_orderstatus = 'F' AS hole FROM orders JOIN big ON o_orderkey = way
"""


@query(
    "exact_multipolygons",
    _CLOSED + _slab_sql(_RELATIONS) + """
, a AS (SELECT id, sum(size) AS area FROM gap WHERE outer_ AND NOT inner_ GROUP BY id)
, n AS (SELECT id, count(*) FILTER (NOT hole) AS outers, count(*) FILTER (hole) AS holes FROM member GROUP BY id HAVING count(*) FILTER (NOT hole) > 0)
SELECT CASE WHEN id < 0 THEN 'way' ELSE 'relation' END AS kind, CASE WHEN id < 0 THEN -id - 1 ELSE id END AS id, outers, holes, round(coalesce(area, 0), 8) AS area, coalesce(area, 0) >= 0.1 AS accepted FROM n LEFT JOIN a USING (id)""",
    "way_nodes",
)
def exact_multipolygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of relations' polygons (the union of their outer rings less that of their inner ones) and of closed ways, and whether a filter by area takes them."""
    found = arranged.areas(_of_relations(spark, sf_dir), "ring", F.col("inner"), STEPS, "kind", "id").where("n_a > 0")
    area = F.coalesce("less", F.lit(0.0))
    return found.select("kind", "id", F.col("n_a").alias("outers"), F.col("n_b").alias("holes"), F.round(area, 8).alias("area"), (area >= 0.1).alias("accepted"))


@query(
    "exact_algebra",
    _CLOSED + _slab_sql("SELECT way // 10 AS id, way, way % 2 = 1 AS hole FROM big") + """
SELECT id AS area, round(coalesce(sum(size) FILTER (outer_ OR inner_), 0), 8) AS both, round(coalesce(sum(size) FILTER (outer_ AND inner_), 0), 8) AS common,
  round(coalesce(sum(size) FILTER (outer_ AND NOT inner_), 0), 8) AS less, round(coalesce(sum(size) FILTER (outer_ <> inner_), 0), 8) AS either FROM gap GROUP BY id""",
    "way_nodes",
)
def exact_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of union, intersection, difference and symmetric difference of the even and the odd ways of each ten."""
    own = _rings(spark, sf_dir).select(F.floor(F.col("way") / 10).alias("area"), (F.col("way") % 2 == 1).alias("inner"), "ring")
    found = arranged.areas(own, "ring", F.col("inner"), STEPS, "area").where("both IS NOT NULL")
    return found.select("area", *((F.round(c, 8) + 0.0).alias(c) for c in arranged.SETS))


@query("polygon_rings")
def polygon_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rings of relations' polygons: how many parts and holes, the area, the largest part's, and the length of the boundary."""
    each = arranged.parts(_of_relations(spark, sf_dir), "ring", F.col("inner"), STEPS, "less", "kind", "id")
    return each.groupBy("kind", "id").agg(
        F.count(F.when(F.col("area") > 0, 1)).alias("parts"), F.count(F.when(F.col("area") < 0, 1)).alias("holes"),
        F.round(F.sum("area"), 8).alias("area"), F.round(F.max("area"), 8).alias("largest"), F.round(F.sum("length"), 6).alias("length"))


#: Steps to a unit for outlines whose ends lie between the nodes' places; width and longest mitre.
FINE, WIDTH, LIMIT = 100_000, 0.01, 5.0


@query(
    "offset_polygons",
    _CLOSED + f"""
, c AS (SELECT way, row_number() OVER (PARTITION BY way ORDER BY pos) - 1 AS i, x, y FROM (SELECT *, lag(x) OVER v AS px, lag(y) OVER v AS py FROM r0 WINDOW v AS (PARTITION BY way ORDER BY pos)) WHERE px IS NULL OR px <> x OR py <> y)
, s AS (SELECT * FROM (SELECT way, i, x, y, lead(x) OVER v AS x2, lead(y) OVER v AS y2, count(*) OVER (PARTITION BY way) - 1 AS n FROM c WINDOW v AS (PARTITION BY way ORDER BY i)) WHERE x2 IS NOT NULL AND n > 2)
, v AS (SELECT *, -(y2-y)/sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS vx, (x2-x)/sqrt((x2-x)*(x2-x)+(y2-y)*(y2-y)) AS vy FROM s)
, t AS (SELECT a.*, b.vx AS wx, b.vy AS wy, CASE WHEN a.vx*b.vy-a.vy*b.vx > 0 THEN -{WIDTH} ELSE {WIDTH} END AS k, 1+a.vx*b.vx+a.vy*b.vy AS cos FROM v a JOIN v b ON a.way = b.way AND b.i = (a.i + 1) % a.n)
, f AS (SELECT *, k / CASE WHEN 2 > {LIMIT * LIMIT} * cos THEN 2.0 ELSE cos END AS far FROM t)
, q AS (
  SELECT way, 0 AS part, i::INTEGER AS j, x, y FROM s UNION ALL SELECT way, 0, n::INTEGER, x2, y2 FROM s WHERE i = n - 1
  UNION ALL SELECT way, i*2+1, unnest([0, 1, 2, 3, 4]), unnest([x+{WIDTH}*vx, x2+{WIDTH}*vx, x2-{WIDTH}*vx, x-{WIDTH}*vx, x+{WIDTH}*vx]), unnest([y+{WIDTH}*vy, y2+{WIDTH}*vy, y2-{WIDTH}*vy, y-{WIDTH}*vy, y+{WIDTH}*vy]) FROM f
  UNION ALL SELECT way, i*2+2, unnest([0, 1, 2, 3, 4]), unnest([x2, x2+k*vx, x2+far*(vx+wx), x2+k*wx, x2]), unnest([y2, y2+k*vy, y2+far*(vy+wy), y2+k*wy, y2]) FROM f)
, shape AS (SELECT way AS id, way * 100 + part AS way, part > 0 AS hole, j AS pos, round_even(x*{FINE}, 0)/{FINE} AS x, round_even(y*{FINE}, 0)/{FINE} AS y FROM q)
""" + _slab_sql("SELECT DISTINCT id, way, hole FROM shape").replace(", s AS (SELECT way, pos, x, y,", ", s2 AS (SELECT way, pos, x, y,").replace("FROM r0 WINDOW", "FROM shape WINDOW").replace("member JOIN s USING", "member JOIN s2 USING").replace("> 1e-9", "> 1e-13") + """
SELECT id AS way, round(coalesce(sum(size) FILTER (outer_ OR inner_), 0), 7) AS grown, round(coalesce(sum(size) FILTER (outer_ AND NOT inner_), 0), 7) AS shrunk FROM gap GROUP BY id""",
    "way_nodes",
)
def offset_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas of each closed way's polygon grown and shrunk by a width, with mitred corners."""
    found = arranged.offset_areas(_rings(spark, sf_dir), "ring", WIDTH, FINE, "way", limit=LIMIT)
    return found.select("way", *((F.round(c, 7) + 0.0).alias(c) for c in ("grown", "shrunk")))


@query(
    "simplified_ways",
    """
, n AS (SELECT way, count(*) AS n FROM way_nodes GROUP BY way)
, r AS (WITH RECURSIVE span(way, i, j) AS (
    SELECT way, 1::BIGINT, n FROM n
    UNION ALL
    SELECT way, unnest([i, k]), unnest([k, j]) FROM (
      SELECT way, i, j, -max((d, -pos))[2] AS k, max(d) AS d FROM (
        SELECT s.way, i, j, p.pos, round(sqrt(pow(p.x-a.x-l*(b.x-a.x),2)+pow(p.y-a.y-l*(b.y-a.y),2)), 12) AS d
        FROM span s JOIN way_nodes a ON a.way = s.way AND a.pos = i JOIN way_nodes b ON b.way = s.way AND b.pos = j JOIN way_nodes p ON p.way = s.way AND p.pos > i AND p.pos < j,
        LATERAL (SELECT CASE WHEN a.x = b.x AND a.y = b.y THEN 0 ELSE least(greatest(((p.x-a.x)*(b.x-a.x)+(p.y-a.y)*(b.y-a.y))/(pow(b.x-a.x,2)+pow(b.y-a.y,2)), 0), 1) END AS l)
      ) GROUP BY way, i, j) WHERE d > 0.2
  ) SELECT * FROM span)
, k AS (SELECT way, i AS pos FROM r UNION SELECT way, j FROM r)
SELECT way, count(*) AS nodes, CAST(sum(pos) AS BIGINT) AS places FROM k GROUP BY way""",
    "way_nodes",
)
def simplified_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which nodes of each way stay where it may be a fifth of the tile off: how many, and the sum of their places."""
    line = ways.lines(way_nodes(spark, sf_dir))
    axis = lambda a: F.transform("line", lambda p: p[a])
    kept = line.select("way", outlines.simplified(axis("x"), axis("y"), F.lit(0.2)).alias("k"))
    return kept.select("way", F.size("k").cast("bigint").alias("nodes"), F.aggregate("k", F.lit(0).cast("bigint"), lambda a, i: a + i + 1).alias("places"))
