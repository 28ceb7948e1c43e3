"""Queries over polygons: multipolygons, clipping, encoding, sets of cells, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import shapes as S
from tilewright.operators import areas, arranged, planar, rings, ways
from tilewright.plans.fixtures import sql, triangles, way_nodes
from tilewright.plans.lines import _M, _S, _SEG, SCALE
from tilewright.plans.lines import SQL as _LINE_SQL
from tilewright.session import table

QUERIES, SQL = {}, {}
CELLS = 32
#: The lattice of the ways' nodes: steps to a unit.
STEPS = 1000


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections)
        return f

    return add


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = ways.lines(way_nodes(spark, sf_dir)).where(F.size("line") > 2)
    return lines.select("way", F.concat("line", F.slice("line", 1, 1)).alias("ring"))


_CLOSED = """
, big AS (SELECT way FROM way_nodes GROUP BY way HAVING count(*) > 2)
, r0 AS (SELECT way, pos, x, y FROM way_nodes JOIN big USING (way) UNION ALL SELECT way, max(pos)+1, arg_min(x,pos), arg_min(y,pos) FROM way_nodes JOIN big USING (way) GROUP BY way)
"""


def _clip_sql(x0: float, y0: float, x1: float, y1: float) -> str:
    """CTEs that cut the rings r0 to a rectangle, side by side; the last one is r4 (way, pos, x, y), closed."""
    out = []
    for k, (axis, other, at, sign) in enumerate((("x", "y", x0, 1), ("x", "y", x1, -1), ("y", "x", y0, 1), ("y", "x", y1, -1))):
        cut = f"{other}+({at}-{axis})/({axis}2-{axis})*({other}2-{other})"
        x, y = (f"{at}", cut) if axis == "x" else (cut, f"{at}")
        out.append(f"""
, s{k} AS (SELECT * FROM (SELECT way, pos, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM r{k} WINDOW w AS (PARTITION BY way ORDER BY pos)) WHERE x2 IS NOT NULL)
, o{k} AS (SELECT way, pos*2 AS p, {x} AS x, {y} AS y FROM s{k} WHERE (({axis}-{at})*{sign} >= 0) <> (({axis}2-{at})*{sign} >= 0) UNION ALL SELECT way, pos*2+1, x2, y2 FROM s{k} WHERE ({axis}2-{at})*{sign} >= 0)
, n{k} AS (SELECT way, row_number() OVER (PARTITION BY way ORDER BY p) AS pos, x, y FROM o{k})
, r{k + 1} AS (SELECT * FROM n{k} UNION ALL SELECT way, max(pos)+1, arg_min(x,pos), arg_min(y,pos) FROM n{k} GROUP BY way)""")
    return "".join(out)


_LINE_SQL["clipped_rings"] = sql(
    _CLOSED + _clip_sql(0.25, 0.25, 0.75, 0.75) + """
, t AS (SELECT way, pos, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM r4 WINDOW w AS (PARTITION BY way ORDER BY pos))
, a AS (SELECT way, count(*) AS n, sum(x*y2-x2*y)/2 AS area FROM t GROUP BY way)
SELECT way, CAST(coalesce(n, 0) AS INT) AS nodes, round(abs(coalesce(area, 0)), 9) AS area FROM big LEFT JOIN a USING (way)""",
    "way_nodes",
)


@query(
    "encoded_polygons",
    _CLOSED + _clip_sql(0.1, 0.2, 0.9, 0.8) + f"""
, t AS (SELECT way, pos, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM r4 WINDOW w AS (PARTITION BY way ORDER BY pos))
, a AS (SELECT way, abs(sum(x*y2-x2*y))/2 AS area, sum(CASE WHEN x2 IS NULL THEN 1 ELSE floor(sqrt(pow((x-x2)*{_S},2)+pow(y-y2,2))*{_M}/10000)+1 END) AS n, min(x) AS x0, max(y) AS y1 FROM t GROUP BY way)
, z AS (SELECT way, max(z) AS z FROM way_nodes GROUP BY way)
SELECT way, CAST(n AS BIGINT) AS nodes, round(area, 9) AS area, true AS ccw, z AS altitude, round(x0, 9) AS x0, round(y1, 9) AS y1 FROM a JOIN z USING (way) WHERE area >= 0.0001""",
    "way_nodes",
)
def encoded_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons made ready for a mesh: clipped to the tile, small ones dropped, turned counter-clockwise, refined, with an altitude."""
    cut = _rings(spark, sf_dir).select("way", rings.clipped("ring", 0.1, 0.2, 0.9, 0.8).alias("ring")).where(F.abs(S.signed_area("ring")) >= 0.0001)
    fine = cut.select("way", S.refine(S.counter_clockwise("ring"), 10_000.0, SCALE).alias("ring"))
    z = way_nodes(spark, sf_dir).groupBy("way").agg(F.max("z").alias("altitude"))
    b = S.bounds("ring")
    return fine.join(z, "way").select(
        "way", F.size("ring").cast("bigint").alias("nodes"), F.round(S.signed_area("ring"), 9).alias("area"), (S.signed_area("ring") > 0).alias("ccw"), "altitude",
        F.round(b["x0"], 9).alias("x0"), F.round(b["y1"], 9).alias("y1"))


def _scan_sql(source: str, keys: str) -> str:
    """CTE ``cell`` (keys, r, c): cells of closed rings given as edges (keys, x, y, x2, y2), by the even-odd rule."""
    return f"""
, edge AS ({source})
, xs AS (SELECT {keys}, r, x + ((r+0.5)/{CELLS} - y)/(y2-y)*(x2-x) AS at FROM edge, range(0, {CELLS}) AS t(r) WHERE (y <= (r+0.5)/{CELLS}) <> (y2 <= (r+0.5)/{CELLS}))
, cell AS (SELECT {keys}, r, c FROM xs, range(0, {CELLS}) AS t(c) GROUP BY ALL HAVING count(CASE WHEN xs.at <= (c+0.5)/{CELLS} THEN 1 END) % 2 = 1)
"""


_WAY_EDGES = "SELECT way, x, y, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM r0 WINDOW w AS (PARTITION BY way ORDER BY pos)"
_WAY_CELLS = _CLOSED + _scan_sql(_WAY_EDGES, "way")


@query(
    "area_algebra",
    _WAY_CELLS + """
, m AS (SELECT way // 100 AS area, r, c, bool_or(way % 2 = 0) AS a, bool_or(way % 2 = 1) AS b FROM cell GROUP BY ALL)
SELECT area, count(*) AS both, count(*) FILTER (a AND b) AS common, count(*) FILTER (a AND NOT b) AS less, count(*) FILTER (a <> b) AS either FROM m GROUP BY area""",
    "way_nodes",
)
def area_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union, intersection, difference and symmetric difference of the even and the odd ways of an area, in cells."""
    rows = areas.rows_of(_rings(spark, sf_dir), "ring", CELLS, "way").withColumn("area", F.floor(F.col("way") / 100))
    m = areas.combined(rows, F.col("way") % 2 == 1, "area")
    n = lambda bits, name: areas.count_of(F.expr(bits)).alias(name)
    return m.groupBy("area").agg(n("a | b", "both"), n("a & b", "common"), n("a & ~b", "less"), n("a ^ b", "either"))


@query(
    "buffered_areas",
    _WAY_CELLS + """
, a AS (SELECT DISTINCT way // 40 AS area, r, c FROM cell)
, g AS (SELECT DISTINCT area, r + dr AS r, c + dc AS c FROM a, range(-3, 4) AS t(dr), range(-3, 4) AS u(dc))
, s AS (SELECT area, r + dr AS r, c + dc AS c FROM g, range(-1, 2) AS t(dr), range(-1, 2) AS u(dc) GROUP BY ALL HAVING count(*) = 9)
SELECT area, count(*) AS cells, min(r) AS top, max(c) AS east FROM s GROUP BY area""",
    "way_nodes",
)
def buffered_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas grown by two cells, with gaps of two cells closed."""
    some = _rings(spark, sf_dir).withColumn("area", F.floor(F.col("way") / 40))
    out = areas.buffered(areas.rows_of(some, "ring", CELLS, "area"), 2, 1, "area")
    return out.groupBy("area").agg(areas.count_of("bits").alias("cells"), F.min("row").alias("top"), F.max(areas.last_col()).alias("east"))


@query(
    "multipolygons",
    _WAY_CELLS + """
, m AS (SELECT o_custkey AS id, o_orderkey AS way, o_orderstatus AS role FROM orders JOIN big ON o_orderkey = way WHERE o_orderstatus IN ('O', 'F'))
, n AS (SELECT id, count(*) FILTER (role = 'O') AS outers, count(*) FILTER (role = 'F') AS holes FROM m GROUP BY id HAVING count(*) FILTER (role = 'O') > 0)
, k AS (SELECT id, r, c FROM m JOIN cell USING (way) GROUP BY ALL HAVING bool_or(role = 'O') AND NOT bool_or(role = 'F'))
, s AS (SELECT id, count(*) AS cells FROM k GROUP BY id)
SELECT 'relation' AS kind, id, outers, holes, coalesce(cells, 0) AS cells, coalesce(cells, 0) >= 100 AS accepted FROM n LEFT JOIN s USING (id)
UNION ALL SELECT 'way', o_orderkey, 1, 0, coalesce(cells, 0), coalesce(cells, 0) >= 100 FROM orders JOIN big ON o_orderkey = way LEFT JOIN (SELECT way, count(*) AS cells FROM cell GROUP BY way) w ON w.way = o_orderkey WHERE o_orderstatus = 'P'""",
    "way_nodes",
)
def multipolygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of relations (their outer rings less their inner ones) and of closed ways that no relation has, split by a filter on their area."""
    r = _rings(spark, sf_dir)
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way"), F.col("o_custkey").alias("relation"), "o_orderstatus").join(r, "way")
    in_relation = F.col("o_orderstatus") != "P"
    own = own.select(
        F.when(in_relation, "relation").otherwise("way").alias("kind"), F.when(in_relation, F.col("relation")).otherwise(F.col("way")).alias("id"),
        (F.col("o_orderstatus") == "F").alias("inner"), "ring")
    n = own.groupBy("kind", "id").agg(F.count(F.when(~F.col("inner"), 1)).alias("outers"), F.count(F.when(F.col("inner"), 1)).alias("holes")).where("outers > 0")
    m = areas.combined(areas.rows_of(own, "ring", CELLS, "kind", "id", "inner"), F.col("inner"), "kind", "id")
    out = n.join(m.groupBy("kind", "id").agg(areas.count_of(F.expr("a & ~b")).alias("cells")), ["kind", "id"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    return out.select("kind", "id", "outers", "holes", "cells", (F.col("cells") >= 100).alias("accepted"))


@query(
    "water_pre_masks",
    _scan_sql(
        "SELECT way, tri, kind, x1 AS x, y1 AS y, x2, y2 FROM triangles UNION ALL SELECT way, tri, kind, x2, y2, x3, y3 FROM triangles UNION ALL SELECT way, tri, kind, x3, y3, x1, y1 FROM triangles",
        "way, tri, kind",
    ) + """
, p AS (SELECT way // 20 AS tile, r, c, max(CASE WHEN kind = 1 THEN 1 WHEN kind IN (2, 3) THEN 2 ELSE 0 END) AS paint FROM cell GROUP BY ALL)
, t AS (SELECT tile, count(*) FILTER (paint = 0) AS land, count(*) FILTER (paint = 1) AS inland, count(*) FILTER (paint = 2) AS sea FROM p GROUP BY tile)
SELECT tile, land, inland, 1024 - land - inland AS black FROM t WHERE land < 1024 AND land + inland > 0""",
    "triangles",
)
def water_pre_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks painted from triangles: black, then land white, inland water grey, sea black; those of one colour are skipped."""
    kind = F.col("kind")
    corners = F.array(*[S.point(F.col(f"x{i}"), F.col(f"y{i}")) for i in (1, 2, 3, 1)])
    t = triangles(spark, sf_dir).select(F.floor(F.col("way") / 20).alias("tile"), F.when(kind == 1, 1).when(kind.isin(2, 3), 2).otherwise(0).alias("paint"), corners.alias("ring"))
    mask = areas.painted(areas.rows_of(t, "ring", CELLS, "tile", "paint"), F.col("paint"), [0, 1, 2], "tile")
    out = mask.groupBy("tile").agg(areas.count_of("v0").alias("land"), areas.count_of("v1").alias("inland"))
    whole = CELLS * CELLS
    return out.where(f"land < {whole} AND land + inland > 0").select("tile", "land", "inland", (whole - F.col("land") - F.col("inland")).alias("black"))


@query(
    "tile_pieces",
    _SEG + """
, i AS (SELECT way // 30 AS tile, way, pos, CAST(round(x*1000) AS BIGINT) AS x, CAST(round(y*1000) AS BIGINT) AS y, CAST(round(x2*1000) AS BIGINT) AS x2, CAST(round(y2*1000) AS BIGINT) AS y2, kind FROM seg WHERE x2 IS NOT NULL)
, g AS (SELECT * FROM i WHERE x <> x2 OR y <> y2)
, p AS (SELECT a.tile, a.way, a.pos, a.x, a.y, b.x AS qx, b.y AS qy, a.x2-a.x AS ux, a.y2-a.y AS uy, b.x2-b.x AS vx, b.y2-b.y AS vy, b.x-a.x AS wx, b.y-a.y AS wy FROM g a JOIN g b ON a.tile = b.tile AND (a.way, a.pos) <> (b.way, b.pos))
, k AS (SELECT *, ux*vy-uy*vx AS det, wx*vy-wy*vx AS s, wx*uy-wy*ux AS t, ux*ux+uy*uy AS long FROM p)
, m AS (SELECT *, s*sign(det) AS s1, t*sign(det) AS t1, abs(det) AS d FROM k)
, c AS (SELECT tile, way, pos, s1/d AS a, x*d+s1*ux AS xn, y*d+s1*uy AS yn, d FROM m WHERE d > 0 AND s1 BETWEEN 0 AND d AND t1 BETWEEN 0 AND d
  UNION ALL SELECT tile, way, pos, (wx*ux+wy*uy)/long, qx, qy, 1 FROM m WHERE d = 0 AND t = 0
  UNION ALL SELECT tile, way, pos, ((wx+vx)*ux+(wy+vy)*uy)/long, qx+vx, qy+vy, 1 FROM m WHERE d = 0 AND t = 0
  UNION ALL SELECT tile, way, pos, 0, x, y, 1 FROM g UNION ALL SELECT tile, way, pos, 1, x2, y2, 1 FROM g)
, stop AS (SELECT tile, way, pos, a, xn/d AS x, yn/d AS y, (xn // gcd(xn, d), d // gcd(xn, d), yn // gcd(yn, d), d // gcd(yn, d)) AS place FROM c WHERE a BETWEEN 0 AND 1)
, part AS (SELECT *, lead(place) OVER w AS place2, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM stop WINDOW w AS (PARTITION BY tile, way, pos ORDER BY a))
, once AS (SELECT tile, least(place, place2) AS e, greatest(place, place2) AS f, bit_or(kind) AS flags, any_value(sqrt(pow(part.x2-part.x,2)+pow(part.y2-part.y,2))) AS size FROM part JOIN (SELECT tile, way, pos, kind FROM g) USING (tile, way, pos) WHERE place2 IS NOT NULL AND place <> place2 GROUP BY 1, 2, 3)
SELECT tile, count(*) AS pieces, CAST(sum(flags) AS BIGINT) AS flags, round(sum(size)/1000, 4) AS length FROM once GROUP BY tile""",
    "way_nodes",
)
def tile_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segments of all ways of a tile in one arrangement: cut where they meet, and where they overlap along a line one piece with the flags of all."""
    seg = ways.segments(way_nodes(spark, sf_dir), "way", "pos", "kind").withColumn("tile", F.floor(F.col("way") / 30))
    found = arranged.measured(planar.on_lattice(seg, STEPS), "tile", flags="kind", bits=3)
    return found.select("tile", "pieces", "flags", F.round(F.col("length") / STEPS, 4).alias("length"))


@query(
    "surfaces_left",
    _WAY_CELLS + """
, odd AS (SELECT DISTINCT way // 100 AS area, r, c FROM cell WHERE way % 10 = 7)
SELECT way, count(*) AS cells FROM cell WHERE way % 2 = 0 AND NOT EXISTS (SELECT 1 FROM odd WHERE odd.area = cell.way // 100 AND odd.r = cell.r AND odd.c = cell.c) GROUP BY way""",
    "way_nodes",
)
def surfaces_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each even way's surface less all surfaces of its area whose number ends in seven."""
    rows = areas.rows_of(_rings(spark, sf_dir), "ring", CELLS, "way").withColumn("area", F.floor(F.col("way") / 100))
    left = areas.less(rows.where("way % 2 = 0"), rows.where("way % 10 = 7"), "area")
    return left.groupBy("way").agg(areas.count_of("bits").alias("cells"))


@query(
    "airport_boundaries",
    _WAY_CELLS + """
, m AS (SELECT o_custkey AS airport, o_orderstatus AS kind, r, c FROM orders JOIN cell ON way = o_orderkey)
SELECT airport, count(DISTINCT (r, c)) AS cells, count(DISTINCT CASE WHEN kind = 'O' THEN (r, c) END) AS given, min(r) AS south, max(r) AS north, min(c) AS west, max(c) AS east FROM m GROUP BY airport""",
    "way_nodes",
)
def airport_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of airports: the union of the one that is given and of all their surfaces, with its bounds."""
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way"), F.col("o_custkey").alias("airport"), (F.col("o_orderstatus") == "O").alias("given"))
    rows = areas.rows_of(_rings(spark, sf_dir).join(own, "way"), "ring", CELLS, "airport", "given")
    m = areas.combined(rows, F.col("given"), "airport").withColumn("bits", F.expr("a | b"))
    return m.groupBy("airport").agg(
        areas.count_of("bits").alias("cells"), areas.count_of("b").alias("given"), F.min("row").alias("south"), F.max("row").alias("north"), F.min(areas.first_col()).alias("west"), F.max(areas.last_col()).alias("east"))
