"""Queries over rasters and meshes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geodesy as G
from tilewright.functions import profiles as P
from tilewright.operators import meshes, rasters
from tilewright.plans.fixtures import points, raster, sites, sql, triangles
from tilewright.plans.tiling import _cell

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections)
        return f

    return add


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raster with everything below -150 as no data."""
    return raster(spark, sf_dir).withColumn("value", F.when(F.col("value") >= -150, F.col("value")))


def _extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the last row and column of the raster, which the globe is spread over."""
    return raster(spark, sf_dir).agg(F.max("row").alias("last_row"), F.max("col").alias("last_col"))


_HOLED = ", h AS (SELECT row, col, CASE WHEN value >= -150 THEN value END AS value FROM raster)\n"


@query(
    "raster_fill",
    _HOLED + """
, n1 AS (SELECT h.row, h.col, max(o.value) AS v FROM h JOIN h o ON abs(o.row-h.row)+abs(o.col-h.col) = 1 AND o.row BETWEEN h.row-1 AND h.row+1 AND o.col BETWEEN h.col-1 AND h.col+1 WHERE h.value IS NULL GROUP BY h.row, h.col)
, f1 AS (SELECT row, col, coalesce(h.value, v) AS value FROM h LEFT JOIN n1 USING (row, col))
, n2 AS (SELECT h.row, h.col, max(o.value) AS v FROM f1 h JOIN f1 o ON abs(o.row-h.row)+abs(o.col-h.col) = 1 AND o.row BETWEEN h.row-1 AND h.row+1 AND o.col BETWEEN h.col-1 AND h.col+1 WHERE h.value IS NULL GROUP BY h.row, h.col)
SELECT row, col, coalesce(f1.value, v, 0) AS value FROM f1 LEFT JOIN n2 USING (row, col)""",
    "raster",
)
def raster_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voids filled from their neighbours in two passes, the rest with zero."""
    return rasters.fill(holed(spark, sf_dir), 2, 0.0)


@query(
    "raster_gradient",
    """
, g AS (SELECT m.row, m.col, m.value, l.value AS l, r.value AS r, u.value AS u, d.value AS d FROM raster m LEFT JOIN raster l ON l.row = m.row AND l.col = m.col-1 LEFT JOIN raster r ON r.row = m.row AND r.col = m.col+1
  LEFT JOIN raster u ON u.row = m.row-1 AND u.col = m.col LEFT JOIN raster d ON d.row = m.row+1 AND d.col = m.col)
, s AS (SELECT row, col, CASE WHEN l IS NULL THEN (r-value)/30 WHEN r IS NULL THEN (value-l)/30 ELSE (r-l)/60 END AS dx, CASE WHEN u IS NULL THEN (value-d)/20 WHEN d IS NULL THEN (u-value)/20 ELSE (u-d)/40 END AS dy FROM g)
SELECT row, col, round(dx/sqrt(1+dx*dx+dy*dy), 9) AS nx, round(dy/sqrt(1+dx*dx+dy*dy), 9) AS ny,
  CAST(round_even((1+dx/sqrt(1+dx*dx+dy*dy))/2*65535, 0) AS INT) AS qx, CAST(round_even((1-dy/sqrt(1+dx*dx+dy*dy))/2*65535, 0) AS INT) AS qy FROM s""",
    "raster",
)
def raster_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normals from central differences, and quantised."""
    g = rasters.gradient(raster(spark, sf_dir), 30.0, 20.0)
    norm = F.sqrt(1 + F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    g = g.select("row", "col", (F.col("dx") / norm).alias("nx"), (F.col("dy") / norm).alias("ny"))
    qx, qy = P.quantised_normal("nx", "ny")
    return g.select("row", "col", F.round("nx", 9).alias("nx"), F.round("ny", 9).alias("ny"), qx.alias("qx"), qy.alias("qy"))


@query(
    "raster_smooth",
    _HOLED + """
, k AS (SELECT d, 3 - abs(d) AS k FROM range(-2, 3) AS r(d))
, a AS (SELECT row, col + d AS col, sum(value*k) AS v, sum(k) AS w FROM h, k WHERE value IS NOT NULL GROUP BY row, col + d)
, b AS (SELECT row + d AS row, col, sum(v*k) AS v, sum(w*k) AS w FROM a, k GROUP BY row + d, col)
SELECT b.row, b.col, round(v/w, 6) AS value FROM b JOIN h USING (row, col) WHERE h.value IS NOT NULL""",
    "raster",
)
def raster_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangular smoothing of two cells to each side, without the voids."""
    return rasters.smooth(holed(spark, sf_dir), 2).withColumn("value", F.round("value", 6))


@query(
    "raster_sample",
    """
, last AS (SELECT max(row) AS r, max(col) AS c FROM raster)
, place AS (SELECT event_id, (lon+180)/360*last.c AS px, (90-lat)/180*last.r AS py FROM points, last)
, c AS (SELECT *, floor(px) AS c, floor(py) AS r, px-floor(px) AS u, py-floor(py) AS v FROM place)
, k AS (SELECT event_id, r AS row, c AS col, 1-greatest(u,v) AS w FROM c UNION ALL SELECT event_id, r+1, c+1, least(u,v) FROM c UNION ALL SELECT event_id, CASE WHEN u >= v THEN r ELSE r+1 END, CASE WHEN u >= v THEN c+1 ELSE c END, abs(u-v) FROM c)
, j AS (SELECT k.event_id, sum(value*w) AS v, count(*) = count(value) AS whole FROM k LEFT JOIN raster USING (row, col) WHERE w > 0 GROUP BY k.event_id)
SELECT event_id, CASE WHEN whole THEN round(v + 1e-9, 6) END AS altitude FROM j""",
    "points", "raster",
)
def raster_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elevation at points, interpolated in the triangles of raster cells."""
    out = rasters.sample(
        points(spark, sf_dir).select("event_id", "lon", "lat").crossJoin(_extent(spark, sf_dir)), raster(spark, sf_dir), "event_id",
        (F.col("lon") + 180) / 360 * F.col("last_col"), (90 - F.col("lat")) / 180 * F.col("last_row"),
    )
    return out.select("event_id", F.round(F.col("value") + 1e-9, 6).alias("altitude"))  # halves of the last digit go one way


@query(
    "raster_overlay",
    """
SELECT row, col, CASE WHEN (row+col)%3=0 AND value > 0 THEN value*2 ELSE value END AS value FROM raster""",
    "raster",
)
def raster_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base raster under a patch that holds every third cell above zero."""
    base = raster(spark, sf_dir)
    patch = base.where("(row + col) % 3 = 0").withColumn("value", F.when(F.col("value") > 0, F.col("value") * 2))
    return rasters.overlay(base, patch)


@query(
    "raster_tiles",
    """
, t AS (SELECT r.row, r.col, value, tr, tc FROM raster r, unnest(range(CAST(floor((r.row-4)/32) AS BIGINT), CAST(floor((r.row+4)/32) AS BIGINT) + 1)) AS a(tr), unnest(range(CAST(floor((r.col-4)/32) AS BIGINT), CAST(floor((r.col+4)/32) AS BIGINT) + 1)) AS b(tc))
SELECT tr, tc, count(*) AS cells, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value >= 100) AS above,
  CAST(CASE WHEN ceil(max(value))-floor(min(value)) < 770 THEN 771 WHEN ceil(max(value))-floor(min(value)) < 1284 THEN 1285 WHEN ceil(max(value))-floor(min(value)) < 4368 THEN 4369 ELSE 13107 END AS INT) AS span
FROM t GROUP BY tr, tc""",
    "raster",
)
def raster_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of square tiles with a halo of four cells: range, mean, cells above a level, quantisation."""
    t = rasters.with_halo(raster(spark, sf_dir), 32, 4)
    return t.groupBy("tr", "tc").agg(
        F.count("*").alias("cells"), F.min("value").alias("low"), F.max("value").alias("high"), F.round(F.avg("value"), 6).alias("mean"),
        F.count(F.when(F.col("value") >= 100, 1)).alias("above"),
    ).withColumn("span", P.altitude_steps("low", "high")["span"])


@query(
    "pixel_colours",
    """
, p AS (SELECT row, col // 3 AS px, min(CASE WHEN col%3=0 THEN value END) AS a, min(CASE WHEN col%3=1 THEN value END) AS b, min(CASE WHEN col%3=2 THEN value END) AS c FROM raster GROUP BY row, col // 3 HAVING count(*) = 3)
, q AS (SELECT row, px, CAST(abs(a)%256 AS INT) AS r, CAST(abs(b)%256 AS INT) AS g, CAST(abs(c)%256 AS INT) AS b FROM p)
, s AS (SELECT row, px, CAST(least(greatest(round_even((r+10-127.5)*1.2+127.5, 0),0),255) AS INT) AS r, CAST(least(greatest(round_even((g+10-127.5)*1.2+127.5, 0),0),255) AS INT) AS g, CAST(least(greatest(round_even((b+10-127.5)*1.2+127.5, 0),0),255) AS INT) AS b FROM q)
, y AS (SELECT *, 0.299e0*r+0.587e0*g+0.114e0*b AS grey FROM s)
, z AS (SELECT row, px, CAST(least(greatest(round_even(grey+(r-grey)*0.7e0, 0),0),255) AS INT) AS r, CAST(least(greatest(round_even(grey+(g-grey)*0.7e0, 0),0),255) AS INT) AS g, CAST(least(greatest(round_even(grey+(b-grey)*0.7e0, 0),0),255) AS INT) AS b FROM y)
SELECT row, px, r, g, b, CAST(round_even((r*100+g*155)/255.0e0, 0) AS INT) AS blended FROM z""",
    "raster",
)
def pixel_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brightness, contrast, saturation and blending of pixels made of three cells each."""
    byte = lambda k: F.min(F.when(F.col("col") % 3 == k, (F.abs("value") % 256).cast("int")))
    cells = raster(spark, sf_dir).groupBy("row", F.floor(F.col("col") / 3).alias("px"))  # a pixel of fewer cells is none
    px = cells.agg(*[byte(k).alias(c) for k, c in enumerate("rgb")], F.count("*").alias("n")).where("n = 3")
    px = px.select("row", "px", *[P.brightness_contrast(c, 10.0, 20.0).alias(c) for c in "rgb"])
    px = px.select("row", "px", *[v.alias(c) for v, c in zip(P.saturation("r", "g", "b", -30.0), "rgb")])
    return px.withColumn("blended", P.blend("g", "r", F.lit(100)))


@query(
    "mesh_kinds",
    """
SELECT CASE WHEN kind >= 4 THEN 'levelled' WHEN kind & 2 <> 0 THEN 'sea' WHEN kind & 1 <> 0 THEN 'inland' ELSE 'land' END AS class, count(*) AS n,
  round(sum(abs((x2-x1)*(y3-y1)-(x3-x1)*(y2-y1))/2), 6) AS area FROM triangles GROUP BY 1""",
    "triangles",
)
def mesh_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles classified by their bits, the highest first."""
    k = F.col("kind")
    kind = F.when(k >= 4, "levelled").when(k.bitwiseAND(2) != 0, "sea").when(k.bitwiseAND(1) != 0, "inland").otherwise("land")
    return triangles(spark, sf_dir).groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.round(F.sum(meshes.area()), 6).alias("area"))


def water_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triangles on a grid of 0.05, so that they share vertices; kinds 0 to 2."""
    near = lambda c: F.bround(F.col(c) * 20, 0) / 20
    return triangles(spark, sf_dir).select("way", "tri", (F.col("kind") % 3).alias("kind"), *[near(f"{c}{i}").alias(f"{c}{i}") for i in (1, 2, 3) for c in ("x", "y")])


_WATER = (
    "\n, mesh AS (SELECT way, tri, kind % 3 AS kind, "
    + ", ".join(f"round_even({c}{i}*20, 0)/20 AS {c}{i}" for i in (1, 2, 3) for c in ("x", "y"))
    + " FROM triangles)\n, v AS ("
    + " UNION ALL ".join(f"SELECT way, tri, kind, x{i} AS x, y{i} AS y FROM mesh" for i in (1, 2, 3))
    + ")\n, vk AS (SELECT x, y, bit_or(CAST(1 << kind AS INT)) AS kinds FROM v GROUP BY x, y)\n"
    ", vc AS (SELECT *, kinds & 1 <> 0 AND kinds & 6 <> 0 AS coast FROM vk)\n"
)
_SIDES = (
    ", sides AS ("
    + " UNION ALL ".join(
        f"SELECT way, tri, kind, {n} AS n, CASE WHEN (x{i},y{i})<=(x{j},y{j}) THEN x{i} ELSE x{j} END AS ax, CASE WHEN (x{i},y{i})<=(x{j},y{j}) THEN y{i} ELSE y{j} END AS ay, "
        f"CASE WHEN (x{i},y{i})<=(x{j},y{j}) THEN x{j} ELSE x{i} END AS bx, CASE WHEN (x{i},y{i})<=(x{j},y{j}) THEN y{j} ELSE y{i} END AS b_y FROM mesh"
        for n, (i, j) in enumerate(((1, 2), (2, 3), (3, 1)))
    )
    + ")\n, sk AS (SELECT ax, ay, bx, b_y, bit_or(CAST(1 << kind AS INT)) AS kinds, count(*) AS triangles FROM sides WHERE NOT (ax = bx AND ay = b_y) GROUP BY ax, ay, bx, b_y)\n"
)


@query("vertex_kinds", _WATER + "SELECT x, y, kinds, coast FROM vc", "triangles")
def vertex_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of triangles at each vertex, and whether it lies on the coast."""
    return meshes.vertex_kinds(water_mesh(spark, sf_dir))


@query("side_kinds", _WATER + _SIDES + "SELECT ax AS x, ay AS y, bx AS x2, b_y AS y2, kinds, triangles FROM sk", "triangles")
def side_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides shared by triangles, with the kinds on them."""
    s = meshes.side_kinds(water_mesh(spark, sf_dir))
    return s.select("a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), "kinds", "triangles")


@query(
    "recut_water",
    _WATER + _SIDES + """
, free AS (SELECT s.* FROM sk s JOIN vc a ON a.x = s.ax AND a.y = s.ay AND a.coast JOIN vc b ON b.x = s.bx AND b.y = s.b_y AND b.coast WHERE s.kinds & 1 = 0)
, cut AS (SELECT way, tri, count(*) AS cuts FROM sides JOIN free USING (ax, ay, bx, b_y) WHERE sides.kind > 0 GROUP BY way, tri)
, shore AS (SELECT way, tri, count(*) AS c FROM v JOIN vc USING (x, y) WHERE coast AND kind > 0 GROUP BY way, tri)
SELECT m.way, m.tri, CAST(coalesce(cuts, 0) AS INT) AS cuts, CAST(CASE WHEN coalesce(cuts, 0) = 0 AND coalesce(c, 0) = 3 THEN 3 ELSE coalesce(cuts, 0) + 1 END AS BIGINT) AS parts,
  round(abs((x2-x1)*(y3-y1)-(x3-x1)*(y2-y1))/2, 9) AS area FROM mesh m LEFT JOIN cut USING (way, tri) LEFT JOIN shore USING (way, tri)""",
    "triangles",
)
def recut_water(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water triangles recut along the coast: parts and their whole area for each triangle."""
    parts = meshes.recut(water_mesh(spark, sf_dir), ["way", "tri"])
    return parts.groupBy("way", "tri").agg(F.max("cuts").alias("cuts"), F.count("*").alias("parts"), F.round(F.sum(meshes.area()), 9).alias("area"))


@query(
    "mask_cells",
    f"""
, b AS (SELECT kind, (x1+x2+x3)/3*20-10 AS lon, (y1+y2+y3)/3*20+40 AS lat FROM triangles WHERE kind > 0)
, c AS (SELECT kind, {_cell(12)}, {_cell(14, x='fx', y='fy')} FROM b)
, q AS (SELECT *, CASE (fx//16)%4 WHEN 0 THEN -16 WHEN 3 THEN 16 ELSE 0 END AS sx, CASE (fy//16)%4 WHEN 0 THEN -16 WHEN 3 THEN 16 ELSE 0 END AS sy FROM c)
, e AS (SELECT kind, til_x, til_y FROM q UNION ALL SELECT kind, til_x+sx, til_y FROM q WHERE sx <> 0 UNION ALL SELECT kind, til_x, til_y+sy FROM q WHERE sy <> 0 UNION ALL SELECT kind, til_x+sx, til_y+sy FROM q WHERE sx <> 0 AND sy <> 0)
, sea AS (SELECT til_x, til_y, count(*) AS n FROM e WHERE kind >= 2 GROUP BY til_x, til_y)
, inland AS (SELECT til_x, til_y, count(*) AS n FROM q WHERE kind = 1 GROUP BY til_x, til_y)
SELECT til_x, til_y, sea.n AS sea, coalesce(inland.n, 0) AS inland FROM sea LEFT JOIN inland USING (til_x, til_y)""",
    "triangles",
)
def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water triangles of each mask cell: sea with replication near borders, inland only where there is sea."""
    bx, by = meshes.barycentre()
    rows = triangles(spark, sf_dir).where("kind > 0").select("kind", (bx * 20 - 10).alias("lon"), (by * 20 + 40).alias("lat"))
    sea = meshes.mask_cells(rows.where("kind >= 2"), F.col("lat"), F.col("lon"), 12).groupBy("til_x", "til_y").agg(F.count("*").alias("sea"))
    x, y = G.texture_cell("lat", "lon", 12)
    inland = rows.where("kind = 1").groupBy(x.alias("til_x"), y.alias("til_y")).agg(F.count("*").alias("inland"))
    return sea.join(inland, ["til_x", "til_y"], "left").withColumn("inland", F.coalesce("inland", F.lit(0)))


@query(
    "depth_ratios",
    """
, last AS (SELECT max(row) AS r, max(col) AS c FROM raster)
, s2 AS (SELECT c_custkey, c_custkey % 5 = 0 AS coast, CAST(floor((lon+180)/360*last.c) AS BIGINT) AS col, CAST(floor((90-lat)/180*last.r) AS BIGINT) AS row FROM sites, last)
SELECT c_custkey, round(CASE WHEN coast THEN 0 ELSE greatest(least(10*coalesce(abs(value)%256, 255)/255, 1), 0.1) END, 9) AS ratio FROM s2 LEFT JOIN raster USING (row, col)""",
    "sites", "raster",
)
def depth_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of places from the mask pixel under them; 255 where there is no mask."""
    at = sites(spark, sf_dir).crossJoin(_extent(spark, sf_dir)).select(
        "c_custkey", (F.col("c_custkey") % 5 == 0).alias("coast"),
        F.floor((F.col("lon") + 180) / 360 * F.col("last_col")).alias("col"), F.floor((90 - F.col("lat")) / 180 * F.col("last_row")).alias("row"),
    )
    mask = at.join(raster(spark, sf_dir), ["row", "col"], "left").withColumn("mask", F.coalesce(F.abs("value") % 256, F.lit(255.0)))
    return mask.select("c_custkey", F.round(P.depth_ratio("coast", "mask"), 9).alias("ratio"))
