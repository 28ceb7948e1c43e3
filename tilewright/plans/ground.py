"""Queries over the ground: elevation files composed in an order, and masks by distance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import airports, rasters
from tilewright.plans.fixtures import anchors, raster, sql
from tilewright.plans.grids import _extent
from tilewright.session import written
from tilewright.sources import elevation

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections)
        return f

    return add


#: Cells along a square of the files, squares of a column of the globe, and how much coarser the second source is.
SIDE, COLUMN, COARSE = 32, 170, 4


def _squares(cells: DataFrame, side: int) -> DataFrame:
    """Cells (row, col, value) dealt to files' squares, which share their outer rows and columns."""
    c = F.col
    near = lambda axis: F.when((c(axis) % side == 0) & (c(axis) > 0), F.array(F.floor(c(axis) / side), F.floor(c(axis) / side) - 1)).otherwise(F.array(F.floor(c(axis) / side)))
    each = cells.withColumn("sr", F.explode(near("row"))).withColumn("sc", F.explode(near("col")))
    return each.select(
        "sr", "sc", (89 - c("sr") % COLUMN).cast("int").alias("lat"), (c("sc") + 2 * F.floor(c("sr") / COLUMN) - 180).cast("int").alias("lon"),
        (c("row") - c("sr") * side).alias("row"), (c("col") - c("sc") * side).alias("col"), "value")


def _placed(samples: DataFrame, side: int) -> DataFrame:
    """Samples of files as one raster again."""
    c = F.col
    sr, sc = 89 - c("lat") + COLUMN * F.floor((c("lon") + 180) / 2), F.pmod(c("lon") + 180, F.lit(2))
    return samples.select((sr * side + c("row")).cast("bigint").alias("row"), (sc * side + c("col")).cast("bigint").alias("col"), "value")


@query(
    "composed_elevations",
    f"""
, sq AS (SELECT row, col, value, row // {SIDE} - a AS sr, col // {SIDE} - b AS sc FROM raster, range(2) AS t(a), range(2) AS u(b) WHERE (a = 0 OR row % {SIDE} = 0) AND (b = 0 OR col % {SIDE} = 0))
, fine AS (SELECT DISTINCT row, col, value FROM sq WHERE sr >= 0 AND sc >= 0 AND (sr + sc) % 2 = 0 AND value >= -600)
, z AS (SELECT row // {COARSE} AS r, col // {COARSE} AS c, value FROM raster WHERE row % {COARSE} = 0 AND col % {COARSE} = 0)
, k AS (SELECT a.r*{COARSE} + i AS row, a.c*{COARSE} + j AS col, i/{COARSE} AS p, j/{COARSE} AS q, a.value AS z00, CASE WHEN j = 0 THEN 0 ELSE b.value END AS z01, CASE WHEN i = 0 THEN 0 ELSE d.value END AS z10, CASE WHEN i = 0 OR j = 0 THEN 0 ELSE e.value END AS z11
  FROM z a LEFT JOIN z b ON b.r = a.r AND b.c = a.c + 1 LEFT JOIN z d ON d.r = a.r + 1 AND d.c = a.c LEFT JOIN z e ON e.r = a.r + 1 AND e.c = a.c + 1, range({COARSE}) AS t(i), range({COARSE}) AS u(j))
, up AS (SELECT row, col, (1-p)*((1-q)*z00 + q*z01) + p*((1-q)*z10 + q*z11) AS value FROM k)
SELECT row, col, round(coalesce(fine.value, up.value) + 1e-9, 6) AS value FROM up FULL JOIN fine USING (row, col) WHERE coalesce(fine.value, up.value) IS NOT NULL""",
    "raster",
)
def composed_elevations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of elevation files, read back and composed: every second square in full, with holes, over a coarser one of all squares."""
    ground = raster(spark, sf_dir).select(F.col("row").cast("bigint").alias("row"), F.col("col").cast("bigint").alias("col"), "value")
    fine = _squares(ground.withColumn("value", F.when(F.col("value") >= -600, F.col("value"))), SIDE).where((F.col("sr") + F.col("sc")) % 2 == 0)
    every = F.col("row") % COARSE + F.col("col") % COARSE == 0
    coarse = _squares(ground.where(every).select((F.col("row") / COARSE).cast("bigint").alias("row"), (F.col("col") / COARSE).cast("bigint").alias("col"), "value"), SIDE // COARSE)
    layers = []
    for name, squares, side in (("fine", fine, SIDE), ("coarse", coarse, SIDE // COARSE)):
        files = written(elevation.packed(squares, side + 1), name)
        layers.append(_placed(elevation.decoded(files), side))
    once = layers[1].groupBy("row", "col").agg(F.max("value").alias("value"))  # squares share their sides
    out = rasters.composed(layers[0], rasters.upsampled(once, COARSE))
    return out.select("row", "col", F.round(F.col("value") + 1e-9, 6).alias("value"))


BAND = 6


@query(
    "distance_masks",
    f"""
, w AS (SELECT row, col FROM raster WHERE value < -900)
, o AS (SELECT a, b, sqrt(a*a + b*b) AS d FROM range(-{BAND}, {BAND + 1}) AS t(a), range(-{BAND}, {BAND + 1}) AS u(b) WHERE a*a + b*b < {BAND * BAND})
, n AS (SELECT row + a AS row, col + b AS col, min(d) AS d FROM w, o GROUP BY 1, 2)
SELECT row, col, round(coalesce(d, {BAND}), 6) AS distance, CAST(255 - floor(255 * coalesce(d, {BAND}) / {BAND}) AS INT) AS mask FROM raster LEFT JOIN n USING (row, col)""",
    "raster",
)
def distance_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks that fade with the distance from water: how far each cell of the ground is from it, and its grey."""
    found = rasters.distances(raster(spark, sf_dir), F.col("value") < -900, BAND)
    return found.select("row", "col", F.round("distance", 6).alias("distance"), (255 - F.floor(255 * F.col("distance") / BAND)).cast("int").alias("mask"))


#: Places of a cell that are looked at along each side, and where in its cell an airport has its middle.
PARTS, MIDDLE = 4, (0.53, 0.46)


@query(
    "ordered_airports",
    f"""
, x AS (SELECT max(row) AS lr, max(col) AS lc FROM raster)
, apt AS (SELECT row_number() OVER (ORDER BY s_suppkey) AS k, s_suppkey*31%(lr+1) AS r, s_suppkey*17%(lc+1) AS c, 3+s_suppkey%4 AS a, 2+s_suppkey%5 AS b, 1+s_suppkey%3 AS pix FROM anchors, x)
, area AS (SELECT k, pix, r+i AS row, c+j AS col, count(*)/{PARTS * PARTS}.0e0 AS w FROM apt, range(-8, 9) AS t(i), range(-8, 9) AS u(j), range({PARTS}) AS v(p), range({PARTS}) AS y(q)
  WHERE abs(i+(p+0.5e0)/{PARTS}-{MIDDLE[0]}e0)*b + abs(j+(q+0.5e0)/{PARTS}-{MIDDLE[1]}e0)*a < a*b GROUP BY ALL)
, m AS (SELECT k, pix, row, col, w, value FROM area JOIN raster USING (row, col))
, pr AS (SELECT o.k, o.row, o.col, o.w, i.row AS irow, i.col AS icol, i.w*(o.pix+1-abs(o.row-i.row))*(o.pix+1-abs(o.col-i.col)) AS f
  FROM m o JOIN m i ON i.k = o.k AND abs(o.row-i.row) <= o.pix AND abs(o.col-i.col) <= o.pix)
, states AS (WITH RECURSIVE st AS (SELECT 0 AS k, row, col, value FROM (SELECT DISTINCT row, col, value FROM m)
  UNION ALL SELECT st.k+1, st.row, st.col, coalesce(n.w*n.s + (1-n.w)*st.value, st.value) FROM st
  LEFT JOIN (SELECT pr.row, pr.col, pr.w, sum(pr.f*z.value)/sum(pr.f) AS s FROM pr JOIN st z ON z.k+1 = pr.k AND z.row = pr.irow AND z.col = pr.icol GROUP BY ALL) n ON n.row = st.row AND n.col = st.col
  WHERE st.k < (SELECT max(k) FROM apt)) SELECT * FROM st)
, soft AS (SELECT row, col, value FROM states WHERE k = (SELECT max(k) FROM apt))
SELECT r.row, r.col, round(r.value + coalesce(s.value - r.value, 0)*least(1, r.row/p)*least(1, (lr-r.row)/p)*least(1, r.col/p)*least(1, (lc-r.col)/p), 6) AS value
FROM raster r LEFT JOIN soft s USING (row, col), x, (SELECT max(pix)*1.0e0 AS p FROM apt)""",
    "raster", "anchors",
)
def ordered_airports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ground smoothed over airports, one after the other, each by a width of its own, and blended at the raster's sides."""
    ground, s, c = raster(spark, sf_dir), F.col("s_suppkey"), F.col
    at = anchors(spark, sf_dir).crossJoin(_extent(spark, sf_dir)).select(
        "s_suppkey", (1 + s % 3).alias("pix"), (s * 31 % (c("last_row") + 1) + MIDDLE[0]).alias("r"), (s * 17 % (c("last_col") + 1) + MIDDLE[1]).alias("c"), (3 + s % 4).alias("a"), (2 + s % 5).alias("b"))
    node = lambda r, k: F.struct(r.alias("row"), k.alias("col"))
    ring = F.array(node(c("r") - c("a"), c("c")), node(c("r"), c("c") + c("b")), node(c("r") + c("a"), c("c")), node(c("r"), c("c") - c("b")))
    at = written(at.select("s_suppkey", "pix", ring.alias("ring")), "airports")
    areas = airports.coverage(at, "s_suppkey", PARTS).join(at.select(s.alias("id"), "pix"), "id")
    soft = airports.smoothed_in_order(ground, areas)
    sides = ground.crossJoin(_extent(spark, sf_dir)).crossJoin(at.agg(F.max("pix").alias("width")))
    out = airports.blended_at_sides(sides, soft, F.lit(0), F.lit(0), c("last_row"), c("last_col"), c("width"))
    return out.select("row", "col", F.round("value", 6).alias("value"))
