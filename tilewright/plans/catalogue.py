"""Queries over catalogs and airports: coverage, filters, listings, descriptors, weighted means, rasters of masks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geodesy as G
from tilewright.functions import names as N
from tilewright.functions.geodesy import haversine
from tilewright.operators import spatial
from tilewright.plans.fixtures import anchors, points, raster, sites, sql, way_nodes, zones
from tilewright.plans.tiling import _cell
from tilewright.session import table

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections) if projections else body
        return f

    return add


@query(
    "flat_ways",
    """
SELECT way, count(*) AS nodes, max(z) - min(z) AS spread, avg(z) > 25 AS high FROM way_nodes GROUP BY way HAVING count(*) > 1 AND max(z) - min(z) <= 10""",
    "way_nodes",
)
def flat_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways whose elevations lie within ten units."""
    out = way_nodes(spark, sf_dir).groupBy("way").agg(F.count("*").alias("nodes"), (F.max("z") - F.min("z")).alias("spread"), (F.avg("z") > 25).alias("high"))
    return out.where("nodes > 1 AND spread <= 10")


@query(
    "layer_coverage",
    """
, t AS (SELECT DISTINCT CAST(floor(lat/10)*10 AS INT) AS lat, CAST(floor(lon/10)*10 AS INT) AS lon FROM points)
SELECT t.lat, t.lon, count(z.zone) FILTER (WHERE z.zone % 3 <> 0) AS inside, (SELECT count(*) FROM zones WHERE zone % 3 = 0) - count(z.zone) FILTER (WHERE z.zone % 3 = 0) AS outside
FROM t LEFT JOIN zones z ON z.x0 <= t.lon + 10 AND t.lon <= z.x1 AND z.y0 <= t.lat + 10 AND t.lat <= z.y1 GROUP BY t.lat, t.lon""",
    "points", "zones",
)
def layer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For blocks of ten degrees: layers whose extent meets them, and layers of negated extents that don't."""
    block = lambda c: (F.floor(F.col(c) / 10) * 10).cast("int").alias(c)
    t = points(spark, sf_dir).select(block("lat"), block("lon")).distinct()
    z = zones(spark, sf_dir)
    boxes = t.select("lat", "lon", F.col("lon").cast("double").alias("bx0"), F.col("lat").cast("double").alias("by0"))
    a = spatial.with_cells(boxes, F.col("bx0"), F.col("by0"), F.col("bx0") + 10, F.col("by0") + 10, 20.0)
    b = spatial.with_cells(z.select("zone", "x0", "y0", "x1", "y1"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), 20.0)
    met = a.join(b, ["_cx", "_cy"]).where("x0 <= bx0 + 10 AND bx0 <= x1 AND y0 <= by0 + 10 AND by0 <= y1").select("lat", "lon", "zone").distinct()
    n = met.groupBy("lat", "lon").agg(F.count(F.when(F.col("zone") % 3 != 0, 1)).alias("inside"), F.count(F.when(F.col("zone") % 3 == 0, 1)).alias("met"))
    negated = z.where("zone % 3 = 0").agg(F.count("*").alias("n"))
    out = t.join(n, ["lat", "lon"], "left").crossJoin(negated)  # one row
    return out.select("lat", "lon", F.coalesce("inside", F.lit(0)).alias("inside"), (F.col("n") - F.coalesce("met", F.lit(0))).alias("outside"))


@query(
    "overlay_filter",
    """
SELECT p_partkey, p_name FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 17 = 0 OR contains(lower(p_name), '7') OR NOT (p_size > 2))""",
)
def overlay_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions left after exclusion by number, by part of the name and by the negation of a test."""
    p = table(spark, sf_dir, "part")
    gone = p.where("p_partkey % 17 = 0").select("p_partkey").unionByName(
        p.where(F.contains(F.lower("p_name"), F.lit("7"))).select("p_partkey")).unionByName(p.where("NOT (p_size > 2)").select("p_partkey"))
    return p.join(gone.distinct(), "p_partkey", "left_anti").select("p_partkey", "p_name")


@query(
    "terrain_texts",
    f"""
, t AS (SELECT DISTINCT {_cell(8)}, event_type FROM points)
SELECT til_x, til_y, event_type, 'A' || chr(10) || '800' || chr(10) || 'TERRAIN' || chr(10) || 'LOAD_CENTER ' || printf('%.5f', round(360/pi()*atan(exp(pi()*(1-(til_y+8)/pow(2,7))))-90, 5)) || ' ' || printf('%.5f', round(((til_x+8)/pow(2,7)-1)*180, 5))
  || chr(10) || 'BASE_TEX_NOWRAP ' || til_y || '_' || til_x || '_SRC8.dds' || CASE WHEN event_type = 'view' THEN chr(10) || 'BORDER_TEX mask.png' ELSE '' END AS descriptor FROM t""",
    "points",
)
def terrain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptor texts of texture cells; one kind has a mask."""
    x, y = G.texture_cell("lat", "lon", 8)
    t = points(spark, sf_dir).select(x.alias("til_x"), y.alias("til_y"), "event_type").distinct()
    lat, lon = G.tile_corner(F.col("til_x") + 8, F.col("til_y") + 8, 8)
    head = F.format_string("A\n800\nTERRAIN\nLOAD_CENTER %.5f %.5f\nBASE_TEX_NOWRAP ", F.round(lat, 5), F.round(lon, 5))
    text = F.concat(head, N.texture_name("til_x", "til_y", F.lit(8), F.lit("SRC")), F.lit(".dds"), F.when(F.col("event_type") == "view", "\nBORDER_TEX mask.png").otherwise(""))
    return t.select("til_x", "til_y", "event_type", text.alias("descriptor"))


@query(
    "kernel_altitudes",
    """
, d AS (SELECT c_custkey, s_acctbal, 2*6378137*atan2(sqrt(h), sqrt(1-h)) AS m FROM (SELECT c_custkey, s_acctbal, pow(sin(radians(s.lat-a.lat)/2),2)+cos(radians(s.lat))*cos(radians(a.lat))*pow(sin(radians(s.lon-a.lon)/2),2) AS h
  FROM sites s, anchors a))
, w AS (SELECT c_custkey, sum(exp(-m/500000)*s_acctbal) AS v, sum(exp(-m/500000)) AS w FROM d WHERE m < 2000000 GROUP BY c_custkey)
SELECT s.c_custkey, round(CASE WHEN coalesce(w.w, 0) < 1e-6 THEN s.c_acctbal ELSE w.v/w.w END, 4) AS altitude FROM sites s LEFT JOIN w USING (c_custkey)""",
    "sites", "anchors",
)
def kernel_altitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of the anchors within 2,000 km of a site under an exponential kernel; the site's own value where there are none."""
    s, a = sites(spark, sf_dir), anchors(spark, sf_dir)
    near = spatial.kernel_sums(s, a, "c_custkey", "s_acctbal", 2_000_000.0, 500_000.0)
    value = F.when(F.coalesce("w", F.lit(0.0)) < 1e-6, F.col("c_acctbal")).otherwise(F.col("v") / F.col("w"))
    return s.join(near, "c_custkey", "left").select("c_custkey", F.round(value, 4).alias("altitude"))


@query(
    "work_list",
    """
, t AS (SELECT CAST(floor(lat) AS INT) AS lat, CAST(floor(lon) AS INT) AS lon, count(*) AS n, bool_or(event_type = 'click') AS vectors, bool_or(event_type = 'view') AS mesh, bool_or(value > 80) AS masks FROM points GROUP BY 1, 2)
SELECT lat, lon, n, vectors, mesh, masks, CAST(vectors AS INT) + CAST(mesh AS INT) + CAST(masks AS INT) AS stages FROM t WHERE vectors OR mesh OR masks""",
    "points",
)
def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles to build with the stages that each needs."""
    t = points(spark, sf_dir).groupBy(F.floor("lat").cast("int").alias("lat"), F.floor("lon").cast("int").alias("lon")).agg(
        F.count("*").alias("n"), F.bool_or(F.col("event_type") == "click").alias("vectors"), F.bool_or(F.col("event_type") == "view").alias("mesh"), F.bool_or(F.col("value") > 80).alias("masks")
    )
    stages = sum((F.col(c).cast("int") for c in ("mesh", "masks")), F.col("vectors").cast("int"))
    return t.where("vectors OR mesh OR masks").withColumn("stages", stages)


@query(
    "shore_masks",
    """
, k AS (SELECT d, (5 - abs(d)) / 25.0e0 AS w FROM range(-4, 5) AS t(d))
, m AS (SELECT row + a.d AS row, col + b.d AS col, sum(CASE WHEN value < 0 THEN 255 * a.w * b.w ELSE 0 END) AS soft, max(CASE WHEN a.d = 0 AND b.d = 0 AND value < 0 THEN 255 ELSE 0 END) AS mask FROM raster, k a, k b GROUP BY row + a.d, col + b.d)
, t AS (SELECT CAST(floor(row/16) AS BIGINT) AS tr, CAST(floor(col/16) AS BIGINT) AS tc, least(greatest(round_even(greatest(soft, mask), 0), 0), 255) AS v FROM m)
, s AS (SELECT tr, tc, sum(v)/256 AS mean, CASE WHEN count(*) < 256 THEN 0 ELSE min(v) END AS low, max(v) AS high FROM t GROUP BY tr, tc)
SELECT tr, tc, mean, CAST(low AS INT) AS low, CAST(high AS INT) AS high FROM s WHERE high > 30 AND low < 255""",
    "raster",
)
def shore_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-edged masks of square tiles of the raster with a halo, kept where they are mixed: tile, mean, least and most."""
    from tilewright.operators import rasters
    from tilewright.operators.images import shore

    size, halo = 16, 4
    cells = rasters.with_halo(raster(spark, sf_dir), size, halo).select("tr", "tc", "row", "col", (F.col("value") < 0).alias("water"))
    side = size + 2 * halo
    place = ((F.col("row") - F.col("tr") * size + halo) * side + F.col("col") - F.col("tc") * size + halo).cast("int")
    packed = cells.where("water").groupBy("tr", "tc").agg(F.collect_list(place).alias("cells"))  # a tile is of a set size

    def blur(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # so many masks are held at once
                batch = whole.slice(at, 512)
                found = batch.column(2)
                mask = np.zeros((batch.num_rows, side * side))
                mask[np.repeat(np.arange(batch.num_rows), found.value_lengths().to_numpy(zero_copy_only=False)), found.flatten().to_numpy()] = 255
                soft = shore(mask.reshape(-1, side, side), halo)[:, halo:-halo, halo:-halo].reshape(-1, size * size)
                low, high = soft.min(1), soft.max(1)
                kept = np.flatnonzero((high > 30) & (low < 255))
                if len(kept):
                    values = [pa.array(soft.mean(1)[kept]), pa.array(low[kept].astype(np.int32)), pa.array(high[kept].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept)).cast(pa.int64()) for c in (0, 1)), *values], ["tr", "tc", "mean", "low", "high"])

    return packed.mapInArrow(blur, "tr bigint, tc bigint, mean double, low int, high int")
