"""Queries about runways: profiles of their ground, and which outlines are sane."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.operators import runways
from tilewright.plans.fixtures import raster, sql, way_nodes

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections)
        return f

    return add


@query(
    "way_profiles",
    """
, t AS (SELECT way, pos, z, CASE WHEN count(*) OVER (PARTITION BY way) = 1 THEN 0 ELSE (pos-1.0e0)/(count(*) OVER (PARTITION BY way)-1) END AS t FROM way_nodes)
, p AS (SELECT way, pos, t, 1.0e0 AS w, z, least(8, count(*) OVER (PARTITION BY way)) AS n FROM t UNION ALL SELECT way, 0, 0.5e0, 0, 0, least(8, count(*)) FROM t GROUP BY way)
, f AS (WITH RECURSIVE st AS (SELECT 1 AS k, way, pos, t, w, z, n, 0.0e0 AS prev, 1.0e0 AS cur, sum(w*z) OVER (PARTITION BY way)/sum(w) OVER (PARTITION BY way) AS fit FROM p
  UNION ALL SELECT k, way, pos, t, w, z, n, prev, cur, fit + cur*sum(w*z*cur) OVER g/sum(w*cur*cur) OVER g FROM (
    SELECT k+1 AS k, way, pos, t, w, z, n, cur AS prev, (t - sum(w*t*cur*cur) OVER g/sum(w*cur*cur) OVER g)*cur - coalesce(sum(w*cur*cur) OVER g/nullif(sum(w*prev*prev) OVER g, 0), 0)*prev AS cur, fit
    FROM st WHERE k < n WINDOW g AS (PARTITION BY way)) WINDOW g AS (PARTITION BY way)) SELECT * FROM st WHERE k = n)
SELECT way, round(fit + 1e-9, 6) AS middle FROM f WHERE pos = 0""",
    "way_nodes",
)
def way_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polynomial fitted to each way's elevations, and its value in the middle."""
    n = F.count("*").over(Window.partitionBy("way"))
    rows = way_nodes(spark, sf_dir).withColumn("t", F.when(n == 1, F.lit(0.0)).otherwise((F.col("pos") - 1) / (n - 1)))
    fit = runways.fitted(rows, "way", F.col("t"), F.col("z"), F.lit(1.0))
    return fit.select("way", F.round(runways.height_at("profile", F.lit(0.5)) + 1e-9, 6).alias("middle"))


@query(
    "runway_profiles",
    """
, s AS (SELECT row, col AS i, value AS z, max(col) OVER (PARTITION BY row) AS s FROM raster)
, p AS (SELECT row, i, i/CAST(s AS DOUBLE) AS t, pow(greatest(i, s-i)+s//2, 4) AS w, z FROM s WHERE s > 0 AND z IS NOT NULL
  UNION ALL SELECT DISTINCT row, -1-k, k/2.0e0, 0, 0 FROM s, range(3) AS u(k) WHERE s > 0)
, f AS (WITH RECURSIVE st AS (SELECT 0 AS k, row, i, t, w, z, 0.0e0 AS prev, 1.0e0 AS cur, sum(w*z) OVER (PARTITION BY row)/sum(w) OVER (PARTITION BY row) AS fit FROM p
  UNION ALL SELECT k, row, i, t, w, z, prev, cur, fit + cur*sum(w*z*cur) OVER g/sum(w*cur*cur) OVER g FROM (
    SELECT k+1 AS k, row, i, t, w, z, cur AS prev, (t - sum(w*t*cur*cur) OVER g/sum(w*cur*cur) OVER g)*cur - coalesce(sum(w*cur*cur) OVER g/nullif(sum(w*prev*prev) OVER g, 0), 0)*prev AS cur, fit
    FROM st WHERE k < 7 WINDOW g AS (PARTITION BY row)) WINDOW g AS (PARTITION BY row)) SELECT * FROM st WHERE k = 7)
SELECT row, round(max(CASE i WHEN -1 THEN fit END), 6) AS first, round(max(CASE i WHEN -2 THEN fit END), 6) AS middle, round(max(CASE i WHEN -3 THEN fit END), 6) AS last FROM f GROUP BY row""",
    "raster",
)
def runway_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row of the ground as a runway: heights of its weighted profile at both ends and in the middle."""
    ground = raster(spark, sf_dir).withColumn("steps", F.max("col").over(Window.partitionBy("row"))).where("steps > 0")
    fit = runways.fitted(ground, "row", F.col("col") / F.col("steps"), F.col("value"), runways.profile_weight(F.col("col"), F.col("steps")))
    at = ((0.0, "first"), (0.5, "middle"), (1.0, "last"))
    return fit.select("row", *[F.round(runways.height_at("profile", F.lit(t)), 6).alias(name) for t, name in at])


#: The least area of a runway, and how far its outline may be from a rectangle.
LEAST, MOST = 0.02, 0.25


@query(
    "runway_checks",
    f"""
, p AS (SELECT DISTINCT way, x, y FROM way_nodes)
, e AS (SELECT a.way, a.x, a.y, (b.x-a.x)/sqrt(pow(b.x-a.x, 2)+pow(b.y-a.y, 2)) AS ux, (b.y-a.y)/sqrt(pow(b.x-a.x, 2)+pow(b.y-a.y, 2)) AS uy FROM p a JOIN p b ON a.way = b.way AND (a.x <> b.x OR a.y <> b.y))
, d AS (SELECT e.way, ux, uy, e.x AS ox, e.y AS oy, (p.x-e.x)*ux+(p.y-e.y)*uy AS s, (p.y-e.y)*ux-(p.x-e.x)*uy AS o FROM e JOIN p ON p.way = e.way)
, r AS (SELECT way, ux, uy, ox, oy, min(s) AS s0, max(s) AS s1, max(o) AS w FROM d GROUP BY ALL HAVING min(o) >= -1e-12 AND max(o) > 1e-12)
, b AS (SELECT way, row_number() OVER (PARTITION BY way) AS c, struct_pack(ux := ux, uy := uy, ox := ox, oy := oy, s0 := s0, s1 := s1, w := w) AS r FROM r QUALIFY rank() OVER (PARTITION BY way ORDER BY round((s1-s0)*w, 9), round(-greatest(s1-s0, w), 9)) = 1)
, f AS (SELECT n.way, c, pos, (x-r.ox)*r.ux+(y-r.oy)*r.uy AS s, (y-r.oy)*r.ux-(x-r.ox)*r.uy AS o, r FROM way_nodes n JOIN b ON b.way = n.way)
, g AS (SELECT *, coalesce(lead(s) OVER w, first_value(s) OVER w) AS s2, coalesce(lead(o) OVER w, first_value(o) OVER w) AS o2 FROM f WINDOW w AS (PARTITION BY way, c ORDER BY pos))
, k AS (SELECT way, c, s, o, s2, o2, CASE WHEN i % 2 = 0 THEN r.s0 ELSE r.s1 END AS cs, CASE WHEN i < 2 THEN 0 ELSE r.w END AS co, i FROM g, range(4) AS t(i))
, l AS (SELECT *, coalesce(least(1, greatest(0, ((cs-s)*(s2-s)+(co-o)*(o2-o))/nullif(pow(s2-s, 2)+pow(o2-o, 2), 0))), 0) AS a FROM k)
, h AS (SELECT way, c, max(m) AS m FROM (SELECT way, c, i, min(sqrt(pow(s+a*(s2-s)-cs, 2)+pow(o+a*(o2-o)-co, 2))) AS m FROM l GROUP BY way, c, i) GROUP BY way, c)
, q AS (SELECT way, c, abs(sum(s*o2-s2*o))/2 AS area, max(least(s-r.s0, r.s1-s, o, r.w-o)) AS m FROM g GROUP BY way, c)
, v AS (SELECT way, round(min(area), 9) AS area, round(min(greatest(q.m, h.m, 0)), 9) AS misfit FROM q JOIN h USING (way, c) GROUP BY way)
, t AS (SELECT way, max(tag) = 'R' AS custom FROM way_nodes GROUP BY way)
SELECT way, area, misfit, CASE WHEN area < {LEAST} THEN 'small' WHEN custom THEN 'custom' WHEN misfit > {MOST} THEN 'bad' ELSE 'sane' END AS verdict FROM v JOIN t USING (way)""",
    "way_nodes",
)
def runway_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways as outlines of runways: their area, how far they are from a rectangle, and whether they are kept."""
    nodes = F.sort_array(F.collect_list(F.struct("pos", "x", "y")))
    each = way_nodes(spark, sf_dir).groupBy("way").agg(nodes.alias("p"), (F.max("tag") == "R").alias("custom"))
    r = each.select("way", "custom", runways.rectangle_misfit("p.x", "p.y").alias("r")).where("r.misfit IS NOT NULL")
    r = r.select("way", "custom", F.round("r.area", 9).alias("area"), F.round("r.misfit", 9).alias("misfit"))
    verdict = F.when(F.col("area") < LEAST, "small").when(F.col("custom"), "custom").when(F.col("misfit") > MOST, "bad").otherwise("sane")
    return r.select("way", "area", "misfit", verdict.alias("verdict"))
