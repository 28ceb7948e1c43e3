"""Queries over points, sites and zones: tiling, tags, spatial joins, priorities, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions import geodesy as G
from tilewright.functions import names as N
from tilewright.operators import spatial, tags
from tilewright.operators.components import components
from tilewright.plans.fixtures import anchors, points, sites, sql, zones

QUERIES, SQL = {}, {}


def query(name: str, body: str | None = None, *projections: str):
    """Registers a query under a name, with its SQL if there is any."""

    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections) if projections else body
        return f

    return add


_RY = "ln(tan(({lat}+90)*pi()/360))/pi()"
_CELL = "CAST(floor(({lon}/180+1)*pow(2,{z}-5))*16 AS BIGINT) AS {x}, CAST(floor((1-" + _RY + ")*pow(2,{z}-5))*16 AS BIGINT) AS {y}"


def _cell(z, lon="lon", lat="lat", x="til_x", y="til_y"):
    return _CELL.format(z=z, lon=lon, lat=lat, x=x, y=y)


def assign_zones(pts: DataFrame, zone_table: DataFrame, default_zl: int, default_provider: str) -> DataFrame:
    """Each point with zoom and provider of the zone of the highest priority that holds it, else the default.

    The zones of a grid cell come as one array, so points are joined once and the winner is taken in the row.
    """
    met = spatial.with_boxes(pts, zone_table, 10.0, "priority", "zl", "provider")
    win = F.array_max(F.transform("_boxes", lambda z: F.struct(z["priority"], z["zl"].alias("zl"), z["provider"].alias("provider"))))
    return met.withColumn("_win", win).select(
        *pts.columns, F.coalesce("_win.zl", F.lit(default_zl)).alias("zl"), F.coalesce("_win.provider", F.lit(default_provider)).alias("provider")
    )


def upgrade_near(pts: DataFrame, places: DataFrame, reach_deg: float, zoom: int) -> DataFrame:
    """Raises the zoom of points within a box around any of the places."""
    boxes = places.select(*[(F.col(c) + s * reach_deg).alias(n) for c, s, n in (("lon", -1, "x0"), ("lat", -1, "y0"), ("lon", 1, "x1"), ("lat", 1, "y1"))])
    near = spatial.with_boxes(pts, boxes, 1.0)
    return near.withColumn("zl", F.when(F.size("_boxes") > 0, F.greatest("zl", F.lit(zoom))).otherwise(F.col("zl"))).drop("_boxes")


@query(
    "texture_cells",
    f"""
, win AS (SELECT p.event_id, max_by(struct_pack(zl := zl, provider := provider), priority) AS w FROM points p JOIN zones z
  ON p.lon BETWEEN z.x0 AND z.x1 AND p.lat BETWEEN z.y0 AND z.y1 GROUP BY p.event_id)
, near AS (SELECT DISTINCT p.event_id FROM points p JOIN anchors a
  ON p.lon BETWEEN a.lon - 0.5 AND a.lon + 0.5 AND p.lat BETWEEN a.lat - 0.5 AND a.lat + 0.5)
, placed AS (SELECT p.*, coalesce(w.w.provider, 'BASE') AS provider,
  CASE WHEN n.event_id IS NULL THEN coalesce(w.w.zl, 11) ELSE greatest(coalesce(w.w.zl, 11), 15) END AS zl
  FROM points p LEFT JOIN win w USING (event_id) LEFT JOIN near n USING (event_id))
, cells AS (SELECT *, {_cell('zl')} FROM placed)
SELECT til_x, til_y, zl, provider, count(*) AS n, round(avg(value), 4) AS avg_value FROM cells GROUP BY ALL""",
    "points", "zones", "anchors",
)
def texture_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texture cells of points: zone of the highest priority, finer near airports, counts and means."""
    pts = assign_zones(points(spark, sf_dir), zones(spark, sf_dir), 11, "BASE")
    pts = upgrade_near(pts, anchors(spark, sf_dir), 0.5, 15)
    x, y = G.texture_cell("lat", "lon", "zl")
    return pts.groupBy(x.alias("til_x"), y.alias("til_y"), "zl", "provider").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value")
    )


@query(
    "tile_counts",
    f"""
, t AS (SELECT CAST(floor(round_even((lon/180+1)*pow(2,17), 0)/256) AS BIGINT) AS x,
  CAST(floor(round_even((1-{_RY.format(lat='lat')})*pow(2,17), 0)/256) AS BIGINT) AS y, value FROM points)
SELECT x, y, list_reduce(list_transform(range(9, -1, -1), lambda a: CAST(((x >> a) & 1) + 2 * ((y >> a) & 1) AS VARCHAR)), lambda p, q: p || q) AS quadkey,
  count(*) AS n, round(sum(value), 4) AS total FROM t GROUP BY x, y""",
    "points",
)
def tile_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each web-mercator tile at zoom 10, with the quadkey."""
    x, y = G.tile("lat", "lon", 10)
    counted = points(spark, sf_dir).groupBy(x.alias("x"), y.alias("y")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return counted.select("x", "y", G.quadkey("x", "y", 10).alias("quadkey"), "n", "total")


@query(
    "geodesy",
    f"""
SELECT c_custkey, round(cos(radians(lat))*pi()*6378137/180, 6) AS lon_m, round(2*pi()*6378137*cos(radians(lat))/pow(2,22), 9) AS px,
  round(radians(lon)*6378137, 4) AS east, round({_RY.format(lat='lat')}*pi()*6378137, 4) AS north,
  round(2*6378137*atan2(sqrt(h), sqrt(1-h)), 3) AS metres, til_x, til_y,
  round((til_x/pow(2,13)-1)*180, 9) AS corner_lon, round(360/pi()*atan(exp(pi()*(1-til_y/pow(2,13))))-90, 9) AS corner_lat,
  round(least(greatest((lon/180+1)*pow(2,9)-til_x//16, 0), 1), 9) AS s,
  round(least(greatest(1-((1-{_RY.format(lat='lat')})*pow(2,9)-til_y//16), 0), 1), 9) AS t,
  CASE WHEN (lon+180)/360 >= 1 THEN repeat('1', 24) ELSE lpad(bin(CAST(floor((lon+180)/360*16777216) AS BIGINT)), 24, '0') END AS prefix
FROM (SELECT *, {_cell(14)}, pow(sin(radians(lat-48.85)/2),2)+cos(radians(lat))*cos(radians(48.85e0))*pow(sin(radians(lon-2.35)/2),2) AS h FROM sites)""",
    "sites",
)
def geodesy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar geodesy of every site."""
    x, y = G.texture_cell("lat", "lon", 14)
    rows = sites(spark, sf_dir).withColumn("til_x", x).withColumn("til_y", y)
    east, north = G.to_mercator("lon", "lat")
    corner_lat, corner_lon = G.tile_corner("til_x", "til_y", 14)
    s, t = G.texture_coordinates("lat", "lon", "til_x", "til_y", 14)
    return rows.select(
        "c_custkey", F.round(G.lon_to_m("lat"), 6).alias("lon_m"), F.round(G.pixel_size("lat", 14), 9).alias("px"),
        F.round(east, 4).alias("east"), F.round(north, 4).alias("north"),
        F.round(G.haversine("lon", "lat", F.lit(2.35), F.lit(48.85)), 3).alias("metres"), "til_x", "til_y",
        F.round(corner_lon, 9).alias("corner_lon"), F.round(corner_lat, 9).alias("corner_lat"), F.round(s, 9).alias("s"), F.round(t, 9).alias("t"),
        G.binary_prefix((F.col("lon") + 180) / 360).alias("prefix"),
    )


@query(
    "names",
    """
, f AS (SELECT *, CAST(floor(lat) AS INT) AS a, CAST(floor(lon) AS INT) AS b, CAST(floor(lat/10)*10 AS INT) AS a10, CAST(floor(lon/10)*10 AS INT) AS b10 FROM sites)
, g AS (SELECT *, (CASE WHEN a < 0 THEN '-' ELSE '+' END) || lpad(abs(a)::VARCHAR, 2, '0') || (CASE WHEN b < 0 THEN '-' ELSE '+' END) || lpad(abs(b)::VARCHAR, 3, '0') AS short_name,
  (CASE WHEN a10 < 0 THEN '-' ELSE '+' END) || lpad(abs(a10)::VARCHAR, 2, '0') || (CASE WHEN b10 < 0 THEN '-' ELSE '+' END) || lpad(abs(b10)::VARCHAR, 3, '0') AS block,
  (CASE WHEN a < 0 THEN 'S' ELSE 'N' END) || lpad(abs(a)::VARCHAR, 2, '0') || (CASE WHEN b < 0 THEN 'W' ELSE 'E' END) || lpad(abs(b)::VARCHAR, 3, '0') AS hem FROM f)
SELECT c_custkey, short_name, block, hem, a AS back_lat, b AS back_lon, 'tiles/' || block || '/' || short_name || '/mesh' AS path,
  (c_custkey % 7) || '_' || (c_custkey % 11) || '_' || 'SRC' || (10 + c_custkey % 9) || '.dds' AS texture, CAST(c_custkey % 11 AS INT) AS tex_x, CAST(10 + c_custkey % 9 AS INT) AS tex_zl,
  'https://' || ['a','b','c'][CAST(c_custkey % 3 + 1 AS INT)] || '.example/' || (10 + c_custkey % 9) || '/' || c_custkey || '/' || (CAST(pow(2, 10 + c_custkey % 9) AS BIGINT) - 1 - c_custkey % 11) AS url
FROM g""",
    "sites",
)
def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, paths and addresses of the tile that holds each site, and names read back."""
    rows = sites(spark, sf_dir).withColumn("hem", N.hemisphere_name("lat", "lon"))
    zoom = (10 + F.col("c_custkey") % 9).cast("int")
    rows = rows.withColumn("texture", F.concat(N.texture_name((F.col("c_custkey") % 11), (F.col("c_custkey") % 7), zoom, F.lit("SRC")), F.lit(".dds")))
    back_lat, back_lon = N.parse_hemisphere("hem")
    read = N.parse_texture_name("texture")
    address = N.url(F.lit("https://{switch:a,b,c}.example/{zoom}/{x}/{-y}"), zoom, "c_custkey", F.col("c_custkey") % 11, F.lit(""), "c_custkey")
    return rows.select(
        "c_custkey", N.signed_name("lat", "lon").alias("short_name"), N.block_name("lat", "lon").alias("block"), "hem",
        back_lat.alias("back_lat"), back_lon.alias("back_lon"), N.tile_path("tiles", "lat", "lon", "mesh").alias("path"), "texture",
        read["x"].alias("tex_x"), read["zoom"].alias("tex_zl"), address.alias("url"),
    )


@query(
    "tag_selection",
    """
, t AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k FROM points)
SELECT event_id, event_type, k, event_type = 'click' AND k = '7' AS both_hold FROM t
WHERE event_type = 'click' OR k = '7'""",
    "points",
)
def tag_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by tag queries, a union of clauses, with the tags asked for."""
    rows = points(spark, sf_dir).select(
        "event_id", F.map_concat(F.create_map(F.lit("type"), "event_type"), F.from_json("props", "map<string,string>")).alias("tags")
    )
    clauses = [tags.parse('node["type"="click"]'), tags.parse('node["k"="7"]')]
    found = tags.select(rows, clauses, keep=["type", "k"])
    return found.select(
        "event_id", F.col("tags")["type"].alias("event_type"), F.col("tags")["k"].alias("k"),
        ((F.col("tags")["type"] == "click") & (F.col("tags")["k"] == "7")).alias("both_hold"),
    )


@query(
    "tag_exclusion",
    """
SELECT event_type, count(*) AS n FROM points WHERE NOT (event_type IN ('view', 'error')) AND CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0 GROUP BY event_type""",
    "points",
)
def tag_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that have none of some keys; a point's keys are its type and whether k is odd."""
    k = F.from_json("props", "map<string,string>")["k"].cast("int")
    rows = points(spark, sf_dir).withColumn("tags", F.map_from_entries(F.array(
        F.struct(F.col("event_type").alias("k"), F.lit("yes").alias("v")), F.struct(F.when(k % 2 == 0, "even").otherwise("odd").alias("k"), F.lit("yes").alias("v"))
    )))
    return tags.without(rows, ["view", "error", "odd"]).groupBy("event_type").agg(F.count("*").alias("n"))


@query(
    "nearest_airport",
    """
, d AS (SELECT c_custkey, s_suppkey, pow(sin(radians(s.lat-a.lat)/2),2)+cos(radians(s.lat))*cos(radians(a.lat))*pow(sin(radians(s.lon-a.lon)/2),2) AS h FROM sites s, anchors a)
, m AS (SELECT c_custkey, s_suppkey, 2*6378137*atan2(sqrt(h), sqrt(1-h)) AS metres FROM d)
, b AS (SELECT c_custkey, min_by(s_suppkey, struct_pack(m := metres, s := s_suppkey)) AS s_suppkey, min(metres) AS metres FROM m WHERE metres < 1500000 GROUP BY c_custkey)
SELECT s.c_custkey, coalesce('airport ' || b.s_suppkey, 'new ' || s.c_name) AS owner, round(b.metres, 2) AS metres FROM sites s LEFT JOIN b USING (c_custkey)""",
    "sites", "anchors",
)
def nearest_airport(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each site with the nearest airport within a radius; sites without one found a new entity."""
    near = spatial.nearest_within(sites(spark, sf_dir), anchors(spark, sf_dir), "c_custkey", "s_suppkey", 1_500_000.0, 10.0)
    owner = F.coalesce(F.concat(F.lit("airport "), F.col("s_suppkey").cast("string")), F.concat(F.lit("new "), "c_name"))
    return near.select("c_custkey", owner.alias("owner"), F.round("metres", 2).alias("metres"))


@query(
    "first_zone",
    """
SELECT s.c_custkey, min(z.zone) AS zone FROM sites s JOIN zones z ON s.lon BETWEEN z.x0 AND z.x1 AND s.lat BETWEEN z.y0 AND z.y1 GROUP BY s.c_custkey""",
    "sites", "zones",
)
def first_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial join in which the first zone in order wins."""
    held = spatial.points_in_boxes(sites(spark, sf_dir), zones(spark, sf_dir), 10.0)
    return held.groupBy("c_custkey").agg(F.min("zone").alias("zone"))


@query(
    "outside_zones",
    """
SELECT c_custkey, c_mktsegment FROM sites s WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE s.lon BETWEEN z.x0 AND z.x1 AND s.lat BETWEEN z.y0 AND z.y1)""",
    "sites", "zones",
)
def outside_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spatial anti join."""
    return spatial.points_in_boxes(sites(spark, sf_dir), zones(spark, sf_dir), 10.0, "left_anti").select("c_custkey", "c_mktsegment")


@query(
    "merged_zones",
    """
, box AS (SELECT c_custkey AS id, c_nationkey % 5 AS class, lon AS x0, lat AS y0, lon + 3 AS x1, lat + 2 AS y1 FROM sites)
, pair AS (SELECT a.id AS a, b.id AS b FROM box a JOIN box b ON a.class = b.class AND a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1)
, reach AS (SELECT id AS a, id AS b FROM box UNION SELECT r.a, p.b FROM reach r JOIN pair p ON r.b = p.a)
, root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)
SELECT r.root, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM root r JOIN box USING (id) GROUP BY r.root""",
    "sites",
)
def merged_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping boxes around sites of one class merged transitively to their common bounds."""
    c = F.col
    z = sites(spark, sf_dir).select(c("c_custkey").alias("id"), (c("c_nationkey") % 5).alias("class"), c("lon").alias("x0"), c("lat").alias("y0"), (c("lon") + 3).alias("x1"), (c("lat") + 2).alias("y1"))
    roots = components(spatial.linking_boxes(z, "id", 1.0, "class"))
    least = roots.groupBy("root").agg(F.min("node").alias("first"))
    named = z.join(roots.join(least, "root").select(c("node").alias("id"), "first"), "id", "left")
    return named.groupBy(F.coalesce("first", "id").alias("root")).agg(
        F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )


SQL["merged_zones"] = SQL["merged_zones"].replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "quadtree",
    """
, p AS (SELECT event_id, lpad(bin(CAST(floor((lon+180)/360*16777216) AS BIGINT)), 24, '0') AS bx, lpad(bin(CAST(floor((lat+90)/180*16777216) AS BIGINT)), 24, '0') AS b_y FROM points)
, l AS (SELECT event_id, level, substr(bx, 1, level) AS kx, substr(b_y, 1, level) AS ky FROM p, range(1, 9) AS r(level))
, c AS (SELECT level, kx, ky, count(*) AS n FROM l GROUP BY ALL)
, best AS (SELECT l.event_id, min(l.level) AS level FROM l JOIN c USING (level, kx, ky) WHERE c.n <= 100 OR l.level = 8 GROUP BY l.event_id)
SELECT l.kx, l.ky, count(*) AS n FROM best b JOIN l USING (event_id, level) GROUP BY l.kx, l.ky""",
    "points",
)
def quadtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adaptive quadtree buckets of at most 100 points, at most 8 levels deep."""
    from tilewright.operators.quadtree import buckets

    pts = points(spark, sf_dir).select("event_id", ((F.col("lon") + 180) / 360).alias("u"), ((F.col("lat") + 90) / 180).alias("v"))
    return buckets(pts, "u", "v", capacity=100, first_level=1, last_level=8).groupBy("kx", "ky").agg(F.count("*").alias("n"))


@query(
    "airport_keys",
    """
SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN substr('L' || lpad(s_suppkey::VARCHAR, 6, 'F'), 1, 4) WHEN s_suppkey % 4 = 1 THEN substr('Q' || s_suppkey || 'ZZZ', 1, 3) WHEN s_suppkey % 4 = 2 THEN s_name ELSE 'place' END AS key,
  CASE s_suppkey % 4 WHEN 0 THEN 'icao' WHEN 1 THEN 'iata' WHEN 2 THEN 'name' ELSE 'place' END AS key_type
FROM anchors""",
    "anchors",
)
def airport_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known key of each airport in order of kinds."""
    k = F.col("s_suppkey")
    digits = k.cast("string")
    keyed = N.airport_key(
        F.when(k % 4 == 0, F.concat(F.lit("L"), F.lpad(digits, 6, "F"))), F.when(k % 4 == 1, F.concat(F.lit("Q"), digits, F.lit("ZZZ"))),
        F.lit(""), F.when(k % 4 == 2, F.col("s_name")), F.col("lon"), F.col("lat"),
    )
    return anchors(spark, sf_dir).select("s_suppkey", keyed.alias("k")).select(
        "s_suppkey", F.when(F.col("k.key_type") == "place", "place").otherwise(F.col("k.key")).alias("key"), "k.key_type"
    )


@query(
    "pyramid_fallback",
    f"""
, want AS (SELECT DISTINCT {_cell(12)} FROM points)
, have AS (SELECT zl, CAST(floor(x / pow(2, 12 - zl) / 16) * 16 AS BIGINT) AS x, CAST(floor(y / pow(2, 12 - zl) / 16) * 16 AS BIGINT) AS y, min(s_suppkey) AS source
  FROM (SELECT s_suppkey, CAST(12 - s_suppkey % 5 AS INT) AS zl, {_cell(12, x='x', y='y')} FROM anchors) GROUP BY ALL)
, hit AS (SELECT w.til_x, w.til_y, h.zl, h.source FROM want w JOIN have h ON h.x = CAST(floor(w.til_x / pow(2, 12 - h.zl) / 16) * 16 AS BIGINT) AND h.y = CAST(floor(w.til_y / pow(2, 12 - h.zl) / 16) * 16 AS BIGINT))
SELECT w.til_x, w.til_y, max(h.zl) AS zl, max_by(h.source, h.zl) AS source FROM want w LEFT JOIN hit h USING (til_x, til_y) GROUP BY w.til_x, w.til_y""",
    "points", "anchors",
)
def pyramid_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each wanted texture the finest one on hand, its own or an ancestor up to four levels up."""
    x, y = G.texture_cell("lat", "lon", 12)
    want = points(spark, sf_dir).select(x.alias("til_x"), y.alias("til_y")).distinct()
    zl = (12 - F.col("s_suppkey") % 5).cast("int")
    have = anchors(spark, sf_dir).select(
        "s_suppkey", zl.alias("zl"), G.parent_cell(x, 12 - zl).alias("x"), G.parent_cell(y, 12 - zl).alias("y")
    ).groupBy("zl", "x", "y").agg(F.min("s_suppkey").alias("source"))
    tried = want.withColumn("zl", F.explode(F.sequence(F.lit(8), F.lit(12)))).withColumns(
        {"x": G.parent_cell("til_x", 12 - F.col("zl")), "y": G.parent_cell("til_y", 12 - F.col("zl"))}
    )
    hit = tried.join(have, ["zl", "x", "y"]).groupBy("til_x", "til_y").agg(F.max("zl").alias("zl"), F.max_by("source", "zl").alias("source"))
    return want.join(hit, ["til_x", "til_y"], "left").select("til_x", "til_y", "zl", "source")


@query(
    "obsolete_textures",
    f"""
, need AS (SELECT DISTINCT {_cell(9)} FROM points WHERE event_id % 3 = 0), have AS (SELECT DISTINCT {_cell(9)} FROM points WHERE event_id % 2 = 0)
SELECT * FROM have EXCEPT SELECT * FROM need""",
    "points",
)
def obsolete_textures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Textures on hand that nothing needs (anti join)."""
    x, y = G.texture_cell("lat", "lon", 9)
    cells = points(spark, sf_dir).select("event_id", x.alias("til_x"), y.alias("til_y"))
    need = cells.where("event_id % 3 = 0").select("til_x", "til_y")
    return cells.where("event_id % 2 = 0").select("til_x", "til_y").distinct().join(need, ["til_x", "til_y"], "left_anti")


@query(
    "resolved_layers",
    """
SELECT p_partkey, p_brand, coalesce(s.s_name, 'default') AS source, CASE WHEN p_size <= 10 THEN 'low' WHEN p_size <= 30 THEN 'medium' WHEN p_size <= 45 THEN 'high' ELSE 'mask' END AS priority,
  coalesce(n.n_name, 'GLOBE') AS extent FROM part p LEFT JOIN supplier s ON s.s_suppkey = p.p_partkey % 13 LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey AND n.n_nationkey % 2 = 0""",
)
def resolved_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of layers joined with its providers and their extents; defaults where there are none."""
    from tilewright.session import table

    layers = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", (F.col("p_partkey") % 13).alias("s_suppkey"))
    provider = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    extent = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    size = F.col("p_size")
    rank = F.when(size <= 10, "low").when(size <= 30, "medium").when(size <= 45, "high").otherwise("mask")
    return layers.join(provider, "s_suppkey", "left").join(extent, "s_nationkey", "left").select(
        "p_partkey", "p_brand", F.coalesce("s_name", F.lit("default")).alias("source"), rank.alias("priority"), F.coalesce("n_name", F.lit("GLOBE")).alias("extent")
    )
