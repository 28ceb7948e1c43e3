"""Queries that select: members of relations, loads by tile or box, classes of surfaces, catalogs and their order."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.functions import names as N
from tilewright.functions import shapes as S
from tilewright.functions.geodesy import METRES_PER_DEGREE
from tilewright.operators import relations, ways
from tilewright.operators.quadtree import buckets
from tilewright.operators.spatial import points_in_boxes
from tilewright.plans.fixtures import anchors, points, site_zones, sites, sql, way_nodes, zones
from tilewright.plans.lines import _SEG
from tilewright.session import scratch_path, table
from tilewright.sources import layers

QUERIES, SQL = {}, {}
SCALE = math.cos(math.radians(45.5))
#: Square metres of a square degree at the latitude of the ways.
SQUARE = METRES_PER_DEGREE**2 * SCALE


def query(name: str, body: str | None = None, *projections: str):
    def add(f):
        QUERIES[name] = f
        if body is not None:
            SQL[name] = sql(body, *projections) if projections else body.strip()
        return f

    return add


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as member ways of the relation of their customer, with a role."""
    role = F.when(F.col("o_orderstatus") == "O", "outer").when(F.col("o_orderstatus") == "F", "inner").otherwise("label")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("relation"), F.col("o_orderkey").alias("way"), role.alias("role"), "o_orderpriority")


@query(
    "relation_roles",
    """
SELECT o_custkey AS relation, count(*) FILTER (o_orderstatus = 'O') AS outers, count(*) FILTER (o_orderstatus = 'F') AS inners,
  coalesce(string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) FILTER (o_orderstatus = 'O'), '') AS outer_ways
FROM orders WHERE o_orderstatus IN ('O', 'F') GROUP BY o_custkey HAVING count(*) FILTER (o_orderstatus = 'O') > 0""",
)
def relation_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of relations by role; other roles go, and so do relations without an outer member."""
    r = relations.by_role(_members(spark, sf_dir)).where(F.size("outer") > 0)
    names = F.array_join(F.transform("outer", lambda w: w.cast("string")), " ")
    return r.select("relation", F.size("outer").cast("bigint").alias("outers"), F.size("inner").cast("bigint").alias("inners"), names.alias("outer_ways"))


@query(
    "owned_members",
    """
SELECT o_orderkey AS way FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT (o_orderstatus IN ('O', 'F')
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'))""",
)
def owned_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways that match a selection themselves, less those that a selected relation owns."""
    m = _members(spark, sf_dir)
    direct = m.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("way")
    selected = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("relation"))
    return relations.without_owned(direct, m, selected)


@query(
    "tile_loads",
    """
, wanted AS (SELECT * FROM points WHERE event_type IN ('click', 'purchase'))
SELECT CAST(floor(lat) AS INT) AS lat, CAST(floor(lon) AS INT) AS lon, count(*) AS n, min(event_id) AS first, max(event_id) AS last
FROM wanted WHERE lat >= 40 AND lat < 50 AND lon >= -10 AND lon < 30 GROUP BY 1, 2""",
    "points",
)
def tile_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several tag queries over a stretch of tiles, read back from the layer's cache, which keeps tiles apart."""
    pts = points(spark, sf_dir).select("event_id", "lon", "lat", F.create_map(F.lit("event"), F.col("event_type")).alias("tags"))
    path = scratch_path(spark, "layer")
    queries = ['node["event"="click"]', 'node["event"="purchase"]']
    layers.write_cache(layers.matching(pts, "node", queries), path)
    found = layers.read_tiles(spark, path, lat=(40, 50), lon=(-10, 30))
    return found.groupBy("tile_lat", "tile_lon").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("event_id").alias("last")).select(
        F.col("tile_lat").alias("lat"), F.col("tile_lon").alias("lon"), "n", "first", "last")


@query(
    "box_loads",
    """
SELECT z.zone, count(*) AS n, max(p.event_id) AS last FROM zones z JOIN points p ON p.lon BETWEEN z.x0 AND z.x1 AND p.lat BETWEEN z.y0 AND z.y1
WHERE p.event_type = 'view' GROUP BY z.zone""",
    "points", "zones",
)
def box_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tag query over each of many boxes."""
    pts = points(spark, sf_dir).select("event_id", "lon", "lat", F.create_map(F.lit("event"), F.col("event_type")).alias("tags"))
    found = points_in_boxes(layers.matching(pts, "node", ['node["event"="view"]']), zones(spark, sf_dir).select("zone", "x0", "y0", "x1", "y1"), 20.0)
    return found.groupBy("zone").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


_RING = _SEG.replace(
    "FROM way_nodes WINDOW",
    "FROM (SELECT way, pos, x, y FROM way_nodes UNION ALL SELECT way, max(pos)+1, arg_min(x,pos), arg_min(y,pos) FROM way_nodes GROUP BY way) WINDOW",
).strip() + "\n, area AS (SELECT way, round(abs(sum(x*y2-x2*y))/2, 9) AS area FROM seg WHERE n > 3 GROUP BY way)\n"


def _areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """way, ring and area of the closed ring of each way of three nodes or more."""
    lines = ways.lines(way_nodes(spark, sf_dir)).where(F.size("line") > 2)
    rings = lines.select("way", F.concat("line", F.slice("line", 1, 1)).alias("ring"))
    return rings.withColumn("area", F.round(F.abs(S.signed_area("ring")), 9))


@query(
    "lake_classes",
    _RING + """
SELECT way, CASE WHEN area < 0.001 THEN 'none' WHEN area < 0.1 OR way % 10 = 3 THEN 'water' ELSE 'sea_like' END AS class, area FROM area""",
    "way_nodes",
)
def lake_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Water surfaces by area: large ones count as sea unless their name is on a list; tiny ones are left out of both."""
    kept_names = [f"lake {i}" for i in range(3, 4)]
    name = F.concat(F.lit("lake "), (F.col("way") % 10).cast("string"))
    kind = relations.lake_class(F.col("area"), name, least=0.001, large=0.1, keep=kept_names)
    return _areas(spark, sf_dir).select("way", kind.alias("class"), "area")


@query(
    "airport_discards",
    _RING + f"""
, s AS (SELECT o_custkey AS airport, o_orderstatus AS kind, area*{SQUARE!r}*1e-6 AS m2 FROM area JOIN orders ON o_orderkey = way)
, a AS (SELECT airport, max(CASE WHEN kind = 'O' THEN m2 END) AS boundary, sum(CASE WHEN kind = 'F' THEN m2 ELSE 0 END) AS runway FROM s GROUP BY airport)
SELECT airport, CASE WHEN boundary IS NOT NULL THEN boundary >= 900 ELSE runway >= 400 END AS kept FROM a""",
    "way_nodes",
)
def airport_discards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airports that are large enough: by their boundary if there is one, else by their runways together."""
    own = _areas(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("way"), F.col("o_custkey").alias("airport"), "o_orderstatus"), "way")
    m2 = F.col("area") * SQUARE * 1e-6  # the ways are drawn a thousand times too large
    each = own.groupBy("airport").agg(F.max(F.when(F.col("o_orderstatus") == "O", m2)).alias("boundary"), F.sum(F.when(F.col("o_orderstatus") == "F", m2).otherwise(0.0)).alias("runway"))
    return each.select("airport", F.when(F.col("boundary").isNotNull(), F.col("boundary") >= 900).otherwise(F.col("runway") >= 400).alias("kept"))


@query(
    "overlay_roads",
    """
SELECT n_nationkey AS zone, l_linenumber AS road_type, count(*) AS segments
FROM lineitem JOIN (SELECT l_orderkey % 25 AS n_nationkey, l_orderkey FROM lineitem GROUP BY ALL) USING (l_orderkey)
WHERE NOT (CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE l_linenumber IN (2, 5, 7) END) GROUP BY ALL""",
)
def overlay_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Road segments left by each zone's list of types to leave out; ``*`` leaves out all, an empty list none."""
    roads = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 25).alias("zone"), F.col("l_linenumber").alias("road_type"))
    wish = F.when(F.col("zone") % 3 == 0, "*").when(F.col("zone") % 3 == 1, "").otherwise("2, 5,7")
    return roads.where(~relations.left_out(F.col("road_type"), wish)).groupBy("zone", "road_type").agg(F.count("*").alias("segments"))


@query(
    "tile_zones",
    """
SELECT CAST(floor(y0) AS INT) AS lat, CAST(floor(x0) AS INT) AS lon, count(*) AS zones,
  string_agg('[' || printf('%.1f,%.1f,%.1f,%.1f', y0, x0, y1, x1) || '] ' || zl || ' ' || provider, ';' ORDER BY zl DESC, zone) AS zone_list
FROM site_zones GROUP BY 1, 2""",
    "site_zones",
)
def tile_site_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each tile the zones that begin in it, as the line of its settings, by falling zoom."""
    box = F.format_string("[%.1f,%.1f,%.1f,%.1f] %d %s", "y0", "x0", "y1", "x1", "zl", "provider")
    z = site_zones(spark, sf_dir).select(F.floor("y0").cast("int").alias("lat"), F.floor("x0").cast("int").alias("lon"), F.struct(-F.col("zl"), "zone", box.alias("t")).alias("z"))
    lists = z.groupBy("lat", "lon").agg(F.sort_array(F.collect_list("z")).alias("z"))
    return lists.select("lat", "lon", F.size("z").cast("bigint").alias("zones"), F.array_join(F.transform("z", lambda r: r["t"]), ";").alias("zone_list"))


@query(
    "chosen_resolutions",
    """
, r AS (SELECT p_partkey, p_size, i, 64.0e0 / pow(2, i) * (1 + (p_partkey % 3)) AS res FROM part, range(0, 8) AS t(i))
SELECT p_partkey, coalesce(min(i) FILTER (res <= 1.1 * p_size), 0) AS level FROM r GROUP BY p_partkey""".replace(", r AS", "WITH r AS", 1),
)
def chosen_resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of a source's resolutions that is fine enough for what is asked, within a tenth; none: the first."""
    p = table(spark, sf_dir, "part")
    res = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: 64.0 / F.pow(F.lit(2.0), i) * (1 + F.col("p_partkey") % 3))
    return p.select("p_partkey", N.first_sufficient(res, F.col("p_size") * 1.1).cast("bigint").alias("level"))


@query(
    "collected_sets",
    """
SELECT c_nationkey AS nation, count(DISTINCT c_mktsegment) AS n, array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM customer GROUP BY c_nationkey""",
)
def collected_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The set of values met under each key."""
    met = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.sort_array(F.collect_set("c_mktsegment")).alias("s"))
    return met.select("nation", F.size("s").cast("bigint").alias("n"), F.array_join("s", ",").alias("segments"))


def _rank(order: list[Column], *groups: str) -> Column:
    return F.row_number().over(Window.partitionBy(*groups).orderBy(*order)).cast("bigint").alias("place")


@query(
    "polygon_order",
    _RING + """
, b AS (SELECT way % 100 AS layer, way, max(x)-min(x) AS w, max(y)-min(y) AS h FROM seg WHERE n > 3 GROUP BY way)
SELECT layer, way, row_number() OVER (PARTITION BY layer ORDER BY round(w*h, 9) DESC, way) AS place FROM b""",
    "way_nodes",
)
def polygon_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polygons of a layer by the size of their bounds, the largest first."""
    b = _areas(spark, sf_dir).select((F.col("way") % 100).alias("layer"), "way", S.bounds("ring").alias("b"))
    size = F.round((F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0")), 9)
    return ways.numbered(b.select("layer", "way", size.alias("size")), [F.col("size").desc(), F.col("way")], "place", "layer").drop("size")


@query(
    "airport_listing",
    """
, k AS (SELECT s_suppkey, s_nationkey, s_suppkey % 5 AS kind, s_name FROM anchors)
SELECT s_nationkey AS nation, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY kind, s_name, s_suppkey) AS place FROM k""",
    "anchors",
)
def airport_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Airports of a country listed by kind of key (icao, iata, local, name, place), then by key."""
    kinds = F.array(*[F.lit(k) for k in ("icao", "iata", "local_ref", "name", "place")])
    a = anchors(spark, sf_dir).withColumn("key_type", F.get(kinds, (F.col("s_suppkey") % 5).cast("int")))
    order = F.array_position(kinds, F.col("key_type"))
    listed = a.select(F.col("s_nationkey").alias("nation"), "s_suppkey", order.alias("kind"), "s_name")
    return ways.numbered(listed, [F.col("kind"), F.col("s_name"), F.col("s_suppkey")], "place", "nation").select("nation", "s_suppkey", "place")


@query(
    "grid_lines",
    """
SELECT way, array_to_string(list_sort(list(DISTINCT CAST(round_even(x*1000, 0) AS BIGINT))), ' ') AS xs, array_to_string(list_sort(list(DISTINCT CAST(round_even(y*1000, 0) AS BIGINT))), ' ') AS ys FROM way_nodes GROUP BY way""",
    "way_nodes",
)
def grid_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted distinct columns and rows that a way's nodes lie on."""
    lines = ways.lines(way_nodes(spark, sf_dir))
    axis = lambda c: F.array_join(F.sort_array(F.array_distinct(F.transform("line", lambda p: F.rint(p[c] * 1000).cast("bigint")))).cast("array<string>"), " ")
    return lines.select("way", axis("x").alias("xs"), axis("y").alias("ys"))


@query(
    "zone_rings",
    """
SELECT zone, row_number() OVER (PARTITION BY zone % 2 ORDER BY zl DESC, priority) AS place, 5 AS points, printf('%.1f %.1f', y0, x0) AS closes FROM site_zones""",
    "site_zones",
)
def zone_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones by falling zoom, their rings closed by repeating the first point of the flat list of coordinates."""
    flat = F.array("y0", "x0", "y0", "x1", "y1", "x1", "y1", "x0")
    z = site_zones(spark, sf_dir).withColumn("half", F.col("zone") % 2).withColumn("ring", S.closed_flat(flat))
    at = lambda i: F.element_at("ring", i)
    z = ways.numbered(z, [F.col("zl").desc(), F.col("priority")], "place", "half")
    return z.select("zone", "place", (F.size("ring") / 2).cast("int").alias("points"), F.format_string("%.1f %.1f", at(-2), at(-1)).alias("closes"))


@query(
    "boundary_order",
    """
, e AS (SELECT way, pos, x, y, greatest(x, 1-x, y, 1-y) AS m FROM way_nodes)
, s AS (SELECT way, pos, CASE WHEN x = 1-m THEN 0.0e0 WHEN 1-x = 1-m THEN 1.0e0 ELSE x END AS x, CASE WHEN x = 1-m OR 1-x = 1-m THEN y WHEN y = 1-m THEN 0.0e0 ELSE 1.0e0 END AS y FROM e)
, p AS (SELECT way, pos, CASE WHEN x = 0 AND y < 1 THEN y WHEN y = 1 AND x < 1 THEN 1+x WHEN x = 1 AND y > 0 THEN 3-y ELSE 4-x END AS b FROM s)
, q AS (SELECT way, pos, CASE WHEN b >= 4 THEN b-4 ELSE b END AS b FROM p)
SELECT way, pos, round(b, 9) AS place, round(coalesce(lead(b) OVER w, first_value(b) OVER (PARTITION BY way ORDER BY b, pos) + 4), 9) AS next_place FROM q WINDOW w AS (PARTITION BY way ORDER BY b, pos)""",
    "way_nodes",
)
def boundary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points pushed to the nearest side of the tile, by their place along its sides, each with the next one around."""
    n = way_nodes(spark, sf_dir)
    c = F.col
    side = 1 - F.greatest(c("x"), 1 - c("x"), c("y"), 1 - c("y"))
    left, right = c("x") == side, 1 - c("x") == side
    x = F.when(left, 0.0).when(right, 1.0).otherwise(c("x"))
    y = F.when(left | right, c("y")).when(c("y") == side, 0.0).otherwise(1.0)
    b = n.select("way", "pos", S.perimeter_place(x, y).alias("b"))
    w = Window.partitionBy("way").orderBy("b", "pos")
    return b.select("way", "pos", F.round("b", 9).alias("place"), F.round(F.coalesce(F.lead("b").over(w), F.first("b").over(w) + 4), 9).alias("next_place"))


@query(
    "tagged_first",
    """
SELECT way, pos, row_number() OVER (PARTITION BY way ORDER BY CASE WHEN tag = 'R' THEN 0 ELSE 1 END, pos) AS place FROM way_nodes""",
    "way_nodes",
)
def tagged_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged elements before those without a tag, each in their own order."""
    n = way_nodes(spark, sf_dir).withColumn("tags", F.when(F.col("tag") == "R", F.create_map(F.lit("ref"), F.lit("R"))))
    return n.select("way", "pos", _rank([F.col("tags").isNull(), F.col("pos")], "way"))


@query(
    "layer_union",
    """
SELECT 'banked' AS layer, way, count(*) AS nodes FROM way_nodes GROUP BY way HAVING max(kind) <= 5 AND max(z) - min(z) >= 20
UNION ALL SELECT 'small', way, count(*) FROM way_nodes GROUP BY way HAVING max(kind) > 6""",
    "way_nodes",
)
def layer_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two selections of roads as one layer."""
    w = way_nodes(spark, sf_dir).groupBy("way").agg(F.count("*").alias("nodes"), F.max("kind").alias("level"), (F.max("z") - F.min("z")).alias("rise"))
    part = lambda name, test: w.where(test).select(F.lit(name).alias("layer"), "way", "nodes")
    return part("banked", "level <= 5 AND rise >= 20").unionByName(part("small", "level > 6"))


@query(
    "file_union",
    """
SELECT 'customer' AS file, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2""",
)
def file_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of several files as one layer that knows the file of each; files that are absent count as empty."""
    both = layers.read_files(spark, {name: f"{sf_dir}/{name}.parquet" for name in ("customer", "supplier", "absent")}, ("c_nationkey", "s_nationkey"))
    return both.groupBy("file", F.coalesce("c_nationkey", "s_nationkey").alias("nation")).agg(F.count("*").alias("n"))


@query(
    "known_providers",
    """
SELECT s_nationkey AS provider FROM supplier INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 5000""",
)
def known_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers that are named and in the catalog."""
    named = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("provider"))
    return named.intersect(table(spark, sf_dir, "customer").where("c_acctbal > 5000").select("c_nationkey"))


@query(
    "existing_tiles",
    """
, d AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'scene_broken' ELSE 'scene_' || printf('%+03d%+04d', CAST(floor(lat) AS INT), CAST(floor(lon) AS INT)) || '/x' || event_id % 3 END AS dir FROM points)
, k AS (SELECT event_id, regexp_extract(dir, '([+-]\\d{2})([+-]\\d{3})', 1) AS a, regexp_extract(dir, '([+-]\\d{2})([+-]\\d{3})', 2) AS b, dir FROM d)
SELECT CAST(a AS INT) AS lat, CAST(b AS INT) AS lon, min(dir) AS dir FROM k WHERE a <> '' GROUP BY 1, 2""",
    "points",
)
def existing_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles read from names of folders; malformed names are skipped, of several folders the first by name counts."""
    good = F.concat(F.lit("scene_"), N.signed_name("lat", "lon"), F.lit("/x"), (F.col("event_id") % 3).cast("string"))
    dirs = points(spark, sf_dir).select(F.when(F.col("event_id") % 11 == 0, "scene_broken").otherwise(good).alias("dir"))
    return layers.tiles_of(dirs, "dir")


@query(
    "clicked_zones",
    """
SELECT p.event_id, count(*) AS deleted, min(z.zone) AS first FROM points p JOIN zones z ON p.lon >= z.x0 AND p.lon < z.x1 AND p.lat >= z.y0 AND p.lat < z.y1
WHERE p.event_type = 'click' AND z.zl = 12 + p.event_id % 5 GROUP BY p.event_id""",
    "points", "zones",
)
def clicked_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that a click lies in, of the zoom at hand only."""
    clicks = points(spark, sf_dir).where("event_type = 'click'").select("event_id", "lon", "lat", (12 + F.col("event_id") % 5).alias("want"))
    met = points_in_boxes(clicks, zones(spark, sf_dir), 20.0).where("zl = want")
    ring = F.array(*[S.point(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))])
    inside = met.where(S.winding_contains(ring, F.col("lon"), F.col("lat")))
    return inside.groupBy("event_id").agg(F.count("*").alias("deleted"), F.min("zone").alias("first"))


@query(
    "texture_sizes",
    _RING + """
SELECT way, round(area * pow(40000 * cos(radians(45.5)) / pow(2, 15 + 8), 2) * pow(2, 2 * (14 + way % 5 - 17)) / 1024 * 1e9, 6) AS size FROM area""",
    "way_nodes",
)
def texture_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estimated room of the textures of a polygon: its area in pixels, by its zoom."""
    pixel = 40000 * math.cos(math.radians(45.5)) / 2 ** (15 + 8)
    zl = 14 + F.col("way") % 5
    return _areas(spark, sf_dir).select("way", F.round(F.col("area") * pixel**2 * F.pow(F.lit(2.0), 2 * (zl - 17)) / 1024 * 1e9, 6).alias("size"))


@query(
    "bucket_statistics",
    """
, p AS (SELECT event_type, event_id, lpad(bin(CAST(floor((lon+180)/360*16777216) AS BIGINT)), 24, '0') AS bx, lpad(bin(CAST(floor((lat+90)/180*16777216) AS BIGINT)), 24, '0') AS b_y FROM points)
, l AS (SELECT event_type, event_id, level, substr(bx, 1, level) AS kx, substr(b_y, 1, level) AS ky FROM p, range(1, 9) AS r(level))
, c AS (SELECT level, kx, ky, count(*) AS n FROM l GROUP BY ALL)
, best AS (SELECT l.event_id, min(l.level) AS level FROM l JOIN c USING (level, kx, ky) WHERE c.n <= 100 OR l.level = 8 GROUP BY l.event_id)
, b AS (SELECT l.kx, l.ky, count(*) AS n FROM best b JOIN l USING (event_id, level) GROUP BY l.kx, l.ky)
SELECT length(kx) AS depth, count(*) AS buckets, max(n) AS largest, round(avg(n), 6) AS mean_size FROM b GROUP BY 1""",
    "points",
)
def bucket_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets of the quadtree by depth: how many, the largest and the mean size."""
    pts = points(spark, sf_dir).select("event_id", ((F.col("lon") + 180) / 360).alias("u"), ((F.col("lat") + 90) / 180).alias("v"))
    b = buckets(pts, "u", "v", capacity=100, first_level=1, last_level=8).groupBy("kx", "ky").agg(F.count("*").alias("n"))
    return b.groupBy(F.length("kx").cast("bigint").alias("depth")).agg(F.count("*").alias("buckets"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_size"))


@query(
    "representative_places",
    """
, c AS (SELECT way, pos, x, y FROM way_nodes UNION ALL SELECT way, max(pos)+1, arg_min(x,pos), arg_min(y,pos) FROM way_nodes WHERE way % 2 = 0 GROUP BY way)
SELECT way, round(avg(x), 7) AS x, round(avg(y), 7) AS y FROM c GROUP BY way""",
    "way_nodes",
)
def representative_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean place of a way's nodes; the node that closes a way counts again."""
    lines = ways.lines(way_nodes(spark, sf_dir))
    closed = F.when(F.col("way") % 2 == 0, F.concat("line", F.slice("line", 1, 1))).otherwise(F.col("line"))
    place = lines.select("way", S.mean_place(closed).alias("p"))
    return place.select("way", F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"))


@query(
    "archive_names",
    """
, t AS (SELECT c_custkey, CAST(floor(lat) AS INT) AS lat, CAST(floor(lon) AS INT) AS lon FROM sites)
SELECT c_custkey, CASE WHEN lat < 0 THEN 'S' ELSE '' END || chr(CAST(65 + CASE WHEN lat >= 0 THEN lat // 4 ELSE (-1 - lat) // 4 END AS INT)) || lpad(CAST(31 + CAST(floor(lon / 6) AS INT) AS VARCHAR), 2, '0') AS zone FROM t""",
    "sites",
)
def archive_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of elevations that a tile's file is in: six degrees by four, a letter and a number."""
    return sites(spark, sf_dir).select("c_custkey", N.archive_zone(F.floor("lat"), F.floor("lon")).alias("zone"))


@query(
    "snapped_cells",
    """
, g AS (SELECT c_custkey, (1.0 + lon/180.0)*128 AS x, (1.0 - ln(tan((lat+90.0)*pi()/360))/pi())*128 AS y FROM sites)
SELECT c_custkey, round(CASE WHEN abs(x-round(x)) > 0.01 THEN x ELSE round(x) END, 7) AS x, round(CASE WHEN abs(y-round(y)) > 0.01 THEN y ELSE round(y) END, 7) AS y FROM g""",
    "sites",
)
def snapped_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places in cells of the texture grid, snapped to its lines where they are near."""
    from tilewright.functions import geodesy as G

    x, y = G.grid_place("lat", "lon", 12)
    return sites(spark, sf_dir).select("c_custkey", F.round(G.snapped(x, 0.01), 7).alias("x"), F.round(G.snapped(y, 0.01), 7).alias("y"))


@query(
    "helipads",
    """
, pads AS (SELECT event_id, lon, lat FROM points WHERE event_type = 'signup')
SELECT event_id, 7 AS corners, round(lon + 0.5, 7) AS first_x, round(lat, 7) AS first_y FROM pads p
WHERE NOT EXISTS (SELECT 1 FROM zones z WHERE p.lon BETWEEN z.x0 AND z.x1 AND p.lat BETWEEN z.y0 AND z.y1)""",
    "points", "zones",
)
def helipads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Helipads that are single nodes grow into hexagons, unless they lie in an area that is treated already."""
    from tilewright.operators.spatial import points_outside_boxes

    pads = points(spark, sf_dir).where("event_type = 'signup'").select("event_id", "lon", "lat")
    free = points_outside_boxes(pads, "event_id", zones(spark, sf_dir).select("x0", "y0", "x1", "y1"), 20.0)
    ring = S.regular_ring("lon", "lat", 0.5 * METRES_PER_DEGREE)
    return free.select("event_id", F.size(ring).alias("corners"), F.round(F.get(ring, F.lit(0))["x"], 7).alias("first_x"), F.round(F.get(ring, F.lit(0))["y"], 7).alias("first_y"))
