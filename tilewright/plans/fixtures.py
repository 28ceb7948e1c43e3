"""Geographic tables derived from the supplied ones by fixed projections, in Spark and in SQL.

``CTE`` holds the same projections for DuckDB, to be put before a query's SQL with ``sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import spread, table


def _place(key: str, a: int, b: int, more_a: str = "", more_b: str = "") -> tuple[str, str]:
    lon = f"CAST(({key}*{a}{more_a})%3600000 AS DOUBLE)/10000.0e0-180.0e0"
    lat = f"CAST(({key}*{b}{more_b})%1700000 AS DOUBLE)/10000.0e0-85.0e0"
    return lon, lat


_POINT = _place("user_id", 7919, 15485863, "+event_id*104729", "+event_id*32452843")
_SITE = _place("c_custkey", 7919, 15485863)
_ANCHOR = _place("s_suppkey", 104729, 32452843)
_WAY_X = "CAST((l_partkey*37+l_suppkey*11)%1000 AS DOUBLE)/1000.0e0"
_WAY_Y = "CAST((l_suppkey*131+l_partkey*17)%1000 AS DOUBLE)/1000.0e0"
_WAY_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
)
_SITE_BOX = [("x0", _SITE[0], "-2"), ("y0", _SITE[1], "-1"), ("x1", _SITE[0], "+4"), ("y1", _SITE[1], "+2")]
_ZONE_X = "CAST((n_nationkey*53)%25 AS DOUBLE)*14.0e0-180.0e0"
_ZONE_Y = "CAST((n_nationkey*29)%25 AS DOUBLE)*5.0e0-80.0e0"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tagged points."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id", "user_id", "event_type", "value", "props", "ts", f"{_POINT[0]} AS lon", f"{_POINT[1]} AS lat"
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as surfaces to attach."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey", f"{_SITE[0]} AS lon", f"{_SITE[1]} AS lat"
    )


def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as airports."""
    return table(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey", "s_name", "s_nationkey", "s_acctbal", f"{_ANCHOR[0]} AS lon", f"{_ANCHOR[1]} AS lat"
    )


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as ordered nodes of ways, in tile-local degrees."""
    # partitioned by the name that it keeps, so that what is grouped by way needs no other shuffle
    return spread(table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "way"), "way").selectExpr(
        "way", f"CAST(row_number() OVER (PARTITION BY way ORDER BY {_WAY_ORDER}) AS BIGINT) AS pos",
        f"{_WAY_X} AS x", f"{_WAY_Y} AS y", "l_linenumber AS kind", "l_quantity AS z", "l_returnflag AS tag",
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as prioritised rectangles with a zoom and a provider."""
    return table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS zone", "CAST(n_nationkey AS BIGINT) AS priority", "12 + n_nationkey % 5 AS zl", "n_name AS provider",
        f"{_ZONE_X} AS x0", f"{_ZONE_Y} AS y0", f"{_ZONE_X}+40.0e0 AS x1", f"{_ZONE_Y}+25.0e0 AS y1",
    )


def site_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of tenths of a degree around the sites, with a zoom and a provider: as many as there are customers."""
    return table(spark, sf_dir, "customer").selectExpr(
        "CAST(c_custkey AS BIGINT) AS zone", "CAST(c_custkey AS BIGINT) AS priority", "CAST(12 + c_custkey % 5 AS INT) AS zl", "c_mktsegment AS provider",
        *[f"CAST(floor(({v})*10.0e0){more} AS DOUBLE)/10.0e0 AS {n}" for n, v, more in _SITE_BOX],
    )


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a raster: a row for each vector, a column for each component; -1000 to 1000 metres."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row"), F.posexplode("embedding").alias("col", "v"))
    return rows.select("row", "col", F.rint(F.col("v").cast("double") * 1000).alias("value"))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three consecutive nodes of a way as a triangle of kind 0 to 7; local degrees and node keys."""
    return way_nodes(spark, sf_dir).groupBy("way", F.expr("CAST(floor((pos-1)/3) AS BIGINT) AS tri")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "x", "y", "kind"))).alias("p")
    ).where(F.size("p") == 3).select(
        "way", "tri", (F.element_at("p", 1)["kind"] % 8).alias("kind"),
        *[F.element_at("p", i)[c].alias(f"{c}{i}") for i in (1, 2, 3) for c in ("x", "y")],
    )


CTE = {
    "points": f"SELECT event_id, user_id, event_type, value, props, ts, {_POINT[0]} AS lon, {_POINT[1]} AS lat FROM events",
    "sites": f"SELECT c_custkey, c_name, c_mktsegment, c_acctbal, c_nationkey, {_SITE[0]} AS lon, {_SITE[1]} AS lat FROM customer",
    "anchors": f"SELECT s_suppkey, s_name, s_nationkey, s_acctbal, {_ANCHOR[0]} AS lon, {_ANCHOR[1]} AS lat FROM supplier",
    "way_nodes": f"SELECT l_orderkey AS way, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_WAY_ORDER}) AS pos, "
    f"{_WAY_X} AS x, {_WAY_Y} AS y, l_linenumber AS kind, l_quantity AS z, l_returnflag AS tag FROM lineitem",
    "zones": "SELECT n_nationkey AS zone, CAST(n_nationkey AS BIGINT) AS priority, 12 + n_nationkey % 5 AS zl, n_name AS provider, "
    f"{_ZONE_X} AS x0, {_ZONE_Y} AS y0, {_ZONE_X}+40.0e0 AS x1, {_ZONE_Y}+25.0e0 AS y1 FROM nation",
    "site_zones": "SELECT CAST(c_custkey AS BIGINT) AS zone, CAST(c_custkey AS BIGINT) AS priority, CAST(12 + c_custkey % 5 AS INT) AS zl, c_mktsegment AS provider, "
    + ", ".join(f"CAST(floor(({v})*10.0e0){more} AS DOUBLE)/10.0e0 AS {n}" for n, v, more in _SITE_BOX) + " FROM customer",
    "raster": "SELECT vec_id AS row, CAST(i - 1 AS INT) AS col, round_even(CAST(embedding[i] AS DOUBLE) * 1000, 0) AS value "
    "FROM embeddings, unnest(range(1, len(embedding) + 1)) AS u(i)",
    "tri_nodes": "SELECT *, (pos - 1) // 3 AS tri, (pos - 1) % 3 + 1 AS corner FROM way_nodes",
    "triangles": "SELECT way, tri, min(CASE WHEN corner = 1 THEN kind END) % 8 AS kind, "
    + ", ".join(f"min(CASE WHEN corner = {i} THEN {c} END) AS {c}{i}" for i in (1, 2, 3) for c in ("x", "y"))
    + " FROM tri_nodes GROUP BY way, tri HAVING count(*) = 3",
}
_NEEDS = {"triangles": ("way_nodes", "tri_nodes"), "tri_nodes": ("way_nodes",)}


def sql(body: str, *names: str) -> str:
    """``body`` after the named projections; ``body`` may begin with more of them (``, name AS (...) SELECT``)."""
    wanted = [n for name in names for n in (*_NEEDS.get(name, ()), name)]
    return "WITH " + ",\n".join(f"{n} AS ({CTE[n]})" for n in dict.fromkeys(wanted)) + "\n" + body.strip()
