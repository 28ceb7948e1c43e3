"""OSM XML as DataFrames: nodes, ways and relations. Compressed files are read as their names say."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import spread, tasks

_TAG = "tag array<struct<_k:string,_v:string>>"
NODE = f"_id bigint, _lat double, _lon double, {_TAG}"
WAY = f"_id bigint, nd array<struct<_ref:bigint>>, {_TAG}"
RELATION = f"_id bigint, member array<struct<_type:string,_ref:bigint,_role:string>>, {_TAG}"


def _read(spark: SparkSession, path: str, row: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row).option("mode", "FAILFAST").schema(schema).load(path)


def _tags() -> Column:
    pairs = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k:string,_v:string>>")), lambda t: F.struct(t["_k"], t["_v"]))
    return F.map_from_entries(F.filter(pairs, lambda t, i: ~_again(pairs, t, i))).alias("tags")


def _again(pairs: Column, t: Column, i: Column) -> Column:
    """Whether a key comes again later: its last value counts."""
    return F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda u: u["_k"] == t["_k"])


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """id, lon, lat, tags."""
    return _read(spark, path, "node", NODE).select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags())


def ways(spark: SparkSession, path: str) -> DataFrame:
    """id, nodes, tags of ways that have nodes."""
    out = _read(spark, path, "way", WAY).where(F.size("nd") > 0)
    return out.select(F.col("_id").alias("id"), F.transform("nd", lambda n: n["_ref"]).alias("nodes"), _tags())


def relations(spark: SparkSession, path: str) -> DataFrame:
    """id, outer, inner (way ids by role; other members are left out), tags."""
    role = lambda r: F.transform(F.filter("member", lambda m: (m["_type"] == "way") & (m["_role"] == r)), lambda m: m["_ref"]).alias(r)
    return _read(spark, path, "relation", RELATION).select(F.col("_id").alias("id"), role("outer"), role("inner"), _tags())


def merged_nodes(found: DataFrame) -> DataFrame:
    """id, kept: nodes of one place share the least id."""
    found = spread(found.select("id", "lon", "lat"), "lon", "lat")
    least = found.groupBy("lon", "lat").agg(F.min("id").alias("kept"))
    return found.join(least, ["lon", "lat"]).select("id", "kept")


def truncated(spark: SparkSession, path: str) -> DataFrame:
    """path of the files that don't end with the closing tag."""
    last = spark.read.text(path).select(F.input_file_name().alias("path"), F.endswith(F.rtrim("value"), F.lit("</osm>")).alias("end"))
    return last.groupBy("path").agg(F.max("end").alias("whole")).where("NOT whole").select("path")


def write(nodes_: DataFrame, ways_: DataFrame, path: str) -> None:
    """Nodes and ways as XML files in two folders below ``path``, in the order of ids; those marked ``direct`` first, if that is a column."""
    tag = F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("_k"), e["value"].alias("_v"))).alias("tag")
    n = _in_order(nodes_).select(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), tag)
    w = _in_order(ways_).select(F.col("id").alias("_id"), F.transform("nodes", lambda i: F.struct(i.alias("_ref"))).alias("nd"), tag)
    for df, row in ((n, "node"), (w, "way")):
        df.write.format("xml").option("rootTag", "osm").option("rowTag", row).save(f"{path}/{row}")


def _in_order(df: DataFrame) -> DataFrame:
    order = [F.col("direct").desc()] * ("direct" in df.columns) + [F.col("id")]
    n = tasks(df)
    return (df.repartitionByRange(n, *order) if n else df.repartitionByRange(*order)).sortWithinPartitions(*order)
