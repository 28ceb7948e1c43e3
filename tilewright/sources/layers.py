"""Layers of features: tag queries over them, a cache by tile, many files as one, tiles named by folders."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.operators import tags as T


def matching(features: DataFrame, kind: str, queries: list[str], keep: list[str] | None = None) -> DataFrame:
    """Features of a kind (node, way, rel) that any of the queries selects, with the tags in ``keep`` (all without it)."""
    clauses = [c for c in map(T.parse, queries) if c[0] == kind]
    return T.select(features, clauses, keep) if clauses else features.limit(0)


def write_cache(features: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """Writes features as Parquet, a folder for each ten degrees; tiles are columns within it, sorted so that pages can be skipped."""
    cell = lambda c: F.floor(F.col(c)).cast("int")
    block = lambda c: (F.floor(F.col(c) / 10) * 10).cast("int")
    dealt = features.withColumns({"tile_lat": cell(lat), "tile_lon": cell(lon), "lat10": block(lat), "lon10": block(lon)})
    # a block with very many features is dealt over several files by its tiles
    dealt.repartition("lat10", "lon10", "tile_lat", "tile_lon").sortWithinPartitions("lat10", "lon10", "tile_lat", "tile_lon").write.partitionBy("lat10", "lon10").parquet(path)


def read_tiles(spark: SparkSession, path: str, lat: tuple[int, int], lon: tuple[int, int]) -> DataFrame:
    """Cached features of the tiles from ``lat[0]`` to before ``lat[1]``, and so for lon; other folders aren't read."""
    part = lambda c, span: (F.col(f"{c}10") >= span[0] // 10 * 10) & (F.col(f"{c}10") < span[1])
    tile = lambda c, span: (F.col(f"tile_{c}") >= span[0]) & (F.col(f"tile_{c}") < span[1])
    found = spark.read.parquet(path).where(part("lat", lat) & part("lon", lon) & tile("lat", lat) & tile("lon", lon))
    return found.drop("lat10", "lon10")


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``, which is made and written first where there is none."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def read_files(spark: SparkSession, paths: dict[str, str], columns: tuple[str, ...]) -> DataFrame:
    """Rows of several Parquet files with ``file`` and the columns that they have of those named; absent files are skipped."""
    out = None
    for name, path in paths.items():
        try:
            rows = spark.read.parquet(path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
                raise
            continue
        rows = rows.select(F.lit(name).alias("file"), *[c for c in columns if c in rows.columns])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        raise FileNotFoundError(f"none of {sorted(paths.values())}")
    return out


def folders(spark: SparkSession, path: str) -> DataFrame:
    """The files below a folder as a table of their paths, sizes and times; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")


def tiles_of(names: DataFrame, name: str | Column) -> DataFrame:
    """lat, lon, and the first name, of the tiles that names such as ``scene_+47-123`` have in them; others are skipped."""
    column = F.col(name) if isinstance(name, str) else name
    part = lambda i: F.regexp_extract(column, r"([+-]\d{2})([+-]\d{3})", i)
    found = names.select(part(1).try_cast("int").alias("lat"), part(2).try_cast("int").alias("lon"), column.alias("dir"))
    return found.where("lat IS NOT NULL AND lon IS NOT NULL").groupBy("lat", "lon").agg(F.min("dir").alias("dir"))


def replace_parts(rows: DataFrame, path: str, part: str) -> None:
    """Writes rows in folders by ``part``; of what is there already, only the folders of these rows are replaced, when the write is done."""
    # a folder of very many rows is dealt over several tasks
    rows.repartition(part, F.spark_partition_id() % 8).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
