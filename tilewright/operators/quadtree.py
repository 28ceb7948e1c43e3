"""Adaptive quadtree buckets from counts of each level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.functions.geodesy import binary_prefix


def buckets(points: DataFrame, u: str, v: str, capacity: int, first_level: int, last_level: int) -> DataFrame:
    """Each row with the binary prefixes (kx, ky) of its bucket; u and v are fractions of the square.

    A bucket is the shallowest cell between the levels that holds at most ``capacity`` rows, or one
    of the last level. Cells of all levels come from counts of the deepest one, so the rows are
    counted once, and the levels join small tables.
    """
    rows = points.withColumn("_bx", F.substring(binary_prefix(u), 1, last_level)).withColumn("_by", F.substring(binary_prefix(v), 1, last_level))
    leaves = rows.groupBy("_bx", "_by").agg(F.count("*").alias("n"))
    cells = leaves.withColumn("level", F.explode(F.sequence(F.lit(first_level), F.lit(last_level))))
    cells = cells.withColumn("kx", F.expr("substring(_bx, 1, level)")).withColumn("ky", F.expr("substring(_by, 1, level)"))
    size = cells.groupBy("level", "kx", "ky").agg(F.sum("n").alias("size"))
    fits = cells.join(size, ["level", "kx", "ky"]).where((F.col("size") <= capacity) | (F.col("level") == last_level))
    best = fits.groupBy("_bx", "_by").agg(F.min_by(F.struct("kx", "ky"), "level").alias("k"))
    return rows.join(best, ["_bx", "_by"]).select(*points.columns, "k.kx", "k.ky")
