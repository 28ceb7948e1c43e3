"""Lines from ordered nodes, and edges between nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.session import spread, written


def lines(nodes: DataFrame, way: str = "way", pos: str = "pos") -> DataFrame:
    """way, line: the way's (x, y) in order, as array<struct<x, y>>."""
    placed = F.sort_array(F.collect_list(F.struct(pos, "x", "y")))
    out = nodes.groupBy(way).agg(placed.alias("_p"))
    return out.select(way, F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("line"))


def resolve(ways: DataFrame, nodes: DataFrame, way: str = "way", members: str = "nodes", node: str = "node") -> DataFrame:
    """Ways with member lists joined to their nodes in order; members that are unknown are skipped."""
    each = ways.where(F.size(members) > 0).select(way, F.posexplode(members).alias("pos", node))
    return lines(each.join(nodes, node), way)


def segments(nodes: DataFrame, way: str = "way", pos: str = "pos", *more: str) -> DataFrame:
    """Consecutive nodes of each way: x, y, x2, y2 and the first node's other columns."""
    w = Window.partitionBy(way).orderBy(pos)
    out = nodes.select(way, pos, "x", "y", *more, F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    return out.where("x2 IS NOT NULL")


def merged_edges(edges: DataFrame, flags: Column) -> DataFrame:
    """Undirected edges between (x, y) and (x2, y2), ends in order, with the flags of all of them."""
    a, b = F.struct("x", "y"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    keyed = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), flags.alias("_flags")).where("a <> b")
    out = spread(keyed, "a", "b").groupBy("a", "b").agg(F.bit_or("_flags").alias("flags"))
    return out.select("a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"), "flags")


def snap(edges: DataFrame, nodes: DataFrame, digits: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes merged by rounded place (the first one's z in the given order wins), and edges between them, loops dropped."""
    near = lambda c: F.rint(c * 10.0**digits) / 10.0**digits
    merged = nodes.groupBy(near(F.col("x")).alias("x"), near(F.col("y")).alias("y")).agg(F.min_by("z", F.struct(*order)).alias("z"))
    moved = edges.select(near(F.col("x")).alias("x"), near(F.col("y")).alias("y"), near(F.col("x2")).alias("x2"), near(F.col("y2")).alias("y2"), "flags")
    return merged, merged_edges(moved, F.col("flags"))


def running_total(df: DataFrame, order: str, value: Column, name: str, block: int = 1024) -> DataFrame:
    """Adds the sum of ``value`` over all rows before a row in the order of a unique integer key.

    The order is cut into blocks of ``block`` keys: sums of blocks are ordered by themselves, in
    chunks of blocks and then over chunks, so no task has all rows.
    """
    level = df.withColumn("_v", value).withColumn("_b", F.floor(F.col(order) / block))
    sums = level.groupBy("_b").agg(F.sum("_v").alias("_s")).withColumn("_c", F.floor(F.col("_b") / block))
    chunks = sums.groupBy("_c").agg(F.sum("_s").alias("_t"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("_c", F.coalesce(F.sum("_t").over(before(Window.orderBy("_c"))), F.lit(0)).alias("_tb"))
    sums = sums.select("_b", "_c", F.coalesce(F.sum("_s").over(before(Window.partitionBy("_c").orderBy("_b"))), F.lit(0)).alias("_sb"))
    base = sums.join(chunks, "_c").select("_b", (F.col("_sb") + F.col("_tb")).alias("_base"))
    inner = F.coalesce(F.sum("_v").over(before(Window.partitionBy("_b").orderBy(order))), F.lit(0))
    return level.withColumn("_in", inner).join(base, "_b").withColumn(name, F.col("_in") + F.col("_base")).select(*df.columns, name)


def numbered(df: DataFrame, order: list[Column], name: str, *within: str) -> DataFrame:
    """Adds each row's number from 1 in the given order, for each group of ``within`` if there is one.

    Rows are dealt to ranges of the order, and a range's numbers begin after those of the ranges before
    it, so no task has all rows, however few the groups are. Rows alike in the whole order are numbered
    in any way; nulls come first, and null groups are one group.
    """
    dealt = written(df.repartitionByRange(*map(F.col, within), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy("_range", *within).agg(F.count("*").alias("_n"))  # a row for each range and group in it
    before = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(within)], F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    at = F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(within):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    return dealt.withColumn("_at", at).join(base, same).select(*df.columns, (F.col("_at") + F.col("_base")).cast("bigint").alias(name))
