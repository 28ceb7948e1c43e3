"""Connected components by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long ids -> (node, root) for every node of an edge; root is one of its component.

    In each round every node moves to its neighbour of the least hash, if that is less than its own,
    and the edges are drawn between the places moved to. The hashed order makes the number of rounds
    grow with the logarithm of the nodes, on long chains too. Only counts reach the driver.

    Edges with a null end, edges from a node to itself and repeated edges add nothing; nodes without
    another edge aren't in the result, and no edges give an empty one. Other columns are ignored. A
    node with very many edges is one row of a partial minimum before it is shuffled.
    """
    order = lambda e: e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tidy = lambda e: cut_lineage(order(e.where("a <> b")).distinct())
    edges = tidy(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL"))
    moved = edges.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.withColumn("h", F.xxhash64("b")).groupBy("a").agg(F.min("h").alias("h"), F.min_by("b", "h").alias("b"))
        hop = cut_lineage(
            least.select(F.col("a").alias("was"), F.when(F.col("h") < F.xxhash64("a"), F.col("b")).otherwise(F.col("a")).alias("to"))
        )
        ends = edges
        for end in ("a", "b"):
            ends = ends.join(hop.withColumnsRenamed({"was": end, "to": f"to_{end}"}), end)
        edges = tidy(ends.select(F.col("to_a").alias("a"), F.col("to_b").alias("b")))
        known = moved.join(hop.withColumnRenamed("was", "root"), "root", "left")
        known = known.select("node", F.coalesce("to", "root").alias("root"))
        new = hop.select(F.col("was").alias("node"), F.col("to").alias("root"))
        moved = cut_lineage(known.unionByName(new.join(known.select("node"), "node", "left_anti")))
    return moved
