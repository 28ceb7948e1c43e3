"""The ground of airports: areas smoothed in their order, over a raster of any size.

Rows of a null key, place or weight and weights not above zero are no part of an area; an (id, row, col)
that repeats counts once, with its largest weight. A raster's cells without data give nothing and stay
without; of a cell that comes twice the least value is smoothed, and both rows get the result. Columns
beyond those named are left out. Empty tables give the raster as it was.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.operators.rasters import SIZE, with_halo
from tilewright.session import written


def coverage(rings: DataFrame, id: str, parts: int = 4) -> DataFrame:
    """id, row, col, weight: the share of each cell that the area of a ring (array of row, col places) covers.

    A cell is looked at in ``parts`` by ``parts`` places, which are inside by the even-odd rule; the last
    node of a ring may repeat the first or not. Rows of cells are dealt out before the places are
    tested, so a large ring is the work of many rows. Rings that are null, hold nulls or have fewer than
    three nodes cover nothing; of an id's rings each is an area of its own (the caller adds them up).
    """
    c = F.col
    held = rings.select(c(id).alias("id"), F.transform("ring", lambda p: F.struct(p["row"].cast("double").alias("r"), p["col"].cast("double").alias("c"))).alias("ring"))
    held = held.where((F.size("ring") > 2) & ~F.exists("ring", lambda p: p["r"].isNull() | p["c"].isNull()))
    sides = F.transform("ring", lambda p, i: F.struct(p.alias("a"), F.element_at("ring", (i + 1) % F.size("ring") + 1).alias("b")))
    low, high = (F.floor(f(F.transform("ring", lambda p: p["r"]))) for f in (F.array_min, F.array_max))
    rows = held.select("id", sides.alias("sides"), F.explode(F.sequence(low, high)).alias("row"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("_i"))
    y = c("row") + (c("_i") + 0.5) / parts
    met = F.filter("sides", lambda s: (s["a"]["r"] <= y) != (s["b"]["r"] <= y))
    at = F.array_sort(F.transform(met, lambda s: s["a"]["c"] + (y - s["a"]["r"]) / (s["b"]["r"] - s["a"]["r"]) * (s["b"]["c"] - s["a"]["c"])))
    crossed = rows.select("id", "row", at.alias("x"))
    spans = crossed.select("id", "row", "x", F.explode(F.expr("CASE WHEN size(x) > 1 THEN sequence(0, size(x) - 2, 2) END")).alias("k"))
    # places (k + 1/2) / parts between two crossings
    first, last = (F.ceil(F.get("x", c("k") + j) * parts - 0.5) for j in (0, 1))
    place = spans.select("id", "row", first.alias("f"), (last - 1).alias("l")).where("f <= l")
    cells = place.select("id", "row", "f", "l", F.explode(F.sequence(F.floor(c("f") / parts), F.floor(c("l") / parts))).alias("col"))
    n = F.least("l", c("col") * parts + parts - 1) - F.greatest("f", c("col") * parts) + 1
    return cells.groupBy("id", "row", "col").agg((F.sum(n) / float(parts * parts)).alias("weight"))


def _levels(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, int]:
    """id, level: how many ids the longest chain of edges (a before b) to an id has, and the number of levels.

    An id is of level k or above if an edge from one of level k - 1 or above leads to it. There are as
    many rounds as the longest chain is long; they take the small table of edges, and only counts reach the driver.
    """
    left, k = ids, 0
    out = ids.select("id", F.lit(0).alias("level"))
    while True:
        left = written(edges.join(left.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "levels")
        if left.isEmpty():
            return out.groupBy("id").agg(F.max("level").alias("level")), k + 1
        k += 1
        out = out.unionByName(left.select("id", F.lit(k).alias("level")))


def _smoothed(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Cells of one area in a block, and around it, smoothed by the area's own width among themselves."""
    pix = int(rows["pix"].iloc[0])
    r = (rows["row"] - rows["tr"] * size).to_numpy(np.int64) + pix
    c = (rows["col"] - rows["tc"] * size).to_numpy(np.int64) + pix
    side = size + 2 * pix
    weight, total = np.zeros((side, side)), np.zeros((side, side))
    w, z = rows["weight"].to_numpy(np.float64), rows["value"].to_numpy(np.float64)
    weight[r, c], total[r, c] = w, w * z
    taps = pix + 1.0 - np.abs(np.arange(-pix, pix + 1))
    for axis in (1, 0):
        for x in (weight, total):
            wide = np.pad(x, [(pix, pix) if a == axis else (0, 0) for a in (0, 1)])
            x[:] = sum(k * np.take(wide, range(i, i + side), axis) for i, k in enumerate(taps))
    own = (r >= pix) & (r < size + pix) & (c >= pix) & (c < size + pix)
    soft = total[r, c][own] / weight[r, c][own]
    out = rows.loc[own, ["id", "row", "col", "following"]].copy()
    out["value"] = w[own] * soft + (1 - w[own]) * z[own]
    return out


def smoothed_in_order(raster: DataFrame, areas: DataFrame, size: int = SIZE) -> DataFrame:
    """row, col, value of the cells of areas (id, row, col, weight, pix), each area smoothed after those of lesser id.

    An area's cells are averaged among themselves, by triangles of ``pix`` cells to each side (the largest
    one of its rows) and their weights, and go towards the average by their own weight. Areas of null or
    no width change nothing. An area that shares a cell with one before it starts from what that one left;
    areas without a common cell don't depend on each other. So all areas of a level (the length of the
    longest chain of such areas before them) are one round, whose shuffle has their cells only, and cells
    that no later area has take no part in later rounds. An area is dealt to blocks with a halo of its own
    width, so it may be of any size.
    """
    c = F.col
    part = areas.where("pix > 0 AND weight > 0 AND id IS NOT NULL").select("id", "row", "col", "weight", "pix")
    width = part.groupBy("id").agg(F.max("pix").cast("int").alias("pix"))
    met = part.drop("pix").join(raster.where("value IS NOT NULL").select("row", "col", c("value").cast("double").alias("value")), ["row", "col"])
    once = met.groupBy("row", "col", "id").agg(F.max("weight").cast("double").alias("weight"), F.min("value").alias("value")).join(width, "id")
    order = Window.partitionBy("row", "col").orderBy("id")
    held = written(once.select("*", F.lag("id").over(order).alias("before"), F.lead("id").over(order).alias("following")), "airport-cells")
    edges = written(held.where("before IS NOT NULL").select(c("before").alias("a"), c("id").alias("b")).distinct(), "airport-order")
    levels, rounds = _levels(edges, held.select("id").distinct())
    held = written(held.join(levels, "id"), "airport-levels")
    kind = {f.name: f.dataType.simpleString() for f in held.schema}
    fields = f"id {kind['id']}, row {kind['row']}, col {kind['col']}, following {kind['following']}, value double"
    done = None
    for k in range(rounds):
        ready = held.where(c("level") == k)
        if done is not None:
            passed = done.where("following IS NOT NULL").select(c("following").alias("id"), "row", "col", c("value").alias("_v"))
            ready = ready.join(passed, ["id", "row", "col"], "left").withColumn("value", F.coalesce("_v", "value")).drop("_v")
        dealt = with_halo(ready.select("id", "row", "col", "weight", "pix", "following", "value"), size, c("pix"))
        soft = dealt.groupBy("id", "tr", "tc").applyInPandas(lambda rows: _smoothed(rows, size), fields)
        out = written(soft, "airport-round")
        done = out if done is None else done.unionByName(out)
    return done.where("following IS NULL").select("row", "col", "value")


def blended_at_sides(raster: DataFrame, patch: DataFrame, r0: Column, c0: Column, r1: Column, c1: Column, width: Column) -> DataFrame:
    """row, col, value: the patch (one row for a cell) over the raster, fading to the raster's own values at its sides.

    The sides are rows r0 and r1 and columns c0 and c1 (inside), columns of ``raster``. At a side nothing of the
    patch is left, from ``width`` cells on all of it; a width of zero fades nothing.
    """
    share = F.lit(1.0)
    for d in (F.col("row") - r0, r1 - F.col("row"), F.col("col") - c0, c1 - F.col("col")):
        share = share * F.when(width > 0, F.least(F.lit(1.0), d / width)).otherwise(1.0)
    p = patch.where("value IS NOT NULL").select("row", "col", F.col("value").alias("_p"))
    met = raster.join(p, ["row", "col"], "left")
    return met.select("row", "col", F.coalesce(F.col("value") + (F.col("_p") - F.col("value")) * share, "value").alias("value"))
