"""Rasters in long form (row, col, value): a null value is no data. Neighbours meet in square blocks with a halo."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells along a side of a block.
SIZE = 256


def in_blocks(raster: DataFrame, halo: int, made, fields: str, size: int = SIZE) -> DataFrame:
    """What ``made`` makes of square blocks of the raster, in numpy, one shuffle for any number of neighbours.

    ``made`` gets the values of a block and ``halo`` cells around it (NaN for no data) and where the
    raster has cells, both from the top left, and gives an array for each of ``fields``; results are
    kept for the block's own cells. A block is of a set size, however large the raster.
    """
    names = [f.split()[0] for f in fields.split(", ")]
    side = size + 2 * halo

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        tr, tc = int(rows["tr"].iloc[0]), int(rows["tc"].iloc[0])
        r = rows["row"].to_numpy(np.int64) - tr * size + halo
        c = rows["col"].to_numpy(np.int64) - tc * size + halo
        v, here = np.full((side, side), np.nan), np.zeros((side, side), bool)
        v[r, c], here[r, c] = rows["value"].to_numpy(np.float64, na_value=np.nan), True
        own = (r >= halo) & (r < size + halo) & (c >= halo) & (c < size + halo)
        r, c = r[own], c[own]
        out = {"row": r + tr * size - halo, "col": c + tc * size - halo}
        return pd.DataFrame(out | {n: x[r, c] for n, x in zip(names, made(v, here))})

    kind = {f.name: f.dataType.simpleString() for f in raster.schema}
    dealt = with_halo(raster.select("row", "col", "value"), size, halo)
    out = dealt.groupBy("tr", "tc").applyInPandas(run, f"row {kind['row']}, col {kind['col']}, {fields}")
    return out.select("row", "col", *[F.nanvl(n, F.lit(None)).alias(n) for n in names])


def _moved(v: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """The value of the cell at an offset from each cell, NaN beyond the edge."""
    out = np.full_like(v, np.nan)
    h, w = v.shape
    out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = v[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out


def upsampled(raster: DataFrame, times: int) -> DataFrame:
    """The raster on a grid ``times`` finer, between whose old cells values go linearly (row and col are multiplied).

    Cells that need a value of a neighbour without data have none. Only rows with a value come out.
    """
    z = in_blocks(raster, 1, lambda v, here: [v, _moved(v, 0, 1), _moved(v, 1, 0), _moved(v, 1, 1)], "z00 double, z01 double, z10 double, z11 double")
    steps = F.sequence(F.lit(0), F.lit(times - 1))
    each = z.select("*", F.explode(steps).alias("i")).select("*", F.explode(steps).alias("j"))
    i, j, c = F.col("i") / times, F.col("j") / times, F.col
    mixed = lambda share, n, a, b: F.when(c(n) == 0, a).otherwise((1 - share) * a + share * b)
    value = mixed(i, "i", mixed(j, "j", c("z00"), c("z01")), mixed(j, "j", c("z10"), c("z11")))
    out = each.select((c("row") * times + c("i")).alias("row"), (c("col") * times + c("j")).alias("col"), value.alias("value"))
    return out.where("value IS NOT NULL")


def composed(*layers: DataFrame) -> DataFrame:
    """row, col, value: in each cell the value of the first layer that has one. A cell that comes twice in a layer gets its least value."""
    out = None
    for i, layer in enumerate(layers):
        ranked = layer.where("value IS NOT NULL").select("row", "col", F.struct(F.lit(i).alias("rank"), F.col("value").cast("double").alias("value")).alias("v"))
        out = ranked if out is None else out.unionByName(ranked)
    return out.groupBy("row", "col").agg(F.min("v").alias("v")).select("row", "col", "v.value")


def distances(raster: DataFrame, source: Column, band: int) -> DataFrame:
    """row, col, distance: how far each cell is from the nearest cell where ``source`` holds, in cells, ``band`` at most.

    Exact: along rows first, then across them; both need no more than the band around a block. Where
    ``source`` is null it doesn't hold; a cell that comes twice is a source if one of its rows is.
    """

    def made(v: np.ndarray, here: np.ndarray):
        far = float(band)
        along = np.where(v > 0, 0.0, np.inf)  # NaN is no source
        for d in (1, -1):  # the nearest one to either side in the row
            last = np.full(len(v), np.inf)
            for c in range(v.shape[1])[::d]:
                last = np.where(v[:, c] > 0, 0.0, last + 1)
                along[:, c] = np.minimum(along[:, c], last)
        square, least = along**2, along**2
        for dr in range(1, band):
            least[dr:] = np.minimum(least[dr:], square[:-dr] + dr * dr)
            least[:-dr] = np.minimum(least[:-dr], square[dr:] + dr * dr)
        return [np.minimum(np.sqrt(least), far)]

    held = raster.groupBy("row", "col").agg(F.max(F.coalesce(source, F.lit(False)).cast("double")).alias("value"))
    return in_blocks(held, band, made, "distance double")


def fill(raster: DataFrame, passes: int, rest: float | None = None, most: int | None = None) -> DataFrame:
    """Cells without data take their four neighbours' largest value, in passes; what is left then becomes ``rest``.

    A raster of ``most`` cells without data or more is refused.
    """
    if most is not None and (found := raster.where("value IS NULL").count()) >= most:
        raise ValueError(f"{found} cells without data are too many to fill")

    def made(v: np.ndarray, here: np.ndarray):
        for _ in range(passes):
            holes = here & np.isnan(v)
            if not holes.any():
                break
            near = np.fmax(np.fmax(_moved(v, -1, 0), _moved(v, 1, 0)), np.fmax(_moved(v, 0, -1), _moved(v, 0, 1)))
            v = np.where(holes, near, v)
        return (v,)

    out = in_blocks(raster, passes, made, "value double")
    return out if rest is None else out.withColumn("value", F.coalesce("value", F.lit(rest)))


def gradient(raster: DataFrame, width: float, height: float) -> DataFrame:
    """row, col, dx, dy: central differences, one-sided at edges."""

    def made(v: np.ndarray, here: np.ndarray):
        def one(low: np.ndarray, high: np.ndarray, step: float) -> np.ndarray:
            both = (high - low) / (2 * step)
            return np.where(np.isnan(low), (high - v) / step, np.where(np.isnan(high), (v - low) / step, both))

        return one(_moved(v, 0, -1), _moved(v, 0, 1), width), one(_moved(v, 1, 0), _moved(v, -1, 0), height)

    return in_blocks(raster, 1, made, "dx double, dy double")


def smooth(raster: DataFrame, width: int) -> DataFrame:
    """Triangular smoothing of ``width`` cells along columns, then rows; weights without data don't count."""

    def made(v: np.ndarray, here: np.ndarray):
        known = ~np.isnan(v)
        total, weight = np.where(known, v, 0.0), known.astype(np.float64)
        for axis in (1, 0):
            taps = [(d, float(width + 1 - abs(d))) for d in range(-width, width + 1)]
            step = lambda x: sum(k * np.nan_to_num(_moved(x, *((0, d) if axis else (d, 0)))) for d, k in taps)  # noqa: B023, E731
            total, weight = step(total), step(weight)
        return (np.where(known, total / np.where(weight > 0, weight, 1), np.nan),)

    return in_blocks(raster.where("value IS NOT NULL"), width, made, "value double")


def overlay(base: DataFrame, patch: DataFrame) -> DataFrame:
    """The patch where it has data, else the base."""
    p = patch.where("value IS NOT NULL").withColumnRenamed("value", "_p")
    return base.join(p, ["row", "col"], "full").select("row", "col", F.coalesce("_p", "value").alias("value"))


def sample(points: DataFrame, raster: DataFrame, key: str, px: Column, py: Column) -> DataFrame:
    """points with ``value``: interpolated in the triangle of the cell that holds (px, py), in cells from the top left.

    A cell is split along the diagonal from its top left to its bottom right corner; a missing corner gives null.
    """
    at = points.select(key, px.alias("_px"), py.alias("_py"))
    at = at.withColumn("_c", F.floor("_px")).withColumn("_r", F.floor("_py"))
    at = at.withColumn("_u", F.col("_px") - F.col("_c")).withColumn("_v", F.col("_py") - F.col("_r"))
    u, v = F.col("_u"), F.col("_v")
    corner = lambda dr, dc, w: F.struct((F.col("_r") + dr).alias("row"), (F.col("_c") + dc).alias("col"), w.alias("w"))
    corners = F.array(
        corner(0, 0, 1 - F.greatest(u, v)), corner(1, 1, F.least(u, v)),
        F.when(u >= v, corner(0, 1, u - v)).otherwise(corner(1, 0, v - u)),
    )
    each = at.select(key, F.explode(F.filter(corners, lambda c: c["w"] > 0)).alias("k")).select(key, "k.row", "k.col", "k.w")
    found = each.join(raster, ["row", "col"], "left").groupBy(key).agg(
        F.when(F.count("value") == F.count("*"), F.sum(F.col("value") * F.col("w"))).alias("value")
    )
    return points.join(found, key, "left")


def with_halo(raster: DataFrame, size: int, halo: int) -> DataFrame:
    """Cells dealt to square tiles (tr, tc) and to the neighbours within ``halo`` cells of them."""
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / size), F.floor((F.col(c) + halo) / size))
    return raster.withColumn("tr", F.explode(near("row"))).withColumn("tc", F.explode(near("col")))


def mosaic(tiles: DataFrame, n: int, halo: int) -> DataFrame:
    """Squares (lat, lon) of n by n cells (row, col, value), each with a rim from the eight squares around it.

    Rows and columns of the rim are below 0 or from n on. Only cells near a side are sent to the
    squares there; squares that aren't there get nothing.
    """
    near = F.sequence(F.lit(-1), F.lit(1))
    sent = tiles.withColumn("_dy", F.explode(near)).withColumn("_dx", F.explode(near))
    sent = sent.select((F.col("lat") + F.col("_dy")).alias("lat"), (F.col("lon") + F.col("_dx")).alias("lon"), (F.col("row") - n * F.col("_dy")).alias("row"), (F.col("col") - n * F.col("_dx")).alias("col"), "value")
    sent = sent.where(F.col("row").between(-halo, n + halo - 1) & F.col("col").between(-halo, n + halo - 1))
    return sent.join(tiles.select("lat", "lon").distinct(), ["lat", "lon"], "left_semi")


def _cubic(t: Column) -> Column:
    """The weight of a sample at a distance of t cells in cubic convolution (a = -1/2)."""
    t = F.abs(t)
    return F.when(t <= 1, (1.5 * t - 2.5) * t * t + 1).when(t < 2, ((2.5 - 0.5 * t) * t - 4) * t + 2).otherwise(0.0)


#: Corners of a patch's source, in its order around: top left, bottom left, bottom right, top right.
CORNERS = ("nw", "sw", "se", "ne")


def warped(patches: DataFrame, raster: DataFrame) -> DataFrame:
    """row, col, value of a raster made of rectangular patches, each taken from a quadrangle of ``raster``.

    ``patches`` has the rectangle's r0, c0 (inside) and r1, c1 (outside), and where its corners lie in the
    source, in cells from the top left: structs (row, col) named ``nw``, ``sw``, ``se`` and ``ne``. Places
    between the corners go bilinearly, and values by cubic convolution. A cell whose source has no
    data is left out; other samples without data count as the source cell's own. Patches without cells
    or with a null corner give nothing; patches that overlap give a cell twice. Each source cell carries
    its sixteen samples to one join, so a target cell meets one row.
    """
    c = F.col
    from_to = lambda lo, hi: F.explode(F.sequence(c(lo), c(hi) - 1))
    rows = patches.where((c("r1") > c("r0")) & (c("c1") > c("c0"))).withColumn("row", from_to("r0", "r1"))
    each = rows.repartition("row").withColumn("col", from_to("c0", "c1"))  # patches may be few and large
    u, v = (c("col") - c("c0") + 0.5), (c("row") - c("r0") + 0.5)
    w, h = c("c1") - c("c0"), c("r1") - c("r0")

    def place(axis: str) -> Column:
        nw, sw, se, ne = (c(f"{k}.{axis}") for k in CORNERS)
        return nw + (ne - nw) / w * u + (sw - nw) / h * v + (se - sw - ne + nw) / w / h * u * v - 0.5

    at = each.select("row", "col", place("row").alias("_y"), place("col").alias("_x"))
    at = at.withColumns({"_r": F.floor("_y"), "_c": F.floor("_x")})
    taps = [(i, j) for i in range(-1, 3) for j in range(-1, 3)]
    samples = in_blocks(raster, 2, lambda z, here: [_moved(z, i, j) for i, j in taps], ", ".join(f"s{k} double" for k in range(16)))
    samples = samples.select(c("row").alias("_r"), c("col").alias("_c"), F.array(*[f"s{k}" for k in range(16)]).alias("_s")).where(c("_s")[taps.index((0, 0))].isNotNull())
    # Spark takes what few patches make for small and would send it to the driver, but it is as large as the raster
    met = at.hint("merge").join(samples.hint("merge"), ["_r", "_c"])
    own = c("_s")[taps.index((0, 0))]
    weigh = lambda k, i, j: F.coalesce(c("_s")[k], own) * _cubic(c("_y") - c("_r") - i) * _cubic(c("_x") - c("_c") - j)
    return met.select("row", "col", sum((weigh(k, i, j) for k, (i, j) in enumerate(taps)), F.lit(0.0)).alias("value"))
