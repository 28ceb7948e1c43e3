"""Outlines grown and shrunk by a width, and simplified.

Growing is exact union, shrinking exact difference: along each edge of a ring lies a rectangle that
reaches as far as the width on either side, and at each corner what two rectangles leave open on its
outer side: a mitre, or a bevel where the mitre would be longer than its limit. A polygon with these is
the grown one, a polygon less these the shrunk one. So outlines that meet themselves, and gaps and necks
that close, need no repair afterwards. Ends are whole numbers of lattice steps (see ``planar``).

Points that repeat the one before are one point. Rings of a null point or less than three different
points give nothing; columns other than the named are ignored; rings that repeat in a group are one. Empty tables
give empty ones.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.functions.shapes import let, point
from tilewright.operators import planar
from tilewright.session import written


def cleaned(ring: Column) -> Column:
    """A closed ring (the last point repeats the first) without points that repeat the one before."""
    return F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))


def stroke(ring: Column, width: float, limit: float = 5.0) -> Column:
    """Closed rings along a cleaned closed ring: a rectangle for each edge, and a mitre or bevel for each corner.

    ``limit`` is the longest mitre in widths.
    """
    n = F.size(ring) - 1
    at = lambda i: F.get(ring, F.pmod(i, n))

    def normal(i: Column) -> Column:
        """Of edge i, to the left."""
        a, b = at(i), at(i + 1)
        size = F.sqrt((b["x"] - a["x"]) * (b["x"] - a["x"]) + (b["y"] - a["y"]) * (b["y"] - a["y"]))
        return point(-(b["y"] - a["y"]) / size, (b["x"] - a["x"]) / size)

    moved = lambda p, v, k: point(p["x"] + k * v["x"], p["y"] + k * v["y"])

    def rectangle(i: Column) -> Column:
        a, b = at(i), at(i + 1)
        return let(normal(i), lambda v: F.array(moved(a, v, width), moved(b, v, width), moved(b, v, -width), moved(a, v, -width), moved(a, v, width)))

    def corner(i: Column) -> Column:
        """Between edge i and the next one, on the outer side of the turn."""

        def quad(two: Column) -> Column:
            p, u, v = at(i + 1), two["u"], two["v"]
            k = F.when(u["x"] * v["y"] - u["y"] * v["x"] > 0, -width).otherwise(width)
            cos = 1 + u["x"] * v["x"] + u["y"] * v["y"]
            far = k / F.when(2 > limit * limit * cos, F.lit(2.0)).otherwise(cos)
            return F.array(p, moved(p, u, k), point(p["x"] + far * (u["x"] + v["x"]), p["y"] + far * (u["y"] + v["y"])), moved(p, v, k), p)

        return let(F.struct(normal(i).alias("u"), normal(i + 1).alias("v")), quad)

    return F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(rectangle(i), corner(i))))


def offset(rings: DataFrame, ring: str, width: float, steps: int, *group: str, limit: float = 5.0, size: int | None = None) -> DataFrame:
    """Pieces with sides (see ``planar.sides``) of each group's rings (A) and of what lies along their edges (B).

    The union of the two is the group's polygons grown by the width; A less B is them shrunk.
    """
    c = F.col
    whole = rings.where(~F.exists(c(ring), lambda p: (p["x"] + p["y"]).isNull()))
    own = whole.select(*group, cleaned(c(ring)).alias("_ring")).where(F.size("_ring") > 3)
    own = own.distinct().withColumn("_number", F.monotonically_increasing_id())
    parts = F.concat(F.array(F.struct(F.lit(0).alias("i"), F.lit(False).alias("_in_b"), c("_ring").alias("r"))), F.transform(stroke(c("_ring"), width, limit), lambda r, i: F.struct((i + 1).alias("i"), F.lit(True).alias("_in_b"), r.alias("r"))))
    each = own.select(*group, "_number", F.explode(parts).alias("_p")).select(*group, F.struct("_number", "_p.i").alias("_part"), "_p._in_b", "_p.r")
    edges = written(planar.on_lattice(planar.ring_edges(each, "r", *group, "_part", "_in_b"), steps), "outlines")
    found = planar.pieces(planar.stretches(edges, *group), *group, size=size)
    return planar.sides(found, edges.withColumnRenamed("_in_b", "b"), "b", "_part", *group, size=size)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def simplified(x: pd.Series, y: pd.Series, tolerance: pd.Series) -> pd.Series:
    """The places (from 0) of a line's points that stay: both ends, and between two that stay the one farthest from their segment, if it is farther than the tolerance.

    Of equally far points the first stays. Lines with a null stay as they are; a null or empty line has no places.
    """

    def kept(a, b, most: float) -> list[int]:
        n = 0 if a is None or b is None else len(a)
        p = np.array([a, b], float).T if n else np.empty((0, 2))
        if n < 3 or not np.isfinite(p).all():
            return list(range(n))
        stay, waiting = {0, n - 1}, [(0, n - 1)]
        while waiting:
            i, j = waiting.pop()
            if j - i < 2:
                continue
            d, q = p[j] - p[i], p[i + 1 : j] - p[i]
            long = d @ d
            k = np.clip(q @ d / long, 0, 1) if long else np.zeros(len(q))
            far = np.round(np.hypot(*(q - k[:, None] * d).T), 12)  # so that points of equal distance are equal
            best = int(far.argmax())
            if far[best] > most:
                stay.add(i + 1 + best)
                waiting += [(i, i + 1 + best), (i + 1 + best, j)]
        return sorted(stay)

    return pd.Series([kept(*row) for row in zip(x, y, tolerance)])


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("ring", T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in ("x", "y")]))), T.StructField("area", T.DoubleType())])))
def _halved(xs: pa.Array, ys: pa.Array, sizes: pa.Array) -> pa.Array:
    count, done = len(xs), []
    n = xs.value_lengths().to_numpy(zero_copy_only=False)
    x, y = (v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (xs, ys))
    own, most = np.repeat(np.arange(count), n), sizes.cast(pa.float64()).to_numpy(zero_copy_only=False)
    good = np.bincount(own, ~np.isfinite(x + y), minlength=count) == 0
    keep = good[own]
    x, y, own = x[keep], y[keep], own[keep]
    ring = own  # which piece a point is of; pieces lie one after the other
    while len(x):
        first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
        at = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        x0, x1, y0, y1 = (f.reduceat(v, first) for v in (x, y) for f in (np.minimum, np.maximum))
        w, h = x1 - x0, y1 - y0
        whole = np.maximum(w, h) <= most[own[first]]
        done.append((own[whole[at]], at[whole[at]], x[whole[at]], y[whole[at]]))
        middle = np.floor(np.where(w >= h, x0 + x1, y0 + y1) / 2 * 1e6 + 0.5) / 1e6
        k = np.flatnonzero((at[1:] == at[:-1]) & ~whole[at[1:]])
        wide, m = (w >= h)[at[k]], middle[at[k]]
        a, b = np.where(wide, x[k], y[k]), np.where(wide, x[k + 1], y[k + 1])
        c, d = np.where(wide, y[k], x[k]), np.where(wide, y[k + 1], x[k + 1])
        made = []
        for side, sign in enumerate((1, -1)):
            from_in, to_in = (a - m) * sign >= 0, (b - m) * sign >= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                other = c + (m - a) / (b - a) * (d - c)
            keep = np.stack([from_in != to_in, to_in], 1).ravel()  # of each segment first where it crosses, then its end
            along, across = np.stack([m, b], 1).ravel()[keep], np.stack([other, d], 1).ravel()[keep]
            by_x = np.repeat(wide, 2)[keep]
            made.append((np.repeat(own[k], 2)[keep], np.repeat(at[k] * 2 + side, 2)[keep], np.where(by_x, along, across), np.where(by_x, across, along)))
        own, ring, x, y = (np.concatenate(v) for v in zip(*made))
        if len(x):  # closed again by their first points
            first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]])
            order = np.argsort(np.r_[ring, ring[first]], kind="stable")
            own, ring, x, y = (np.r_[v, v[first]][order] for v in (own, ring, x, y))
    # pieces in the order of their rings
    base, parts = 0, []
    for o, r, px, py in done:
        new = np.cumsum(np.r_[0, r[1:] != r[:-1]]) + base if len(r) else r
        parts.append((o, new, px, py))
        base = new[-1] + 1 if len(new) else base
    own, ring, x, y = (np.concatenate(v) for v in zip(*parts)) if parts else (np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0))
    order = np.argsort(own, kind="stable")
    own, ring, x, y = own[order], ring[order], x[order], y[order]
    first = np.flatnonzero(np.r_[True, ring[1:] != ring[:-1]]) if len(ring) else np.zeros(0, int)
    cross = np.r_[np.where(ring[1:] == ring[:-1], x[:-1] * y[1:] - x[1:] * y[:-1], 0.0), 0.0] if len(ring) else np.zeros(0)
    area = np.bincount(np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)])), cross) / 2  # one after the other, as in SQL
    points = pa.ListArray.from_arrays(pa.array(np.r_[first, len(x)].astype(np.int32)), pa.StructArray.from_arrays([pa.array(x), pa.array(y)], ["x", "y"]))
    offsets = np.searchsorted(own[first], np.arange(count + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([points, pa.array(area)], ["ring", "area"]))


_halved = _halved.asNondeterministic()  # else what explodes it is planned with a filter that cuts once more


def halved(rings: DataFrame, ring: str, size: float, *key: str) -> DataFrame:
    """key, ring, area: the pieces of closed rings, none wider or higher than ``size``, and their signed areas.

    A piece that is over the size is cut across its longer side (its width if both are alike), halfway
    to six digits, and so are its halves, many rings at once in numpy and without a shuffle. The halves of a concave
    ring may hang together by edges along the cut, which hold no area. Rings that are null, empty or hold
    null or non-finite coordinates are left out, as are other columns; equal rings are cut alike.
    """
    if size < 1e-5:
        raise ValueError("pieces can't be smaller than what places are rounded to")
    axis = lambda a: F.transform(ring, lambda p: p[a])
    good = rings.where((F.size(ring) > 0) & ~F.exists(ring, lambda p: (p["x"] + p["y"]).isNull()))
    each = good.select(*key, F.explode(_halved(axis("x"), axis("y"), F.lit(float(size)))).alias("_p"))
    return each.select(*key, "_p.ring", "_p.area")
