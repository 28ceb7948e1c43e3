"""Runways: elevation profiles by least squares, and how far a runway's outline is from a rectangle."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tilewright.operators.rings import FEW, _hull

#: Below this share of its first value a pivot is rounding only: the points don't determine its term.
SINGULAR = 1e-11
#: An outline that isn't wider than this is a line.
FLAT = 1e-12


def _term(k: int, t: Column) -> Column:
    """The Chebyshev polynomial of degree k over [0, 1]."""
    return F.cos(k * F.acos(F.greatest(F.least(2 * t - 1, F.lit(1.0)), F.lit(-1.0))))


def fitted(points: DataFrame, key: str, t: Column, z: Column, weight: Column, degree: int = 7) -> DataFrame:
    """key, n, profile: the polynomial through (t, z) of least weighted squares, t going from 0 to 1 along a line.

    ``profile`` has the weights of the Chebyshev terms, the lowest first, for ``height_at``. Only sums of a
    line's points are gathered (the product of two terms is the mean of two terms, so they are
    2 * degree + 1 and degree + 1 sums), partly before the shuffle; a line of any number of points is
    one row, in which the normal equations are solved. Terms that the points don't determine (fewer than
    degree + 1 different t) are zero, the highest first. Points of a null key, of which t, z or the weight
    is null or not finite, t is outside 0 to 1 or the weight not above zero don't count (n is the number of those
    that do); a line without others isn't there. Points that repeat count as often.
    """
    c, real = F.col, lambda x: x.cast("double")
    p = points.select(c(key).alias("_key"), real(t).alias("t"), real(z).alias("z"), real(weight).alias("w")).where("_key IS NOT NULL")
    p = p.where((c("t") >= 0) & (c("t") <= 1) & (c("w") > 0) & (c("w") < float("inf")) & (F.abs("z") < float("inf")))
    m = [F.sum(c("w") * _term(k, c("t"))).alias(f"m{k}") for k in range(2 * degree + 1)]
    b = [F.sum(c("w") * c("z") * _term(k, c("t"))).alias(f"b{k}") for k in range(degree + 1)]
    sums = p.groupBy("_key").agg(F.count("*").alias("n"), *m, *b)
    rows = [F.array(*[(c(f"m{i + j}") + c(f"m{abs(i - j)}")) / 2 for j in range(degree + 1)], c(f"b{i}")) for i in range(degree + 1)]
    held = sums.select("_key", "n", F.array(*rows).alias("g"))

    def step(g: Column, k: Column) -> Column:
        own = F.get(g, k)
        pivot = F.get(own, k)
        good = pivot > SINGULAR * F.get(F.get("g", k), k)
        unit = F.transform(own, lambda v: F.when(good, v / pivot).otherwise(0.0))
        rest = lambda row: F.zip_with(row, unit, lambda v, u: v - F.get(row, k) * u)
        return F.transform(g, lambda row, i: F.when(i == k, unit).otherwise(rest(row)))

    solved = F.aggregate(F.sequence(F.lit(0), F.lit(degree)), c("g"), step)
    return held.select(c("_key").alias(key), "n", F.transform(solved, lambda row: F.get(row, F.lit(degree + 1))).alias("profile"))


def height_at(profile: str, t: Column) -> Column:
    """The value of a profile at t, from 0 to 1 along its line; null where it or t is."""
    angle = F.acos(F.greatest(F.least(2 * t.cast("double") - 1, F.lit(1.0)), F.lit(-1.0)))
    terms = F.transform(profile, lambda v, k: v * F.cos(k * angle))
    return F.aggregate(terms, F.lit(0.0), lambda total, v: total + v)


def profile_weight(i: Column, steps: Column) -> Column:
    """How much a runway's sample i of steps + 1 counts: the ends twice as much as the middle, to the fourth power."""
    return F.pow(F.greatest(i, steps - i) + F.floor(steps / 2), F.lit(4))


#: Numbers that are held at once of each kind, of lines of as many points.
AT_ONCE = 1 << 15


@F.arrow_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("area", "misfit")]))
def rectangle_misfit(x: pa.Array, y: pa.Array) -> pa.Array:
    """The area of a ring, and the Hausdorff distance between it and the smallest rotated rectangle around it.

    The ring is open (its last node isn't its first); the distance is that of either one's corners from
    the other's sides. Of rectangles of equal area (to nine digits) the longest count, of those the nearest. Without three different
    nodes, or with one that is null or not finite, both are null.
    """
    n, ends = [], []
    for v in (x, y):
        n.append(v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        ends.append(np.cumsum(n[-1]))
    known = x.is_valid().to_numpy(zero_copy_only=False) & y.is_valid().to_numpy(zero_copy_only=False)
    if (n[0] != n[1])[known].any():
        raise ValueError("a line has as many x as y")
    px, py = (v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False) for v in (x, y))
    out, sizes = np.full((2, len(x)), np.nan), np.where(known, n[0], 0)
    for size in np.unique(sizes[sizes > 2]):
        at = np.flatnonzero(sizes == size)
        step = max(1, 2 * AT_ONCE // int(size * (size - 1)))
        for lo in range(0, len(at), step):
            some = at[lo : lo + step]
            own = np.arange(size)[:, None]
            a, b = px[ends[0][some] - size + own], py[ends[1][some] - size + own]
            good = np.isfinite(a + b).all(0)
            out[:, some[good]] = _misfits(a[:, good], b[:, good]) if size <= FEW else np.array([_misfit(*line) or (np.nan, np.nan) for line in zip(a[:, good].T, b[:, good].T)]).reshape(-1, 2).T
    return pa.StructArray.from_arrays([pa.array(v, mask=np.isnan(v)) for v in out], ["area", "misfit"])


rectangle_misfit = rectangle_misfit.asNondeterministic()  # else a filter on what comes out computes it once more


def _misfits(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """As ``_misfit`` for many lines (columns) of as many points, NaN where that has none: a side lies along two points that have all others on one side."""
    n, m = x.shape
    i, j = np.triu_indices(n, 1)
    ux, uy = x[j] - x[i], y[j] - y[i]
    long = np.sqrt(ux * ux + uy * uy)
    apart = long > 0
    long[~apart] = 1
    ux, uy = ux / long, uy / long
    s0, s1, o0, o1 = (np.zeros_like(long) for _ in range(4))
    for k in range(n):
        dx, dy = x[k] - x[i], y[k] - y[i]
        s, o = dx * ux + dy * uy, dy * ux - dx * uy
        for out, least, v in ((s0, np.minimum, s), (s1, np.maximum, s), (o0, np.minimum, o), (o1, np.maximum, o)):
            least(out, v, out=out)
    wide = np.maximum(o1, -o0)
    side = apart & (np.minimum(o1, -o0) <= FLAT) & (wide > FLAT)
    size = np.where(side, np.round((s1 - s0) * wide, 9), np.inf)
    length = np.where(side & (size == size.min(0)), np.round(-np.maximum(s1 - s0, wide), 9), np.inf)
    line, pair = np.nonzero((side & (length == length.min(0))).T)  # those that count, in the order of their lines
    first = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
    out = np.full((2, m), np.nan)
    if not len(line):
        return out
    ux, uy, ox, oy, sign = ux[pair, line], uy[pair, line], x[i[pair], line], y[i[pair], line], np.where(o1[pair, line] > FLAT, 1.0, -1.0)
    dx, dy = x[:, line] - ox, y[:, line] - oy
    s, o = dx * ux + dy * uy, (dy * ux - dx * uy) * sign
    low, high, top = s.min(0), s.max(0), o.max(0)
    off = np.minimum(np.minimum(s - low, high - s), np.minimum(o, top - o)).max(0)  # a node's distance from the nearest side
    ds, do = np.roll(s, -1, axis=0) - s, np.roll(o, -1, axis=0) - o
    square = np.maximum(ds * ds + do * do, 1e-300)
    far = np.zeros(len(line))
    for cs, co in ((low, 0.0), (high, 0.0), (high, top), (low, top)):
        ws, wo = cs - s, co - o
        along = np.minimum(np.maximum((ws * ds + wo * do) / square, 0), 1)
        es, eo = along * ds - ws, along * do - wo
        far = np.maximum(far, np.sqrt((es * es + eo * eo).min(0)))
    found = line[first]
    out[0, found] = np.abs((x * np.roll(y, -1, axis=0) - np.roll(x, -1, axis=0) * y).sum(0))[found] / 2
    out[1, found] = np.minimum.reduceat(np.maximum(np.maximum(off, far), 0), first)
    return out


def _misfit(x: np.ndarray, y: np.ndarray) -> tuple[float, float] | None:
    p = np.column_stack([x, y])
    hull = _hull(np.unique(p, axis=0))
    if np.isnan(p).any() or len(hull) < 3:
        return None
    edges = np.roll(hull, -1, axis=0) - hull
    found = []
    for ux, uy in edges / np.hypot(*edges.T)[:, None]:
        turned = hull @ np.array([[ux, -uy], [uy, ux]])
        low, high = turned.min(0), turned.max(0)
        if high[1] - low[1] <= FLAT:
            continue
        found.append(((round(float(np.prod(high - low)), 9), round(-float(max(high - low)), 9)), ux, uy, low, high))
    if not found:  # all nodes lie on a line but for rounding
        return None
    least = min(f[0] for f in found)
    off = min(_apart(p @ np.array([[ux, -uy], [uy, ux]]), low, high) for rank, ux, uy, low, high in found if rank == least)
    area = float(abs((x * np.roll(y, -1) - np.roll(x, -1) * y).sum()) / 2)
    return area, off


def _apart(ring: np.ndarray, low: np.ndarray, high: np.ndarray) -> float:
    """The Hausdorff distance of a ring from the sides of the upright rectangle around it."""
    corners = np.array([low, [high[0], low[1]], high, [low[0], high[1]]])
    off = np.minimum(ring - low, high - ring).min(1).max()  # a node's distance from the nearest side
    side = np.roll(ring, -1, axis=0) - ring
    size = np.maximum((side**2).sum(1), 1e-300)
    along = np.clip(((corners[:, None] - ring) * side).sum(2) / size, 0, 1)
    far = np.sqrt(((ring + along[:, :, None] * side - corners[:, None]) ** 2).sum(2)).min(1).max()
    return float(max(off, far, 0.0))
