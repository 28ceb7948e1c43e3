"""Column expressions for lines and rings given as array<struct<x, y>>.

``scale`` is the cosine of the latitude: x counts by it in lengths, which are metres if x and y are degrees.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tilewright.functions.geodesy import METRES_PER_DEGREE, C, col

POINTS = "array<struct<x:double,y:double>>"


def let(value: Column, body) -> Column:
    """``body`` of a variable bound to ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def segments(line: C) -> Column:
    """array<struct<a, b>> of a line's consecutive points."""
    line = col(line)
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), F.size(line)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def length_m(line: C, scale: float = 1.0) -> Column:
    part = lambda s: F.sqrt(F.pow((s["b"]["x"] - s["a"]["x"]) * scale, 2) + F.pow(s["b"]["y"] - s["a"]["y"], 2))
    return total(F.transform(segments(line), part)) * METRES_PER_DEGREE


def signed_area(ring: C) -> Column:
    """Shoelace area: positive for counter-clockwise rings."""
    return total(F.transform(segments(ring), lambda s: s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def is_closed(line: C) -> Column:
    line = col(line)
    return (F.size(line) > 2) & (F.element_at(line, 1) == F.element_at(line, -1))


def counter_clockwise(ring: C) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(col(ring))).otherwise(col(ring))


def bounds(line: C) -> Column:
    xs, ys = _axis(line, "x"), _axis(line, "y")
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def _axis(line: C, name: str) -> Column:
    return F.transform(col(line), lambda p: p[name])


def winding_contains(ring: C, x: C, y: C) -> Column:
    """Whether a closed ring winds around a point: a sum over its edges that cross the point's height."""
    px, py = col(x), col(y)

    def turn(s: Column) -> Column:
        a, b = s["a"], s["b"]
        side = (b["x"] - a["x"]) * (py - a["y"]) - (px - a["x"]) * (b["y"] - a["y"])
        return F.when((a["y"] <= py) & (b["y"] > py) & (side > 0), 1).when((a["y"] > py) & (b["y"] <= py) & (side < 0), -1).otherwise(0)

    return F.aggregate(segments(ring), F.lit(0), lambda acc, s: acc + turn(s)) != 0


def refine(line: C, max_length: float, scale: float = 1.0) -> Column:
    """Equal points put into segments longer than ``max_length`` metres: floor(length / max_length) of them."""

    def cut(s: Column) -> Column:
        a, b = s["a"], s["b"]
        long = F.sqrt(F.pow((a["x"] - b["x"]) * scale, 2) + F.pow(a["y"] - b["y"], 2)) * METRES_PER_DEGREE
        n = F.floor(long / max_length).cast("int") + 1
        at = lambda j, c: j / n * b[c] + (n - j) / n * a[c]
        return F.transform(F.sequence(F.lit(0), n - 1), lambda j: point(at(j, "x"), at(j, "y")))

    line = col(line)
    return F.concat(F.flatten(F.transform(segments(line), cut)), F.slice(line, F.greatest(F.size(line), F.lit(1)), F.lit(1)))


def normals(line: C, scale: float = 1.0, left: bool = True) -> Column:
    """Unit normals at each point: the mean of the neighbouring segments' directions, turned.

    At the joint of a closed line both ends share a mean. A small number keeps lengths off zero.
    """
    tiny, sign = 1e-6, 1.0 if left else -1.0

    def scaled(x: Column, y: Column) -> Column:
        return let(tiny + F.sqrt(x * x + y * y), lambda n: point(x / n, y / n))

    directions = F.transform(segments(line), lambda s: scaled((s["b"]["x"] - s["a"]["x"]) * scale, s["b"]["y"] - s["a"]["y"]))

    def at_points(d: Column) -> Column:
        n, closed = F.size(d), is_closed(line)

        def mean(a: Column, b: Column) -> Column:
            return scaled(a["x"] + b["x"], a["y"] + b["y"])

        joint = mean(F.get(d, F.lit(0)), F.get(d, n - 1))
        return F.transform(
            F.sequence(F.lit(0), n),
            lambda i: F.when(
                (i == 0) | (i == n),
                F.when(closed & (n > 1), joint).otherwise(F.get(d, F.least(i, n - 1))),
            ).otherwise(mean(F.get(d, i - 1), F.get(d, i))),
        )

    turned = lambda t: point(-sign / scale * t["y"], sign * t["x"])
    return F.when(F.size(col(line)) < 2, F.array().cast(POINTS)).otherwise(let(directions, lambda d: F.transform(at_points(d), turned)))


def shift(line: C, metres: C, scale: float = 1.0, left: bool = True) -> Column:
    """A line moved sideways."""
    by = col(metres) / METRES_PER_DEGREE
    return F.zip_with(col(line), normals(line, scale, left), lambda p, n: point(p["x"] + by * n["x"], p["y"] + by * n["y"]))


def strip(line: C, width: C, scale: float = 1.0) -> Column:
    """The closed ring of a line's right side and its left side turned back."""
    half = col(width) / 2
    right, back = shift(line, -half, scale), F.reverse(shift(line, half, scale))
    return let(right, lambda r: F.concat(r, back, F.slice(r, 1, 1)))


def distance_to_segment(x: C, y: C, a: Column, b: Column, scale: float = 1.0) -> Column:
    """Metres from a point to the nearest point of a segment."""
    px, py = col(x), col(y)
    dx, dy = (b["x"] - a["x"]) * scale, b["y"] - a["y"]
    along = ((px - a["x"]) * scale * dx + (py - a["y"]) * dy) / (dx * dx + dy * dy)
    k = F.coalesce(F.least(F.greatest(along, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    return F.sqrt(F.pow((px - a["x"]) * scale - k * dx, 2) + F.pow(py - a["y"] - k * dy, 2)) * METRES_PER_DEGREE


def crossing(a: Column, b: Column, c: Column, d: Column, eps: float = 1e-8) -> Column:
    """struct(alpha, beta) where a + alpha (b - a) = c + beta (d - c), for segments that cross other than at common ends; else null."""
    ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - d["x"], c["y"] - d["y"]
    wx, wy = c["x"] - a["x"], c["y"] - a["y"]
    det = ux * vy - uy * vx
    size = F.sqrt((ux * ux + uy * uy) * (vx * vx + vy * vy))
    alpha, beta = (wx * vy - wy * vx) / F.nullif(det, F.lit(0.0)), (ux * wy - uy * wx) / F.nullif(det, F.lit(0.0))
    within, inside = lambda k: k.between(0, 1), lambda k: (k > eps) & (k < 1 - eps)
    good = (F.abs(det) > eps * size) & within(alpha) & within(beta) & (inside(alpha) | inside(beta))
    return F.when(good, F.struct(alpha.alias("alpha"), beta.alias("beta")))


def clip(ring: C, x0: float, y0: float, x1: float, y1: float) -> Column:
    """A closed ring cut to a rectangle, one side after the other; empty if nothing is left."""
    out = col(ring)
    for axis, at, sign in (("x", x0, 1), ("x", x1, -1), ("y", y0, 1), ("y", y1, -1)):
        out = half(out, axis, at, sign)
    return out


def half(ring: C, axis: str, at, sign: int) -> Column:
    """The part of a closed ring on one side of a line across ``axis`` at ``at``, a number or a column: beyond it for sign 1, before it for -1."""
    out = let(col(ring), _cut(axis, "y" if axis == "x" else "x", at, sign))
    return let(out, lambda r: F.when(F.size(r) > 0, F.concat(r, F.slice(r, 1, 1))).otherwise(r))


def _cut(axis: str, other: str, at, sign: int):
    inside = lambda p: (p[axis] - at) * sign >= 0

    def through(a: Column, b: Column) -> Column:
        k = (at - a[axis]) / (b[axis] - a[axis])
        v = a[other] + k * (b[other] - a[other])
        return point(F.lit(at), v) if axis == "x" else point(v, F.lit(at))

    def step(s: Column) -> Column:
        a, b = s["a"], s["b"]
        none = F.array().cast(POINTS)
        return F.when(inside(a) & inside(b), F.array(b)).when(inside(a), F.array(through(a, b))).when(
            inside(b), F.array(through(a, b), b)
        ).otherwise(none)

    return lambda r: F.flatten(F.transform(segments(r), step))


def regular_ring(x: C, y: C, metres: float, corners: int = 6, scale: float = 1.0) -> Column:
    """A closed regular polygon around a point."""
    corner = lambda k: point(
        col(x) + metres / METRES_PER_DEGREE / scale * F.cos(k * 2 * math.pi / corners), col(y) + metres / METRES_PER_DEGREE * F.sin(k * 2 * math.pi / corners)
    )
    return F.transform(F.sequence(F.lit(0), F.lit(corners)), corner)


def perimeter_place(x: C, y: C) -> Column:
    """Where along the unit square's sides a point of them lies: clockwise from (0, 0), in [0, 4)."""
    x, y = col(x), col(y)
    return F.when((x == 0) & (y < 1), y).when((y == 1) & (x < 1), 1 + x).when((x == 1) & (y > 0), 3 - y).otherwise(4 - x) % 4


def perimeter_point(place: C) -> Column:
    """The point at a place along the unit square's sides."""
    s = F.pmod(col(place), F.lit(4.0))
    one, zero = F.lit(1.0), F.lit(0.0)
    return F.when(s < 1, point(zero, s)).when(s < 2, point(s - 1, one)).when(s < 3, point(one, 3 - s)).otherwise(point(4 - s, zero))


def closed_flat(ring: C) -> Column:
    """A flat list of coordinates (y, x, y, x, ...) with its first point repeated at the end."""
    return F.concat(col(ring), F.slice(col(ring), 1, 2))


def mean_place(line: C) -> Column:
    """The mean of a line's points; the point that closes a line counts twice."""
    xs, ys = _axis(line, "x"), _axis(line, "y")
    return point(total(xs) / F.size(col(line)), total(ys) / F.size(col(line)))


def convolve_around(values: C, kernel: list[float]) -> Column:
    """An array convolved with a kernel of odd size as if its end met its beginning."""
    v, half = col(values), len(kernel) // 2
    weights = F.array(*map(F.lit, kernel))
    taps = F.sequence(F.lit(-half), F.lit(half))
    near = lambda i: F.transform(taps, lambda d: F.get(v, F.pmod(i + d, F.size(v))) * F.get(weights, d + half))
    return F.transform(v, lambda _, i: total(near(i)))


def segment_cells(x: C, y: C, x2: C, y2: C, size: float) -> Column:
    """array<struct<cx, cy>>: the grid cells that a segment passes, about as many as its length in cells."""
    x, y, x2, y2 = col(x), col(y), col(x2), col(y2)
    ahead = x <= x2
    ax, ay, bx, by = (F.when(ahead, u).otherwise(v) for u, v in ((x, x2), (y, y2), (x2, x), (y2, y)))
    slack = 1e-9  # a cell too many does no harm

    def rows(c: Column) -> Column:
        at = lambda v: F.coalesce(ay + (v - ax) / F.nullif(bx - ax, F.lit(0.0)) * (by - ay), ay)
        far = F.coalesce(ay + (F.least(bx, (c + 1) * size) - ax) / F.nullif(bx - ax, F.lit(0.0)) * (by - ay), by)
        near = at(F.greatest(ax, c * size))
        return F.sequence(F.floor(F.least(near, far) / size - slack), F.floor(F.greatest(near, far) / size + slack))

    cols = F.sequence(F.floor(ax / size), F.floor(bx / size))
    return F.flatten(F.transform(cols, lambda c: F.transform(rows(c), lambda r: F.struct(c.alias("cx"), r.alias("cy")))))
