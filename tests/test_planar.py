"""Exact arrangements and polygons against brute force on small lattices."""

from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import planar as m

EDGE = "g int, x long, y long, x2 long, y2 long, flags int"


def slow_pieces(segments):
    """Each segment cut at every point of another one that lies on it, in fractions; equal pieces are one."""
    out = {}
    for x, y, x2, y2, flags in segments:
        u, stops = (x2 - x, y2 - y), {Fraction(0), Fraction(1)}
        if u == (0, 0):
            continue
        for a, b, a2, b2, _ in segments:
            v, w = (a2 - a, b2 - b), (a - x, b - y)
            det, s, t = u[0] * v[1] - u[1] * v[0], w[0] * v[1] - w[1] * v[0], w[0] * u[1] - w[1] * u[0]
            if det and 0 <= Fraction(t, det) <= 1:
                stops.add(Fraction(s, det))
            elif not det and not t and v != (0, 0):
                for p in ((a, b), (a2, b2)):
                    stops.add(Fraction((p[0] - x) * u[0] + (p[1] - y) * u[1], u[0] ** 2 + u[1] ** 2))
        stops = sorted(k for k in stops if 0 <= k <= 1)
        for k, j in zip(stops, stops[1:]):
            ends = tuple(sorted((float(x + q * u[0]), float(y + q * u[1])) for q in (k, j)))
            out[ends] = out.get(ends, 0) | flags
    return out


@pytest.mark.parametrize("size", [None, 4])
def test_pieces(spark, size):
    rng = np.random.default_rng(4)
    groups = {g: [(*map(int, rng.integers(0, 9 if g else 60, 4)), int(rng.integers(0, 8))) for _ in range(40)] for g in range(3)}
    groups[3] = [(0, 0, 8, 8, 1), (2, 2, 5, 5, 2), (5, 5, 2, 2, 4), (4, 4, 9, 9, 2), (0, 8, 8, 0, 1), (3, 3, 3, 3, 7), (4, 0, 4, 9, 1), (4, 2, 4, 4, 2)]
    rows = [(g, *s) for g, some in groups.items() for s in some] + [(None, 0, 0, 1, 1, 1), (3, None, 0, 1, 1, 1)]
    df = spark.createDataFrame(rows, EDGE)
    got = m.pieces(m.stretches(df, "g", flags="flags", bits=3), "g", size=size).collect()
    for g, some in groups.items():
        mine = [r for r in got if r["g"] == g]
        want = slow_pieces(some)
        near = lambda p: tuple(round(v, 9) for end in p for v in end)
        assert Counter({near(sorted([(r["x"], r["y"]), (r["x2"], r["y2"])])): r["flags"] for r in mine}) == Counter({near(k): v for k, v in want.items()})
        assert len(mine) == len(want)
    assert m.pieces(m.stretches(df.limit(0), "g"), "g").count() == 0


def cells_of(boxes, n):
    out = np.zeros((n, n), bool)
    for x, y, x2, y2 in boxes:
        out[x:x2, y:y2] = True
    return out


def parts(cells, diagonal):
    """How many connected sets of cells there are."""
    left, count = {tuple(c) for c in np.argwhere(cells).tolist()}, 0
    near = [(1, 0), (-1, 0), (0, 1), (0, -1)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    while left:
        some, count = [left.pop()], count + 1
        while some:
            i, j = some.pop()
            for a, b in near:
                if (i + a, j + b) in left:
                    left.remove((i + a, j + b))
                    some.append((i + a, j + b))
    return count


def test_unions_and_rings_of_boxes(spark):
    """Boxes with common sides and corners: areas and numbers of rings are those of cells."""
    rng, n, rows, want = np.random.default_rng(8), 12, [], {}
    for g in range(30):
        boxes = []
        for k in range(int(rng.integers(1, 14))):
            x, x2, y, y2 = (*sorted(rng.choice(n - 2, 2, replace=False) + 1), *sorted(rng.choice(n - 2, 2, replace=False) + 1))
            boxes.append((bool(k % 3 == 2), *map(int, (x, y, x2, y2))))
        for k, (b, x, y, x2, y2) in enumerate(boxes):
            corners = [(x, y), (x2, y), (x2, y2), (x, y2), (x, y)]
            rows += [(g, k, b, *p, *q) for p, q in zip(corners, corners[1:])]
        a, b = (cells_of([t[1:] for t in boxes if t[0] is which], n) for which in (False, True))
        inside = a & ~b
        want[g] = ((a | b).sum(), (a & b).sum(), inside.sum(), (a ^ b).sum(), parts(inside, False), parts(~inside, True) - 1)
    edges = spark.createDataFrame(rows, "g int, ring int, b boolean, x long, y long, x2 long, y2 long")
    for size in (None, 5):
        sided = m.sides(m.pieces(m.stretches(edges, "g"), "g", size=size), edges, "b", "ring", "g", size=size)
        areas = sided.groupBy("g").agg(*(m.area_of(f).alias(str(i)) for i, f in enumerate((m.UNION, m.COMMON, m.LESS, m.EITHER))))
        assert {r["g"]: tuple(r)[1:] for r in areas.collect()} == {g: tuple(map(float, w[:4])) for g, w in want.items()}
    rings = m.traced(m.boundary(sided, m.LESS, "g"), "g")
    each = rings.groupBy("g", "ring").agg(F.sum(F.expr("x * y2 - x2 * y")).alias("area"), F.sum(F.expr("x2 - x")).alias("dx"), F.sum(F.expr("y2 - y")).alias("dy")).collect()
    assert all(r["dx"] == 0 and r["dy"] == 0 for r in each)  # closed
    count = Counter((r["g"], r["area"] > 0) for r in each)
    assert {g: (count[g, True], count[g, False]) for g in want} == {g: w[4:] for g, w in want.items()}


def test_polygon_rings_add_up(spark, sf_dir):
    from tilewright.registry import QUERIES

    area = {(r["kind"], r["id"]): r["area"] for r in QUERIES["exact_multipolygons"](spark, sf_dir).collect()}
    rings = {(r["kind"], r["id"]): r for r in QUERIES["polygon_rings"](spark, sf_dir).collect()}
    assert set(rings) == {k for k, v in area.items() if v > 0}
    assert all(abs(r["area"] - area[k]) < 1e-7 and r["parts"] > 0 and r["largest"] <= r["length"] ** 2 / 12 for k, r in rings.items())


def test_cells_keep_a_callers_columns(spark):
    from tilewright.operators import spatial

    points = spark.createDataFrame([(1, 0.5, 0.5, 7, 8), (2, None, 0.5, 7, 8)], "id int, lon double, lat double, _cx int, _cy_ int")
    boxes = spark.createDataFrame([(0.0, 0.0, 1.0, 1.0, 9)], "x0 double, y0 double, x1 double, y1 double, _CY int")
    (row,) = spatial.points_in_boxes(points, boxes, 0.3).collect()
    assert (row["id"], row["_cx"], row["_cy_"], row["_CY"]) == (1, 7, 8, 9)
    assert {r["id"]: (r["_cx"], len(r["_boxes"] or [])) for r in spatial.with_boxes(points, boxes, 0.3).collect()} == {1: (7, 1), 2: (7, 0)}
    near = spatial.all_within(points, points.selectExpr("id near", "lon", "lat").where("lon IS NOT NULL"), 1000.0).collect()
    assert [(r["id"], r["near"], r["_cx"]) for r in near] == [(1, 1, 7)]


def test_nulls_in_rings(spark):
    from tilewright.operators import rings

    rows = [(1, 1, [1, 2]), (1, 2, [2, 1]), (2, 1, [1, None]), (2, 2, [None, 1]), (3, 1, []), (3, 2, [4, 5, 4]), (None, 1, [1, 2, 1]), (4, 1, None)]
    got = rings.assemble(spark.createDataFrame(rows, "k int, fragment int, nodes array<long>"), "k").collect()
    assert [(r["k"], r["nodes"]) for r in got] == [(1, [1, 2, 1])]
