"""Outlines grown, shrunk and simplified, against known areas and a recursive version."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.operators import outlines as m
from tilewright.operators import planar

RINGS = "g int, ring array<struct<x:double,y:double>>, _ring string"


def areas(spark, rings, width, limit=5.0):
    df = spark.createDataFrame([(g, ring, "x") for g, ring in rings], RINGS)
    sided = m.offset(df, "ring", width, 1000, "g", limit=limit)
    rows = sided.groupBy("g").agg(planar.area_of(planar.UNION).alias("u"), planar.area_of(planar.LESS).alias("l")).collect()
    return {r["g"]: (r["u"] / 1e6, r["l"] / 1e6) for r in rows}


def test_known_areas(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0), (0.0, 0.0)]
    again = [square[0], square[0], *square[1:3], square[2], *square[3:]]  # points that repeat
    ell = [(0.0, 0.0), (6.0, 0.0), (6.0, 2.0), (2.0, 2.0), (2.0, 6.0), (0.0, 6.0), (0.0, 0.0)]
    neck = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (4.5, 4.0), (4.5, 0.0), (9.0, 0.0), (9.0, 5.0), (0.0, 5.0), (0.0, 0.0)]
    rings = [(1, square), (2, square[::-1]), (3, again), (4, ell), (5, neck), (6, None), (7, []), (8, square[:2] + square[:1]), (9, [square[0], None, *square[1:]])]
    rings += [(10, square), (10, [(x + 4.5, y) for x, y in square]), (11, square), (11, square)]
    got = areas(spark, rings, 0.5)
    assert set(got) == {1, 2, 3, 4, 5, 10, 11}
    for g in (1, 2, 3, 11):
        assert got[g] == pytest.approx((25.0, 9.0))
    assert got[4] == pytest.approx((7 * 3 + 4 * 3, 5 * 1 + 1 * 4))
    assert got[5] == pytest.approx((60.0, 3 * 4 + 3.5 * 4))  # the slit of half a unit closes, what is over it goes
    assert got[10] == pytest.approx((9.5 * 5, 18.0))
    assert areas(spark, [], 0.5) == {}


def test_sharp_corners_are_cut(spark):
    spike = [(0.0, 0.0), (10.0, 0.5), (10.0, -0.5), (0.0, 0.0)]
    long, short = (areas(spark, [(1, spike)], 0.5, limit)[1][0] for limit in (100.0, 2.0))
    # the mitre at the tip is half a width over the sine of half the angle long
    sine = 0.5 / np.hypot(10, 0.5)
    tip = 0.5 / sine
    assert long - short == pytest.approx(tip * np.cos(np.arcsin(sine)) * 0.5 - 0.5 * 0.5 * sine * np.cos(np.arcsin(sine)), rel=0.02)


def slow(p, most):
    if len(p) < 3:
        return list(range(len(p)))
    a, d = p[0], p[-1] - p[0]
    far = []
    for q in p[1:-1]:
        k = min(max(((q - a) @ d) / (d @ d), 0), 1) if d @ d else 0
        far.append(round(float(np.hypot(*(q - a - k * d))), 12))
    if max(far) <= most:
        return [0, len(p) - 1]
    i = 1 + far.index(max(far))
    left, right = slow(p[: i + 1], most), slow(p[i:], most)
    return left + [i + j for j in right[1:]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5)), max_size=12), st.sampled_from([0.0, 0.5, 1.0, 2.0]))
def test_simplified(points, most):
    import pandas as pd

    p = np.array(points, float).reshape(-1, 2)
    (got,) = m.simplified.func(pd.Series([p[:, 0]]), pd.Series([p[:, 1]]), pd.Series([most]))
    assert got == slow(p, most)


def test_simplified_nulls_and_long_lines(spark):
    df = spark.createDataFrame([(1, None, [1.0]), (2, [], []), (3, [1.0, None, 3.0], [0.0, 0.0, 0.0]), (4, [float(i) for i in range(20_000)], [0.0] * 20_000)], "k int, x array<double>, y array<double>")
    got = {r["k"]: r["s"] for r in df.selectExpr("k", "x", "y", "0.5D t").select("k", m.simplified("x", "y", "t").alias("s")).collect()}
    assert got == {1: [], 2: [], 3: [0, 1, 2], 4: [0, 19_999]}
