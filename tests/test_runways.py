import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.operators import runways


def test_profiles_are_weighted_least_squares(spark):
    rng = np.random.default_rng(2)
    lines = {k: (rng.random(n) if k % 2 else np.linspace(0, 1, n), rng.normal(300, 80, n), rng.uniform(0.1, 5, n)) for k, n in enumerate((1, 2, 3, 5, 8, 9, 40, 3000))}
    lines[20] = (np.repeat([0.1, 0.5, 0.9], 4), rng.normal(0, 1, 12), np.ones(12))  # three different places
    rows = [(k, float(t), float(z), float(w)) for k, line in lines.items() for t, z, w in zip(*line)]
    bad = [(0, None, 1.0, 1.0), (0, 0.5, None, 1.0), (0, 0.5, 1.0, None), (0, 0.5, 1.0, 0.0), (0, 0.5, 1.0, -1.0), (0, 1.5, 1.0, 1.0), (0, float("nan"), 1.0, 1.0), (0, 0.5, float("nan"), 1.0), (0, 0.5, 1.0, float("inf")), (None, 0.5, 1.0, 1.0), (99, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows + bad, "m0 int, t double, b0 double, w double")  # names that sums have too
    fit = runways.fitted(df, "m0", F.col("t"), F.col("b0"), F.col("w"))
    at = (0.0, 0.21, 0.5, 0.87, 1.0)
    got = {r["m0"]: (r["n"], [r[f"v{i}"] for i in range(5)]) for r in fit.select("m0", "n", *[runways.height_at("profile", F.lit(t)).alias(f"v{i}") for i, t in enumerate(at)]).collect()}
    assert set(got) == set(lines)
    for k, (t, z, w) in lines.items():
        degree = min(7, len(np.unique(t)) - 1)
        want = np.polynomial.Polynomial.fit(t, z, degree, domain=[0, 1], w=np.sqrt(w))
        inside = [i for i, x in enumerate(at) if t.min() <= x <= t.max()]
        assert got[k][0] == len(t) and np.allclose([got[k][1][i] for i in inside], [want(at[i]) for i in inside], rtol=1e-6, atol=1e-6)
    assert runways.fitted(df.limit(0), "m0", F.col("t"), F.col("b0"), F.col("w")).count() == 0


def test_weights_of_samples(spark):
    df = spark.createDataFrame([(i,) for i in range(8)], "i int")
    assert [r[0] for r in df.select(runways.profile_weight(F.col("i"), F.lit(7))).collect()] == [(max(i, 7 - i) + 3) ** 4 for i in range(8)]


def misfit(ring):
    """Both outlines by many points, the rectangle from many directions."""
    p = np.array(ring)
    best = None
    for a in {np.arctan2(*(q - o)[::-1]) for o in p for q in p if (o != q).any()}:
        t = p @ np.array([[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]])
        low, high = t.min(0), t.max(0)
        if best is None or np.prod(high - low) < best[0] - 1e-12:
            best = (np.prod(high - low), t, np.array([low, [high[0], low[1]], high, [low[0], high[1]]]))

    def off(nodes, outline):
        ends = np.roll(outline, -1, axis=0)
        many = np.concatenate([a + np.linspace(0, 1, 4001)[:, None] * (b - a) for a, b in zip(outline, ends)])
        return max(np.hypot(*(many - q).T).min() for q in nodes)

    return max(off(best[1], best[2]), off(best[2], best[1]))


def test_outlines_and_their_rectangles(spark):
    rng = np.random.default_rng(6)
    turned = lambda ring, a: [(x * np.cos(a) - y * np.sin(a), x * np.sin(a) + y * np.cos(a)) for x, y in ring]
    rings = [turned([(0, 0), (9, 0), (9, 1), (0, 1)], 0.4), turned([(0, 0), (5, -0.2), (9, 0), (9, 1), (0, 1), (0, 1)], 2.0), turned([(0, 0), (9, 0), (9, 1), (5, 1), (5, 4), (4, 4), (4, 1), (0, 1)], 1.1)]
    rings += [[tuple(p) for p in rng.uniform(0, 5, (n, 2))] for n in (5, 7, 9)]
    rows = [(i, [float(p[0]) for p in r], [float(p[1]) for p in r]) for i, r in enumerate(rings)]
    odd = [(90, [], []), (91, [1.0, 2.0], [1.0, 2.0]), (92, [1.0] * 4, [2.0] * 4), (93, None, [1.0]), (94, [1.0, None, 2.0], [1.0, 4.0, 2.0]), (95, [0.0, 1.0, 2.0], [0.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows + odd, "k int, x array<double>, y array<double>")
    got = {r["k"]: r["r"] for r in df.select("k", runways.rectangle_misfit("x", "y").alias("r")).collect()}
    assert all(got[k]["misfit"] is None and got[k]["area"] is None for k, *_ in odd)
    assert got[0]["area"] == pytest.approx(9) and got[0]["misfit"] == pytest.approx(0, abs=1e-9)
    for i, r in enumerate(rings):
        assert got[i]["misfit"] == pytest.approx(misfit(r), abs=2e-3)


def test_nodes_on_a_line_are_no_outline(spark):
    rows = [(i, [(a + k * d) / 1000 for k in (0, 1, 3, 7)], [(b + k * e) / 1000 for k in (0, 1, 3, 7)]) for i, (a, b, d, e) in enumerate(np.random.default_rng(12).integers(1, 120, (300, 4)).tolist())]
    df = spark.createDataFrame(rows, "k int, x array<double>, y array<double>")
    assert df.select(runways.rectangle_misfit("x", "y").alias("r")).where("r.misfit IS NOT NULL OR r.area IS NOT NULL").isEmpty()


def test_lines_of_few_nodes_are_measured_many_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    lines = [rng.integers(0, 6 if k % 3 else 1000, (2, int(n))) / 1000 for k, n in enumerate(rng.integers(1, 17, 600))]
    lines += [np.array([[0.0, 9, 9, 0], [0, 0, 1, 1]]), np.array([[0.0, np.nan, 1, 2], [0, 1, 4, 2]]), rng.uniform(0, 1, (2, 40))]
    want = [runways._misfit(*line) or (None, None) for line in lines]
    x, y = (pa.array([None, *(line[a].tolist() for line in lines)], pa.list_(pa.float64())) for a in (0, 1))
    slow = runways._misfit

    def seldom(x, y):
        assert len(x) > 16
        return slow(x, y)

    monkeypatch.setattr(runways, "_misfit", seldom)
    monkeypatch.setattr(runways, "AT_ONCE", 500)
    got = [(r["area"], r["misfit"]) for r in runways.rectangle_misfit.func(x, y).slice(1).to_pylist()]
    assert [a is None for a, _ in got] == [a is None for a, _ in want] and sum(a is None for a, _ in got) > 30
    known = [k for k, (a, _) in enumerate(want) if a is not None]
    assert np.allclose([got[k] for k in known], [want[k] for k in known], atol=1e-12)
