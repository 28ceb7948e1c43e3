import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import shapes as S
from tilewright.operators import meshes, outlines, rasters, ways


def rings(spark, shapes):
    points = lambda r: None if r is None else [{"x": x, "y": y} for x, y in r + r[:1]]
    return spark.createDataFrame([(k, points(r), "extra") for k, r in enumerate(shapes)], f"k int, shape {S.POINTS}, _b string")


def test_halves_keep_the_area_and_fit(spark):
    comb = [(0.03 + 0.1 * (i // 2), 0.1 if i % 4 in (0, 3) else 0.93) for i in range(12)]
    shapes = [comb, [(0.0, 0.0), (3.0, 0.1), (2.9, 0.2)], [(0.1, 0.1), (0.2, 0.1), (0.15, 0.2)], None, [], [(0.1, 0.1), (float("nan"), 1.0), (2.0, 2.0)],
              [(0.1, 0.1), (None, 1.0), (2.0, 2.0)], [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)], comb]
    df = rings(spark, shapes)
    out = outlines.halved(df, "shape", 0.3, "k").select("k", "ring", S.signed_area("ring").alias("a")).collect()
    assert {r["k"] for r in out} == {0, 1, 2, 7, 8}
    for r in out:
        for axis in "xy":
            v = [p[axis] for p in r["ring"]]
            assert max(v) - min(v) <= 0.3
        assert r["ring"][0] == r["ring"][-1]
    for k in (0, 1, 2, 7, 8):
        ring = shapes[k] + shapes[k][:1]
        want = sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:])) / 2
        assert sum(r["a"] for r in out if r["k"] == k) == pytest.approx(want, abs=1e-12)
    n = {k: sum(r["k"] == k for r in out) for k in range(9)}
    assert n[2] == 1 and n[7] == 64 and n[0] == n[8] > 1
    assert outlines.halved(df.limit(0), "shape", 0.3, "k").count() == 0
    with pytest.raises(ValueError):
        outlines.halved(df, "shape", 0.0, "k")


def test_numbers_over_ranges(spark):
    rows = [(None if i % 7 == 0 else i % 3, i * 37 % 1000, "r") for i in range(1000)] + [(5, None, "n"), (None, None, "n")]
    df = spark.createDataFrame(rows, "g int, v int, _range string")
    got = ways.numbered(df.withColumnRenamed("_range", "tag").repartition(5), [F.col("v").desc()], "place", "g").collect()
    assert len(got) == len(rows)
    for g in (None, 0, 1, 2, 5):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: r["place"])
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))
        v = [r["v"] for r in own if r["v"] is not None]
        assert v == sorted(v, reverse=True) and own[-1]["v"] == (None if g in (None, 5) else v[-1])
    assert sorted(r["place"] for r in ways.numbered(df, [F.col("v")], "place").collect()) == list(range(1, len(rows) + 1))
    assert ways.numbered(df.limit(0), [F.col("v")], "place").count() == 0


def test_locality_takes_bits_in_turns(spark):
    rng = np.random.default_rng(2)
    at = rng.random((200, 2)).tolist() + [[0.0, 0.0], [0.999999, 0.5], [1.5, -1.0]]
    got = spark.createDataFrame(at, "x double, y double").select("x", "y", meshes.locality_key(F.col("x"), F.col("y")).alias("k")).collect()
    for x, y, k in got:
        a, b = (min(max(int(v * 65536), 0), 65535) for v in (x, y))
        assert k == sum((a >> i & 1) << 2 * i | (b >> i & 1) << 2 * i + 1 for i in range(16))


def test_patches_against_numpy(spark):
    rng = np.random.default_rng(6)
    z = rng.random((30, 25)) * 100
    z[7, 9] = np.nan
    df = spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(30) for c in range(25)], "row long, col long, value double")
    quads = [((0, 0, 9, 6), (1, 2, 11, 1, 12, 14, 2, 13)), ((9, 0, 12, 6), (-3, -3, 20, -3, 20, 20, -3, 20)), ((3, 3, 3, 9), (0, 0, 5, 0, 5, 5, 0, 5))]
    names = ("nw", "sw", "se", "ne")
    rows = [(*box, *[{"row": float(q[2 * i]), "col": float(q[2 * i + 1])} for i in range(4)]) for box, q in quads]
    schema = "r0 long, c0 long, r1 long, c1 long, " + ", ".join(f"{n} struct<row:double,col:double>" for n in names)
    got = {(r["row"], r["col"]): r["value"] for r in rasters.warped(spark.createDataFrame(rows, schema), df).collect()}

    def cubic(t):
        t = abs(t)
        return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else max(0, 2 - t) and -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2

    want = {}
    for (r0, c0, r1, c1), q in quads:
        nw, sw, se, ne = (np.array(q[2 * i : 2 * i + 2], float) for i in range(4))
        for r in range(r0, r1):
            for c in range(c0, c1):
                u, v = (c - c0 + 0.5) / (c1 - c0), (r - r0 + 0.5) / (r1 - r0)
                y, x = (1 - v) * ((1 - u) * nw + u * ne) + v * ((1 - u) * sw + u * se) - 0.5
                i, j = int(np.floor(y)), int(np.floor(x))
                held = lambda a, b: 0 <= a < 30 and 0 <= b < 25 and not np.isnan(z[a, b])
                if held(i, j):
                    want[r, c] = sum(z[(a, b) if held(a, b) else (i, j)] * cubic(y - a) * cubic(x - b) for a in range(i - 1, i + 3) for b in range(j - 1, j + 3))
    assert set(got) == set(want) and 0 < len(want) < 72
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)
