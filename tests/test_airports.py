import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.operators import airports

AREA = "id long, row long, col long, weight double, pix int, note string"


def smoothed_one_by_one(z, areas):
    """Areas in the order of their ids, cell by cell."""
    z = dict(z)
    for i in sorted({a[0] for a in areas}):
        cells = {}
        for _, r, c, w, _, _ in (a for a in areas if a[0] == i):
            if z.get((r, c)) is not None:
                cells[r, c] = max(w, cells.get((r, c), 0))
        pix = max(a[4] or 0 for a in areas if a[0] == i)
        new = {}
        for (r, c), w in cells.items() if pix else ():
            near = [((pix + 1 - abs(r - a)) * (pix + 1 - abs(c - b)) * v, z[a, b]) for (a, b), v in cells.items() if abs(r - a) <= pix and abs(c - b) <= pix]
            new[r, c] = w * sum(k * v for k, v in near) / sum(k for k, _ in near) + (1 - w) * z[r, c]
        z |= new
    return z


def test_areas_in_order_over_blocks(spark):
    rng = np.random.default_rng(4)
    z = {(r, c): None if rng.random() < 0.03 else float(rng.integers(0, 500)) for r in range(40) for c in range(30) if rng.random() > 0.03}
    areas = []
    for i in (7, 2, 30, 11, 5, 1):  # one after the other down a chain, one apart, one over several blocks
        r0, c0, n = {1: (0, 0, 6), 2: (4, 4, 6), 5: (8, 7, 5), 7: (11, 9, 9), 11: (25, 2, 4), 30: (2, 2, 26)}[i]
        areas += [(i, r, c, float(rng.choice([0.25, 0.5, 1.0])), i % 3 + 1, "x") for r in range(r0, r0 + n) for c in range(c0, c0 + n)]
    areas += [areas[0], (*areas[1][:3], 0.1, 1, None)]
    want = smoothed_one_by_one(z, areas)
    odd = [(None, 1, 1, 1.0, 2, ""), (50, 1, 1, None, 2, ""), (51, None, 1, 1.0, 2, ""), (52, 3, 3, 1.0, None, ""), (53, 3, 3, 1.0, 0, ""), (54, 3, 3, 0.0, 1, ""), (55, 900, 3, 1.0, 1, "")]
    raster = spark.createDataFrame([(r, c, v, "id") for (r, c), v in z.items()], "row long, col long, value double, following string")
    df = spark.createDataFrame(areas + odd, AREA)
    for size in (7, 256):
        got = {(r["row"], r["col"]): r["value"] for r in airports.smoothed_in_order(raster, df, size).collect()}
        inside = {(r, c) for _, r, c, *_ in areas if z.get((r, c)) is not None}
        assert set(got) == inside
        for k in inside:
            assert got[k] == pytest.approx(want[k], abs=1e-9)
    assert airports.smoothed_in_order(raster, df.limit(0)).count() == 0
    assert airports.smoothed_in_order(raster.limit(0), df).count() == 0


def test_levels_are_longest_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 9), (4, 9)], "a long, b long")
    levels, rounds = airports._levels(edges, spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 9, 12)], "id long"))
    assert {tuple(r) for r in levels.collect()} == {(1, 0), (2, 1), (3, 2), (4, 0), (9, 3), (12, 0)} and rounds == 4


def test_share_of_cells_in_rings(spark):
    rng = np.random.default_rng(8)
    rings = {i: [(float(r), float(c)) for r, c in rng.uniform(-4, 9, (n, 2))] for i, n in enumerate((3, 4, 7, 9, 5))}
    rings[2].append(rings[2][0])
    rows = [(i, [{"row": r, "col": c} for r, c in ring]) for i, ring in rings.items()]
    rows += [(20, None), (21, []), (22, [{"row": 1.0, "col": None}] * 4), (23, [{"row": 1.0, "col": 1.0}] * 2)]
    df = spark.createDataFrame(rows, "k long, ring array<struct<row double, col double>>")
    got = {(r["id"], r["row"], r["col"]): r["weight"] for r in airports.coverage(df, "k", 3).collect()}
    want = {}
    for i, ring in rings.items():
        for r in range(-13, 28):
            for c in range(-13, 28):
                y, x, inside = (r + 0.5) / 3, (c + 0.5) / 3, False
                for (r0, c0), (r1, c1) in zip(ring, ring[1:] + ring[:1]):
                    inside ^= (r0 <= y) != (r1 <= y) and x < c0 + (y - r0) / (r1 - r0) * (c1 - c0)
                if inside:
                    k = (i, r // 3, c // 3)
                    want[k] = want.get(k, 0) + 1 / 9
    assert got == pytest.approx(want)


def test_sides_keep_their_values(spark):
    raster = spark.createDataFrame([(r, c, None if (r, c) == (4, 4) else 10.0) for r in range(9) for c in range(9)], "row long, col long, value double")
    patch = spark.createDataFrame([(r, c, 20.0) for r in range(9) for c in range(9)], "row long, col long, value double")
    lit = F.lit
    got = {(r["row"], r["col"]): r["value"] for r in airports.blended_at_sides(raster, patch, lit(0), lit(0), lit(8), lit(8), lit(2)).collect()}
    near = lambda i: min(1, i / 2, (8 - i) / 2)
    assert all(v == pytest.approx(10 + 10 * near(r) * near(c)) for (r, c), v in got.items() if (r, c) != (4, 4)) and got[4, 4] is None
    assert {r["value"] for r in airports.blended_at_sides(raster.where("value > 0"), patch, lit(0), lit(0), lit(8), lit(8), lit(0)).collect()} == {20.0}
