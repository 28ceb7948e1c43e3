import numpy as np
import pytest

from tilewright.functions import shapes as S
from tilewright.operators import coast


def points(line):
    return [{"x": float(x), "y": float(y)} for x, y in line]


def area(ring):
    x, y = (np.array([p[c] for p in ring]) for c in "xy")
    return abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def test_runways_are_found_again_in_their_parts(spark):
    """Random runways with slight bends, cut into parts that are turned and mixed; at each end one that goes off sharply stays apart."""
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for airport in range(30):
        parts = []
        for k in range(rng.integers(1, 4)):
            angle, line = rng.uniform(0, 2 * np.pi), [rng.random(2) + 10 * k]
            for _ in range(rng.integers(2, 9)):
                angle += rng.uniform(-0.19, 0.19)
                line.append(line[-1] + rng.uniform(0.5, 1) * np.array([np.cos(angle), np.sin(angle)]))
            cuts = sorted({0, len(line) - 1, *rng.integers(1, len(line) - 1, rng.integers(0, 4)).tolist()} if len(line) > 2 else {0, len(line) - 1})
            off = angle + rng.uniform(0.5, 2.5)
            aside = [line[-1], line[-1] + np.array([np.cos(off), np.sin(off)])]
            pieces = [line[a : b + 1] for a, b in zip(cuts, cuts[1:])] + [aside]
            want.setdefault(airport, []).extend([line, aside])
            parts += [p if rng.random() < 0.5 else p[::-1] for p in pieces]
        rng.shuffle(order := list(range(len(parts))))
        rows += [(airport, i, points(parts[j])) for i, j in enumerate(order)]
    df = spark.createDataFrame(rows, f"airport int, part int, points {S.POINTS}")
    got = {}
    for r in coast.runways(df, "airport").collect():
        line = tuple((p["x"], p["y"]) for p in r["points"])
        got.setdefault(r["airport"], []).append(min(line, line[::-1]))
    for airport, lines in want.items():
        shapes = [tuple((float(x), float(y)) for x, y in line) for line in lines]
        assert sorted(got[airport]) == sorted(min(s, s[::-1]) for s in shapes)


def test_land_between_random_coasts(spark):
    """Coasts across a tile in turns of direction, land on their right hand: the land's area is the sum of the strips between them."""
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for tile in range(25):
        n = int(rng.integers(1, 5))
        base = np.sort(rng.choice(np.arange(1, 9), n, replace=False)) / 9
        heights, total = [], 0.0
        for i in range(n):
            x = np.r_[0.0, np.sort(rng.random(int(rng.integers(0, 6)))), 1.0]
            y = base[i] + rng.uniform(-0.04, 0.04, len(x))
            line = np.column_stack([x, y])
            rows.append((tile, i, points(line if i % 2 == 0 else line[::-1])))
            heights.append(np.trapezoid(y, x))
        # below the first coast, then above each second one up to the next
        total = heights[0] + sum((heights[i + 1] if i + 1 < n else 1.0) - heights[i] for i in range(1, n, 2))
        want[tile] = total
    island = [(0.45, 0.002), (0.45, 0.004), (0.47, 0.004), (0.45, 0.002)]
    rows.append((99, 0, points(island)))
    want[99] = area([{"x": x, "y": y} for x, y in island])
    rows.append((100, 0, points([(0.0, 0.5), (0.5, 0.5)])))  # broken: it ends inside
    got = {}
    for r in coast.coast_polygons(spark.createDataFrame(rows, f"tile int, chain int, points {S.POINTS}"), "tile").collect():
        got[r["tile"]] = got.get(r["tile"], 0.0) + area(r["points"])
    assert set(got) == set(want)
    for tile, size in want.items():
        assert got[tile] == pytest.approx(size, abs=1e-9)
