import numpy as np
import pytest

from tilewright.operators import coast, images


def ring_area(r):
    x, y = r[:, 0], r[:, 1]
    return abs((x[:-1] * y[1:] - x[1:] * y[:-1]).sum()) / 2


def test_coast_from_side_to_side():
    left = coast.stitch([np.array([(0.25, 0.0), (0.25, 1.0)])])
    right = coast.stitch([np.array([(0.25, 1.0), (0.25, 0.0)])])
    assert [ring_area(r) for r in left] == pytest.approx([0.75]) and [ring_area(r) for r in right] == pytest.approx([0.25])
    both = coast.stitch([np.array([(0.25, 0.0), (0.25, 1.0)]), np.array([(0.75, 1.0), (0.75, 0.0)])])
    assert [ring_area(r) for r in both] == pytest.approx([0.5])
    island = np.array([(0.4, 0.4), (0.6, 0.4), (0.6, 0.6), (0.4, 0.4)])
    assert len(coast.stitch([island, np.array([(0.25, 0.0), (0.25, 1.0)])])) == 2 and coast.stitch([]) == []


def test_coast_in_spark(spark):
    p = lambda *c: [{"x": float(x), "y": float(y)} for x, y in c]
    rows = [(1, 0, p((0.25, 0), (0.25, 1))), (2, 0, p((0, 0.5), (1, 0.5))), (2, 1, p((0.2, 0.2), (0.3, 0.2), (0.3, 0.3), (0.2, 0.2)))]
    df = spark.createDataFrame(rows, "tile int, chain int, points array<struct<x:double,y:double>>")
    got = {(r["tile"], r["ring"]): ring_area(np.array([(q.x, q.y) for q in r["points"]])) for r in coast.coast_polygons(df, "tile").collect()}
    assert got == {(1, 0): pytest.approx(0.75), (2, 0): pytest.approx(0.005), (2, 1): pytest.approx(0.5)}


def test_runway_parts(spark):
    a, b, c = np.array([(0, 0), (1, 0)]), np.array([(2, 0.05), (1, 0)]), np.array([(2, 0.05), (2, 2)])
    found = coast.merge_parts([a, b, c])
    assert sorted(len(x) for x in found) == [2, 3]
    p = lambda m: [{"x": float(x), "y": float(y)} for x, y in m]
    df = spark.createDataFrame([("A", 0, p(a)), ("A", 1, p(b)), ("B", 0, p(c))], "airport string, part int, points array<struct<x:double,y:double>>")
    assert sorted((r["airport"], len(r["points"])) for r in coast.runways(df, "airport").collect()) == [("A", 3), ("B", 2)]


def test_images():
    mask = np.zeros((20, 20))
    mask[:, 10:] = 255
    for mode in ("sand", "rocks", "steps"):
        soft = images.shore(mask, 3, mode)
        assert (soft[:, 10:] == 255).all() and (soft[5:15, :5] == 0).all()
    assert 0 < images.shore(mask, 3)[10, 9] < 255
    with pytest.raises(ValueError):
        images.shore(mask, 3, "mud")
    t = np.array([[(0, 0), (10, 0), (0, 10)]], float)
    assert images.rasterise(t, 12).sum() == pytest.approx(50, abs=6) and not images.rasterise(t, 12)[11, 11]
    z = np.add.outer(np.arange(5.0), 2 * np.arange(5.0))
    assert images.three_times(z) == pytest.approx(np.add.outer(np.arange(13) / 3, 2 * np.arange(13) / 3))
    flat = images.smooth_within(z, np.ones_like(z), 1)
    assert flat[2, 2] == pytest.approx(z[2, 2]) and (flat[0] == z[0]).all() and (images.smooth_within(z, np.zeros_like(z), 2) == z).all()
