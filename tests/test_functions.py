import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.functions import geodesy as G
from tilewright.functions import names as N
from tilewright.functions import profiles as P
from tilewright.functions import shapes as S
from tilewright.operators import meshes, rasters, rings, spatial, tags, ways


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def line(*points):
    return F.array(*[S.point(F.lit(float(x)), F.lit(float(y))) for x, y in points])


def test_tiles_and_back(spark):
    rng = np.random.default_rng(0)
    places = [(float(a), float(b)) for a, b in zip(rng.uniform(-84, 84, 50), rng.uniform(-179, 179, 50))]
    df = spark.createDataFrame(places, "lat double, lon double")
    x, y = G.tile("lat", "lon", 15)
    px, py = G.pixel("lat", "lon", 15)
    lat, lon = G.pixel_place(px, py, 15)
    for r in df.select("lat", "lon", x.alias("x"), y.alias("y"), G.quadkey(x, y, 15).alias("q"), lat.alias("a"), lon.alias("b")).collect():
        n = 2**15
        ratio = math.log(math.tan((90 + r["lat"]) * math.pi / 360)) / math.pi
        assert (r["x"], r["y"]) == (round((r["lon"] / 180 + 1) * n * 128) // 256, round((1 - ratio) * n * 128) // 256)
        assert r["q"] == "".join(str((r["x"] >> a & 1) + 2 * (r["y"] >> a & 1)) for a in range(14, -1, -1))
        assert abs(r["a"] - r["lat"]) < 1e-4 and abs(r["b"] - r["lon"]) < 1e-4


def test_names(spark):
    lat, lon = N.parse_hemisphere(F.lit("S08W123"))
    r = one(
        spark, a=N.signed_name(F.lit(-7.2), F.lit(-122.1)), b=N.block_name(F.lit(-7.2), F.lit(122.1)), c=N.hemisphere_name(F.lit(-7.2), F.lit(3.0)), lat=lat, lon=lon,
        t=N.parse_texture_name(F.lit("12_34_A_B16.dds")), s=N.readable_size(F.lit(5 * 2**20)), z=N.readable_time(F.lit(3725)), k=N.colour_code(F.lit("L20S-30")),
        h=N.short_text(F.lit("a &amp; " + "x" * 70)),
    )
    assert (r["a"], r["b"], r["c"], r["lat"], r["lon"]) == ("-08-123", "-10+120", "S08E003", -8, -123)
    assert r["t"].asDict() == {"y": 12, "x": 34, "provider": "A_B", "zoom": 16}
    assert (r["s"], r["z"], r["k"].asDict()) == ("5.0M", "1h02m05s", {"light": 20, "contrast": 0, "saturation": -30})
    assert len(r["h"]) == 60 and r["h"].startswith("a & x") and r["h"].endswith("...")


def test_shapes(spark):
    square = line((0, 0), (2, 0), (2, 2), (0, 2), (0, 0))
    r = one(
        spark, area=S.signed_area(square), closed=S.is_closed(square), ccw=S.counter_clockwise(F.reverse(square)), inside=S.winding_contains(square, F.lit(1.0), F.lit(1.0)),
        outside=S.winding_contains(square, F.lit(3.0), F.lit(1.0)), cut=S.signed_area(S.clip(square, 1.0, 1.0, 5.0, 5.0)), none=F.size(S.clip(square, 3.0, 3.0, 5.0, 5.0)),
        fine=F.size(S.refine(line((0, 0), (1, 0)), 30_000.0)), short=F.size(S.refine(line((0, 0)), 1.0)), moved=S.shift(line((0, 0), (0, 1)), F.lit(G.METRES_PER_DEGREE)),
        strip=S.strip(line((0, 0), (0, 1)), F.lit(2 * G.METRES_PER_DEGREE)), d=S.distance_to_segment(F.lit(3.0), F.lit(0.0), *(S.point(F.lit(0.0), F.lit(float(i))) for i in (0, 1))),
        k=S.crossing(*(S.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (2, 2), (0, 2), (2, 0)))),
        apart=S.crossing(*(S.point(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (0, 1), (1, 1)))),
        hexagon=S.regular_ring(F.lit(0.0), F.lit(0.0), 9.0), lone=F.size(S.normals(line((0, 0)))),
    )
    assert (r["area"], r["closed"], r["inside"], r["outside"], r["cut"], r["none"]) == (4.0, True, True, False, 1.0, 0)
    assert r["ccw"][1].x == 2 and r["fine"] == 5 and r["short"] == 1 and r["lone"] == 0 and len(r["hexagon"]) == 7
    assert r["moved"][0].x == pytest.approx(-1, abs=1e-5) and len(r["strip"]) == 5 and r["strip"][0] == r["strip"][4]
    assert r["d"] == pytest.approx(3 * G.METRES_PER_DEGREE) and r["k"].alpha == pytest.approx(0.5) and r["apart"] is None


@pytest.mark.parametrize("place", [0.0, 0.3, 1.0, 1.7, 2.0, 2.2, 3.0, 3.9])
def test_perimeter(spark, place):
    p = S.perimeter_point(F.lit(place))
    assert one(spark, s=S.let(p, lambda q: S.perimeter_place(q["x"], q["y"])))["s"] == pytest.approx(place)


def test_profiles(spark):
    r = one(
        spark, a=P.elevation_ramp(F.lit(0.5), F.lit(0.0), F.lit(10.0), "tanh"), b=P.depth_ratio(F.lit(False), F.lit(0)), c=P.altitude_steps(F.lit(0.5), F.lit(800.0)),
        d=P.levels(F.lit(64), 0, 128), e=P.blend(F.lit(0), F.lit(255), F.lit(128)),
    )
    assert r["a"] == pytest.approx(5.0) and r["b"] == 0.1 and tuple(r["c"]) == (1285, 51) and r["d"] == 128 and r["e"] == 128


def test_tags(spark):
    assert tags.parse('way["natural"="water"];') == ("way", "natural", "water") and tags.parse('rel["x"]') == ("rel", "x", None)
    with pytest.raises(ValueError):
        tags.parse("way natural")
    df = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"b": "3"}), (3, {}), (4, None)], "id long, tags map<string,string>")
    assert [r["id"] for r in tags.select(df, [("way", "a", None), ("way", "b", "3")]).orderBy("id").collect()] == [1, 2]
    members = spark.createDataFrame([(3,), (3,)], "id long")
    got = tags.mark_direct(df.where("tags IS NOT NULL"), members, "id", [("way", "a", None)]).orderBy("id").collect()
    assert [(r["id"], r["direct"]) for r in got] == [(1, True), (3, False)]


def test_spatial_joins_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(zip(rng.uniform(-180, 180, 300), rng.uniform(-80, 80, 300)))]
    boxes = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(zip(rng.uniform(-180, 150, 60), rng.uniform(-80, 60, 60), rng.uniform(0, 30, 60), rng.uniform(0, 20, 60)))]
    p, b = spark.createDataFrame(pts, "id long, lon double, lat double"), spark.createDataFrame(boxes, "box long, x0 double, y0 double, x1 double, y1 double")
    got = {(r["id"], r["box"]) for r in spatial.points_in_boxes(p, b, 7.0).collect()}
    assert got == {(i, k) for i, x, y in pts for k, x0, y0, x1, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1}
    pairs = spatial.overlapping_boxes(b, "box", 7.0).collect()
    want = {(i[0], j[0]) for i in boxes for j in boxes if i[0] < j[0] and i[1] <= j[3] and j[1] <= i[3] and i[2] <= j[4] and j[2] <= i[4]}
    assert {(r["a"], r["b"]) for r in pairs} == want and len(pairs) == len(want)
    anchors = p.where("id % 10 = 0").select(F.col("id").alias("anchor"), "lon", "lat")
    near = {r["id"]: r["anchor"] for r in spatial.nearest_within(p, anchors, "id", "anchor", 2_000_000.0, 5.0).collect()}

    def far(a, b):
        h = math.sin(math.radians(a[2] - b[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(a[1] - b[1]) / 2) ** 2
        return 2 * G.EARTH_RADIUS * math.asin(math.sqrt(h))

    for q in pts:
        d, a = min((far(q, a), a[0]) for a in pts if a[0] % 10 == 0)
        assert near[q[0]] == (a if d < 2_000_000 else None)


def test_rasters_against_numpy(spark):
    rng = np.random.default_rng(5)
    z = rng.uniform(0, 100, (12, 9))
    z[3:5, 4] = np.nan
    rows = [(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(12) for c in range(9)]
    df = spark.createDataFrame(rows, "row long, col int, value double")
    k = np.array([1.0, 2.0, 3.0, 2.0, 1.0])
    v, w = np.nan_to_num(z), (~np.isnan(z)).astype(float)
    for axis in (1, 0):
        v, w = (np.apply_along_axis(lambda a: np.convolve(a, k)[2:-2], axis, m) for m in (v, w))
    for r in rasters.smooth(df, 2).collect():
        assert r["value"] == pytest.approx((v / w)[r["row"], r["col"]])
    full = {(r["row"], r["col"]): r["value"] for r in rasters.fill(df, 2).collect()}
    assert len(full) == 108 and all(x is not None for x in full.values())
    pts = spark.createDataFrame([(0, 2.0, 1.0), (1, 2.25, 1.5), (2, 2.5, 1.25), (3, 8.0, 11.0), (4, 8.5, 11.0)], "id long, x double, y double")
    got = {r["id"]: r["value"] for r in rasters.sample(pts, df, "id", F.col("x"), F.col("y")).collect()}
    assert got[0] == pytest.approx(z[1, 2]) and got[3] == pytest.approx(z[11, 8]) and got[4] is None
    assert got[1] == pytest.approx(0.5 * z[1, 2] + 0.25 * z[2, 3] + 0.25 * z[2, 2])


def test_recut_keeps_area(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(rng.integers(0, 3)), *map(float, rng.integers(0, 4, 6))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, kind int, " + ", ".join(f"{c}{i} double" for i in (1, 2, 3) for c in "xy"))
    parts = meshes.recut(df, ["id"]).groupBy("id").agg(F.sum(meshes.area()).alias("a"), F.max("cuts").alias("cuts"))
    before = {r["id"]: r["a"] for r in df.select("id", meshes.area().alias("a")).collect()}
    got = parts.collect()
    assert {r["id"] for r in got} == set(before) and max(r["cuts"] for r in got) > 1
    assert all(r["a"] == pytest.approx(before[r["id"]]) for r in got)


def test_rings(spark):
    rows = [(1, 0, [1, 2, 3]), (1, 1, [5, 3]), (1, 2, [5, 1]), (1, 3, [8, 9, 8]), (2, 0, [1, 2]), (2, 1, [2, 3])]
    got = rings.assemble(spark.createDataFrame(rows, "rel long, fragment int, nodes array<bigint>"), "rel").orderBy("ring").collect()
    assert [(r["rel"], r["nodes"]) for r in got] == [(1, [1, 2, 3, 5, 1]), (1, [8, 9, 8])]


def test_smallest_rectangle(spark):
    turn = np.array([[math.cos(0.3), math.sin(0.3)], [-math.sin(0.3), math.cos(0.3)]])
    p = np.array([[0, 0], [4, 0], [4, 1], [0, 1], [2, 0.5]]) @ turn
    df = spark.createDataFrame([(p[:, 0].tolist(), p[:, 1].tolist()), ([1.0], [1.0])], "x array<double>, y array<double>")
    a, b = [r["r"] for r in df.select(rings.smallest_rectangle("x", "y").alias("r")).collect()]
    assert (a["area"], a["length"], a["width"]) == pytest.approx((4, 4, 1)) and b["area"] == 0


def test_running_total(spark):
    df = spark.createDataFrame([(i * 7 % 1000, float(i % 5)) for i in range(1000)], "id long, v double")
    got = [r["t"] for r in ways.running_total(df, "id", F.col("v"), "t", block=16).orderBy("id").collect()]
    v = [x for _, x in sorted((i * 7 % 1000, float(i % 5)) for i in range(1000))]
    assert got == [sum(v[:i]) for i in range(1000)]


def test_sizes_over_the_last_unit(spark):
    row = spark.range(1).select(
        N.readable_size(F.lit(1050 * 2**30), "KMG").alias("a"), N.readable_size(F.lit(1024 * 2**30)).alias("b"), N.readable_size(F.lit(5000), "").alias("c")
    ).first()
    assert tuple(row) == ("1050.0G", "1.0T", "5000.0")
