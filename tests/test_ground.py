import numpy as np
from pyspark.sql import functions as F

from tilewright.operators import rasters
from tilewright.sources import elevation


def test_distances_across_blocks(spark):
    rng = np.random.default_rng(3)
    water = rng.random((40, 70)) < 0.01
    rows = [(r, c, float(water[r, c])) for r in range(40) for c in range(70) if (r, c) != (5, 5)] + [(0, 0, None), (0, 0, None)]
    df = spark.createDataFrame(rows, "row long, col long, value double")
    for band, size in ((7, 16), (3, 256)):
        before, rasters.in_blocks.__defaults__ = rasters.in_blocks.__defaults__, (size,)
        try:
            got = {(r["row"], r["col"]): r["distance"] for r in rasters.distances(df, F.col("value") > 0, band).collect()}
        finally:
            rasters.in_blocks.__defaults__ = before
        at = np.argwhere(water & ~((np.arange(40)[:, None] == 5) & (np.arange(70) == 5)))
        for r in range(40):
            for c in range(70):
                if (r, c) != (5, 5):
                    want = min(band, np.sqrt(((at - [r, c]) ** 2).sum(1)).min())
                    assert abs(got[r, c] - want) < 1e-12
        assert len(got) == 40 * 70 - 1
    assert rasters.distances(df.limit(0), F.col("value") > 0, 3).count() == 0


def test_layers_in_order_and_between_cells(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, None), (2, 2, 5.0), (2, 2, 4.0)], "row long, col long, value double")
    b = spark.createDataFrame([(0, 0, 9.0), (0, 1, 3.0), (1, 0, 5.0), (1, 1, None)], "row long, col long, value double")
    assert {tuple(r) for r in rasters.composed(a, b).collect()} == {(0, 0, 1.0), (0, 1, 3.0), (1, 0, 5.0), (2, 2, 4.0)}
    up = {(r["row"], r["col"]): r["value"] for r in rasters.upsampled(b, 2).collect()}
    assert up == {(0, 0): 9.0, (0, 1): 6.0, (0, 2): 3.0, (1, 0): 7.0, (2, 0): 5.0}


def test_files_outside_a_box_are_not_opened(spark, tmp_path):
    cells = [(lat, lon, r, c, float(10 * lat + r - c)) for lat, lon in ((47, 6), (-3, -60)) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    files = elevation.packed(spark.createDataFrame(cells, "lat int, lon int, row int, col int, value double"), 3).collect()
    for f in files:
        (tmp_path / f["path"]).write_bytes(f["content"])
    (tmp_path / "N00E000.hgt").write_bytes(b"123")  # would fail
    got = elevation.read(spark, str(tmp_path), (5, 47, 6, 48)).collect()
    assert {tuple(r) for r in got if r["value"] is not None} == {(47, 6, 3, r, c, v) for lat, lon, r, c, v in cells if lat == 47} and len(got) == 9
    assert elevation.decoded(spark.createDataFrame(files), (-60, -3, -60, -3)).count() == 9
