import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from tilewright import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return v + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.sql(registry.SQL[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in found.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_raster_tiles_use_all_rows(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0]) for i in (0, 1000, 1024, 1028, 1027, 5000)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r["tr"], r["tc"]): r["cells"] for r in registry.QUERIES["raster_tiles"](spark, str(tmp_path)).collect()}
    want = Counter((tr, tc) for i, v in rows for j in range(len(v)) for tr in range((i - 4) // 32, (i + 4) // 32 + 1) for tc in range((j - 4) // 32, (j + 4) // 32 + 1))
    assert got == want and max(got)[0] == 5000 // 32


def within(ring, x0, x1):
    """The area of a ring in a square, by winding: its fan of triangles, each clipped from its corners and crossings."""
    total, square = 0.0, [(x0, x0), (x1, x0), (x1, x1), (x0, x1)]
    cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    for b, c in zip(ring[1:], ring[2:]):
        t = [ring[0], b, c]
        sign = cross(*t)
        if sign == 0:
            continue
        t = t if sign > 0 else t[::-1]
        inside = lambda p, shape: all(cross(q, r, p) >= 0 for q, r in zip(shape, shape[1:] + shape[:1]))
        found = [p for p in t if inside(p, square)] + [p for p in square if inside(p, t)]
        for p, q in zip(t, t[1:] + t[:1]):
            for r, s in zip(square, square[1:] + square[:1]):
                u, v = cross(r, s, p), cross(r, s, q)
                if u * v < 0 and cross(p, q, r) * cross(p, q, s) <= 0:
                    found.append((p[0] + u / (u - v) * (q[0] - p[0]), p[1] + u / (u - v) * (q[1] - p[1])))
        if len(found) > 2:
            mx, my = sum(p[0] for p in found) / len(found), sum(p[1] for p in found) / len(found)
            found.sort(key=lambda p: math.atan2(p[1] - my, p[0] - mx))
            total += math.copysign(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(found, found[1:] + found[:1])) / 2, sign)
    return abs(total)


def test_clipped_rings_against_brute_force(spark):
    from tilewright.plans.fixtures import way_nodes

    nodes = {}
    for r in way_nodes(spark, SF).select("way", "pos", "x", "y").orderBy("way", "pos").collect():
        nodes.setdefault(r["way"], []).append((r["x"], r["y"]))
    got = {r["way"]: r for r in registry.QUERIES["clipped_rings"](spark, SF).collect()}
    assert set(got) == {w for w, p in nodes.items() if len(p) > 2} and max(len(nodes[w]) for w in got) > 5
    for w, r in got.items():
        assert r["area"] == pytest.approx(within(nodes[w], 0.25, 0.75), abs=2e-9), nodes[w]
        assert r["nodes"] > 3 or r["area"] == 0


def test_long_concave_and_crossing_rings_are_clipped(spark):
    from pyspark.sql import functions as F

    from tilewright.functions import shapes as S

    comb = [(0.3 + 0.1 * (i // 2), 0.1 if i % 4 in (0, 3) else 0.9) for i in range(12)]
    rings = [comb, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.4), (0.0, 1.0)], [(0.3, 0.3), (0.9, 0.9), (0.9, 0.3), (0.3, 0.7)],
             [(0.5 + 0.4 * math.cos(i * 4 * math.pi / 5), 0.5 + 0.4 * math.sin(i * 4 * math.pi / 5)) for i in range(5)],
             [(0.0, 0.0), (0.2, 0.0), (0.2, 0.2), (0.1, 0.05)], [(0.25, 0.25), (0.75, 0.25), (0.75, 0.75), (0.25, 0.75)]]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in r + r[:1]]) for k, r in enumerate(rings)], f"k int, ring {S.POINTS}")
    cut = df.select("k", S.clip("ring", 0.25, 0.25, 0.75, 0.75).alias("ring"))
    got = {r["k"]: r["area"] for r in cut.select("k", F.abs(S.signed_area("ring")).alias("area")).collect()}
    assert got == {k: pytest.approx(within(r, 0.25, 0.75), abs=1e-12) for k, r in enumerate(rings)}


def test_entry_works_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/tilewright", f"{tmp_path}/tilewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'texture_cells' in e.queries() and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_profiles_against_numpy(spark):
    import numpy as np

    from tilewright.plans.fixtures import way_nodes

    by = {}
    for r in way_nodes(spark, SF).collect():
        by.setdefault(r["way"], {})[r["pos"]] = r["z"]
    got = {r["way"]: r["middle"] for r in registry.QUERIES["way_profiles"](spark, SF).collect()}
    assert set(got) == set(by)
    for way, z in by.items():
        n = len(z)
        t = np.array([i / (n - 1) if n > 1 else 0.0 for i in range(n)])
        terms = np.vander(t, min(7, n - 1) + 1)
        fit = np.linalg.lstsq(terms, np.array([z[i + 1] for i in range(n)]), rcond=None)[0]
        assert got[way] == pytest.approx(np.vander([0.5], len(fit)) @ fit, abs=1e-3)


def test_rasters_fill_twenty_passes_over_blocks_and_refuse(spark, monkeypatch):
    import numpy as np

    from tilewright.operators import rasters

    rng = np.random.default_rng(1)
    z = np.where(rng.random((70, 50)) < 0.02, rng.integers(0, 99, (70, 50)), np.nan)
    df = spark.createDataFrame([(r, c, None if np.isnan(z[r, c]) else float(z[r, c])) for r in range(70) for c in range(50)], "row int, col int, value double")
    want = z.copy()
    for _ in range(20):
        p = np.pad(want, 1, constant_values=np.nan)
        near = np.fmax(np.fmax(p[:-2, 1:-1], p[2:, 1:-1]), np.fmax(p[1:-1, :-2], p[1:-1, 2:]))
        want = np.where(np.isnan(want), near, want)
    for size in (16, 256):
        monkeypatch.setattr(rasters.in_blocks, "__defaults__", (size,))
        got = np.full((70, 50), np.nan)
        for r in rasters.fill(df, 20).collect():
            got[r["row"], r["col"]] = np.nan if r["value"] is None else r["value"]
        assert np.array_equal(got, want, equal_nan=True)
    with pytest.raises(ValueError):
        rasters.fill(df, 20, most=1000)


def test_a_cluster_needs_a_shared_folder(spark):
    from tilewright import session

    class Conf:
        def get(self, *_):
            return None

    class Context:
        def __init__(self, master):
            self.master = master

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return "set"

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = Context(master)

    assert session.scratch_dir(Session("local[4]")) == "/tmp/checkpoints"
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        with pytest.raises(RuntimeError):
            session.scratch_dir(Session(master))
