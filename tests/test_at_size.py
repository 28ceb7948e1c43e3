"""What tasks hold and interpret: the same results in numpy, and more tasks for larger tables."""

import numpy as np

from tilewright import session
from tilewright.operators import rings
from tilewright.operators.images import blur, shore, triangular
from tilewright.plans import areas, fixtures, lines, meshwork, shaping
from tilewright.sources import osm


def test_tasks_grow_with_the_table(spark, sf_dir, monkeypatch):
    """The number of tasks was the session's, however large the table."""
    before = sorted(map(tuple, lines.QUERIES["edge_flags"](spark, sf_dir).collect()))
    monkeypatch.setattr(session, "SHARE", 1 << 12)
    assert fixtures.way_nodes(spark, sf_dir).rdd.getNumPartitions() > 8
    found = lines.QUERIES["edge_flags"](spark, sf_dir)
    assert found.rdd.getNumPartitions() > 8
    assert sorted(map(tuple, found.collect())) == before


def test_files_in_order_of_more_tasks_for_larger_tables(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(session, "SHARE", 1 << 12)
    rows = fixtures.way_nodes(spark, sf_dir).selectExpr("way * 100 + pos AS id", "x AS lon", "y AS lat")
    assert osm._in_order(rows).rdd.getNumPartitions() > 8 and osm.merged_nodes(rows).count() == rows.count()


def test_corners_are_made_once(spark, sf_dir):
    plan = meshwork.QUERIES["levelled_water"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_tile_pieces_shuffle_no_pieces(spark, sf_dir):
    plan = areas.QUERIES["tile_pieces"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_halving_is_not_interpreted(spark, sf_dir):
    plan = shaping.QUERIES["halved_polygons"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Generate") == 1 and "ArrowEvalPython" in plan


def test_rectangles_of_few_points_are_as_of_many(spark, monkeypatch):
    rng = np.random.default_rng(2)
    made = [rng.integers(0, 9, (int(n), 2)) / 10 for n in rng.integers(1, 9, 60)]
    made += [np.array([[0.1, 0.1]] * 4), np.array([[0.0, 0.0], [0.2, 0.2], [0.4, 0.4]]), np.array([[0, 0], [1, 0], [1, 1], [0, 1]])]
    few = np.array([rings._rectangles(p[None, :, 0].astype(float), p[None, :, 1].astype(float))[0] if len(p) > 1 else np.zeros(4) for p in made])
    many = np.array([rings._rectangle(p.astype(float)) for p in made])
    assert np.allclose(few[:, [0, 2, 3]], many[:, [0, 2, 3]], atol=1e-9)
    df = spark.createDataFrame([(i, p[:, 0].astype(float).tolist(), p[:, 1].astype(float).tolist()) for i, p in enumerate(made)], "i int, x array<double>, y array<double>")
    out = df.select("i", rings.smallest_rectangle("x", "y").alias("r")).orderBy("i").select("r.*").collect()
    assert np.allclose(np.array(out), few)


def test_masks_are_blurred_many_at_once():
    masks = np.random.default_rng(1).integers(0, 2, (5, 12, 9)) * 255
    assert np.array_equal(shore(masks, 3), np.stack([shore(m, 3) for m in masks]))
    one, k = np.zeros((7, 7)), triangular(2)
    one[3, 3] = 1
    assert np.allclose(blur(one, k)[1:6, 1:6], np.outer(k, k))
