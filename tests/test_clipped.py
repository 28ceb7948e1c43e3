import numpy as np

from tilewright.functions import shapes as S
from tilewright.operators import rings
from tilewright.sources import texts


def test_rings_clipped_at_once_as_one_by_one(spark):
    rng = np.random.default_rng(11)
    made = [rng.integers(0, 9, (n, 2)) / 8 for n in (3, 4, 5, 8, 40) for _ in range(20)]
    rows = [(i, [(float(x), float(y)) for x, y in [*r, r[0]]]) for i, r in enumerate(made)] + [(900, []), (901, [(5.0, 5.0)] * 4)]
    df = spark.createDataFrame(rows, f"k int, ring {S.POINTS}")
    got = df.select("k", rings.clipped("ring", 0.25, 0.125, 0.75, 0.9).alias("r")).collect()
    want = df.select("k", S.clip("ring", 0.25, 0.125, 0.75, 0.9).alias("r")).collect()
    assert sorted(got) == sorted(want) and any(r["r"] for r in got) and not all(r["r"] for r in got)
    assert df.limit(0).select(rings.clipped("ring", 0, 0, 1, 1)).isEmpty()


def test_sections_of_many_names_in_a_file(spark, tmp_path):
    (tmp_path / "a.txt").write_text("lost=1\n[one]\n# no\nzoom=3\nzoom=4\n[two]\n[three]\n" + "\n" * 140_000 + "late = x=y\n")
    (tmp_path / "b.txt").write_text("[four]\nzoom=9\n")
    got = {r["name"]: r["entries"] for r in texts.sectioned(spark, str(tmp_path)).collect()}
    assert got == {"one": {"zoom": "4"}, "two": {}, "three": {"late": "x=y"}, "four": {"zoom": "9"}}


def test_warped_places_are_not_sent_to_the_driver(spark, sf_dir):
    from tilewright.registry import QUERIES

    plan = QUERIES["warped_raster"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan
