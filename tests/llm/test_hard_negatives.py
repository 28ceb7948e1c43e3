from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import hard_negatives as m

SCHEMA = "vec_id long, embedding array<float>, label int, size string, ids int"


def slow(rows):
    """Every anchor against every row, in whole numbers of any size."""
    good = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * np.float64(np.float32(x)))) for x in v]))
    out = []
    for i, label, v in good:
        if i % 100:
            continue
        score = [(-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in good if j != i and len(w) == len(v)]
        for ps, j, _ in sorted(x[:3] for x in score if x[2] == label)[:5]:
            fit = sorted(x[:2] for x in score if x[2] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps)[:10]
            out += [(i, j, rank, k, -ps, -ns) for rank, (ns, k) in enumerate(fit, 1)]
    return Counter(out)


def got(spark, rows, **sizes):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    moved = df.withColumn("label", F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"))
    return Counter(tuple(r) for r in m.mine(m.scaled(moved), F.col("vec_id") % 100 == 0, **sizes).collect())


def test_query_and_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    df = m.query(spark, sf_dir)
    want = Counter(con.sql(f"SELECT {', '.join(df.columns)} FROM ({m.SQL})").fetchall())
    assert Counter(tuple(r) for r in df.collect()) == want and len(want) > 100


@pytest.mark.parametrize("sizes", [{"chunk": 40, "block": 3, "sample": 20}, {}])
def test_clusters_ties_and_repeats(spark, sizes):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(6, 5))
    rows = [(i * 20, (centre[i % 6] + 0.05 * rng.normal(size=5)).tolist(), int(i % 3)) for i in range(400)]
    rows += [(i, [0.5, 0.25, 0.0, 0.0, -0.5], i % 4) for i in range(1, 300, 3)]  # equal vectors
    rows += [rows[0], rows[5], (700, [0.0] * 5, 1), (800, [0.5, 0.5], 1), (900, [], 1), (903, [], 2)]
    found = got(spark, rows, **sizes)
    assert found == slow(rows) and len(found) > 300


def test_edge_cases(spark):
    big = float(np.float32(2e6))  # products beyond the whole numbers of doubles
    rows = [(100, [1.0, 2.0], 1), (101, [1.0, 2.0], 1), (102, [1.0, None], 1), (103, [float("nan"), 1.0], 2), (104, None, 2), (None, [1.0, 1.0], 2), (105, [0.5, 1.0], None)]
    rows += [(106, [0.5, 1.0], 3), (107, [0.9, 1.5], 9), (200, [-0.5, -1.0], 1), (201, [0.7, 0.9], 1), (400, [big], 1), (401, [big / 2], 1), (402, [big / 4], 2)]
    assert got(spark, rows) == slow(rows)
    assert got(spark, rows[:1]) == got(spark, []) == Counter()


def test_products_are_exact():
    a = np.array([[2.0**40 + 1, -3.0]])
    assert m.products(a, np.array([[2.0**20 + 1, 5.0]])).tolist() == [[(2**40 + 1) * (2**20 + 1) - 15]]
    assert m.products(a * 2**20, a * 2**20).tolist() == [[2**63 - 1]]


def test_descent_skips_what_is_outside_and_bounds_hold():
    rng = np.random.default_rng(1)
    centre = 2000 * rng.normal(size=(20, 8))
    x = np.floor(centre[rng.integers(0, 20, 3000)] + 40 * rng.normal(size=(3000, 8)))
    most = float(np.sqrt((x * x).sum(1)).max())
    nodes, pages, order = m.cover_tree(x, most)
    assert sorted(order.tolist()) == list(range(3000)) and len(nodes) > 10
    y = m.augmented(x, most)
    for number, first, last, near, far in pages:  # a page lies within its annulus and in the radius of each node above
        rows, node = order[int(first) : int(last)], int(number)
        away = np.sqrt(((y[rows] - y[int(nodes[node, 0])]) ** 2).sum(1))
        assert away.min() == near and away.max() == far
        while node >= 0:
            assert (np.sqrt(((y[rows] - y[int(nodes[node, 0])]) ** 2).sum(1)) <= nodes[node, 1] * (1 + 1e-12)).all()
            node = int(nodes[node, 2])
    ids = np.arange(3000)
    tree = {"ids": ids, "x": x, "nodes": nodes, "pages": pages, "order": order}
    q = x[:50]
    score = m.products(q, x)
    for low, high in ((np.full(50, -(1 << 62)), np.full(50, 1 << 62)), (score.max(1) // 3, score.max(1) // 2)):
        best = m.Best(low, high, 10)
        seen = m.descend(tree, most, q, np.arange(50), ids[:50], best, np.arange(50))
        for i in range(50):
            want = sorted((-s, j) for j, s in enumerate(score[i].tolist()) if low[i] <= s <= high[i] and j != i)[:10]
            assert [(-int(s), int(j)) for s, j, k in zip(best.score[i], best.ids[i], best.known[i]) if k] == want
        assert seen < 0.2 * 50 * 3000
