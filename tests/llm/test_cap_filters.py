import time

import numpy as np
import pytest

from tilewright.llm import cap_filters as m
from tilewright.llm.vectors import unit


def brute(rows, cosine=0.95):
    """rows: (vec_id, list) -> sorted (vec_id, n_links, component_id)."""
    good = [i for i, (v, e) in enumerate(rows) if v is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    n, root = [0] * len(rows), list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, i in enumerate(good):
        for j in good[:k]:
            a, b = np.float32(rows[i][1]).astype(float), np.float32(rows[j][1]).astype(float)
            if len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                n[i] += 1
                n[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in good:
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    return sorted(((v, n[i], least.get(find(i), v)) for i, (v, _) in enumerate(rows)), key=key)


def check(spark, rows, **more):
    df = spark.createDataFrame([(v, e, "x", 1) for v, e in rows], "vec_id long, embedding array<float>, filter string, n int")
    got = m.near_vectors(df, **more).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=key) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def noisy(rng, base, n, noise):
    return [[float(x) for x in base + noise * rng.standard_normal(len(base))] for _ in range(n)]


def test_groups_of_copies(spark):
    rng = np.random.default_rng(2)
    vectors = [list(map(float, rng.standard_normal(64))) for _ in range(150)]
    vectors += [vectors[3]] * 20 + [[2 * x for x in vectors[4]]] * 3
    vectors += noisy(rng, np.array(vectors[5]), 40, 0.02) + noisy(rng, np.array(vectors[6]), 20, 0.1)
    check(spark, [(int(i), v) for i, v in zip(rng.permutation(1000), vectors)])


def test_large_filters_are_split(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal(32)
    rows = [(i, v) for i, v in enumerate(noisy(rng, base, 150, 0.02))]
    check(spark, rows, block=16)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, -0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [1.0, 1.0]), (7, [1.0, 1.0]),
            (8, [1.0, 1.001]), (8, [1.0, 1.001]), (9, [1.0]), (10, [-1.0]), (11, [1.0, 0.0]), (12, [1.0, -0.0]), (13, [1e-30, 0.0]), (14, [1.0, 1.0, 0.0])]
    check(spark, rows)
    assert m.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("n", [500, 50_000])
def test_pairs_at_the_threshold_share_a_filter(n):
    rng = np.random.default_rng(1)
    a = unit(rng.standard_normal((3000, 64)))
    b = rng.standard_normal((3000, 64))
    b = unit(b - (b * a).sum(1, keepdims=True) * a)
    c = 0.95 * a + np.sqrt(1 - 0.95**2) * b
    words = m.codewords_for(n)
    own = [m.filters_of([x.astype("<f4").tobytes() for x in v], "<f4", words, m.CODES) for v in (a, c)]
    missed = [not np.intersect1d(x, y).size for x, y in zip(*own)]
    assert np.mean(missed) <= 0.001


@pytest.mark.parametrize("n", [50_000, 10**7, 10**8])
@pytest.mark.parametrize("d", [16, 64])
def test_no_more_pairs_are_missed_as_the_table_grows(n, d):
    words = m.codewords_for(n)
    a, b = m.pairs_at(0.95, d, 1500, 99)
    missed = 0
    for at in range(0, len(a), 250):
        own = [m.filters_of([x.astype("<f4").tobytes() for x in v[at : at + 250]], "<f4", words, m.CODES) for v in (a, b)]
        missed += sum(not np.intersect1d(x, y).size for x, y in zip(*own))
    assert missed <= 2  # 0.3 are expected


def test_decoding_finds_all_that_pass():
    x = unit(np.random.default_rng(9).standard_normal((50, 24)))
    c = m.Code(24, 32, 0)
    a, b = c.scores(x)
    row, found = c.decode(x, least=2)
    for r in range(len(x)):
        sums = (a[r][:, None] + b[r][None, :]).ravel()
        want = set(np.flatnonzero(sums >= c.threshold)) | set(np.argsort(-sums, kind="stable")[:2])
        assert set(found[row == r]) == want


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in m.query(spark, sf_dir).collect())
    assert got == brute(rows)


@pytest.mark.parametrize("d", [2, 3, 16, 64, 768])
def test_caps_hold_the_share_asked_for(d):
    x = unit(np.random.default_rng(4).standard_normal((200_000, d)))[:, 0]
    for share in (0.3, 0.01, 0.001):
        assert (x > m.cap(d, share)).mean() == pytest.approx(share, abs=4 * np.sqrt(share / len(x)))
    assert m.cap(64, 1e-9) > m.cap(64, 1e-8) > m.cap(64, 1e-4)


def test_a_code_is_built_quickly():
    began = time.perf_counter()
    c = m.Code(64, 1 << 15, 0)
    assert time.perf_counter() - began < 2
    row, _ = c.decode(unit(np.random.default_rng(2).standard_normal((40, 64))))
    assert 4 <= np.bincount(row).mean() <= 30
