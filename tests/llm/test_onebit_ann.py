import numpy as np
import pytest

from tilewright.llm import onebit_ann as m
from tilewright.llm.vectors import as_bytes, component_type


def brute(rows, k=20, step=20):
    good = [(v, np.float32(e).astype(float)) for v, e in rows if v is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = {}
    for v, q in good:
        if v % step == 0:
            near = sorted(((-float(q @ x), w) for w, x in good if w != v and len(x) == len(q)))[:k]
            out.setdefault(v, []).append([(w, -s) for s, w in near])
    return out


def check(spark, rows, recall=1.0):
    df = spark.createDataFrame([(v, e, 1, "x") for v, e in rows], "vec_id long, embedding array<float>, size int, chunk string")
    kind = component_type(df)
    known = as_bytes(df).where("vec IS NOT NULL")
    index = m.build_index(known, kind, chunk=50)
    got = m.search(index, known.where("vec_id % 20 = 0"), kind, block=7).collect()
    return compare(got, brute(rows), recall)


def compare(got, want, recall):
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == {v for v, lists in want.items() if lists[0]}
    hits = total = 0
    for v, found in by.items():
        near = want[v][0]
        assert len(found) == len(near) * len(want[v])
        hits += len({w for w, _ in found} & {w for w, _ in near})
        total += len({w for w, _ in near})
        exact = dict(near)
        for w, s in found:
            assert w not in exact or s == pytest.approx(exact[w], abs=1e-12)
        if recall == 1.0 and len(want[v]) == 1:
            assert [w for w, _ in found] == [w for w, _ in near]
    assert hits >= recall * total


def test_query_against_brute_force(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = m.query(spark, sf_dir).collect()
    assert [x for x in got[0].asDict()] == ["query_id", "rank", "vec_id", "score"]
    compare(got, brute(rows), 0.99)


def test_ties_copies_and_sizes(spark):
    rng = np.random.default_rng(8)
    base = [list(map(float, v)) for v in rng.standard_normal((60, 16)) * 3 + 1]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(50)] + [(300 + i, [float(i + 1), 2.0, 1.0]) for i in range(5)]
    check(spark, rows)


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (20, []), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [nan, 1.0]), (100, [inf, 1.0]), (None, [1.0, 1.0]), (120, [1.0, 2.0]),
            (140, [2.0, 1.0]), (140, [2.0, 1.0]), (7, [1.0, -1.0]), (160, [5.0]), (-20, [3.0, 3.0])]
    check(spark, rows)
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    known = as_bytes(empty).where("vec IS NOT NULL")
    assert m.search(m.build_index(known, "<f4"), known, "<f4").count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((2000, 64)) + 0.3
    mean = x.mean(0)
    bits, norm, _, agree = m.encode(x, mean)
    q = rng.standard_normal((50, 64))
    signs = (np.unpackbits(bits, axis=1)[:, :64].astype(float) * 2 - 1) / 8
    estimate = q @ mean[:, None] + (q @ m._turn(64) @ signs.T) * norm / agree
    error = np.linalg.norm(q, axis=1)[:, None] * norm * np.sqrt((1 - agree**2) / (agree**2 * 63))
    off = np.abs(estimate - q @ x.T) / error
    assert (off > m.EPSILON).mean() < 0.005 and np.abs((estimate - q @ x.T).mean()) < 0.05


def test_sums_from_packed_bits():
    rng = np.random.default_rng(6)
    for d in (3, 16, 64, 100):
        q, x = rng.standard_normal((70, d)), rng.standard_normal((50, d))
        signs = x > 0
        got = m.sign_sums(m.words(np.packbits(signs, axis=1)), m.planes(q), slice(0, 70))
        off = np.abs(got - q @ (2.0 * signs - 1).T) / np.sqrt(d)
        assert (off <= m.planes(q)[4][:, None] + 1e-9).all() and off.max() < 0.1 * np.linalg.norm(q, axis=1).max()


def test_floors_are_reached():
    rng = np.random.default_rng(7)
    x, q = rng.standard_normal((20_000, 32)), rng.standard_normal((200, 32))
    some = rng.choice(len(x), 3000, replace=False)
    centre = m.learn_centres(x[some], 16)
    own = m.nearest(x, centre)
    radius = np.full(len(centre), -np.inf)
    np.maximum.at(radius, own, np.linalg.norm(x - centre[own], axis=1))
    floor, reads = m.reading(q, -1 - np.arange(200), (some, x[some], m.nearest(x[some], centre)), len(x), centre, radius, 20, m.EPSILON)
    best = np.argsort(-(q @ x.T), axis=1)[:, :20]
    assert ((q * x[best[:, 19]]).sum(1) >= floor).mean() > 0.97
    assert np.mean([reads[i, own[best[i]]].mean() for i in range(200)]) > 0.99
    assert m.least_rank(20, 1.0) == 21 and m.least_rank(20, 1e-6) == 1


@pytest.mark.parametrize("n", [3000, 12_000])
def test_clustered_vectors_read_few_lists_and_keep_recall(spark, n):
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((40, 24)) * 3
    x = (centre[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, 24))).astype("f4")
    df = spark.createDataFrame([(i, x[i].tobytes()) for i in range(n)], "vec_id long, vec binary").repartition(4)
    index = m.build_index(df, "<f4", sample=1500)
    got = m.search(index, df.where("vec_id % 100 = 0"), "<f4").collect()
    hits = 0
    for q in range(0, n, 100):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        hits += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-score)[:20].tolist()))
    assert hits >= 0.98 * 20 * (n // 100) and len(got) == 20 * (n // 100)


def reranked(x, step, k=20):
    """(share of the candidates that are reranked, share of the true neighbours among them) of every step-th vector, by the operator's own parts."""
    n, d = x.shape
    rng, ids = np.random.default_rng(4), np.arange(n)
    some = rng.choice(n, min(n, m.SAMPLE_A_ROOT * int(n**0.5) + 256), replace=False)
    centre = m.learn_centres(x[some], int(n**0.5) // m.LIST_A_ROOT)
    own, q_ids = m.nearest(x, centre), ids[::step]
    q = x[q_ids]
    radius = np.array([np.linalg.norm(x[own == c] - centre[c], axis=1).max(initial=-np.inf) for c in range(len(centre))])
    floor, reads = m.reading(q, q_ids, (some, x[some], own[some]), n, centre, radius, k, m.EPSILON)
    chosen = np.zeros((len(q), n), bool)
    for c in np.unique(own):
        at = np.flatnonzero(own == c)
        bits, norm, _, agree = m.encode(x[at], centre[c])
        row = {"ids": at.tobytes(), "codes": bits.tobytes(), "residual": norm.tobytes(), "agreement": agree.tobytes()}
        upper = m.upper_bounds(q, row, centre[c], m.RERANK)(slice(None))
        chosen[:, at] = m.choose(upper, floor, q_ids[:, None] == at, k) & reads[:, [c]]
    score = q @ x.T
    score[np.arange(len(q)), q_ids] = -np.inf
    best = np.argsort(-score, axis=1)[:, :k]
    return chosen.mean(), np.take_along_axis(chosen, best, 1).mean()


def test_the_codes_choose_what_is_reranked():
    """Of vectors that point everywhere under a third is reranked, of clustered ones under a twentieth, and the neighbours are among it."""
    rng = np.random.default_rng(5)
    share, recall = reranked(rng.standard_normal((8000, 64)), 20)
    assert share < 0.3 and recall >= 0.99
    centre = rng.standard_normal((40, 24)) * 3
    share, recall = reranked(centre[rng.integers(0, 40, 12_000)] + 0.3 * rng.standard_normal((12_000, 24)), 100)
    assert share < 0.05 and recall >= 0.99


def test_the_sample_is_bounded_in_bytes():
    assert m.sample_within(64) == 131_072 and m.sample_within(100_000) * 100_000 * 8 <= m.SAMPLE_BYTES and m.sample_within(0) > 0


def ranked_rows(spark, first):
    """Rows that reached the ranking, out of the chunks, in the executions from number ``first`` on; and the number of executions."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    executions, total = store.executionsList(), 0
    for e in (executions.apply(i) for i in range(first, executions.size())):
        nodes, values = store.planGraph(e.executionId()).allNodes(), store.executionMetrics(e.executionId())
        for node in (nodes.apply(i) for i in range(nodes.size())):
            if node.name() == "MapInArrow" and "score" in node.desc() and "floor" not in node.desc().split("[")[-1]:
                metrics = (node.metrics().apply(i) for i in range(node.metrics().size()))
                total += sum(int(values.apply(x.accumulatorId()).replace(",", "")) for x in metrics if x.name() == "number of output rows")
    return total, executions.size()


@pytest.mark.parametrize("ties", [False, True])
def test_rows_to_rank_grow_with_the_queries_only(spark, ties):
    """Each query reads some 50 and some 150 chunks, of which each holds 20 candidates and more."""
    rng, each = np.random.default_rng(12), []
    for n in (3000, 9000):
        x = np.repeat(rng.standard_normal((n // 50, 16)), 50, axis=0) if ties else rng.standard_normal((n, 16))
        x = rng.permutation(x).astype("f4")
        df = spark.createDataFrame([(i, x[i].tobytes()) for i in range(n)], "vec_id long, vec binary").repartition(4)
        index, queries = m.build_index(df, "<f4", chunk=60), df.where("vec_id % 100 = 0")
        first = ranked_rows(spark, 0)[1]
        got = m.search(index, queries, "<f4", block=10).collect()
        assert len(got) == 20 * (n // 100) and index.rows.count() >= n // 60
        each.append(ranked_rows(spark, first)[0] / (n // 100))
        compare(got, brute([(i, x[i].tolist()) for i in range(n)], step=100), 0.97)
    assert 20 <= each[0] and each[1] < 300 and each[1] < 2 * each[0]


def test_places_of_chunks_and_rounds():
    assert m.rounds(0) == m.rounds(4) == [(0, 4)] and m.rounds(17) == [(0, 4), (4, 16), (16, 64)]
    rng = np.random.default_rng(3)
    q, centre, chunks = rng.standard_normal((9, 8)), rng.standard_normal((6, 8)), np.array([1, 3, 2, 0, 5, 1])
    radius, reads = np.where(chunks > 0, 1.0, -np.inf), (rng.random((9, 6)) < 0.7) & (chunks > 0)
    before = m.first_places(q, reads, centre, radius, chunks, 4.0)
    for i in range(9):
        read = np.flatnonzero(reads[i])
        taken = sorted(p for j in read for p in range(before[i, j], before[i, j] + chunks[j]))
        assert taken == list(range(chunks[read].sum()))
        assert sorted(read, key=lambda j: before[i, j]) == sorted(read, key=lambda j: -(q[i] @ centre[j]))
