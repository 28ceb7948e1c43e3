import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import simhash as m
from tilewright.llm.graph import components, local_roots


def slow_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, ids):
    root = list(range(len(fps)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab CÉ é\t\n\x0b\x1c\x85 ", max_size=60))
def test_fingerprint(text):
    assert m.fingerprint(text) == slow_fingerprint(text)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    ids, fps = [r["doc_id"] for r in docs], [slow_fingerprint(r["text"]) for r in docs]
    want = dict(zip(ids, zip(map("{:016x}".format, fps), slow_components(fps, ids))))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in m.query(spark, sf_dir).collect()}
    assert got == want


def test_all_pairs_within_the_radius_are_found(spark):
    rng = np.random.default_rng(3)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    for x in list(fps):
        for d in (1, 2, 3, 4):
            y = x
            for b in rng.choice(64, d, replace=False):
                y ^= 1 << int(b)
            fps.append(y)
    hot = int(rng.integers(0, 1 << 63))
    fps += [hot ^ sum(1 << int(b) for b in rng.choice(12, rng.integers(0, 6), replace=False)) for _ in range(400)]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r["node"]: r["root"] for r in components(m.links(df)).collect()}
    want = slow_components(fps, list(range(len(fps))))
    by = {}
    for x, w in zip(signed, want):
        by.setdefault(w, set()).add(root.get(x, x))
    assert all(len(v) == 1 for v in by.values()) and len({next(iter(v)) for v in by.values()}) == len(by)


def test_edge_cases(spark):
    rows = [(5, None, 1, "x"), (4, "", 1, "x"), (9, " \n", 1, "x"), (7, "one two", 1, "x"), (7, "one two", 1, "x"), (6, "ONE  Two", 1, "x"), (None, "three", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int, key string")
    got = sorted((r["doc_id"] or -1, r["component_id"]) for r in m.near_duplicates(df).collect())
    assert got == [(-1, None), (4, 4), (5, 4), (6, 6), (7, 6), (7, 6), (9, 4)]
    assert m.near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_chain(spark):
    edges = spark.range(300).selectExpr("id a", "id + 1 b").union(spark.range(1000, 1100).selectExpr("1000L a", "id b"))
    rows = components(edges).collect()
    assert len({r["root"] for r in rows if r["node"] < 1000}) == 1 and len({r["root"] for r in rows if r["node"] >= 1000}) == 1
    assert len(rows) == 301 + 100


@pytest.mark.parametrize("n", [1, 50])
def test_local_roots(n):
    i = np.arange(n - 1)
    assert (local_roots(n, i[::-1] + 1, i[::-1]) == 0).all()


def test_hot_keys_are_dealt_to_blocks(spark):
    rng = np.random.default_rng(11)
    hot = int(rng.integers(0, 1 << 62))
    # many fingerprints that differ in few bits, so that they share most of their keys
    fps = sorted({hot ^ sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 9), replace=False)) for _ in range(900)} | {int(x) for x in rng.integers(0, 1 << 62, 50)})
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    assert m.hot_keys(df, 100).count() > 40
    roots = []
    for block in (100, 1 << 20):
        root = {r["node"]: r["root"] for r in components(m.links(df, block=block)).collect()}
        by = {}
        for x in fps:
            by.setdefault(root.get(x, x), set()).add(x)
        roots.append(sorted(map(sorted, by.values())))
    want = {}
    for x, w in zip(fps, slow_components(fps, list(range(len(fps))))):
        want.setdefault(w, set()).add(x)
    assert roots[0] == roots[1] == sorted(map(sorted, want.values()))


def test_keys_are_hot_by_all_that_meet_there(spark):
    """Under one key lie few fingerprints each of its 43 neighbours, but many together."""
    rng = np.random.default_rng(2)
    a, b = m.PARTS[0]
    fps = set()
    for i in [None, *range(b, 64)]:
        base = 0 if i is None else 1 << i
        fps |= {base | int(x) for x in rng.choice(1 << (b - a), 90, replace=False)}
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    hot = {r["key"]: r["blocks"] for r in m.hot_keys(df, 200).collect()}
    assert hot[0] == -(-len(fps) // 200)
    keyed = m.variants(df).groupBy("key").count().collect()
    assert {r["key"] for r in keyed if r["count"] > 200} == set(hot)
    assert all(hot.get(r["key"], 1) * 200 >= r["count"] for r in keyed)
    roots = []
    for block in (200, 1 << 20):
        root = {r["node"]: r["root"] for r in components(m.links(df, block=block)).collect()}
        by = {}
        for x in fps:
            by.setdefault(root.get(x - (1 << 64) if x >> 63 else x, x), set()).add(x)
        roots.append(sorted(map(sorted, by.values())))
    assert roots[0] == roots[1]
