import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tilewright.llm import decontamination as m


def slow_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def slow_windows(text, width):
    w = slow_words(text)
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else set()


def slow_near(w, phrase, within):
    """Whether a stretch of ``within`` words has all words of the phrase."""
    need = Counter(phrase)
    return set(phrase) <= set(w) and any(x in need and not need - Counter(w[i : i + within]) for i, x in enumerate(w))


def slow(docs, items, width, within):
    own = {}
    for item, text in items:
        for p in slow_windows(text, width):
            own.setdefault(p, set()).add(item)
    sizes = {len(p) for p in own}
    out = []
    for doc_id, text in docs:
        w = slow_words(text)
        hit, found = set(), set()
        for i in range(len(w)):
            for n in sizes:
                if (p := tuple(w[i : i + n])) in own and len(p) == n:
                    hit |= set(range(i, i + n))
                    found |= own[p]
        near = set().union(*(own[p] for p in own if slow_near(w, p, within)), set())
        out.append((doc_id, len(w), len(hit), tuple(sorted(str(i) for i in found if i is not None)), len(near - {None})))
    return Counter(out)


def rows(df):
    return Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["n_near"]) for r in df.collect())


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBzZ09_- Éİ\x00\x7f\x85 \n", max_size=30))
def test_words(text):
    assert [w.decode() for w in m.words(text.encode())] == slow_words(text)


def test_query(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = slow(
        [(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()], m.WIDTH, m.WITHIN
    )
    got = m.query(spark, sf_dir).collect()
    digest = lambda t: hashlib.sha256(",".join(t).encode()).hexdigest()
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], r["n_near"]) for r in got) == Counter(
        (d, n, h, len(t), digest(t), h > 0, near) for d, n, h, t, near in want.elements()
    )
    assert any(r["contaminated"] for r in got)


@pytest.mark.parametrize("shard", [200, 1 << 24])
def test_random_texts(spark, shard, monkeypatch):
    """Few words, so that phrases overlap, repeat words and stand across the ends of documents."""
    monkeypatch.setattr(m, "SHARD", shard)
    monkeypatch.setattr(m.build_index, "__defaults__", (shard,))
    monkeypatch.setattr(m.search, "__defaults__", (None, 2, 7))
    rng = np.random.default_rng(shard)
    text = lambda n: " ".join(rng.choice(list("aabcdeé"), n))
    docs = [(i % 50, text(rng.integers(0, 40))) for i in range(60)] + [(99, "x " + "a " * 3000)]
    items = [(i % 7, text(rng.integers(0, 9))) for i in range(9)] + [(10, "a a a a"), (11, "a b, C!"), (11, "zz zz"), (12, "Z-z zz ZZ.")]
    got = m.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4, 6)
    assert rows(got) == slow(docs, items, 4, 6)


def test_edge_cases(spark):
    docs = [(1, None, "x"), (1, "", "x"), (None, "one two three", "x"), (2, "ONE, two; three four", None), (2, "ONE, two; three four", None), (3, "two one", "y")]
    items = [(None, "two three", 1), (5, None, 1), (6, " .", 1), (7, "four", 2), (10, "one two", 3), (7, "one two", 3)]
    d = spark.createDataFrame(docs, "doc_id long, text string, phrase string").withColumnRenamed("phrase", "shard")
    b = spark.createDataFrame(items, "item_id long, text string, term int")
    got = m.contamination(d, b, within=2)
    want = slow([x[:2] for x in docs], [x[:2] for x in items], m.WIDTH, 2)
    assert rows(got) == want and want[(2, 4, 4, ("10", "7"), 2)] == 2
    assert rows(m.contamination(d.limit(0), b)) == Counter()
    assert {(r["n_hit"], len(r["items"])) for r in m.contamination(d, b.limit(0)).collect()} == {(0, 0)}


def test_common_passages_stay_in_shards_of_bounded_size(spark):
    hot = "the same passage stands in every one of these texts, ten words or more"
    docs = spark.range(400).selectExpr("id doc_id", f"concat('{hot} ', repeat('word ', 50)) text")
    index = m.build_index(docs, 4000)
    sizes = [r["n"] for r in index.documents.groupBy("shard").agg({"n_words": "sum"}).toDF("shard", "n").collect()]
    assert len(sizes) > 20 and max(sizes) < 2000
    items = spark.createDataFrame([(i, hot) for i in range(30)], "item_id long, text string")
    got = m.contamination(docs, items).collect()
    assert {(r["n_hit"], len(r["items"])) for r in got} == {(14, 30)} and len(got) == 400


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abc"), min_size=1, max_size=4), st.integers(1, 8))
def test_smallest_stretches(text, phrase, within):
    lists = {w: np.array([i for i, x in enumerate(text) if x == w], np.int64) for w in "abc"}
    holds = lambda i, j: not Counter(phrase) - Counter(text[i:j])
    want = [i for i in range(len(text)) for j in range(i + 1, len(text) + 1) if j - i <= within and holds(i, j) and not holds(i + 1, j) and not holds(i, j - 1)]
    assert m.smallest_stretches(lists, phrase, lists[phrase[0]], within).tolist() == want
