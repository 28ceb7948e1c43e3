import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tilewright.llm import prefix_trie as m

SCHEMA = "conv_id long, turn long, role string, text string, path string, n int"


def slow(rows):
    """Every prefix of every conversation, and every node of each subtree."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, t in own.items():
        h, first = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        whole[c] = own.get(first, [])[:h] + t[h:]
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        sub = [q for q in nodes if q[: len(p)] == p]
        kids = [q for q in sub if len(q) == len(p) + 1]
        leaves = [q for q in sub if not any(x[:-1] == q for x in sub if len(x) == len(q) + 1)]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in sub if q)
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r) for r in df.collect())


def made(spark, rows):
    return m.rebuilt(m.digested(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)))


def random_rows(seed, n):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant", None][t % 3], str(rng.choice(["a", "bé", None]))))
    rows += [(c, t, "user", "deep" if t < 30 or c % 2 else f"deep {c}") for c in (n, n + 1, n + 7) for t in range(40)]
    return rows


@pytest.mark.parametrize(("run", "partitions"), [(4096, "8"), (16, "8"), (9, "3")])
def test_levels_find_what_every_prefix_gives(spark, run, partitions, monkeypatch):
    monkeypatch.setattr(m, "PARTITION", 2)
    monkeypatch.setattr(m, "FEW", 4)
    rows = random_rows(run, 130)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        assert got(m.prefix_trie(made(spark, rows), run)) == slow(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_query_and_its_sql(spark, sf_dir):
    want = duckdb.connect()
    want.sql(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    df = m.query(spark, sf_dir)
    assert got(df) == Counter(want.sql(f"SELECT {', '.join(df.columns)} FROM ({m.SQL})").fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(df) == slow(rows)


def test_edge_cases(spark):
    rows = [(5, None, "user", "x"), (5, 1, None, None), (5, 1, "user", "tie"), (5, 1, "assistant", "tie"), (5, 1, "assistant", "tie"), (None, 1, "user", "x")]
    rows += [(6, 0, "user", "x"), (11, 3, "", ""), (-7, 0, "user", "z"), (-5, 0, "user", "w"), (-5, 1, "user", "w"), (12, 0, "user", "a" * 100_000)]
    assert got(m.prefix_trie(made(spark, rows))) == slow(rows)
    empty = m.digested(spark.createDataFrame([], SCHEMA))
    assert m.prefix_trie(m.rebuilt(empty)).count() == 0


def test_many_copies(spark):
    """All share one conversation: each task hashes or counts a part."""
    rows = [(5 * c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    assert got(m.prefix_trie(made(spark, rows), 8)) == slow(rows)


@pytest.mark.parametrize("n", [1, 2, 40])
def test_peel_closes_all_but_the_outer_paths(n):
    rng = np.random.default_rng(n)
    found = set()
    for _ in range(n):
        turns = rng.integers(0, 3, rng.integers(1, 6))
        found.add(bytes(16) + b"".join(hashlib.md5(turns[: k + 1].tobytes()).digest() for k in range(len(turns))))
    found = sorted(found)
    rows = [(p, np.ones(len(p) // 16, np.int64).tobytes(), 1, i, None) for i, p in enumerate(found)]
    nodes, kept = m.peel(rows, False)
    total = {p[:k] for p in found for k in range(16, len(p) + 1, 16)}
    outer = {p[:k] for p in (found[0], found[-1]) for k in range(16, len(p) + 1, 16)}
    assert len(nodes["depth"] if nodes else []) == len(total - outer) and [k[0] for k in kept] == sorted({found[0], found[-1]})
    assert len(m.peel(rows, True)[0]["depth"]) == len(total)
