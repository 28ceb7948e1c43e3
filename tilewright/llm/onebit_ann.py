"""Nearest neighbours by inner product from randomly rotated one-bit codes.

The index deals all vectors to lists by their nearest centre. Of a vector o of a list with centre c
it keeps the signs of the randomly rotated residual as packed bits, and scalars: the residual's norm
r, and the cosine g between the rotated residual and its signs. For a query q the inner product is
<q,c> + r <q,u> for the residual's direction u, and <q,u> is estimated by <q',s> / g, with the
rotated query q' and the signs s scaled to length one. <q',s> is taken from the packed bits: q' is
written in ``PLANES`` bits a component, and each plane of them is counted against the signs. The
error is at most ``width`` times |q| r sqrt((1 - g^2) / (g^2 (d - 1))), and of what the planes leave
out that share over the root of d, with a probability that ``width`` sets, so bounds follow.

A sample of the vectors gives each query a score that its k-th best reaches with high probability:
the r-th best of the sample, for the least r that few of the k best can fill. Lists whose bound, from
their centre and their largest residual, stays below it are not read, but for the nearest ones; in
the others every vector whose upper bound reaches it is reranked in double precision, as are the k
of the highest bounds of each chunk, so that no query gets fewer than k. A list is left out by a wide
bound (``EPSILON``), as that loses all of its vectors; one vector by a bound of ``RERANK`` expected
errors, which a neighbour at the very floor misses three times in a hundred. The more the vectors
cluster, the fewer lists are read; where they don't, a query reads most lists.

Lists are packed into chunks of bounded size and queries into blocks. A block meets the chunks of the
lists that its queries read, each in a task of its own. A query reads its chunks in rounds: those of
its lists of the highest bounds first, then ``GROWTH`` times as many in all, and so on. A chunk gives
at most each query's k best of it, and only those that come before the k-th best of the rounds
before, as no other can be among the k best. So what goes to the ranking of a round is about
``GROWTH - 1`` times k rows a query, and in all it grows with the queries times the rounds, whose
number is a logarithm of the chunks; only rounds in which what is read gets better and better make
more. Which vectors are reranked doesn't depend on the rounds. Every row is indexed. Centres are learned on the sample, which is at most
``SAMPLE`` vectors and ``SAMPLE_BYTES`` as doubles (the documented bounds), by numpy on the driver.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows
of null vec_id; vectors of other sizes are no candidates. Rows with the query's own vec_id are no
candidates either; rows that repeat a vec_id are queries and candidates of their own with that id. Equal
scores go to the smaller vec_id. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.vectors import as_bytes, component_type, matrix, rotation
from tilewright.session import table, written

K = 20
QUERY_STEP = 20
EPSILON = 4.0
RERANK = 1.9
CHUNK = 4096
QUERIES = 512
PLANES = 6
#: Vectors of the sample at most, their bytes as doubles at most, vectors for each root of their number; vectors a list for each root, lists at most.
SAMPLE = 65_536
SAMPLE_BYTES = 1 << 26
SAMPLE_A_ROOT = 16
LIST_A_ROOT = 8
LISTS = 8192
#: Lists that a query reads in any case, and chunks of its first round; how many times as many it has read after each further one.
NEAREST = 4
GROWTH = 4
SEED = 3

INDEX = "size int, list int, chunk int, ids binary, codes binary, residual binary, agreement binary, radius double, vectors binary"
ASKED = ("query", "vec_id", "floor", "before", "least", "last", "vec")


@functools.lru_cache(maxsize=8)
def _turn(d: int) -> np.ndarray:
    return rotation(d, SEED).astype(np.float32)


@dataclass
class Index:
    """``rows`` is a table of INDEX; centres, sample (ids, vectors) and number of vectors are by size in bytes."""

    rows: DataFrame
    centres: dict[int, np.ndarray]
    sample: dict[int, tuple[np.ndarray, ...]]
    count: dict[int, int]


def learn_centres(x: np.ndarray, lists: int, rounds: int = 6) -> np.ndarray:
    """Centres of a sample by k-means; no more than a quarter of its vectors."""
    lists = max(1, min(lists, len(x) // 4))
    centre = x[np.random.default_rng(SEED).choice(len(x), lists, replace=False)]
    for _ in range(rounds):
        near = nearest(x, centre)
        n = np.bincount(near, minlength=lists)
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centre)
    return centre


def nearest(x: np.ndarray, centre: np.ndarray, step: int = 4096) -> np.ndarray:
    half = (centre * centre).sum(1) / 2
    return np.concatenate([(x[at : at + step] @ centre.T - half).argmax(1) for at in range(0, len(x), step)] or [np.empty(0, np.int64)])


def encode(x: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, ...]:
    """(packed bits, residual norm, residual, agreement) of the rows of x."""
    d = x.shape[1]
    residual = x - centre
    turned = (residual @ _turn(d)).astype(np.float32)
    norm = np.sqrt((residual * residual).sum(1))
    agree = np.abs(turned).sum(1) / np.sqrt(d) / np.where(norm > 0, norm, 1)
    return np.packbits(turned > 0, axis=1), norm.astype(np.float32), residual, np.where(norm > 0, agree, 1).astype(np.float32)


def sample_within(d: int) -> int:
    """How many vectors of d components the sample's bytes hold; centres are no more than a quarter of them."""
    return max(1, SAMPLE_BYTES // (8 * max(d, 1)))


def build_index(known: DataFrame, kind: str, chunk: int = CHUNK, sample: int = SAMPLE) -> Index:
    """An index of rows (vec_id, vec)."""
    itemsize = int(kind[2:])
    count = {r["size"]: r["n"] for r in known.groupBy(F.length("vec").alias("size")).agg(F.count("*").alias("n")).collect()}
    take = min(sample, SAMPLE_A_ROOT * math.isqrt(sum(count.values())) + 256, sample_within(max(count, default=0) // itemsize))
    # spread over all vectors by a hash; only so many reach the driver
    drawn = known.select("vec_id", "vec").orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(take).toPandas()
    sizes = drawn["vec"].map(len).to_numpy() if len(drawn) else np.empty(0, np.int64)
    samples, centres = {}, {}
    for size, n in count.items():
        own = drawn[sizes == size]
        x = matrix(own["vec"].tolist(), kind) if len(own) else np.zeros((0, size // itemsize))
        centres[size] = learn_centres(x, min(LISTS, math.isqrt(n) // LIST_A_ROOT)) if len(x) else np.zeros((1, size // itemsize))
        samples[size] = (own["vec_id"].to_numpy(np.int64), x, nearest(x, centres[size]))

    def assign(batches):
        for batch in batches:
            vec = batch.column(1).to_pylist()
            size, where = np.array([len(v) for v in vec], np.int32), np.zeros(len(vec), np.int32)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                where[at] = nearest(matrix([vec[i] for i in at], kind), centres[int(s)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size), pa.array(where)], ["vec_id", "vec", "size", "list"])

    dealt = written(known.select("vec_id", "vec").mapInArrow(assign, "vec_id bigint, vec binary, size int, list int"), "lists")
    chunks = written(dealt.groupBy("size", "list").agg(F.ceil(F.count("*") / chunk).alias("chunks")), "list-sizes")
    place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("chunks")).cast("int").alias("chunk")

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        vec, lead = rows["vec"].tolist(), rows[["size", "list", "chunk"]].iloc[:1]
        bits, norm, _, agree = encode(matrix(vec, kind), centres[int(lead["size"].iloc[0])][int(lead["list"].iloc[0])])
        made = {"ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "codes": bits.tobytes(), "residual": norm.tobytes(), "agreement": agree.tobytes()}
        made |= {"radius": float(norm.max()), "vectors": b"".join(vec)}
        return pd.concat([lead.reset_index(drop=True), pd.DataFrame({c: [v] for c, v in made.items()})], axis=1)

    rows = dealt.join(chunks, ["size", "list"]).select("vec_id", "vec", "size", "list", place)
    return Index(written(rows.groupBy("size", "list", "chunk").applyInPandas(pack, INDEX), "index"), centres, samples, count)


def least_rank(k: int, share: float, doubt: float = 1e-2) -> int:
    """The least r such that r of the k best fall into a sample of that share with at most that probability."""
    share, tail = min(share, 1.0), 1.0
    for r in range(k + 1):
        if tail <= doubt:
            return max(r, 1)
        tail -= math.comb(k, r) * share**r * (1 - share) ** (k - r)
    return k + 1


def reading(
    q: np.ndarray, q_ids: np.ndarray, sample: tuple[np.ndarray, ...], n: int, centre: np.ndarray, radius: np.ndarray, k: int, epsilon: float
) -> tuple[np.ndarray, np.ndarray]:
    """(floor of each query, whether it reads each list), from the sample's (ids, vectors, lists).

    The floor is a score that the query's k-th best of n vectors reaches with high probability.
    Besides the lists whose bound reaches it, a query reads those of the sample's vectors that do,
    and the ``NEAREST`` ones by inner product and by distance: there its near copies are, whose
    residuals don't point anywhere.
    """
    ids, x, lists = sample
    floor, reads, rank = np.full(len(q), -np.inf), np.zeros((len(q), len(centre)), bool), least_rank(k, len(x) / max(n, 1))
    half = (centre * centre).sum(1) / 2
    for at in range(0, len(q), 64):
        some = slice(at, at + 64)
        if len(x) > rank + 1:
            score = q[some] @ x.T
            score[q_ids[some, None] == ids[None, :]] = -np.inf
            least = np.partition(score, len(x) - rank, axis=1)[:, len(x) - rank]
            floor[some] = least - 1e-9 * np.abs(np.where(np.isfinite(least), least, 0))
            i, j = np.nonzero(score >= floor[some, None])
            reads[at + i, lists[j]] = True
        inner = q[some] @ centre.T
        reads[some] |= inner + epsilon * np.sqrt((q[some] ** 2).sum(1))[:, None] * radius / np.sqrt(q.shape[1]) >= floor[some, None]
        for near in (inner, inner - half):
            best = np.argpartition(-near, min(NEAREST, near.shape[1]) - 1, axis=1)[:, :NEAREST]
            np.put_along_axis(reads[some], best, True, axis=1)
    return floor, reads & np.isfinite(radius)


def planes(turned: np.ndarray, count: int = PLANES) -> tuple[np.ndarray, ...]:
    """Rotated queries in ``count`` bits a component: (bits of each plane in 64-bit words, least, step, sum, what is left out)."""
    low = turned.min(1, keepdims=True)
    step = np.maximum(turned.max(1, keepdims=True) - low, 1e-30) / (2**count - 1)
    level = np.rint((turned - low) / step).astype(np.int64)
    close = low + step * level
    bits = np.stack([words(np.packbits((level >> j & 1).astype(bool), axis=1)) for j in range(count)])
    return bits, low[:, 0], step[:, 0], close.sum(1), np.sqrt(((turned - close) ** 2).sum(1))


def words(packed: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def sign_sums(bits: np.ndarray, query: tuple[np.ndarray, ...], some: slice) -> np.ndarray:
    """The sum of each query's components under the signs in ``bits``, by counting bits of the planes."""
    plane, low, step, total, _ = query
    ones = np.bitwise_count(bits).sum(1, dtype=np.int64)
    held = np.zeros((plane[0][some].shape[0], len(bits)))
    for j, p in enumerate(plane):
        for w in range(bits.shape[1]):
            held += np.bitwise_count(bits[None, :, w] & p[some, w, None]) * float(1 << j)
    return 2 * (low[some, None] * ones + step[some, None] * held) - total[some, None]


def choose(upper: np.ndarray, floor: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Which vectors each query reranks: those whose upper bound reaches its floor, and the k of the highest bounds; never its own."""
    upper = np.where(own, -np.inf, upper)
    least = np.partition(upper, upper.shape[1] - k, axis=1)[:, upper.shape[1] - k] if upper.shape[1] > k else np.full(len(upper), -np.inf)
    return (upper >= np.minimum(floor, least)[:, None]) & ~own


def upper_bounds(q: np.ndarray, row, centre: np.ndarray, width: float):
    """A function of a slice of the queries: upper bounds of their inner products with all vectors of one row of INDEX."""
    n, d = len(row["ids"]) // 8, q.shape[1]
    bits = words(np.frombuffer(row["codes"], np.uint8).reshape(n, -1))
    norm, agree = np.frombuffer(row["residual"], np.float32), np.frombuffer(row["agreement"], np.float32)
    length, base = np.sqrt((q * q).sum(1)), q @ centre
    scale = (norm / agree).astype(np.float64)
    off = width * norm * np.sqrt(np.maximum(1 - agree**2, 0) / (agree**2 * max(d - 1, 1))) + 1e-5 * norm
    query = planes(q @ _turn(d).astype(np.float64))
    lost = query[4] * min(1.0, width / math.sqrt(d))
    return lambda some: base[some, None] + sign_sums(bits, query, some) * (scale / np.sqrt(d)) + length[some, None] * off + lost[some, None] * scale


def best_of_chunk(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, row, centre: np.ndarray, kind: str, k: int, width: float):
    """(query's place, vec_id, score) of the k best of each query in one row of INDEX."""
    ids, d = np.frombuffer(row["ids"], np.int64), q.shape[1]
    n = len(ids)
    exact = np.frombuffer(row["vectors"], kind).reshape(n, d).astype(np.float64)
    length, most, out = np.sqrt((q * q).sum(1)), np.sqrt((exact * exact).sum(1).max()), []
    upper = upper_bounds(q, row, centre, width)
    for at in range(0, len(q), 64):
        some = slice(at, at + 64)
        chosen = choose(upper(some), floor[some], q_ids[some, None] == ids, k)
        if chosen.mean() > 1 / 8:  # one product for all is faster than the chosen pairs one by one
            product = np.where(chosen, q[some] @ exact.T, -np.inf)
            least = np.partition(product, n - k, axis=1)[:, n - k] if n > k else np.full(len(product), -np.inf)
            chosen &= product >= (least - 1e-12 * length[some] * most)[:, None]  # ties of the k-th stay
        i, j = np.nonzero(chosen)
        score = np.einsum("ij,ij->i", q[at + i], exact[j])
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        kept = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((at + i[kept], ids[j[kept]], score[kept]))
    return tuple(np.concatenate(c) for c in zip(*out))


def rounds(units: int) -> list[tuple[int, int]]:
    """Ranges of a query's chunks by their place among those that it reads: a few, then ``GROWTH`` times as many in all, until there are ``units``."""
    edges = [0, NEAREST]
    while edges[-1] < units:
        edges.append(edges[-1] * GROWTH)
    return list(zip(edges, edges[1:]))


def first_places(q: np.ndarray, reads: np.ndarray, centre: np.ndarray, radius: np.ndarray, chunks: np.ndarray, epsilon: float) -> np.ndarray:
    """How many chunks each query reads before those of each list: lists of the highest bounds come first, those that it doesn't read last."""
    bound = q @ centre.T + epsilon * np.sqrt((q * q).sum(1))[:, None] * radius / np.sqrt(q.shape[1])
    order = np.argsort(np.where(reads, -bound, np.inf), axis=1, kind="stable")
    size = np.take_along_axis(np.where(reads, chunks, 0), order, 1)
    before = np.empty_like(size)
    np.put_along_axis(before, order, np.cumsum(size, axis=1) - size, 1)
    return before


def search(index: Index, queries: DataFrame, kind: str, k: int = K, epsilon: float = EPSILON, width: float = RERANK, block: int = QUERIES) -> DataFrame:
    """query, query_id, rank, vec_id, score: the k nearest rows of the index of each row (vec_id, vec)."""
    queries = written(queries.select("vec_id", "vec", F.monotonically_increasing_id().alias("query")), "queries")
    blocks = max(1, -(-queries.count() // block))
    # two numbers for each list reach the driver, and there is a bounded number of lists
    found = index.rows.groupBy("size", "list").agg(F.max("radius").alias("radius"), (F.max("chunk") + 1).alias("chunks")).collect()
    radius = {s: np.full(len(c), -np.inf) for s, c in index.centres.items()}
    chunks_of = {s: np.zeros(len(c), np.int64) for s, c in index.centres.items()}
    for r in found:
        radius[r["size"]][r["list"]], chunks_of[r["size"]][r["list"]] = r["radius"], r["chunks"]
    centres, sample, count = index.centres, index.sample, index.count

    def read_in(low: int, high: int, best: DataFrame | None) -> DataFrame:
        """What is found in the chunks whose places among a query's are in the range, if it comes before the k-th in ``best``."""

        def route(batches):
            for batch in batches:
                ids, vec, numbers, score, last = (batch.column(c).to_pylist() for c in range(5))
                for s in {len(v) for v in vec} & set(centres):
                    own = np.array([i for i, v in enumerate(vec) if len(v) == s])
                    for at in (own[i : i + QUERIES] for i in range(0, len(own), QUERIES)):
                        q, q_ids = matrix([vec[i] for i in at], kind), np.array([ids[i] for i in at], np.int64)
                        floor, reads = reading(q, q_ids, sample[s], count[s], centres[s], radius[s], k, epsilon)
                        before = first_places(q, reads, centres[s], radius[s], chunks_of[s], epsilon)
                        i, lists = np.nonzero(reads & (before < high) & (before + chunks_of[s] > low))
                        columns = [pa.array(np.full(len(i), s, np.int32)), pa.array(lists.astype(np.int32)), pa.array([numbers[j] for j in at[i]], pa.int64())]
                        columns += [pa.array(q_ids[i]), pa.array(floor[i]), pa.array(before[i, lists]), pa.array([score[j] for j in at[i]], pa.float64())]
                        columns += [pa.array([last[j] for j in at[i]], pa.int64()), pa.array([vec[j] for j in at[i]], pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["size", "list", *ASKED])

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    qs = [q for q in row["qs"] if low <= q["before"] + row["chunk"] < high]
                    if not qs:
                        continue
                    x = matrix([q["vec"] for q in qs], kind)
                    numbers, q_ids, last = (np.array([q[c] for q in qs], np.int64) for c in ("query", "vec_id", "last"))
                    floor, least = (np.array([q[c] for q in qs], np.float64) for c in ("floor", "least"))
                    at, ids, score = best_of_chunk(x, q_ids, floor, row, centres[row["size"]][row["list"]], kind, k, width)
                    kept = (score > least[at]) | (score == least[at]) & (ids < last[at])
                    at, ids, score = at[kept], ids[kept], score[kept]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers[at]), pa.array(q_ids[at]), pa.array(ids), pa.array(score)], ["query", "query_id", "vec_id", "score"]
                    )

        if best is None:
            asked = queries.select("*", F.lit(-np.inf).alias("least"), F.lit(0).cast("bigint").alias("last"))
        else:
            kth = best.where(F.col("rank") == k).select("query", F.col("score").alias("least"), F.col("vec_id").alias("last"))
            asked = queries.join(kth, "query", "left").select(
                "vec_id", "vec", "query", F.coalesce("least", F.lit(-np.inf)).alias("least"), F.coalesce("last", F.lit(0)).alias("last")
            )
        routed = asked.mapInArrow(
            route, "size int, list int, query bigint, vec_id bigint, floor double, before bigint, least double, last bigint, vec binary"
        )
        place = F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("block")
        packed = routed.groupBy("size", "list", place).agg(F.collect_list(F.struct(*ASKED)).alias("qs"))  # a block is of bounded size
        chunks = index.rows.select("size", "list", "chunk")
        pairs = packed.join(chunks, ["size", "list"]).join(index.rows, ["size", "list", "chunk"])
        return pairs.mapInArrow(run, "query bigint, query_id bigint, vec_id bigint, score double")

    order, best = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id"), None
    for low, high in rounds(max((int(c.sum()) for c in chunks_of.values()), default=0)):
        if best is not None:
            best = written(best, "best")
        found = read_in(low, high, best)
        found = found if best is None else best.drop("rank").unionByName(found)
        best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: the 20 nearest of every vector whose vec_id is divisible by 20, among all others."""
    rows = table(spark, sf_dir, "embeddings")
    kind = component_type(rows)
    known = written(as_bytes(rows).where("vec IS NOT NULL"), "vectors")
    found = search(build_index(known, kind), known.where(F.col("vec_id") % QUERY_STEP == 0), kind)
    return found.select("query_id", "rank", "vec_id", "score")
