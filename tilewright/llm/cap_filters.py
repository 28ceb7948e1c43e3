"""Near-duplicate vectors by spherical-cap filters from structured random product codes.

A filter is a direction: a pair of codewords, one for either half of a randomly rotated vector. A
vector passes the filters whose inner product with it exceeds a threshold, found by list decoding:
the codewords of one half are sorted, so only sums that can pass are looked at, and never all pairs
of codewords. Several independent codes are used, and a vector takes its few best filters of a code
where fewer pass. Vectors are shuffled on their filters and compared in double precision there. A
pair counts at its first common filter only.

Exact copies are one vector with a count. Filters with many vectors are split into blocks, and the
pairs of blocks are tasks of their own; a task gives each vector's number of links and a star for
what is connected, never pairs. What can be missed are pairs without a common filter. A code misses
more of them the more codewords it has, so the number of codes follows from the share that a code
misses of made pairs at exactly the cosine asked for: the expected share that all codes miss is at
most ``MISSED`` for any number of vectors, and falls fast above that cosine (tests measure it).

Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so
do rows of null vec_id; vectors of different sizes don't link. Rows that repeat a vec_id are vectors
of their own with that id. Ties and extra columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.graph import components, local_roots
from tilewright.llm.vectors import as_bytes, component_type, matrix, rotation, unit
from tilewright.session import cut_lineage, table, written

COSINE = 0.95
CODES = 3
PASSED = 9
LEAST = 4
MISSED = 2e-4
BLOCK = 1024
#: Vectors of a filter up to which many filters are compared at once.
FEW = 48
SEED = 5


def codewords_for(n: int) -> int:
    """Codewords of a half so that filters grow with the vectors: a power of two near the root of n."""
    return int(np.clip(1 << int(np.ceil(np.log2(max(n, 1)) / 2)), 16, 1 << 15))


@functools.lru_cache(maxsize=64)
def cap(d: int, share: float) -> float:
    """The inner product with a direction that a share of all unit vectors of size d exceeds.

    Its angle's density is proportional to cos^(d-2); the tail is summed from the far end, so that
    tiny shares come out right.
    """
    angle = np.linspace(np.pi / 2, -np.pi / 2, 200_001)
    density = np.cos(angle) ** (d - 2)
    tail = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return float(np.sin(np.interp(share, tail / tail[-1], angle)))


class Code:
    """Directions for vectors of one size; the same for the same arguments everywhere."""

    def __init__(self, d: int, words: int, number: int, seed: int = SEED, passed: int = PASSED):
        self.d, rng = max(d, 2), np.random.default_rng([seed, number, d])
        half = self.d // 2
        self.words = min(words, 2 ** min(half + 1, 15))  # few dimensions have few directions to tell apart
        self.turn = rotation(self.d, seed * 1000 + number).astype(np.float32)
        parts = [rng.standard_normal((self.words, size)) for size in (half, self.d - half)]
        self.parts = [(p / np.linalg.norm(p, axis=1, keepdims=True) / np.sqrt(2)).astype(np.float32) for p in parts]
        self.threshold = np.float32(cap(self.d, passed / self.words**2))

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        x = np.pad(x, ((0, 0), (0, self.d - x.shape[1]))).astype(np.float32) @ self.turn
        half = self.parts[0].shape[1]
        return [x[:, :half] @ self.parts[0].T, x[:, half:] @ self.parts[1].T]

    def decode(self, x: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) of unit vectors: all filters that pass, and the ``least`` best of each row."""
        a, b = self.scores(x)
        k = min(least, self.words)
        reach = (b >= self.threshold - a.max(1, keepdims=True) - 1e-5).sum(1)  # no other codewords can pass
        order = _best(b, max(k, int(reach.max(initial=0))))
        ranked = np.take_along_axis(b, order, 1)
        row, i = np.nonzero(a >= self.threshold - ranked[:, :1])
        rows, filters, at = [], [], 0
        while len(row) and at < order.shape[1]:
            going = a[row, i] + ranked[row, at] >= self.threshold
            row, i = row[going], i[going]
            rows.append(row)
            filters.append(i * self.words + order[row, at])
            at += 1
        best = _best(a, k)  # the best sums lie among the k best of either half
        sums = (np.take_along_axis(a, best, 1)[:, :, None] + ranked[:, None, :k]).reshape(len(x), -1)
        top = np.argsort(-sums, axis=1, kind="stable")[:, :k]
        r = np.repeat(np.arange(len(x)), k)
        top = top.ravel()
        rows.append(r)
        filters.append(best[r, top // k] * self.words + order[r, top % k])
        found = np.unique(np.concatenate(rows) * np.int64(self.words) ** 2 + np.concatenate(filters))
        return found // self.words**2, found % self.words**2


def _best(x: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, the largest first."""
    some = np.sort(np.argpartition(-x, k - 1, axis=1)[:, :k], axis=1)
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(x, some, 1), axis=1, kind="stable"), 1)


@functools.lru_cache(maxsize=64)
def code(d: int, words: int, number: int) -> Code:
    return Code(d, words, number)


def pairs_at(cosine: float, d: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unit vectors at exactly a cosine, in all directions alike."""
    rng = np.random.default_rng([seed, d])
    a = unit(rng.standard_normal((n, d)))
    b = rng.standard_normal((n, d))
    return a, cosine * a + np.sqrt(1 - cosine**2) * unit(b - (b * a).sum(1, keepdims=True) * a)


@functools.lru_cache(maxsize=64)
def codes_for(d: int, words: int, cosine: float = COSINE, missed: float = MISSED) -> int:
    """Codes that together miss at most a share ``missed`` of the pairs at a cosine, from what single codes miss."""
    if d < 2:
        return 1  # one direction and its opposite
    n, step, alone = 1000, 125, 0
    a, b = pairs_at(cosine, d, n, SEED)
    for number in range(CODES):
        c = code(d, words, number)
        for at in range(0, n, step):
            (r, f), (s, g) = c.decode(a[at : at + step]), c.decode(b[at : at + step])
            common = np.intersect1d(r * np.int64(c.words) ** 2 + f, s * np.int64(c.words) ** 2 + g)
            alone += min(step, n - at) - len(np.unique(common // c.words**2))
    return int(np.ceil(np.log(missed) / np.log((alone + 0.5) / (CODES * n + 1))))


def filters_of(
    vectors: list[bytes], kind: str, words: int, codes: int, cosine: float = COSINE, needed: dict[int, int] | None = None
) -> list[np.ndarray]:
    """The filters of each vector by ``codes`` codes or as many as are needed, ascending; sizes and codes have filters of their own.

    ``needed`` has the codes of each size, where they are known already.
    """
    out: list = [None] * len(vectors)
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        x = unit(matrix([vectors[i] for i in at], kind))
        rows, found = [], []
        d = x.shape[1]
        for c in range(max(codes, needed[d] if needed else codes_for(d, words, cosine))):
            r, f = code(x.shape[1], words, c).decode(x)
            rows.append(r)
            found.append((np.int64(x.shape[1]) * 4096 + c << 31) + f)
        r, f = np.concatenate(rows), np.concatenate(found)
        order = np.lexsort((f, r))
        for i, own in zip(at, np.split(f[order], np.cumsum(np.bincount(r, minlength=len(at)))[:-1])):
            out[i] = own
    return out


def _listed(distinct: DataFrame, kind: str, words: int, codes: int, cosine: float) -> DataFrame:
    """Each vector with the list of its filters."""
    sizes = [r["n"] for r in distinct.select((F.length("vec") / int(kind[2:])).cast("int").alias("n")).distinct().collect()]
    needed = {d: codes_for(d, words, cosine) for d in sizes}  # measured once, here

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                own = filters_of(batch.column(2).to_pylist(), kind, words, codes, cosine, needed)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f.tobytes() for f in own], pa.binary())], ["id", "copies", "vec", "filters"])

    return distinct.mapInArrow(run, "id bigint, copies bigint, vec binary, filters binary")


def _emit(listed: DataFrame) -> DataFrame:
    """A row for each vector and filter, with all that a comparison needs: the vector, and the filters before this one."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                own = batch.column(3).to_pylist()
                each = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), [len(f) // 8 for f in own])))
                before = pa.array([f[:k] for f in own for k in range(0, len(f), 8)], pa.binary())
                names = ["filter", "id", "copies", "vec", "filters"]
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(own), np.int64)), *each.columns[:3], before], names)

    return listed.mapInArrow(run, "filter bigint, id bigint, copies bigint, vec binary, filters binary")


def _count(listed: DataFrame) -> DataFrame:
    """filter, n: vectors of each filter."""

    def run(batches):
        for batch in batches:
            found, n = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], ["filter", "n"])

    return listed.select("filters").mapInArrow(run, "filter bigint, n bigint").groupBy("filter").agg(F.sum("n").alias("n"))


def _first_common(lists: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) have no common filter in their lists."""
    own = [np.frombuffer(x, np.int64) for x in lists]
    if len(i) > 50_000:
        found, column = np.unique(np.concatenate(own), return_inverse=True)
        row = np.repeat(np.arange(len(own)), [len(f) for f in own])
        common = np.zeros((len(own), len(own)), bool)
        for at in range(0, len(found), 2048):
            some = (column >= at) & (column < at + 2048)
            m = np.zeros((len(own), 2048), np.float32)
            m[row[some], column[some] - at] = 1
            common |= (m @ m.T) > 0
        return ~common[i, j]
    width = max(map(len, own), default=0)
    left, right = np.full((len(own), width), -1), np.full((len(own), width), -2)
    for k, f in enumerate(own):
        left[k, : len(f)] = right[k, : len(f)] = f
    seen = np.zeros(len(i), bool)
    for c in range(width):
        seen |= (right[j] == left[i, c][:, None]).any(1)
    return ~seen


def _compare(x: np.ndarray, copies: np.ndarray, lists: list[bytes], block: np.ndarray, cosine: float):
    """Links (with copies) and root of each row of one filter, or None without links."""
    near = x @ x.T >= cosine
    if (block != block[0]).any():  # a task for two blocks: pairs inside a block are another task's
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    if not len(i):
        return None
    first = _first_common(lists, i, j)
    i, j = i[first], j[first]
    links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
    return links.astype(np.int64), local_roots(len(x), i, j)


def _near_in_groups(vectors: list[bytes], group: np.ndarray, block: np.ndarray, kind: str, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of one group at the cosine; rows of a group follow each other, and many small groups are compared at once.

    In a group of two blocks only pairs between them count: those within one are another task's.
    """
    size, found = np.array([len(v) for v in vectors]), []
    starts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
    mixed = np.repeat(np.maximum.reduceat(block, starts) != np.minimum.reduceat(block, starts), np.diff([*starts, len(group)]))
    for s in np.unique(size):
        rows = np.flatnonzero(size == s)
        x, g, lag = unit(matrix([vectors[r] for r in rows], kind)), group[rows], 1
        at = np.arange(len(rows))
        while len(at := at[at + lag < len(rows)]) and len(at := at[g[at] == g[at + lag]]):
            for k in range(0, len(at), 100_000):
                i = at[k : k + 100_000]
                near = np.einsum("ij,ij->i", x[i], x[i + lag]) >= cosine
                i, j = rows[i[near]], rows[i[near] + lag]
                good = ~mixed[i] | (block[i] != block[j])
                found.append((i[good], j[good]))
            lag += 1
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _first_of_pairs(lists: dict[int, bytes], i: np.ndarray, j: np.ndarray, step: int = 20_000) -> np.ndarray:
    """Which of the pairs (i, j) have no common filter in their lists."""
    out = []
    for at in range(0, len(i), step):
        ends = [np.frombuffer(lists[r], np.int64) for r in np.concatenate([i[at : at + step], j[at : at + step]]).tolist()]
        n = len(ends) // 2
        pair, own = np.repeat(np.arange(len(ends)) % n, [len(e) for e in ends]), np.concatenate(ends)
        order = np.lexsort((own, pair))
        pair, own = pair[order], own[order]
        again = (pair[1:] == pair[:-1]) & (own[1:] == own[:-1])
        out.append(~np.isin(np.arange(n), pair[1:][again]))
    return np.concatenate(out)


def _verified(rows: DataFrame, kind: str, cosine: float) -> DataFrame:
    """id, links, root from rows sorted by (filter, part)."""
    names = ["filter", "part", "block", "id", "copies", "vec", "filters"]

    def compare_all(held: list[pa.RecordBatch], upto: int):
        t = pa.Table.from_batches(held).slice(0, upto).combine_chunks()
        if not t.num_rows:
            return
        f, part, block, ids, copies = (t[c].to_numpy() for c in names[:5])
        cuts = np.flatnonzero((np.diff(f) != 0) | (np.diff(part) != 0)) + 1
        bounds = np.concatenate([[0], cuts, [len(f)]])
        vec, lists = t["vec"], t["filters"]
        out = []
        size = np.diff(bounds)
        few = np.flatnonzero((size > 1) & (size <= FEW))
        if len(few):
            rows = np.concatenate([np.arange(a, b) for a, b in zip(bounds[few], bounds[few + 1])])
            group = np.repeat(few, size[few])
            i, j = _near_in_groups(vec.take(pa.array(rows)).to_pylist(), group, block[rows], kind, cosine)
            if len(i):
                some = np.unique(np.concatenate([i, j]))
                own = dict(zip(some.tolist(), lists.take(pa.array(rows[some])).to_pylist()))
                first = _first_of_pairs(own, i, j)
                i, j = i[first], j[first]
                links = np.bincount(i, copies[rows[j]], len(rows)) + np.bincount(j, copies[rows[i]], len(rows))
                root, some = local_roots(len(rows), i, j), np.flatnonzero(links)
                out.append((ids[rows[some]], links[some].astype(np.int64), ids[rows[root[some]]]))
        for g in np.flatnonzero(size > FEW):
            a, b = bounds[g], bounds[g + 1]
            x = unit(matrix(vec.slice(a, b - a).to_pylist(), kind))
            near = _compare(x, copies[a:b], lists.slice(a, b - a).to_pylist(), block[a:b], cosine)
            if near is not None:
                links, root = near
                some = np.flatnonzero(links)
                out.append((ids[a:b][some], links[some], ids[a:b][root[some]]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["id", "links", "root"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                held.append(piece)
                size += piece.num_rows
                last = piece.slice(piece.num_rows - 1)
                key = (last["filter"][0], last["part"][0])
                own = 0  # rows of the last filter, which may go on
                for b in reversed(held):
                    same = (b["filter"].to_numpy() == key[0].as_py()) & (b["part"].to_numpy() == key[1].as_py())
                    own += int(same.sum())
                    if not same.all():
                        break
                if size - own:
                    yield from compare_all(held, size - own)
                    rest = pa.Table.from_batches(held).slice(size - own).combine_chunks()
                    held, size = rest.to_batches(), own
        if held:
            yield from compare_all(held, size)

    return rows.select(*names).mapInArrow(run, "id bigint, links bigint, root bigint")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, codes: int = CODES, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    kind = component_type(vectors)
    every = written(as_bytes(vectors), "vectors")
    known = every.where("vec IS NOT NULL")
    grouped = known.groupBy("vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))
    distinct = written(grouped.select("id", "copies", "vec"), "distinct-vectors")
    words = codewords_for(distinct.count())
    listed = written(_listed(distinct, kind, words, codes, cosine), "filters")
    large = _count(listed).where(F.col("n") > 2 * block)
    # a table, so Spark knows its size and broadcasts it where that is small
    blocks = written(large.select("filter", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "large-filters")
    rows = _emit(listed).join(blocks, "filter", "left")
    mine = F.pmod(F.xxhash64("id"), "blocks").cast("int")
    rows = rows.withColumn("block", F.coalesce(mine, F.lit(0)))
    # a task for each two blocks of a large filter, and for each block with itself
    others = F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)
    rows = rows.withColumn("other", F.explode(others)).withColumn(
        "part", F.least("block", "other") * F.coalesce("blocks", F.lit(1)) + F.greatest("block", "other")
    )
    dealt = rows.repartition("filter", "part").sortWithinPartitions("filter", "part")
    found = cut_lineage(_verified(dealt, kind, cosine).groupBy("id", "root").agg(F.sum("links").alias("links")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    each = distinct.join(links, "id", "left").join(roots, "id", "left")
    each = each.select("vec", "id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "id").alias("root"))
    least = each.groupBy("root").agg(F.min("id").alias("component_id"))
    result = known.join(each.join(least, "root").select("vec", "n_links", "component_id"), "vec")
    result = result.select("vec_id", "n_links", "component_id")
    alone = every.where("vec IS NULL").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = result.unionByName(alone)
    return result.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: links and components of all embeddings at a cosine of 0.95."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: The same by comparing all pairs.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / sqrt(list_inner_product(a.e, a.e) * list_inner_product(b.e, b.e)) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.a = e.vec_id LEFT JOIN degree d ON d.a = e.vec_id
"""
