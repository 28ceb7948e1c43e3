"""Hard negatives of anchors, found in cover trees over norm-augmented candidates.

Components are scaled and rounded down, so scores are integers. Each candidate gets one more component,
the root of M^2 - |x|^2 for the largest norm M, so that all have one length; then the inner product with an
anchor q is (|q|^2 + M^2 - D^2) / 2 for the distance D between them, and distances to a node's centre and
its covering radius bound all inner products below the node.

Candidates are dealt to chunks by label and nearest centre (centres are learned on a bounded sample), and
to several where many share both. A task builds the cover tree of a chunk: the levels' scales fall by
``STEP``, a node's children are a net of its points at the next scale, each within it of its own centre and
farther than it from the other centres, and every node knows its real covering radius. Children of few
points are kept in pages of the node, by distance from its centre, so a page is bounded from both sides.

Anchors are dealt to blocks. A block meets the trees of a group in one task and descends them best first:
nodes wait in the order of their greatest upper bound; a node is left for anchors whose window is outside
its bounds or whose k-th best so far can't be beaten; pages are verified exactly. What a bounded sample of
rows gives goes first, so that good scores are known from the start. Each tree gives the k best of a
query, and these are ranked once more. Blocks times groups of trees is the work, as all rows are asked
about all anchors; a tree whose root is outside all windows costs one bound.

Rows of null label, null vector, or null or non-finite components take no part, nor do those of null vec_id.
Vectors of different sizes don't meet. Zero and empty vectors take part. Rows with the anchor's own vec_id
are not its candidates; rows that repeat a vec_id are anchors and candidates of their own. Equal scores go by
vec_id; further equal rows in any order, as they are the same. Scores are exact; they saturate at the ends
of the 64-bit range. Other columns are ignored, and empty tables give nothing.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.session import table, written

SCALE = 256
ANCHOR_STEP = 100
#: Positives of an anchor, negatives of a positive, and the window of their scores in hundredths of the positive's.
POSITIVES = 5
NEGATIVES = 10
WINDOW = (30, 90)
#: Scales of the levels fall by this factor; points of a page, of a chunk; anchors of a block; trees of a group.
STEP = 1.3
PAGE = 64
CHUNK = 4096
BLOCK = 512
TREES = 4
#: Rows of the sample for centres and first scores, and its bytes at most.
SAMPLE = 4096
SAMPLE_BYTES = 1 << 23
CENTRES = 1024
_LOW, _HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max

ROWS = "vec_id bigint, label bigint, size int, vec binary"
TREE = "label bigint, size int, ids binary, vectors binary, nodes binary, pages binary, order binary"


def scaled(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, size, vec: floor(scale * component) as doubles, one row for each row that takes part."""

    def run(batches):
        for batch in batches:
            ids, labels, vectors = batch.columns
            x = vectors.flatten()
            values = x.to_numpy(zero_copy_only=False).astype(np.float64)
            size = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.concatenate([[0], np.cumsum(size)])
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.floor(scale * values) + 0.0
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(whole))])
            good = bad[ends[1:]] == bad[ends[:-1]]
            for c in batch.columns:
                good &= c.is_valid().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(good)
            vec = [whole[ends[i] : ends[i + 1]].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), labels.take(pa.array(at)), pa.array(size[at]), pa.array(vec, pa.binary())], ["vec_id", "label", "size", "vec"])

    return df.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"), "embedding").mapInArrow(run, ROWS)


def rows_of(vectors: bytes | list[bytes], n: int) -> np.ndarray:
    joined = vectors if isinstance(vectors, bytes) else b"".join(vectors)
    return np.frombuffer(joined, np.float64).reshape(n, -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, saturated."""
    most = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * max(q.shape[1], 1)
    if most < 2**53:
        return (q @ x.T).astype(np.int64)
    a, b = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x))
    if not q.shape[1]:
        return np.zeros((len(q), len(x)), np.int64)
    return np.clip(a @ b.T, _LOW, _HIGH).astype(np.int64)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with one component more, so that all have the length ``most``."""
    return np.column_stack([x, np.sqrt(np.maximum(most * most - (x * x).sum(1), 0))])


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - c) ** 2).sum(1))


def cover_tree(x: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, pages, order of the rows) of the cover tree of the rows of x.

    A node is (row of its centre, covering radius, parent), parents before children; a page is (node,
    first, last, least and greatest distance from the node's centre), its rows those of ``order``.
    """
    y = augmented(x, most)
    length2 = (y * y).sum(1)
    nodes, pages, order = [], [], []
    first = _distances(y, y[0])
    waiting = [(0, np.arange(len(y)), first, float(first.max(initial=0)), -1)]
    while waiting:
        centre, points, far, scale, parent = waiting.pop()
        number, radius = len(nodes), float(far.max())
        nodes.append((centre, radius, parent))
        rest = points
        if len(points) > PAGE and radius > 0:
            scale = min(scale, radius) / STEP
            # a net at this scale: the node's own centre, then points farther than it from all centres before
            nearest, owner, centres = far.copy(), np.zeros(len(points), np.int64), [centre]
            here, own2 = y[points], length2[points]
            while nearest.max() > scale:
                i = int(nearest.argmax())
                own = np.sqrt(np.maximum(own2 + own2[i] - 2 * (here @ here[i]), 0))  # good enough to choose by
                own[i] = 0
                closer = own < nearest
                nearest[closer], owner[closer] = own[closer], len(centres)
                centres.append(points[i])
            count = np.bincount(owner, minlength=len(centres))
            for k in np.flatnonzero(count > PAGE):
                mine = points[owner == k]
                waiting.append((centres[k], mine, _distances(y[mine], y[centres[k]]), scale, number))
            rest = points[count[owner] <= PAGE]
        away = _distances(y[rest], y[centre])
        by = np.argsort(away, kind="stable")
        for at in range(0, len(rest), PAGE):
            some = by[at : at + PAGE]
            pages.append((number, len(order), len(order) + len(some), away[some[0]], away[some[-1]]))
            order += rest[some].tolist()
    return np.array(nodes, np.float64).reshape(-1, 3), np.array(pages, np.float64).reshape(-1, 5), np.array(order, np.int64)


class Best:
    """The k best (score, vec_id) of queries with windows [low, high], kept in order."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.low, self.high, self.k = low, high, k
        self.score = np.full((len(low), k), _LOW)
        self.ids = np.full((len(low), k), _HIGH)
        self.known = np.zeros((len(low), k), bool)
        #: A score that the k-th best reaches at least.
        self.floor = low.copy()

    def add(self, some: np.ndarray, score: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Candidates ``ids`` with their scores for the queries ``some`` (a row each)."""
        fits = allowed & (score >= self.floor[some, None]) & (score <= self.high[some, None])
        rows = np.flatnonzero(fits.any(1))
        if not len(rows):
            return
        at = some[rows]
        s = np.concatenate([self.score[at], score[rows]], axis=1)
        v = np.concatenate([self.ids[at], np.broadcast_to(ids, (len(rows), len(ids)))], axis=1)
        ok = np.concatenate([self.known[at], fits[rows]], axis=1)
        # three stable sorts: what fits first, then by score, then by id
        order = np.argsort(v, axis=1, kind="stable")
        for key in (lambda o: ~np.take_along_axis(s, o, 1), lambda o: ~np.take_along_axis(ok, o, 1)):
            order = np.take_along_axis(order, np.argsort(key(order), axis=1, kind="stable"), 1)
        order = order[:, : self.k]
        self.score[at], self.ids[at], self.known[at] = (np.take_along_axis(m, order, 1) for m in (s, v, ok))
        full = self.known[at, -1]
        self.floor[at[full]] = np.maximum(self.floor[at[full]], self.score[at[full], -1])


def descend(tree: dict, most: float, q: np.ndarray, of: np.ndarray, own: np.ndarray, best: Best, asked: np.ndarray) -> int:
    """Adds what a tree holds to ``best``; how many rows it has verified.

    ``q`` are the anchors, ``of`` is each query's anchor, ``own`` its vec_id, ``asked`` the queries that the tree is for.
    """
    if not len(asked):
        return 0
    n = len(tree["ids"])
    x, ids, nodes, pages, order = tree["x"], tree["ids"], tree["nodes"], tree["pages"], tree["order"]
    length2, full, seen = (q * q).sum(1), most * most, 0
    children: dict[int, list[int]] = {}
    for i, parent in enumerate(nodes[:, 2].astype(int)):
        children.setdefault(parent, []).append(i)
    own_pages: dict[int, list[int]] = {}
    for i, node in enumerate(pages[:, 0].astype(int)):
        own_pages.setdefault(node, []).append(i)
    slack = 1 + 1e-9 * (full + length2)  # of rounding

    def to_centres(numbers: list[int], anchors: np.ndarray) -> np.ndarray:
        """Distances of anchors to the nodes' centres, with the further component: zero for an anchor."""
        inner = q[anchors] @ x[nodes[numbers, 0].astype(int)].T
        return np.sqrt(np.maximum(length2[anchors, None] + full - 2 * inner, 0))

    def bounds(anchors: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of inner products at such distances."""
        at = length2[anchors] + full
        return (at - greatest**2) / 2 - slack[anchors], (at - np.maximum(least, 0) ** 2) / 2 + slack[anchors]

    def open_for(some: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return some[(high >= best.floor[some]) & (low <= best.high[some])]

    waiting: list[tuple] = []

    def wait(kind: int, number: int, some: np.ndarray, anchors: np.ndarray, least: np.ndarray, greatest: np.ndarray, away: np.ndarray) -> None:
        low, high = bounds(anchors, least, greatest)
        place = np.searchsorted(anchors, of[some])
        left = open_for(some, low[place], high[place])
        if len(left):
            heapq.heappush(waiting, (-float(high.max()), len(waiting), kind, number, left, anchors, low, high, away))

    anchors = np.unique(of[asked])
    away = to_centres([0], anchors)[:, 0]
    wait(0, 0, asked, anchors, away - nodes[0, 1], away + nodes[0, 1], away)
    while waiting:
        _, _, kind, number, some, anchors, low, high, away = heapq.heappop(waiting)
        place = np.searchsorted(anchors, of[some])
        some = open_for(some, low[place], high[place])  # scores have risen meanwhile
        if not len(some):
            continue
        left = np.unique(of[some])
        away = away[np.searchsorted(anchors, left)]
        if kind:
            first, last = pages[number, 1:3].astype(int)
            rows = order[first:last]
            rows = rows[np.argsort(ids[rows], kind="stable")]
            score = products(q[left], x[rows])[np.searchsorted(left, of[some])]
            best.add(some, score, ids[rows], ids[rows] != own[some, None])
            seen += len(rows) * len(left)
            continue
        for p in own_pages.get(number, ()):
            near, far = pages[p, 3:5]
            wait(1, p, some, left, np.maximum(away - far, near - away), away + far, away)
        if below := children.get(number):
            to = to_centres(below, left)
            for c, a in zip(below, to.T):
                wait(0, c, some, left, a - nodes[c, 1], a + nodes[c, 1], a)
    return seen


def centres_of(x: np.ndarray, count: int) -> np.ndarray:
    """So many of a sample's rows, each the farthest from those before: the top of a cover tree over all."""
    at, far = [0], _distances(x, x[0])
    while len(at) < count and far.max() > 0:
        at.append(int(far.argmax()))
        far = np.minimum(far, _distances(x, x[at[-1]]))
    return x[at]


class Index:
    """Cover trees of all rows (``trees``, rows of TREE with a number), a sample and the largest norm, by size."""

    def __init__(self, known: DataFrame, chunk: int = CHUNK, sample: int = SAMPLE):
        stats = known.groupBy("size").agg(F.count("*").alias("n")).collect()
        self.count = {r["size"]: r["n"] for r in stats}
        self.most = self._largest(known)
        self.sample: dict[int, tuple[np.ndarray, ...]] = {}
        for size in self.count:
            take = max(1, min(sample, SAMPLE_BYTES // (8 * max(size, 1))))
            # spread over all rows by a hash; only so many reach the driver
            drawn = known.where(F.col("size") == size).orderBy(F.xxhash64("vec_id", "vec"), "vec_id").limit(take).toPandas()
            self.sample[size] = (drawn["vec_id"].to_numpy(np.int64), drawn["label"].to_numpy(np.int64), rows_of(drawn["vec"].tolist(), len(drawn)))
        self.chunk = chunk
        self.trees = written(self._trees(known), "cover-trees")

    @staticmethod
    def _largest(known: DataFrame) -> dict[int, float]:
        def run(batches):
            for batch in batches:
                size = batch.column(0).to_numpy()
                norm = np.array([math.sqrt(float((np.frombuffer(v) ** 2).sum())) for v in batch.column(1).to_pylist()])
                found = np.unique(size)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([float(norm[size == s].max()) for s in found])], ["size", "most"])

        most = known.select("size", "vec").mapInArrow(run, "size int, most double").groupBy("size").agg(F.max("most").alias("most"))
        return {r["size"]: r["most"] * (1 + 1e-12) for r in most.collect()}

    def _trees(self, known: DataFrame) -> DataFrame:
        most, centres = self.most, {}
        for size, (_, _, x) in self.sample.items():
            centres[size] = centres_of(augmented(x, most[size]), min(CENTRES, max(1, math.isqrt(self.count[size] // self.chunk))))

        def assign(batches):
            for batch in batches:
                size, vec = batch.column(2).to_numpy(), batch.column(3).to_pylist()
                cell = np.zeros(len(vec), np.int32)
                for s in np.unique(size):
                    at = np.flatnonzero(size == s)
                    y, c = augmented(rows_of([vec[i] for i in at], len(at)), most[s]), centres[s]
                    cell[at] = ((c * c).sum(1) - 2 * y @ c.T).argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], ["vec_id", "label", "size", "vec", "cell"])

        dealt = written(known.mapInArrow(assign, f"{ROWS}, cell int"), "cells")
        chunks = written(dealt.groupBy("size", "label", "cell").agg(F.ceil(F.count("*") / self.chunk).alias("chunks")), "chunks")

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("vec_id", kind="stable")
            size = int(rows["size"].iloc[0])
            x = rows_of(rows["vec"].tolist(), len(rows))
            made = dict(zip(("nodes", "pages", "order"), (m.tobytes() for m in cover_tree(x, most[size]))))
            made |= {"label": rows["label"].iloc[0], "size": size, "ids": rows["vec_id"].to_numpy(np.int64).tobytes(), "vectors": x.tobytes()}
            return pd.DataFrame({c.split()[0]: [made[c.split()[0]]] for c in TREE.split(", ")})

        place = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("chunks")).cast("int").alias("chunk")
        rows = dealt.join(chunks, ["size", "label", "cell"]).select("vec_id", "label", "size", "vec", "cell", place)
        return rows.groupBy("size", "label", "cell", "chunk").applyInPandas(build, TREE).withColumn("tree", F.monotonically_increasing_id())


def search(index: Index, anchors: DataFrame, queries: DataFrame, same: bool, k: int, block: int = BLOCK, trees: int = TREES) -> DataFrame:
    """The k best rows of each query: its number, rank, id, score.

    ``anchors`` has vec_id, number, label, size, vec; ``queries`` has number (its anchor's), positive, low and high: the
    window of the scores that it asks for. Candidates have the anchor's label (``same``) or another.
    """
    most, sample = index.most, index.sample
    n = max(1, -(-anchors.count() // block))
    groups = max(1, -(-index.trees.count() // trees))
    asked = queries.groupBy("number").agg(F.collect_list(F.struct("positive", "low", "high")).alias("asked"))
    packed = anchors.join(asked, "number").withColumn("block", F.pmod(F.xxhash64("number"), F.lit(n)))
    one = F.struct("number", "vec_id", "label", "vec", "asked")
    packed = written(packed.groupBy("size", "block").agg(F.collect_list(one).alias("rows")), "blocks")  # blocks are of a bounded size

    def prepared(rows: list[dict], size: int) -> tuple:
        q, own = rows_of([r["vec"] for r in rows], len(rows)), [(i, a) for i, r in enumerate(rows) for a in r["asked"]]
        of = np.array([i for i, _ in own], np.int64)
        column = lambda c: np.array([rows[i][c] for i, _ in own], np.int64)
        best = Best(np.array([a["low"] for _, a in own], np.int64), np.array([a["high"] for _, a in own], np.int64), k)
        label, ids = column("label"), column("vec_id")
        first, labels, x = sample[size]
        by = np.argsort(first, kind="stable")
        for at in range(0, len(by), 256):
            some = by[at : at + 256]
            fits = ((labels[some] == label[:, None]) == same) & (first[some] != ids[:, None])
            best.add(np.arange(len(own)), products(q, x[some])[of], first[some], fits)
        return q, of, ids, label, np.array([a["positive"] for _, a in own], np.int64), column("number"), best.floor

    def floors(batches):
        """Blocks with the scores that the sample gives for a start."""
        for batch in batches:
            for row in batch.to_pylist():
                floor = prepared(row["rows"], row["size"])[-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["size"]], pa.int32()), pa.array([row["block"]], pa.int64()), pa.array([floor.tobytes()], pa.binary())], ["size", "block", "floor"]
                )

    floored = packed.join(packed.select("size", "block", "rows").mapInArrow(floors, "size int, block bigint, floor binary"), ["size", "block"])
    names = [c.split()[0] for c in TREE.split(", ")]
    none = lambda c, kind: F.lit(None).cast(kind).alias(c)
    kinds = dict(c.split() for c in TREE.split(", "))
    sent = floored.select(
        F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(1).alias("kind"), *(F.col("size") if c == "size" else none(c, kinds[c]) for c in names), "rows", "floor"
    )
    held = index.trees.select(F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("kind"), *names, none("rows", packed.schema["rows"].dataType), none("floor", "binary"))

    def run(batches):
        at, mine = None, []
        for batch in batches:
            for i in range(batch.num_rows):  # one at a time: a block and its trees are held
                row = batch.slice(i, 1).to_pylist()[0]
                if row["group"] != at:
                    at, mine = row["group"], []
                if row["kind"] == 0:
                    ids = np.frombuffer(row["ids"], np.int64)
                    mine.append({
                        "label": row["label"], "size": row["size"], "ids": ids, "x": rows_of(row["vectors"], len(ids)), "order": np.frombuffer(row["order"], np.int64),
                        "nodes": np.frombuffer(row["nodes"]).reshape(-1, 3), "pages": np.frombuffer(row["pages"]).reshape(-1, 5),
                    })
                    continue
                rows, size = row["rows"], row["size"]
                q, own = rows_of([r["vec"] for r in rows], len(rows)), [(i, a) for i, r in enumerate(rows) for a in r["asked"]]
                of = np.array([i for i, _ in own], np.int64)
                ids, label, number = (np.array([rows[i][c] for i, _ in own], np.int64) for c in ("vec_id", "label", "number"))
                low, high, positive = (np.array([a[c] for _, a in own], np.int64) for c in ("low", "high", "positive"))
                best = Best(low, high, k)
                best.floor = np.frombuffer(row["floor"], np.int64).copy()
                for t in mine:
                    if t["size"] == size:
                        descend(t, most[size], q, of, ids, best, np.flatnonzero((label == t["label"]) == same))
                i, j = np.nonzero(best.known)
                columns = (number[i], positive[i], best.ids[i, j], best.score[i, j])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["number", "positive", "id", "score"])

    dealt = held.unionByName(sent).repartition("group").sortWithinPartitions("group", "kind")
    found = dealt.mapInArrow(run, "number bigint, positive bigint, id bigint, score bigint")
    order = Window.partitionBy("number", "positive").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW, chunk: int = CHUNK, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``scaled`` rows.

    ``anchor`` says which rows are anchors. The window is in hundredths of the positive's score.
    """
    known = written(rows, "scaled")
    index = Index(known, chunk, sample)
    anchors = written(known.where(anchor).withColumn("number", F.monotonically_increasing_id()), "anchors")
    open_ = anchors.select("number", F.lit(0).cast("bigint").alias("positive"), F.lit(_LOW).alias("low"), F.lit(_HIGH).alias("high"))
    first = search(index, anchors, open_, True, positives, block)
    p = written(first.select("number", F.col("rank").cast("bigint").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score").cast("decimal(38,0)")
    # low: the least whole number of at least that many hundredths; high: the greatest of at most
    low = F.ceil(score * window[0] / 100).cast("bigint")
    high = F.floor(score * window[1] / 100).cast("bigint")
    asked = p.select("number", "positive", low.alias("low"), high.alias("high")).where("low <= high")
    second = search(index, anchors, asked, False, negatives, block).select("number", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = second.join(p, ["number", "positive"]).join(anchors.select("number", F.col("vec_id").alias("anchor_id")), "number")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: hard negatives of the rows whose vec_id is divisible by 100."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine(scaled(moved), F.col("vec_id") % ANCHOR_STEP == 0)


#: The same in DuckDB, every anchor against every row.
SQL = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
), positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM positive p JOIN scored s USING (anchor_id) WHERE NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
