"""The trie of conversation prefixes, by peeling turns off from the deepest on.

A turn becomes a digest and the length of its text before anything is shuffled; texts are not. A
conversation becomes a path: the keys of its prefixes, each the digest of the key before and the turn,
from the root's on. Equal conversations are counted first and are one path from then on.

Paths are dealt by ranges, so that the members of a node stand together. A task takes a run of paths and
peels it: from the greatest depth up, it joins the paths that end at a depth with the nodes that survive
from the depth below, groups them by their key, adds up members, children, leaves and saved bytes, and
strips the last turn. All nodes of the run are found on the way, in one pass. A node that other runs may
share lies on the first or the last path of its run; such nodes are left open, and the two paths go on
to the next level with what hangs from their nodes. There are two for each run, so a level has a small
part of the paths of the one before, and the last level, of ``RUN`` paths at most, closes all nodes. A
prefix of very many conversations is spread over runs like any other. A path is one row (its keys take
16 bytes a turn).

Keys are 128 bits of a cryptographic hash, so different prefixes don't share one. The digest of the
conversations that end at a node reads their ids in order as a stream, in pieces: what many
conversations share is formatted in many tasks.

Conversations are rebuilt by ``rebuilt`` first: the first h turns of conversation c - c % 5 (with the sign of
c, as in SQL), then the conversation's own turns after its first h. Turns are ordered by turn, nulls
first; of equal turns that of the smaller digest comes first. Rows that repeat are turns of their own; rows
of null conv_id belong to no conversation; null roles and texts are empty. Other columns are ignored. An
empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import table, written

#: A conversation shares turns with the first of its group of so many; the number of turns is a hash by so many.
GROUP = 5
SHARED = 9
#: Paths, and bytes of their keys, that a task peels at once.
RUN = 4096
RUN_BYTES = 1 << 24
#: Paths of a run at least, however long, and of a partition on average, so that each level has fewer paths.
FEW = 8
PARTITION = 64

ROOT = bytes(16)
PATH = "path binary, sizes binary, n bigint, least bigint, hung binary"
NODE = "key binary, parent binary, depth int, conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint"
#: Sums that hang from a node: members, children, leaves, saved bytes; and the smallest member.
_SUMS, _LEAST, _NONE = 4, 4, np.iinfo(np.int64).max


def shared_turns(conv_id: int) -> int:
    """h: how many turns a conversation takes from the first of its group."""
    return zlib.crc32(str(conv_id).encode()) % SHARED


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text), size (of the text, in UTF-8), one row for each turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.octet_length(text).cast("bigint").alias("size")
    )


def rebuilt(turns: DataFrame) -> DataFrame:
    """conv_id, turns (digest, size): each conversation of ``digested`` turns with those that it shares."""
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "size"))).alias("t"))
    own = own.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["size"].alias("size"))).alias("own"))
    own = written(own, "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED)).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = own.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("first"), F.slice("own", 1, SHARED - 1).alias("head"))
    known = own.withColumns({"h": h, "first": first}).join(heads, "first", "left")
    start = F.slice(F.coalesce("head", F.array().cast(own.schema["own"].dataType)), F.lit(1), F.col("h"))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return known.select("conv_id", F.concat(start, rest).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path, sizes: the keys of a conversation's prefixes, and the bytes of each one's last text, from the root on."""

    def run(batches):
        for batch in batches:
            made, sizes = [], []
            for turns in batch.column(1).to_pylist():
                key, keys = ROOT, [ROOT]
                for t in turns:
                    key = hashlib.blake2b(key + t["digest"], digest_size=16).digest()
                    keys.append(key)
                made.append(b"".join(keys))
                sizes.append(np.array([0, *(t["size"] for t in turns)], np.int64).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary()), pa.array(sizes, pa.binary())], ["conv_id", "path", "sizes"])

    return conversations.select("conv_id", "turns").mapInArrow(run, "conv_id bigint, path binary, sizes binary")


def peel(rows: list[tuple], close: bool) -> tuple[dict[str, np.ndarray], list[tuple]]:
    """The nodes of a run of sorted paths (rows of PATH), and the paths that stay open, with what hangs from their nodes.

    With ``close`` no path stays open.
    """
    length = np.array([len(r[0]) // 16 for r in rows])
    start = np.cumsum(length) - length
    keys = np.frombuffer(b"".join(r[0] for r in rows), [("a", "<u8"), ("b", "<u8")])
    sizes = np.frombuffer(b"".join(r[1] for r in rows), np.int64)
    hung = np.zeros((len(keys), _SUMS + 1), np.int64)
    hung[:, _LEAST] = _NONE
    for i, r in enumerate(rows):
        if r[4] is not None:
            hung[start[i] : start[i] + length[i]] = np.frombuffer(r[4], np.int64).reshape(-1, _SUMS + 1)
        else:
            hung[start[i] + length[i] - 1, [0, _LEAST]] = r[2], r[3]
    whole = np.array([r[4] is not None for r in rows])
    by_length = np.argsort(-length, kind="stable")
    last = len(rows) - 1
    kept = [] if close else sorted({0, last})
    left = {i: np.zeros((length[i], _SUMS + 1), np.int64) for i in kept}
    for x in left.values():
        x[:, _LEAST] = _NONE

    def alike(i: np.ndarray, j, d: int) -> np.ndarray:
        return keys[start[i] + d] == keys[start[j] + d]

    out, path, held, alive = [], np.empty(0, np.int64), np.empty((0, _SUMS + 1), np.int64), 0
    for d in range(int(length.max()) - 1, -1, -1):
        while alive < len(rows) and length[by_length[alive]] > d:
            alive += 1
        new = by_length[:alive]
        new = new[(length[new] == d + 1) | whole[new]]  # paths that end here, and what hangs from open ones
        path = np.concatenate([path, new])
        held = np.concatenate([held, hung[start[new] + d]])
        order = np.argsort(path, kind="stable")
        path, held = path[order], held[order]
        if not len(path):
            continue
        first = np.flatnonzero(np.concatenate([[True], ~alike(path[1:], path[:-1], d)]))
        total = np.add.reduceat(held, first)
        total[:, _LEAST] = np.minimum.reduceat(held[:, _LEAST], first)
        path = path[first]
        for i in kept:
            if length[i] > d:
                mine = alike(path, i, d)
                if mine.any():  # not twice: where both paths share a node, it is the first one's
                    left[i][d] = total[mine][0]
                    path, total = path[~mine], total[~mine]
        leaf = total[:, 2] == 0
        total[leaf, 2] = 1
        size = sizes[start[path] + d] if len(path) else np.empty(0, np.int64)
        total[:, 3] += (total[:, 0] - 1) * size
        if len(path):
            out.append((np.full(len(path), d), path, total))
        held = total.copy()
        held[:, 1] = 1
    found = {}
    if out:
        depth, path, total = (np.concatenate(c) for c in zip(*out))
        at = start[path] + depth
        found = {"key": keys[at], "parent": keys[np.maximum(at - 1, 0)], "depth": depth, "total": total}
    return found, [(rows[i][0], rows[i][1], None, None, left[i].tobytes()) for i in kept]


def _runs(batches, run: int, run_bytes: int) -> Iterator[list[tuple]]:
    rows, size = [], 0
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            rows.append(row)
            size += len(row[0])
            if len(rows) >= run or size >= run_bytes and len(rows) >= FEW:
                yield rows
                rows, size = [], 0
    if rows:
        yield rows


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(keys), [None, pa.py_buffer(np.ascontiguousarray(keys))]).cast(pa.binary())


def level(sorted_paths: DataFrame, close: bool, run: int, run_bytes: int) -> DataFrame:
    """Nodes (rows of NODE) and open paths (rows of PATH, their ``key`` null) of sorted partitions of paths."""
    schema = f"{NODE}, {PATH}"
    names = [c.split()[0] for c in schema.split(", ")]

    def task(batches):
        for rows in _runs(batches, 1 << 62 if close else run, 1 << 62 if close else run_bytes):
            found, kept = peel(rows, close)
            if found:
                t, n = found["total"], len(found["depth"])
                columns = [_binary(found["key"]), _binary(found["parent"]), pa.array(found["depth"].astype(np.int32)), pa.array(t[:, _LEAST])]
                columns += [pa.array(t[:, 0]), *(pa.array(t[:, i]) for i in (1, 2, 3))]
                columns += [pa.nulls(n, kind) for kind in (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names)
            if kept:
                n = len(kept)
                columns = [pa.nulls(n, kind) for kind in (pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5)]
                columns += [pa.array(c, kind) for c, kind in zip(zip(*kept), (pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays(columns, names)

    return sorted_paths.mapInArrow(task, schema)


def trie(known: DataFrame, run: int = RUN, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The nodes (key, parent, depth, conv_id, n_convs, n_children, n_leaves, saved) of paths (rows of PATH, none twice).

    ``n_leaves`` and ``saved`` count a node's subtree with its top.
    """
    spark, nodes = known.sparkSession, []
    left = known.select(*(c.split()[0] for c in PATH.split(", ")))
    names = [c.split()[0] for c in PATH.split(", ")]
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        count = left.count()
        close = bool(nodes) and count <= run
        # the first level always deals its paths, as most of the work is there
        dealt = left.repartition(1) if close else left.repartitionByRange(max(1, min(most, count // PARTITION)), "path")
        done = written(level(dealt.sortWithinPartitions("path"), close, run, run_bytes), "trie")
        nodes.append(done.where("key IS NOT NULL").drop(*names))
        if close or not count:
            break
        left = done.where("key IS NULL").select(*names)
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out


def endings(known: DataFrame) -> DataFrame:
    """key, n, least, ends_sha256: how many of the conversations (conv_id, path) end at a node, the least, and their digest.

    The digest is of their ids in ascending order, joined by commas.
    """

    def listed(batches):
        """Pieces of the ids of a key, each with its first."""
        held, ids = None, []

        def piece():
            return pa.RecordBatch.from_pylist(
                [{"key": held, "first": ids[0], "n": len(ids), "piece": ",".join(map(str, ids))}],
                pa.schema([("key", pa.binary()), ("first", pa.int64()), ("n", pa.int64()), ("piece", pa.string())]),
            )

        for batch in batches:
            for key, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (key != held or len(ids) >= 10_000):
                    yield piece()
                    ids = []
                held = key
                ids.append(conv_id)
        if ids:
            yield piece()

    def digests(batches):
        held, state, n, least = None, None, 0, None
        schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for key, first, count, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if key != held or state is None:
                    if state is not None:
                        out.append({"key": held, "n": n, "least": least, "ends_sha256": state.hexdigest()})
                    held, state, n, least = key, hashlib.sha256(piece.encode()), count, first
                else:
                    state.update(b"," + piece.encode())
                    n += count
            yield pa.RecordBatch.from_pylist(out, schema)
            # pieces of the batch's last key may follow
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"key": held, "n": n, "least": least, "ends_sha256": state.hexdigest()}], schema)

    ends = known.select(F.substring("path", -16, 16).alias("key"), "conv_id")
    pieces = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(listed, "key binary, first bigint, n bigint, piece string")
    return pieces.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digests, "key binary, n bigint, least bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame, run: int = RUN, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns): conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    known = written(paths(conversations), "paths")
    ended = written(endings(known), "endings")
    # one row for each different conversation; the last key stands for the whole path
    some = known.select(F.substring("path", -16, 16).alias("key"), "path", "sizes").dropDuplicates(["key"]).join(ended, "key")
    nodes = written(trie(some.select("path", "sizes", "n", "least", F.lit(None).cast("binary").alias("hung")), run, run_bytes), "nodes")
    # parents have children: few of the nodes stand on this side
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    found = nodes.withColumn("parent", F.when(F.col("depth") > 0, F.col("parent"))).join(parents, "parent", "left").join(ended.select("key", "ends_sha256"), "key", "left")
    return found.select(
        "conv_id", F.col("depth").cast("bigint").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the trie of all conversations, rebuilt with shared first turns."""
    return prefix_trie(rebuilt(digested(table(spark, sf_dir, "conversations"))))


#: The same in DuckDB: every prefix of every conversation, grouped; subtrees by the prefixes of each node.
SQL = r"""
WITH own AS (
  SELECT conv_id AS c, list(struct_pack(d := md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')), s := strlen(coalesce(text, ''))::BIGINT)
      ORDER BY turn NULLS FIRST, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc AS (  -- byte by byte, bit by bit
  SELECT c, t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda v, i: xor(v >> 1, 3988292384 * (v & 1))))) % 9 AS h FROM own
), whole AS (
  SELECT a.c, list_concat(coalesce(b.t, [])[1:a.h], a.t[a.h + 1:]) AS t FROM crc a LEFT JOIN crc b ON b.c = a.c - a.c % 5
), prefix AS (
  SELECT c, d, list_transform(t[1:d], lambda x: x.d) AS p, CASE WHEN d > 0 THEN t[d].s ELSE 0 END AS s, d = len(t) AS ended
  FROM whole, unnest(range(len(t) + 1)) AS u(d)
), node AS (
  SELECT d, p, min(c) AS conv_id, count(*) AS n, any_value(s) AS s, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ended), '') AS ends FROM prefix GROUP BY d, p
), kids AS (
  SELECT p[1:d - 1] AS p, count(*) AS k FROM node WHERE d > 0 GROUP BY 1
), full_node AS (
  SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kids USING (p)
), below AS (
  SELECT p[1:a] AS p, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * s) AS saved FROM full_node, unnest(range(d + 1)) AS u(a) GROUP BY 1
)
SELECT f.conv_id, f.d::BIGINT AS depth, q.conv_id AS parent_conv_id, f.n AS n_convs, f.k AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM full_node f JOIN below USING (p) LEFT JOIN node q ON f.d > 0 AND q.p = f.p[1:f.d - 1]
"""
