"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits, each the majority over the XXH64 hashes of a text's word shingles.
Fingerprints within ``radius`` (at most 3) bits are linked. The bits are taken as three parts. Of
up to three differing bits, dropping one part leaves at most two, and two fingerprints at distance
two meet at a variant of both with one bit flipped: half the radius. So each distinct fingerprint
emits, for each part dropped, itself and all variants of one flipped bit (131 keys of about 43
bits), keys are shuffled, and pairs under one key are verified on all 64 bits. No pair is missed.

Exact copies and texts of one fingerprint are one row before the shuffle. The rows of a key, all
within one bit of it on 43 bits, are compared in numpy; what leaves the task is a star for each
connected set of them, not all pairs. Keys under which very many fingerprints meet are found by
summing the counts of what fingerprints share without a part, and are dealt to blocks.

Null text counts as empty; fingerprints of texts without words are zero and linked like others.
Null or repeated doc_ids, ties and extra columns do no harm: rows are kept one by one, and a
component's id is its smallest non-null doc_id (null if there is none). An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.graph import components, local_roots
from tilewright.llm.tokens import pieces_of
from tilewright.session import table, written

SHINGLE = 3
RADIUS = 3
SEED = 42
#: Fingerprints that may meet under a key before they are dealt to several tasks.
BLOCK = 4096
#: Bits of the three parts: from, to.
PARTS = ((0, 21), (21, 42), (42, 64))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The fingerprint as an unsigned integer; words are cut at ASCII white space, A-Z is lower-cased."""
    import xxhash

    # lower() and split() of bytes know ASCII only
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, sizes = b" ".join(words), list(map(len, words))
    starts = [0, *accumulate(n + 1 for n in sizes)]
    ends = [a + n for a, n in zip(starts, sizes)]
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, seed)
    hashes = np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])), "<u8", len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), one row for each row."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                found = np.array([fingerprint(t, shingle, seed) for t in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _part_keys(part: tuple[int, int]) -> list[Column]:
    """The keys of ``fp`` without a part of the bits: as it is, and with one of the other bits flipped."""
    a, b = part
    kept = F.lit(_signed(((1 << 64) - 1) ^ (((1 << b) - 1) ^ ((1 << a) - 1))))
    base = F.col("fp").bitwiseAND(kept)
    return [base] + [base.bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64) if not a <= i < b]


def variants(fps: DataFrame) -> DataFrame:
    """key, fp: for each part dropped, the fingerprint and its variants of one flipped bit."""
    return fps.select(F.explode(F.array(*[k for part in PARTS for k in _part_keys(part)])).alias("key"), "fp")


def hot_keys(fps: DataFrame, block: int) -> DataFrame:
    """key, blocks of the keys under which more than ``block`` fingerprints meet.

    Under a key meet all that share, without a part, the key itself or one of its neighbours of one bit, so
    the counts of these are summed. A sum can only be that large if one of the counts is over a small part
    of it; keys without such a count near them are left out before anything is summed.
    """
    dense = None
    counts = [fps.groupBy(_part_keys(part)[0].alias("fp")).agg(F.count("*").alias("n")) for part in PARTS]
    for i, (part, count) in enumerate(zip(PARTS, counts)):
        few = block // (len(PARTS) * len(_part_keys(part)))
        near = count.where(F.col("n") > few).select(F.explode(F.array(*_part_keys(part))).alias("key"), F.lit(i).alias("part"))
        dense = near if dense is None else dense.unionByName(near)
    dense = written(dense.distinct(), "dense-keys")
    out = dense.select("key", F.lit(0).alias("n")).limit(0)
    if not dense.isEmpty():
        for i, (part, count) in enumerate(zip(PARTS, counts)):
            around = dense.where(F.col("part") == i).select("key", F.col("key").alias("fp"))
            around = around.select("key", F.explode(F.array(*_part_keys(part))).alias("fp"))
            out = out.unionByName(around.join(count, "fp").select("key", "n"))
    return out.groupBy("key").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")).where("blocks > 1")


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints within the radius.

    The fingerprints of a key are compared in one task, unless the key is hot: then they are dealt to
    blocks, and each two blocks are a task. What leaves a task is a star for what is connected in it.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the radius is at most 3")

    def verified(group: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        twin = np.zeros(len(group), bool)
        same = group[1:] == group[:-1]
        twin[1:] |= same
        twin[:-1] |= same
        group, fp = group[twin], fp[twin]
        n = len(group)
        root, lag, at = np.arange(n), 1, np.arange(n)
        some_i, some_j, held = [], [], 0
        while len(at := at[at + lag < n]) and len(at := at[group[at] == group[at + lag]]):
            near = at[np.bitwise_count((fp[at] ^ fp[at + lag]).view(np.uint64)) <= radius]
            some_i.append(near)
            some_j.append(near + lag)
            held += len(near)
            if held > 1 << 20:  # keep a star for what is connected so far
                root = local_roots(n, np.concatenate([*some_i, np.arange(n)]), np.concatenate([*some_j, root]))
                some_i, some_j, held = [], [], 0
            lag += 1
        root = local_roots(n, np.concatenate([*some_i, np.arange(n)]), np.concatenate([*some_j, root]))
        moved = fp != fp[root]
        edges = np.unique(np.stack([fp[moved], fp[root[moved]]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []  # rows of the last group, which may go on

        def whole():
            key, two, fp = (np.concatenate(c) for c in zip(*held))
            new = (key[1:] != key[:-1]) | (two[1:] != two[:-1])
            return verified(np.cumsum(np.concatenate([[0], new]))[: len(key)], fp)

        for batch in batches:
            if not batch.num_rows:
                continue
            key, two, fp = (batch.column(c).to_numpy() for c in range(3))
            last = int(np.flatnonzero((key == key[-1]) & (two == two[-1]))[0])
            goes_on = held and held[0][0][-1] == key[0] and held[0][1][-1] == two[0]
            if last or not goes_on:
                held.append((key[:last], two[:last], fp[:last]))
                yield whole()
                held = [(key[last:], two[last:], fp[last:])]
            else:
                held.append((key, two, fp))
        if held:
            yield whole()

    # fingerprints are small, but each becomes 131 keys: spread them before that
    spread = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    keyed = variants(spread).withColumn("two", F.lit(0))
    hot = written(hot_keys(fps, block), "hot-keys")
    if not hot.isEmpty():
        keyed = keyed.drop("two").join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        keyed = keyed.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        keyed = keyed.select("key", "fp", (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).alias("two"))
    dealt = keyed.select("key", "two", "fp").repartition("key", "two").sortWithinPartitions("key", "two")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reachable by links), one row for each row."""
    known = written(fingerprints(docs, shingle, seed), "fingerprints")
    distinct = known.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    grouped = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return known.join(grouped.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row of each component, all columns as they are: that of the smallest doc_id.

    Nulls come last. Rows of one doc_id are told apart by a hash of their texts; rows that repeat
    both are one document, of which the first by the other columns (as JSON) stays. Column names are
    free, as the row is carried in one column. Texts are shuffled once.
    """

    # two columns for doc_id, as null is a value here
    def keys(doc_id: Column, text: Column) -> list[Column]:
        return [F.coalesce(doc_id.cast("bigint"), F.lit(0)).alias("_id"), doc_id.isNull().alias("_none"), F.xxhash64(text).alias("_text")]

    names = ["_id", "_none", "_text"]

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole):
                found = np.array([fingerprint(t, shingle, seed) for t in batch.column(3).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], [*names, "fp"])

    keyed = docs.select(*keys(docs["doc_id"], docs["text"]), docs["text"])
    known = written(keyed.mapInArrow(run, "_id bigint, _none boolean, _text bigint, fp bigint"), "keyed")
    distinct = known.groupBy("fp").agg(F.min(F.struct("_none", "_id", "_text")).alias("first"))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    least = distinct.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first"))
    winners = least.select(*(f"first.{n}" for n in names))
    others = [docs[c] for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.to_json(F.struct(*others)) if others else F.lit("")
    rows = docs.select(*keys(docs["doc_id"], docs["text"]), rest.alias("_rest"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    # repeated rows go before the shuffle, as Spark limits groups on both sides of it
    once = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*names).orderBy("_rest"))).where("_nth = 1")
    return once.join(winners, names, "left_semi").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: fingerprints and components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
