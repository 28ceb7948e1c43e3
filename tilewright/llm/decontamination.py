"""Benchmark decontamination over a distributed positional inverted index.

Tasks deal their documents to shards of about ``SHARD`` bytes and store, for each word of a shard, its
postings: how often it occurs, and where, as differences of positions that run through all documents of
the shard. ``GAP`` free positions follow each document, so no phrase reaches from one into the next.
Postings are not shuffled to be stored.

A search orders the words of each phrase by their number of postings, the rarest first. A phrase goes to
the shards that hold its rarest word; there the word's list, moved to where the phrase would start, is
intersected with those of the next rarest words, of which only the ``LEAD`` first are read for all
phrases. The lists of a phrase's other, common words are read in the shards where starts are left.
Proximity search keeps in the same rounds the places where all words of a phrase stand close together,
in any order, and returns the left ends of the smallest stretches that hold them all.

A shard is of bounded size whatever a word's or a passage's number of copies, and phrases are dealt to
blocks, so no group grows with the input. A document longer than a shard is one of its own.

Null texts have no words, nor have items of null text. Rows that repeat a doc_id, or have none, are
documents of their own; rows that repeat an item_id are one item with the windows of all; items of null
item_id hit words but count as no item. Other columns are ignored. Empty tables give no documents, or
documents without hits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.tokens import pieces_of
from tilewright.session import scratch_path, table, written

#: Words of a window; bytes of text in a shard; words whose lists are read for all phrases; phrases in a block.
WIDTH = 10
SHARD = 1 << 24
LEAD = 3
BLOCK = 20_000
#: Free positions after a document: proximity search reaches over no more words.
GAP = 64
#: The stretch of the query's proximity matches.
WITHIN = 15

INDEX = "shard bigint, term string, n int, positions binary, base bigint, doc_id bigint, n_words bigint"
#: A-Z become a-z, and what is no digit, letter or byte above ASCII a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words of a text in UTF-8."""
    return (text or b"").translate(_FOLD).split()


@dataclass
class Index:
    """A written table of INDEX: postings of the shards' terms, and (without a term) the documents."""

    spark: SparkSession
    path: str

    @property
    def rows(self) -> DataFrame:
        # read anew each time, as a search joins the table to itself
        return self.spark.read.schema(INDEX).parquet(self.path)

    @property
    def postings(self) -> DataFrame:
        return self.rows.where("term IS NOT NULL").select("shard", "term", "n", "positions")

    @property
    def documents(self) -> DataFrame:
        return self.rows.where("term IS NULL").select("shard", "base", "doc_id", "n_words")


class _Shard:
    """Documents of a shard in the making."""

    def __init__(self):
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids, self.docs, self.size = [], [], 0

    def add(self, doc_id: int | None, text: bytes | None) -> None:
        found = words(text)
        self.ids.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.docs.append(doc_id)
        self.size += len(text or b"") + 64

    def batches(self, shard: int, rows: int = 20_000):
        counts = np.array([len(x) for x in self.ids])
        base = np.cumsum(counts + GAP) - counts - GAP
        ids = np.concatenate(self.ids)
        # short keys sort by radix
        order = np.argsort(ids.astype(np.uint16) if len(self.number) <= 1 << 16 else ids, kind="stable")
        place = (np.arange(len(ids)) + np.repeat(GAP * np.arange(len(counts)), counts))[order]
        n = np.bincount(ids, minlength=len(self.number))
        ends = np.concatenate([[0], np.cumsum(n)])
        step = np.diff(place, prepend=0)
        step[ends[:-1]] = place[ends[:-1]]
        step, terms = step.astype("<u4"), list(self.number)
        for at in range(0, len(terms), rows):
            to = min(at + rows, len(terms))
            offsets = pa.py_buffer(((ends[at : to + 1] - ends[at]) * 4).astype(np.int32))
            lists = pa.Array.from_buffers(pa.binary(), to - at, [None, offsets, pa.py_buffer(step[ends[at] : ends[to]])])
            some = [pa.array(terms[at:to], pa.binary()).cast(pa.string()), pa.array(n[at:to].astype(np.int32)), lists]
            yield self._batch(shard, to - at, some, [pa.nulls(to - at, pa.int64())] * 3)
        own = [pa.array(base), pa.array(self.docs, pa.int64()), pa.array(counts)]
        yield self._batch(shard, len(counts), [pa.nulls(len(counts), t) for t in (pa.string(), pa.int32(), pa.binary())], own)

    @staticmethod
    def _batch(shard: int, n: int, of_term: list, of_doc: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, shard, np.int64)), *of_term, *of_doc], [c.split()[0] for c in INDEX.split(", ")]
        )


def build_index(docs: DataFrame, shard_bytes: int = SHARD) -> Index:
    """A stored index of all words of doc_id, text."""

    def run(batches):
        first, made, shard = TaskContext.get().partitionId() << 32, 0, _Shard()
        for whole in batches:
            for batch in pieces_of(whole):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    shard.add(doc_id, text)
                    if shard.size >= shard_bytes:
                        yield from shard.batches(first + made)
                        made, shard = made + 1, _Shard()
        if shard.docs:
            yield from shard.batches(first + made)

    # one table, so that postings and documents come from the same attempts of tasks
    path = scratch_path(docs.sparkSession, "positions")
    rows = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, INDEX)
    rows.write.option("compression", "zstd").parquet(path)
    return Index(docs.sparkSession, path)


def windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id, phrase: the windows of ``width`` words of each text, or all its words if they are fewer."""

    def run(batches):
        for whole in batches:
            for batch in pieces_of(whole, 100):
                ids, found = [], []
                for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                    w = words(text)
                    own = {b" ".join(w[i : i + width]) for i in range(max(len(w) - width, 0) + 1)} if w else ()
                    ids += [item_id] * len(own)
                    found += own
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], ["item_id", "phrase"])

    return items.select(F.col("item_id").cast("bigint"), "text").mapInArrow(run, "item_id bigint, phrase string").distinct()


def _among(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``wanted`` are in the sorted ``values``."""
    if not len(values):
        return np.zeros(len(wanted), bool)
    return values[np.minimum(np.searchsorted(values, wanted), len(values) - 1)] == wanted


def _around(values: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """Those of the sorted ``values`` within ``reach`` of one of the sorted ``places``, of which there are few."""
    first, last = np.searchsorted(values, places - reach), np.searchsorted(values, places + reach, side="right")
    first = np.maximum(first, np.concatenate([[0], last[:-1]]))  # none twice
    count = np.maximum(last - first, 0)
    return values[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]


def _close(values: np.ndarray, wanted: np.ndarray, reach: int) -> np.ndarray:
    """Which of ``wanted`` have one of the sorted ``values`` within ``reach``."""
    return np.searchsorted(values, wanted - reach) < np.searchsorted(values, wanted + reach, side="right")


def smallest_stretches(lists: dict[str, np.ndarray], phrase: list[str], around: np.ndarray, within: int) -> np.ndarray:
    """Left ends of the stretches of at most ``within`` words that hold all words of the phrase, as often as it has them.

    Only stretches that hold no smaller one count, and only words within reach of the places ``around``
    are looked at.
    """
    need = Counter(phrase)
    near = {w: _around(lists[w], around, within) for w in need}
    if not all(len(x) for x in near.values()):
        return np.empty(0, np.int64)
    place = np.concatenate(list(near.values()))
    which = np.repeat(np.arange(len(near)), [len(x) for x in near.values()])
    order = np.argsort(place, kind="stable")
    place, which = place[order].tolist(), which[order].tolist()
    lack, missing, left, out = list(need.values()), len(phrase), 0, []
    for right, w in enumerate(which):
        missing -= lack[w] > 0
        lack[w] -= 1
        ended = False
        while missing == 0:  # as far as it still holds all
            lack[which[left]] += 1
            missing += lack[which[left]] > 0
            left += 1
            ended = True
        if ended and place[right] - place[left - 1] < within:
            out.append(place[left - 1])
    return np.array(out, np.int64)


FOUND = "shard bigint, block int, phrase string, ranks array<int>, starts binary, near binary"


def _narrowed(postings: DataFrame, rows: DataFrame, first: int, last: int | None, within: int | None) -> DataFrame:
    """Rows of FOUND whose starts agree with the lists of the phrases' words of rank ``first`` to before ``last``.

    ``postings`` has shard, block, term, positions. Where no starts are known, they come from the list of
    rank 0. ``near`` holds places of the rarest word, and in the end the left ends of stretches.
    """

    def run(own: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        lists = {t: np.cumsum(np.frombuffer(p, "<u4"), dtype=np.int64) for t, p in zip(own["term"], own["positions"])}
        none, out = np.empty(0, np.int64), []
        for row in wanted.itertuples(index=False):
            phrase = row.phrase.split(" ")
            if row.starts is None:
                near = lists.get(phrase[row.ranks[0]], none)
                starts = near - row.ranks[0]
            else:
                starts, near = np.frombuffer(row.starts, np.int64), np.frombuffer(row.near, np.int64)
            for at in row.ranks[first:last]:
                some = lists.get(phrase[at], none)
                if len(starts):
                    starts = starts[_among(some, starts + at)]
                if within and len(near):
                    near = near[_close(some, near, within - 1)]
            if within and last is None and len(near):
                near = smallest_stretches(lists, phrase, near, within)
            if len(starts) or within and len(near):
                out.append((row.shard, row.block, row.phrase, row.ranks, starts.tobytes(), near.tobytes() if within else b""))
        return pd.DataFrame(out, columns=["shard", "block", "phrase", "ranks", "starts", "near"])

    return postings.groupBy("shard", "block").cogroup(rows.groupBy("shard", "block")).applyInPandas(run, FOUND)


def search(index: Index, phrases: DataFrame, within: int | None = None, lead: int = LEAD, block: int = BLOCK) -> DataFrame:
    """shard, phrase, starts, near: where the phrases (words joined by a space) stand in the shards.

    ``starts`` holds the starts of exact matches and ``near``, if ``within`` is given (at most GAP), the
    left ends of the smallest stretches of so many words with all words of the phrase; both are 64-bit
    integers in the shard's positions.
    """
    if within is not None and not 0 < within <= GAP:
        raise ValueError(f"within is at most {GAP}")
    each = phrases.select("phrase").distinct().select("phrase", F.posexplode(F.split("phrase", " ")).alias("at", "term"))
    wanted = written(each.select("term").distinct(), "terms")
    count = index.postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
    listed = F.sort_array(F.collect_list(F.struct("n", "term", "at")))
    plan = each.join(count, "term", "left").groupBy("phrase").agg(listed.alias("t"), F.count("n").alias("known"))
    plan = plan.where(F.col("known") == F.size("t")).select(
        "phrase", F.element_at("t.term", 1).alias("term"), F.col("t.at").alias("ranks"), F.col("t.term").alias("terms")
    )
    plan = written(plan, "phrases")
    blocks = max(1, -(-plan.count() // block))
    plan = plan.withColumn("block", F.pmod(F.xxhash64("phrase"), F.lit(blocks)).cast("int"))
    unknown = F.lit(None).cast("binary")
    first = written(plan.select("term").distinct(), "rarest-terms")  # small, so that few postings are shuffled
    rows = index.postings.select("shard", "term").join(first, "term", "left_semi").join(plan.drop("terms"), "term")
    rows = rows.select("shard", "block", "phrase", "ranks", unknown.alias("starts"), unknown.alias("near"))
    rare = written(plan.select("block", F.explode(F.slice("terms", 1, lead)).alias("term")).distinct(), "rare-terms")
    left = written(_narrowed(index.postings.join(rare, "term"), rows, 0, lead, within), "starts")
    # now all words of a phrase where proximity needs them, else the common ones only
    which = F.col("ranks") if within else F.slice("ranks", lead + 1, 1 << 30)
    term = F.transform(which, lambda i: F.get(F.split("phrase", " "), i))
    need = written(left.select("shard", "block", F.explode(term).alias("term")).distinct(), "wanted")
    few = index.postings.join(written(need.select("term").distinct(), "wanted-terms"), "term", "left_semi")
    return _narrowed(few.join(need, ["shard", "term"]), left, lead, None, within).select("shard", "phrase", "starts", "near")


HITS = "shard bigint, base bigint, n_hit bigint, exact array<string>, near array<string>"


def hits(index: Index, found: DataFrame) -> DataFrame:
    """Rows of HITS for documents with matches: how many of their words lie in exact matches, and the phrases that match."""

    def run(matches: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("base")
        base, n = docs["base"].to_numpy(np.int64), docs["n_words"].to_numpy(np.int64)
        exact, near = ([set() for _ in base] for _ in range(2))
        edge = np.zeros(int(base[-1] + n[-1]) + 1 if len(base) and len(matches) else 1, np.int32)
        for row in matches.itertuples(index=False):
            starts = np.frombuffer(row.starts, np.int64)
            np.add.at(edge, starts, 1)
            np.add.at(edge, starts + row.phrase.count(" ") + 1, -1)
            for sets, at in ((exact, starts), (near, np.frombuffer(row.near, np.int64))):
                for i in np.unique(np.searchsorted(base, at, side="right") - 1).tolist():
                    sets[i].add(row.phrase)
        covered = np.concatenate([[0], np.cumsum(np.cumsum(edge) > 0)])
        out = [
            (shard, b, int(covered[b + k] - covered[b]), list(exact[i]), list(near[i]))
            for i, (shard, b, k) in enumerate(zip(docs["shard"], base, n))
            if exact[i] or near[i]
        ]
        return pd.DataFrame(out, columns=["shard", "base", "n_hit", "exact", "near"])

    docs = index.documents.select("shard", "base", "n_words")
    return found.groupBy("shard").cogroup(docs.groupBy("shard")).applyInPandas(run, HITS)


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, within: int | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted as strings), n_near: one row for each document.

    ``n_near`` counts the items of which a window's words all stand within so many words of the document, in any order.
    """
    index = build_index(docs)
    own = written(windows(items, width), "windows")
    found = written(hits(index, written(search(index, own, within), "matches")), "hits")
    tagged = F.concat(
        F.transform("exact", lambda p: F.struct(p.alias("phrase"), F.lit(True).alias("exact"))),
        F.transform("near", lambda p: F.struct(p.alias("phrase"), F.lit(False).alias("exact"))),
    )
    pairs = found.select("shard", "base", F.explode(tagged).alias("m")).select("shard", "base", "m.*").join(own, "phrase")
    pairs = pairs.groupBy("shard", "base", "item_id").agg(F.bool_or("exact").alias("exact"), F.bool_or(~F.col("exact")).alias("near"))
    listed = F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item_id").cast("string"))))
    each = pairs.groupBy("shard", "base").agg(listed.alias("items"), F.count(F.when(F.col("near"), F.col("item_id"))).alias("n_near"))
    out = index.documents.join(found.select("shard", "base", "n_hit").join(each, ["shard", "base"], "left"), ["shard", "base"], "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: which words of all documents lie in windows of the benchmark's items."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), within=WITHIN)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near",
    )

