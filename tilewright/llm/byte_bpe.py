"""Byte-level BPE encoding and decoding.

Each task takes its rows in blocks of about ``BLOCK`` characters, a row for each block:

1. A block's texts are cut by the pattern into words, in an Arrow batch. The row holds the words that
   the task hasn't met before as byte arrays, and the block's documents as lists of word numbers.
   Numbers start anew when there are ``WORDS`` of them. Words of more than ``LONG`` bytes are cut
   further where no token of the vocabulary can stand across the place, so no merge could cross it
   either. The most common words, at most ``COMMON`` of a sample of ``SAMPLE_CHARS`` characters over
   all partitions, are folded once for all tasks; they come with their ids. A word that
   isn't among them but is made of their pieces takes the ids of the pieces, if no merge can cross where
   they meet (``Folded``). That only saves work: any other word is folded in its task.
2. Spark's higher-order functions fold the ranked merges over each word's byte array. The state holds
   tokens and the ranks of adjacent pairs in turn; each step merges the leftmost pair of the least
   rank and looks up the two pairs that arise. The ranks are a literal: a perfect hash table from a
   pair of tokens to the rank of their bytes, which is the id of the token they make. Long words
   that can't be cut take all pairs of the least rank in one step, where that gives the same.
3. The ids of the words replace the words' numbers in the documents, in numpy, and one row for each goes on.

Rows stay in their partition and in order, so no text is shuffled, a block and the words bound the
memory, and a lost task is run again by itself. Decoding concatenates the binary pieces of the ids.

Null text counts as empty, with no ids. Null or repeated ids, repeated rows and extra columns do no
harm: rows are encoded one by one. A very long text is a block of its own. An empty table gives an
empty result.
"""

from __future__ import annotations

import base64
import collections
import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.chat_format import let
from tilewright.llm.tokens import KEPT, pieces_of
from tilewright.session import table

BLOCK = 1_000_000
#: Words that a task keeps by number before it starts anew.
WORDS = 300_000
#: Bytes from which a word is cut where no token can stand across, and folded in wide steps.
LONG = 64
#: Words that are folded ahead, and the characters of the sample that they are counted in.
COMMON = 250_000
SAMPLE_CHARS = 32_000_000
NEVER = 2**63 - 1


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[bytes, ...]:
    """The bytes of each id of a rank file."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return tuple(ranks[i] for i in range(len(ranks)))


class Ranks:
    """The literal rank map as a Column, and how a pair of tokens is looked up in it.

    A token is its id plus ``base``, so that any rank is less than any token. A pair's key is one
    number of both; it is sought in the one slot that its bucket's displacement leads to. An entry
    is key * base + rank, so entry - key * base is the rank if the slot is the pair's, else no rank.
    """

    def __init__(self, size: int, slots: int, buckets: int, literal: Column):
        self.base = 1 << size.bit_length()
        self.edge = 2 * self.base - 1  # a token that no pair holds
        self.slots, self.buckets, self.map = slots, buckets, literal

    def within(self, ranks: Column) -> Ranks:
        """The same with the map bound to a variable."""
        other = object.__new__(Ranks)
        other.__dict__ = self.__dict__ | {"map": ranks}
        return other

    def first(self, byte: Column) -> Column:
        return F.get(self.map["bytes"], byte)

    def pair(self, a: Column, b: Column) -> Column:
        """The rank of a pair of tokens, or a number of at least ``base``."""
        key = a * (2 * self.base) + b
        slot = (F.get(self.map["moves"], key % self.buckets) + key) % self.slots
        return (F.get(self.map["entries"], slot) - key * self.base).bitwiseAND(F.lit(NEVER))


def _prime(n: int) -> int:
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return n


@functools.lru_cache(maxsize=2)
def _pair_table(path: str) -> tuple[int, int, str]:
    """(slots, buckets, JSON of the arrays): buckets of keys are displaced until their slots are free."""
    tokens = vocabulary(path)
    base = 1 << len(tokens).bit_length()
    if base > 1 << 20:
        raise ValueError("the vocabulary has too many tokens")
    rank = {t: i for i, t in enumerate(tokens)}
    found = [(rank.get(t[:k]), rank.get(t[k:]), i) for t, i in rank.items() for k in range(1, len(t))]
    a, b, made = np.array([x for x in found if None not in x] or np.empty((0, 3)), np.int64).reshape(-1, 3).T
    key = (a + base) * (2 * base) + b + base
    slots, buckets = _prime(2 * len(key) + 64), _prime(len(key) // 3 + 8)
    order = np.argsort(key % buckets, kind="stable")
    key, made = key[order], made[order]
    starts = np.flatnonzero(np.diff(key % buckets, prepend=-1))
    ends = np.append(starts[1:], len(key))
    moves, entries, rng = np.zeros(buckets, np.int64), np.full(slots, -1, np.int64), np.random.default_rng(1)
    for i in np.argsort(starts - ends, kind="stable"):
        own = key[starts[i] : ends[i]]
        if len(np.unique(own % slots)) < len(own):
            raise ValueError("keys of one bucket share a slot")
        while True:
            tried = rng.integers(0, slots, 64)
            free = (entries[(own + tried[:, None]) % slots] == -1).all(1)
            if free.any():
                break
        moves[own[0] % buckets] = tried[free.argmax()]
        entries[(own + moves[own[0] % buckets]) % slots] = own * base + made[starts[i] : ends[i]]
    first = [rank[bytes([i])] + base for i in range(256)]
    return slots, buckets, json.dumps({"bytes": first, "moves": moves.tolist(), "entries": entries.tolist()}, separators=(",", ":"))


def rank_literal(path: str) -> Ranks:
    slots, buckets, arrays = _pair_table(path)
    # constant folding makes one literal of it
    literal = F.from_json(F.lit(arrays), "bytes array<bigint>, moves array<bigint>, entries array<bigint>")
    return Ranks(len(vocabulary(path)), slots, buckets, literal)


def fold(word: Column, ranks: Ranks) -> Column:
    """The ids of a word given as an array of byte values, one merge a step; not for empty words."""
    base, edge, pair = ranks.base, F.lit(ranks.edge), ranks.pair
    # edge, no rank, token, rank of the pair after it, token, ..., token, no rank, edge
    start = let(
        F.transform(word, ranks.first),
        lambda t: F.concat(
            F.array(edge, F.lit(NEVER)),
            F.flatten(F.zip_with(t, F.concat(F.slice(t, 2, F.size(t)), F.array(edge)), lambda a, b: F.array(a, pair(a, b)))),
            F.array(edge),
        ),
    )

    def merge(x: Column, made: Column, at: Column) -> Column:
        """The tokens on either side of the rank in place ``at`` (from 1) become ``made``."""
        new = F.array(pair(F.get(x, at - 4), made), made, pair(made, F.get(x, at + 2)))
        return F.concat(F.slice(x, F.lit(1), at - 3), new, F.slice(x, at + 3, F.size(x)))

    def step(x: Column, _: Column) -> Column:
        return let(
            F.array_min(x),
            lambda least: F.when(least >= base, x).otherwise(
                let(F.array_position(x, least).cast("int"), lambda at: merge(x, least + base, at))
            ),
        )

    def done(x: Column) -> Column:
        tokens = F.filter(x, lambda v, i: (i % 2 == 0) & (v < edge))
        return F.transform(tokens, lambda v: (v - base).cast("int"))

    return F.aggregate(F.slice(word, 2, F.size(word)), start, step, done)


def fold_wide(word: Column, ranks: Ranks) -> Column:
    """The same for long words: a step merges all pairs of the least rank, from the left.

    That is what single merges do if no pair that arises has a lower rank, whether it stays or is
    merged at once; where one has, the step merges the leftmost pair only.
    """
    base, edge, pair = ranks.base, F.lit(ranks.edge), ranks.pair
    after = lambda t: F.concat(F.slice(t, 2, F.size(t)), F.array(edge))
    state = lambda t: let(
        F.zip_with(t, after(t), pair), lambda r: F.struct(t.alias("t"), r.alias("r"), F.array_min(r).alias("least"))
    )

    def chosen(acc: Column) -> Column:
        """1 for each pair that is merged: every second one of adjacent pairs."""
        marks = F.array_join(F.transform(acc["r"], lambda r: F.when(r == acc["least"], "1").otherwise("0")), "")
        return F.split(F.replace(marks, F.lit("11"), F.lit("10")), "")

    def merged(acc: Column, here) -> Column:
        """The tokens with the pairs merged for whose place ``here`` is true."""
        made = acc["least"] + base
        put = F.transform(acc["t"], lambda t, i: F.when(here(i - 1), F.lit(-1)).when(here(i), made).otherwise(t))
        return F.filter(put, lambda t: t >= 0)

    def step(acc: Column, _: Column) -> Column:
        made = acc["least"] + base

        def of(marks: Column) -> Column:
            is_one = lambda i: F.coalesce(F.get(marks, i) == "1", F.lit(False))
            between = F.transform(acc["t"], lambda t, i: F.when(is_one(i) & is_one(i - 2), pair(made, t)).otherwise(F.lit(NEVER)))
            single = lambda: let(F.array_position(acc["r"], acc["least"]) - 1, lambda p: state(merged(acc, lambda i: i == p)))
            return let(
                state(merged(acc, is_one)),
                lambda new: F.when((new["least"] > acc["least"]) & (F.array_min(between) > acc["least"]), new).otherwise(single()),
            )

        return F.when(acc["least"] >= base, acc).otherwise(let(chosen(acc), of))

    start = let(F.transform(word, ranks.first), state)
    return F.aggregate(F.slice(word, 2, F.size(word)), start, step, lambda acc: F.transform(acc["t"], lambda t: (t - base).cast("int")))


class Places:
    """Where words can be cut: no token of the vocabulary stands across such a place."""

    def __init__(self, path: str):
        tokens = vocabulary(path)
        self.all = tokens
        joined = np.zeros(1 << 16, bool)  # two bytes that stand side by side in a token
        for t in tokens:
            b = np.frombuffer(t, np.uint8).astype(np.int64)
            joined[(b[:-1] << 8) + b[1:]] = True
        self.joined = joined

    def parts(self, word: bytes) -> list[bytes]:
        if len(word) <= LONG:
            return [word]
        b = np.frombuffer(word, np.uint8).astype(np.int64)
        cuts = [0, *(np.flatnonzero(~self.joined[(b[:-1] << 8) + b[1:]]) + 1).tolist(), len(word)]
        out = []
        for a, b in zip(cuts, cuts[1:]):
            out += [word[a:b]] if b - a <= LONG else self._swept(word[a:b])
        return out

    @functools.cached_property
    def tokens(self) -> frozenset[bytes]:
        return frozenset(self.all)

    @functools.cached_property
    def prefixes(self) -> frozenset[bytes]:
        return frozenset(t[:k] for t in self.all for k in range(1, len(t) + 1))

    def _swept(self, word: bytes) -> list[bytes]:
        reach, last, out = 0, 0, []
        for i in range(len(word)):
            if reach <= i and i > last:  # no token that begins before ends after
                out.append(word[last:i])
                last = i
            j = i + 1
            while j <= len(word) and word[i:j] in self.prefixes:
                if word[i:j] in self.tokens:
                    reach = max(reach, j)
                j += 1
        return [*out, word[last:]]


@functools.lru_cache(maxsize=2)
def places(path: str) -> Places:
    """One for each worker process."""
    return Places(path)


class Folded:
    """Ids of words that were folded ahead, and of words that are put together from their pieces.

    Where two tokens stand side by side in a folded word, no merge crosses the place between them in
    any word that they stand side by side in: up to the first merge across it, the merges within the
    two come in the same order whatever else the word holds, and in the fold that was done there was
    none. So tokens of which all neighbours have been met side by side are the ids of the word that
    they spell. A word is sought as a folded word and one or two ends of folded words.
    """

    def __init__(self, ids: dict[bytes, bytes], tokens: tuple[bytes, ...]):
        """``ids``: of each folded word, as 32-bit integers."""
        self.ids, self.ends, self.met = ids, {}, set()
        for word, own in ids.items():
            at = 0
            for i, token in enumerate(np.frombuffer(own, np.int32)[:-1].tolist(), 1):
                at += len(tokens[token])
                self.ends[word[at:]] = own[4 * i :]
                self.met.add(own[4 * i - 4 : 4 * i + 4])

    def get(self, word: bytes) -> bytes | None:
        found = self.ids.get(word)
        return self._joined(word) if found is None and len(word) <= LONG else found

    def _joined(self, word: bytes) -> bytes | None:
        heads, ends, met = self.ids.get, self.ends.get, self.met
        for k in range(len(word) - 1, 0, -1):
            head = heads(word[:k])
            if head is None:
                continue
            last, end = head[-4:], ends(word[k:])
            if end is not None:
                if last + end[:4] in met:
                    return head + end
                continue  # whatever the rest is made of, it begins with that token
            for j in range(len(word) - 1, k, -1):
                middle = ends(word[k:j])
                if middle is not None and last + middle[:4] in met:
                    end = ends(word[j:])
                    if end is not None and middle[-4:] + end[:4] in met:
                        return head + middle + end
        return None


def _word_list(words: list[bytes | None]) -> pa.Array:
    """array<array<smallint>>'s values: the byte values of each word, null for None."""
    ends = np.cumsum([0, *(len(w or b"") for w in words)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(w or b"" for w in words), np.uint8).astype(np.int16))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([w is None for w in words], pa.bool_()))


def _id_list(ids: list[bytes | None]) -> pa.Array:
    ends = np.cumsum([0, *(len(x or b"") // 4 for x in ids)]).astype(np.int32)
    values = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), np.int32))
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in ids], pa.bool_()))


def common_words(docs: DataFrame, path: str, pattern: str, most: int = COMMON, sample_chars: int = SAMPLE_CHARS) -> dict[bytes, bytes]:
    """Ids of the most common words of up to LONG bytes that come more than once in a sample: the beginnings of all partitions."""
    each = max(20_000, sample_chars // max(1, docs.rdd.getNumPartitions()))

    def count(batches):
        import regex

        cut, parts, found, held = regex.compile(pattern).findall, places(path).parts, collections.Counter(), 0
        chunks = re.compile(KEPT).findall
        met: collections.Counter = collections.Counter()
        for batch in (b for whole in batches for b in pieces_of(whole, 200)):
            for text in batch.column(0).to_pylist():
                met.update(chunks((text or "")[: each - held]))
                held += len(text or "")
                if held >= each:
                    break
            if held >= each:
                break
        for chunk, n in met.items():
            for w in cut(chunk):
                for p in parts(w.encode("utf-8", "surrogatepass")):
                    if len(p) <= LONG:
                        found[p] += n
        for at in range(0, len(found), 50_000):
            some = list(found.items())[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([_word_list([w for w, _ in some]), pa.array([n for _, n in some], pa.int64())], ["word", "n"])

    counts = docs.select("text").mapInArrow(count, "word array<smallint>, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.where("n > 1").orderBy(F.desc("n"), "word").limit(most)
    ranks = rank_literal(path)
    folded = top.repartition("word").select("word", let(ranks.map, lambda m: fold(F.col("word"), ranks.within(m))).alias("ids"))
    out: dict[bytes, bytes] = {}
    for batch in folded.toArrow().to_batches():
        words, ids = batch.column(0), batch.column(1)
        w, i = words.flatten().to_numpy().astype(np.uint8).tobytes(), ids.flatten().to_numpy().astype(np.int32).tobytes()
        at, to = np.cumsum([0, *words.value_lengths().to_pylist()]).tolist(), (4 * np.cumsum([0, *ids.value_lengths().to_pylist()])).tolist()
        out.update((w[a:b], i[c:d]) for a, b, c, d in zip(at, at[1:], to, to[1:]))
    return out


def _blocks(docs: DataFrame, path: str, pattern: str, block: int, common: Folded, most: int) -> DataFrame:
    """words: the new words of a block as byte values, null for those whose ids come in known; docs: its documents as numbers of words.

    Words are numbered in the order in which the task's rows bring them, from 0 again where ``anew`` is true.
    """

    def cut_blocks(batches):
        import regex

        cut, parts = regex.compile(pattern).findall, places(path).parts
        chunks = re.compile(KEPT).findall  # the pattern cuts wherever this does
        words: dict[bytes, int] = {}

        class Numbers(dict):
            """Numbers of the words of a chunk, as bytes."""

            def __missing__(self, chunk: str) -> bytes:
                found = [words.setdefault(p, len(words)) for w in cut(chunk) for p in parts(w.encode("utf-8", "surrogatepass"))]
                out = self[chunk] = np.array(found, np.int32).tobytes()
                return out

        known, ids, numbers, held, sent = Numbers(), [], [], 0, 0

        def row():
            some = list(itertools.islice(words, sent, None))
            given = [common.get(w) for w in some]
            new = [w if g is None else None for w, g in zip(some, given)]
            rows = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), _id_list(numbers)], ["doc_id", "numbers"])
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            columns = [whole(_word_list(new)), whole(_id_list(given)), whole(rows), pa.array([sent == 0])]
            return pa.RecordBatch.from_arrays(columns, ["words", "known", "docs", "anew"])

        for whole in batches:
            for batch in pieces_of(whole, 200):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    text = text or ""
                    ids.append(doc_id)
                    numbers.append(b"".join(map(known.__getitem__, chunks(text))))
                    held += len(text) + 64
                    if held >= block:
                        yield row()
                        ids.clear(), numbers.clear()
                        held, sent = 0, len(words)
                        if sent >= most:
                            words.clear(), known.clear()
                            sent = 0
        if ids:
            yield row()

    schema = "words array<array<smallint>>, known array<array<int>>, docs array<struct<doc_id: bigint, numbers: array<int>>>, anew boolean"
    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut_blocks, schema)


def _encoded(docs: DataFrame, path: str, pattern: str, block: int, common: int, most: int, finish, schema: str) -> DataFrame:
    """What ``finish`` makes of (doc_ids, ends, ids) of a block: the ids of its documents, one after the other."""
    ranks = rank_literal(path)
    ahead = Folded(common_words(docs, path, pattern, common) if common else {}, vocabulary(path))

    def ids_of(m: Column) -> Column:
        r = ranks.within(m)
        one = lambda w: F.when(F.size(w) <= LONG, fold(w, r)).otherwise(fold_wide(w, r))
        return F.zip_with("words", "known", lambda w, k: F.coalesce(k, one(w)))

    def put_together(batches):
        values, size = np.empty(0, np.int32), np.empty(0, np.int64)  # of all words so far
        for batch in batches:
            for r in range(batch.num_rows):
                words, rows = batch.column(0).slice(r, 1).flatten(), batch.column(1).slice(r, 1).flatten()
                kept = not batch.column(2)[r].as_py()
                values = np.concatenate([values[: len(values) * kept], words.flatten().to_numpy()])
                size = np.concatenate([size[: len(size) * kept], words.value_lengths().to_numpy().astype(np.int64)])
                lists = rows.field("numbers")
                number = lists.flatten().to_numpy()
                ends = np.concatenate([[0], np.cumsum(size[number])])
                # the place of each id: its place in its word, from where the word's ids begin
                at = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[number] - ends[:-1], size[number])
                upto = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))])]
                yield finish(rows.field("doc_id"), upto, values[at])

    folded = _blocks(docs, path, pattern, block, ahead, most).select(let(ranks.map, ids_of).alias("ids"), "docs", "anew")
    return folded.mapInArrow(put_together, schema)


def encode(docs: DataFrame, path: str, pattern: str, block: int = BLOCK, common: int = COMMON, most: int = WORDS) -> DataFrame:
    """doc_id, ids: the token ids of each row's whole text, without special tokens."""

    def finish(doc_ids: pa.Array, ends: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
        return pa.RecordBatch.from_arrays([doc_ids, lists], ["doc_id", "ids"])

    return _encoded(docs, path, pattern, block, common, most, finish, "doc_id bigint, ids array<int>")


def joined(ids: list[int], pieces: tuple[bytes, ...]) -> bytes:
    """The bytes of ids: their pieces, concatenated."""
    return b"".join(map(pieces.__getitem__, ids))


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, decoded: the bytes of each row's ids; null ids count as none."""

    def run(batches):
        pieces = vocabulary(path)
        for batch in batches:
            out = [joined(ids or [], pieces) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, decoded binary")


@functools.lru_cache(maxsize=2)
def _decimal(path: str) -> tuple[str, ...]:
    return tuple(map(str, range(len(vocabulary(path)))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: encodes all documents and decodes the ids."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def digests(doc_ids: pa.Array, ends: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        names, pieces, sha, out = _decimal(path), vocabulary(path), hashlib.sha256, []
        for a, b in zip(ends.tolist(), ends[1:].tolist()):
            own = ids[a:b].tolist()
            out.append((b - a, sha(" ".join(map(names.__getitem__, own)).encode()).hexdigest(), sha(joined(own, pieces)).hexdigest()))
        columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.string()))]
        return pa.RecordBatch.from_arrays([doc_ids, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return _encoded(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, BLOCK, COMMON, WORDS, digests, schema)
