"""Best-fit packing of documents into training sequences under several capacities.

A document's ids with its end id make one piece; only documents longer than a sequence are cut. A
piece asks for tokens, for one document and for attention cost (its length squared); a sequence has
a capacity of each. Pieces are dealt evenly to shards of about ``shard_pieces``; each shard takes
its pieces by decreasing size and puts each into the open sequence that ``rule`` prefers among
those in which every residual suffices:

``norm``  the least weighted norm of what would be left (best fit);
``dot``   sequences are filled one by one with the fitting piece of the largest weighted dot
          product of demand and residual.

A shard ends with a few sequences that are not full, about one in two thousand in all; results
need no other pass.

A string of a special token in a text becomes that token's id, as the library has it; with
``plain`` it is ordinary text.

Null text counts as empty (a piece of the end id), null and repeated doc_ids are documents of their
own, equal sizes are taken by doc_id and piece, an empty table gives an empty result, and other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.tokens import DROPPED, chunk_ids, pieces_of
from tilewright.session import table, written

CAPACITY = 4096
SHARD_PIECES = 8192
END_ID = 1


def tokenize_pieces(
    docs: DataFrame, vocabulary: str, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False, plain: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of the pieces of every document."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids

    def cut(batches):
        ids, end = chunk_ids(vocabulary, DROPPED, plain), end_id.to_bytes(4, "little")
        for whole in batches:
            for batch in pieces_of(whole):
                out = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    found = ids.encode(text or "") + end
                    for k, at in enumerate(range(0, len(found), 4 * capacity)):
                        part = found[at : at + 4 * capacity]
                        row = (doc_id, k, at // 4, len(part) // 4, zlib.crc32(part))
                        out.append(row + (np.frombuffer(part, "<u4").astype("i4"),) * with_ids)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
                if out:
                    columns = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                    yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(cut, schema)


def demands(lengths: np.ndarray) -> np.ndarray:
    """Tokens, documents and attention cost of each piece."""
    n = lengths.astype(np.float64)
    return np.stack([n, np.ones_like(n), n * n], axis=1)


def assign(lengths: np.ndarray, capacities: tuple, weights: tuple | None = None, rule: str = "norm") -> np.ndarray:
    """The sequence (0, 1, ...) of each piece of one shard; pieces come by decreasing length."""
    caps = np.asarray(capacities, np.float64)
    ask = demands(lengths) / caps
    if (ask > 1 + 1e-12).any():
        raise ValueError("a piece is larger than a capacity")
    if weights is None:  # each residual counts on the scale of what the pieces ask for
        total = ask.sum(0) if len(ask) else np.ones(len(caps))
        weights = total.max() / total
    w, slack = np.asarray(weights, np.float64), 1e-12
    where = np.empty(len(lengths), np.int64)
    if rule == "dot":
        left, made = np.arange(len(lengths)), 0
        while len(left):
            rest, taken = np.ones(len(caps)), np.zeros(len(left), bool)
            while True:
                fits = ~taken & (ask[left] <= rest + slack).all(1)
                if not fits.any():
                    break
                best = np.where(fits, (ask[left] * rest * w).sum(1), -1.0).argmax()
                taken[best], rest = True, rest - ask[left[best]]
                where[left[best]] = made
            left, made = left[~taken], made + 1
        return where
    if rule != "norm":
        raise ValueError(f"rule is norm or dot, not {rule!r}")
    rest, names, used, made = np.empty((len(lengths), len(caps))), np.empty(len(lengths), np.int64), 0, 0
    least = ask[-1] if len(ask) else None  # no piece asks for less
    for i, x in enumerate(ask):
        after = rest[:used] - x
        fits = (after >= -slack).all(1)
        if fits.any():
            at = int(np.where(fits, (w * after * after).sum(1), np.inf).argmin())
        else:
            at, rest[used], names[used], used, made = used, 1.0, made, used + 1, made + 1
        where[i] = names[at]
        rest[at] -= x
        if (rest[at] < least - slack).any():  # nothing fits any more: the sequence is closed
            used -= 1
            rest[at], names[at] = rest[used], names[used]
    return where


def pack(
    pieces: DataFrame,
    capacity: int = CAPACITY,
    max_documents: int | None = None,
    max_attention: float | None = None,
    weights: tuple | None = None,
    rule: str = "norm",
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """The pieces with sequence_id and offset. ``pieces`` is read twice, so it should be a table.

    Without their own limits, documents and attention cost are bound by what the tokens allow, but
    their residuals still decide between sequences. Without weights, a capacity counts by the inverse
    of the share that the shard's pieces ask of it, so that residuals of all three weigh alike.
    """
    capacities = (capacity, max_documents or capacity, max_attention or float(capacity) ** 2)
    shards = max(1, -(-pieces.count() // shard_pieces))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], ignore_index=True)
        local = assign(rows["length"].to_numpy(), capacities, weights, rule)
        rows["offset"] = rows.groupby(local)["length"].cumsum() - rows["length"]
        rows["sequence_id"] = rows.pop("_shard").astype("int64") * shard_pieces * 4 + local
        return rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
    return dealt.groupBy("_shard").applyInPandas(place, f"{fields}, offset bigint, sequence_id bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: packs all documents into sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    pieces = tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pack(written(pieces, "pieces"))
