"""Token ids in Parquet files that can be read selectively.

Documents are dealt by ranges of doc_id and sorted; each task encodes its documents and writes one
file: doc_id, shard (the file's place in the order), shard_start (ids before the document in its
shard), n_tokens, and tokens as a list column. ``encoding`` is ``dictionary`` (at most 2 bytes an id
for vocabularies below 65,537) or ``delta``; row groups and pages are of a set size, and page
indexes let a reader of some doc_ids skip the other pages. Columns of metadata are read without
touching the tokens.

A string of a special token in a text becomes that token's id, as the library has it; with
``plain`` it is ordinary text.

Null text counts as empty (the document still gets its end id) and null doc_ids come first. Rows of
one doc_id are ordered by the first characters of their texts, then by their place in the input, so
that one doc_id of very many rows is dealt over many files; repeated rows are documents of their
own. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.tokens import KEPT, chunk_ids, pieces_of
from tilewright.session import scratch_path, table

END_ID = 0
SCHEMA = "doc_id bigint, shard int, shard_start bigint, n_tokens bigint, tokens array<int>"


def encode_sorted(docs: DataFrame, vocabulary: str, end_id: int = END_ID, plain: bool = False) -> DataFrame:
    """Documents in ascending doc_id order as rows of SCHEMA; shards follow each other in that order."""

    def encode(batches):
        ids, start = chunk_ids(vocabulary, KEPT, plain), 0
        end = end_id.to_bytes(4, "little")
        for whole in batches:
            for batch in pieces_of(whole):
                found = [ids.encode(t or "") + end for t in batch.column("text").to_pylist()]
                counts = [len(x) // 4 for x in found]
                starts = []
                for n in counts:
                    starts.append(start)
                    start += n
                ends = [0]
                for n in counts:
                    ends.append(ends[-1] + n)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(found))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").cast(pa.int64()),
                        batch.column("shard").cast(pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values),
                    ],
                    ["doc_id", "shard", "shard_start", "n_tokens", "tokens"],
                )

    rows = docs.select("doc_id", "text", F.substring("text", 1, 16).alias("_head"), F.monotonically_increasing_id().alias("_row"))
    order = ("doc_id", "_head", "_row")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    return ordered.withColumn("shard", F.spark_partition_id()).mapInArrow(encode, SCHEMA)


def write_tokens(
    tokens: DataFrame, path: str, encoding: str = "dictionary", row_group_bytes: int = 32 << 20, page_rows: int = 1000
) -> None:
    """Writes rows of SCHEMA with the encodings, row groups and pages that are asked for."""
    if encoding not in ("dictionary", "delta"):
        raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")
    (
        tokens.write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")  # deltas, but for:
        .option("parquet.enable.dictionary#shard", "true")
        .option("parquet.enable.dictionary#tokens.list.element", str(encoding == "dictionary").lower())
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(256 << 10))
        .option("parquet.page.row.count.limit", str(page_rows))
        .option("parquet.dictionary.page.size", str(1 << 20))
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """All documents, or those few named, for which other row groups and pages are skipped."""
    found = spark.read.schema(SCHEMA).parquet(path)
    return found if doc_ids is None else found.where(F.col("doc_id").isin(doc_ids))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens; the tokens are not read."""
    return _with_start(spark, path, read_tokens(spark, path).drop("tokens"))


def _with_start(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """Replaces shard and shard_start by start; sums of shards are one row for each file."""
    sums = read_tokens(spark, path).groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = F.expr("coalesce(sum(_n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L)")
    start = (F.col("shard_start") + F.col("_before")).alias("start")
    rows = rows.join(sums.select("shard", before.alias("_before")), "shard")
    return rows.select("doc_id", start, *[c for c in rows.columns if c not in ("doc_id", "shard", "shard_start", "_before")])


def checksums(tokens: DataFrame) -> DataFrame:
    """Rows of SCHEMA with ids_crc32 instead of the tokens."""

    def sums(batches):
        for batch in batches:
            lists = batch.column("tokens")
            ends = lists.offsets.to_pylist()
            data = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends, ends[1:])]
            names = ["doc_id", "shard", "shard_start", "n_tokens"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(crc, pa.int64())], [*names, "ids_crc32"]
            )

    schema = SCHEMA.replace("tokens array<int>", "ids_crc32 bigint")
    return tokens.mapInArrow(sums, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: writes the ids of all documents and describes each document from the files."""
    import public_tokenizers

    path = scratch_path(spark, "tokens")
    write_tokens(encode_sorted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")), path)
    found = _with_start(spark, path, checksums(read_tokens(spark, path)))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")
