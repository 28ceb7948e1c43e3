import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tilewright.llm import packing, token_files

HARD = [
    None, "", " ", "  a  b\n\n c\t\td \r\n", "  x　　y ", "don't  we'll I'M 'S", "x\x1cy\x1f z\x85w",
    "ΑΣ ΣΑΣ. İI K é ̈a", "<|endoftext|> a<|startoftext|>b", "日本語テキスト 😀😀", "a" * 5000, "1234567 ½ ²", "long " * 9000,
    "a  <|endoftext|>  b <|startoftext|><|endoftext|>", "x<|endoftext|", "<|ENDOFTEXT|> <|endoftext|>'s ", "Straße ÄÖÜ ñandú ŒUVRE ªº ÇA façade l'été", "don't DON'T we'RE",
]


def documents(spark, path, texts):
    rows = [(i, t, "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, n_tokens long")
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    return dict(enumerate(texts))


def direct(name, texts):
    t = Tokenizer.from_file(public_tokenizers.path(name))  # as the library has it
    return {i: np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4") for i, x in texts.items()}


def check_files(spark, path, texts):
    want, at = direct("byte_bpe_50k.json", texts), 0
    got = {r["doc_id"]: r for r in token_files.query(spark, path).collect()}
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = np.append(want[i], 0).astype("<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes())), i
        at += len(ids)


def test_files(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_files(spark, sf_dir, texts)


def test_files_hard_texts(spark, tmp_path):
    check_files(spark, str(tmp_path), documents(spark, tmp_path, HARD))


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_selective_reads(spark, tmp_path, encoding):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = token_files.encode_sorted(docs, public_tokenizers.path("byte_bpe_50k.json"))
    path = f"{tmp_path}/tokens"
    token_files.write_tokens(rows, path, encoding, page_rows=50)
    some = token_files.read_tokens(spark, path, [7, 300]).collect()
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["tokens"] for r in some} == {i: [*t.encode(f"text {i}").ids, 0] for i in (7, 300)}
    meta = token_files.read_metadata(spark, path)
    assert "tokens:array" not in meta._jdf.queryExecution().executedPlan().toString().split("ReadSchema", 1)[1]
    starts = [(r["start"], r["n_tokens"]) for r in meta.orderBy("doc_id").collect()]
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_null_and_repeated_ids(spark, tmp_path):
    df = spark.createDataFrame([(None, "a"), (3, "b"), (3, "b"), (3, None)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    rows = token_files.query(spark, str(tmp_path)).collect()
    assert sorted((r["start"], r["n_tokens"]) for r in rows) == [(0, 2), (2, 1), (3, 2), (5, 2)]
    assert packing.query(spark, str(tmp_path)).count() == 4


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert token_files.query(spark, str(tmp_path)).count() == 0
    assert packing.query(spark, str(tmp_path)).count() == 0


def check_packing(spark, path, texts):
    want = direct("word_bpe_49k.json", texts)
    rows = packing.query(spark, path).toPandas()
    for i, g in rows.sort_values("piece").groupby("doc_id"):
        ids = np.append(want[i], 1).astype("<u4")
        assert list(g["piece"]) == list(range(-(-len(ids) // 4096)))
        for r in g.itertuples():
            part = ids[4096 * r.piece : 4096 * (r.piece + 1)]
            assert (r.start, r.length, r.ids_crc32) == (4096 * r.piece, len(part), zlib.crc32(part.tobytes()))
    assert set(rows["doc_id"]) == set(texts)
    for _, g in rows.sort_values("offset").groupby("sequence_id"):
        assert list(g["offset"]) == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 4096
    least = -(-rows["length"].sum() // 4096)
    assert rows["sequence_id"].nunique() <= 1.02 * least + 1
    return rows


def test_packing(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check_packing(spark, sf_dir, texts)


def test_packing_hard_texts(spark, tmp_path):
    check_packing(spark, str(tmp_path), documents(spark, tmp_path, HARD))


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(4096, 4096, 4096.0**2), (4096, 3, 4096.0**2), (4096, 50, 2e6)])
def test_every_capacity_holds(rule, caps):
    rng = np.random.default_rng(1)
    lengths = np.sort(np.minimum(rng.geometric(1 / 300, 3000), 1400))[::-1].copy()
    where = packing.assign(lengths, caps, rule=rule)
    ask = packing.demands(lengths)
    for c, cap in enumerate(caps):
        assert np.bincount(where, ask[:, c]).max() <= cap * (1 + 1e-9)
    assert len(np.unique(where)) == where.max() + 1
    assert where.max() + 1 <= 1.2 * max(ask[:, c].sum() / cap for c, cap in enumerate(caps)) + 2


def test_shards_hold_all_pieces(spark):
    df = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"),
        (1 + F.col("id") % 900).alias("length"), F.lit(0).cast("long").alias("ids_crc32"),
    )
    rows = packing.pack(df, capacity=1000, max_documents=4, shard_pieces=200).toPandas()
    by = rows.groupby("sequence_id")
    assert len(rows) == 3000 and by["length"].sum().max() <= 1000 and by.size().max() <= 4


def test_special_strings_as_plain_text(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    for name, rows in (
        ("byte_bpe_50k.json", token_files.encode_sorted(df, public_tokenizers.path("byte_bpe_50k.json"), plain=True).select(F.col("tokens").alias("ids"))),
        ("word_bpe_49k.json", packing.tokenize_pieces(df, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, plain=True).select("ids")),
    ):
        t = Tokenizer.from_file(public_tokenizers.path(name))
        t.encode_special_tokens = True
        assert rows.collect()[0]["ids"][:-1] == t.encode("a <|endoftext|> b", add_special_tokens=False).ids


def test_one_doc_id_is_dealt_over_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or so few rows are put together again
    df = spark.range(4000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    rows = token_files.encode_sorted(df, public_tokenizers.path("byte_bpe_50k.json"))
    most = rows.groupBy("shard").count().agg(F.max("count")).collect()[0][0]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 2000


def test_documents_and_attention_decide_between_sequences():
    rng = np.random.default_rng(5)
    lengths = np.sort(np.minimum(rng.geometric(1 / 700, 6000), 4096))[::-1].copy()
    caps = (4096, 4096, 4096.0**2)
    groups = lambda where: set(map(tuple, (np.flatnonzero(where == s) for s in range(where.max() + 1))))
    scalar = packing.assign(lengths, caps, weights=(1, 0, 0))
    every = packing.assign(lengths, caps)
    assert every.max() <= scalar.max() + 1 and every.max() + 1 <= lengths.sum() / 4096 * 1.01 + 1
    for weights in ((1, 0, 3), (1, 900, 0)):
        assert len(groups(packing.assign(lengths, caps, weights)) & groups(scalar)) < 0.9 * len(groups(scalar))
    assert len(groups(every) & groups(scalar)) < 0.9 * len(groups(scalar))
