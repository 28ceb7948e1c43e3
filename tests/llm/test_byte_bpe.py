import base64
import hashlib
import random
import time

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tilewright.llm import byte_bpe as m

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
HARD = [
    None, "", " ", "  a  b\n\n c\t\td \r\n", "don't  we'll I'M 'S", "x\x1cy\x1f z\x85w", "<|endoftext|> a", "日本語テキスト 😀😀",
    "a" * 700, "0123456789" * 30, "Thwhouble ereror$$$ thtion$$$", "long words " * 3000, "\x00\x01 é ̈",
]


@pytest.fixture(scope="module")
def tik():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def check(spark, path, texts, tik):
    got = {r["doc_id"]: r for r in m.query(spark, path).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        ids = tik.encode_ordinary(t or "")
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_query(spark, sf_dir, tik):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(spark, sf_dir, texts, tik)


def test_hard_texts_and_extra_columns(spark, tmp_path, tik):
    df = spark.createDataFrame([(i, t, "x", True) for i, t in enumerate(HARD)], "doc_id long, text string, words string, last boolean")
    df.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    check(spark, str(tmp_path), dict(enumerate(HARD)), tik)


@pytest.mark.parametrize("block", [1, 300, 20_000])
def test_small_blocks_round_trip(spark, tik, block):
    texts = [t or "" for t in HARD for _ in range(3)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    tokens = m.encode(df, PATH, public_tokenizers.PATTERN, block=block, common=block % 7, most=1 + block // 10)  # with no words folded ahead, and some; numbered anew often and seldom
    assert {r["doc_id"]: r["ids"] for r in tokens.collect()} == {i: tik.encode_ordinary(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in m.decode(tokens, PATH).collect()} == dict(enumerate(texts))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert m.encode(df, PATH, public_tokenizers.PATTERN).count() == 0


def long_words():
    rng = random.Random(3)
    pick = lambda letters, n: "".join(rng.choices(letters, k=n))
    return [
        pick("abcdefghijklmnopqrstuvwxyz", 100_000), "a" * 100_000, "ab" * 3000, "-" * 5000, pick("ab", 3000), pick("ehtio", 2000),
        pick("的一是不了人我在有他这", 2000), pick("éèàü", 3000), "the" * 1000, "aaab" * 500, pick("0123456789", 3000), "internationalization" * 50,
    ]


def test_long_words(spark, tik):
    texts = long_words()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8)
    began = time.perf_counter()
    got = {r["doc_id"]: r["ids"] for r in m.encode(df, PATH, public_tokenizers.PATTERN).collect()}
    assert time.perf_counter() - began < 60
    for i, t in enumerate(texts):
        assert got[i] == tik.encode_ordinary(t), i


def test_both_folds_agree_on_any_bytes(spark, tik):
    rng = random.Random(5)
    words = [bytes(rng.choices(range(256), k=n)) for n in range(1, 70)] + [rng.choice([b"abab", b"aaa", b"the", b"ehe"]) * n for n in range(1, 30)]
    df = spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "i long, w array<smallint>")
    ranks = m.rank_literal(PATH)
    for r in df.select("w", m.fold(F.col("w"), ranks).alias("one"), m.fold_wide(F.col("w"), ranks).alias("wide")).collect():
        want = tik._encode_single_piece(bytes(r["w"]))
        assert r["one"] == want and r["wide"] == want


def test_words_of_one_token_fold_to_it(spark):
    # the encoder takes a word that is a token as it is; the fold comes to the same for this vocabulary
    tokens = [(i, list(t)) for i, t in enumerate(m.vocabulary(PATH))]
    df = spark.createDataFrame(tokens, "i long, w array<smallint>").repartition(8)
    ids = m.fold(F.col("w"), m.rank_literal(PATH)).alias("ids")
    assert df.select("i", ids).where("size(ids) <> 1 OR ids[0] <> i").count() == 0


def test_rare_words_are_put_together_from_folded_pieces(tik):
    """Of words made of syllables many are known from pieces of common ones, and none has other ids than its own fold."""
    rng = random.Random(11)
    syllables = ["the", "and", "ing", "on", "re", "sh", "ble", "en", "ção", "ü", "st", "qu", "ci", "ón", "aa", "ab"]
    word = lambda n: (rng.choice(["", " "]) + "".join(rng.choices(syllables, k=n))).encode()
    one = lambda w: b"".join(i.to_bytes(4, "little") for i in tik._encode_single_piece(w))
    ids = {w: one(w) for w in (word(rng.randint(1, 4)) for _ in range(6000))}
    folded = m.Folded(ids, m.vocabulary(PATH))
    rare = [w for w in (word(rng.randint(4, 6)) for _ in range(6000)) if w not in ids and len(w) <= m.LONG]
    got = {w: folded.get(w) for w in rare + list(ids)}
    assert all(g is None or g == one(w) for w, g in got.items()) and all(got[w] == ids[w] for w in ids)
    assert sum(got[w] is not None for w in rare) > 0.4 * len(rare)
    assert m.Folded({}, m.vocabulary(PATH)).get(b"word") is None and folded.get(b"") is None and folded.get(b"the" * 100) is None


def test_pieces_leave_fewer_folds(spark, tik):
    """Words that a task folds itself, of documents of which the sample of common words holds one half."""
    rng = random.Random(12)
    syllables = ["the", "and", "ing", "on", "re", "sh", "ble", "en", "st", "qu", "ci", "aa"]
    texts = [" ".join("".join(rng.choices(syllables, k=rng.randint(1, 5))) for _ in range(4000)) for _ in range(8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    ids = m.common_words(df, PATH, public_tokenizers.PATTERN, sample_chars=sum(map(len, texts)) // 2)
    blocks = m._blocks(df, PATH, public_tokenizers.PATTERN, m.BLOCK, m.Folded(ids, m.vocabulary(PATH)), m.WORDS)
    counts = blocks.selectExpr("size(filter(words, w -> w IS NOT NULL)) AS own", "size(words) AS n").groupBy().sum("own", "n").collect()[0]
    distinct = len({w for t in texts for w in t.split(" ")})
    assert counts[1] >= distinct > 1.5 * len(ids) and counts[0] < 0.7 * (counts[1] - len(ids))
    got = {r["doc_id"]: r["ids"] for r in m.encode(df, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {i: tik.encode_ordinary(t) for i, t in enumerate(texts)}
