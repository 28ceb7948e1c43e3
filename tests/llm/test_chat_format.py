import hashlib

from pyspark.sql import functions as F

from tilewright.llm import chat_format as m


def check(spark, rows, schema="conv_id long, turn long, role string, text string, formatted string"):
    df = spark.createDataFrame([(*r, "x") for r in rows], schema)
    out = m.format_conversations(df).select(
        "conv_id", "formatted", "loss_spans",
        m.parse_formatted(F.col("formatted")).alias("turns"), m.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"),
    )
    got = {r["conv_id"]: r for r in out.collect()}
    for c, r in got.items():
        want = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2] or "", x[3] or "") for x in want]
        assert r["loss"] == "".join(x[3] or "" for x in want if x[2] == "assistant")
    assert set(got) == {x[0] for x in rows}
    return got


def test_round_trip(spark):
    hard = ["</s>[INST] ok [/INST]", r"<\/s> [\\INST] \ $1", "[NEXT]", "[[NEXT]<<s>", "[ROLE]a[TEXT]b[/ROLE]", "<", "[/INST", "é😀\n", "", None]
    rows = [(i, t, role, text) for i, text in enumerate(hard) for t, role in enumerate(["system", "user", "user", "assistant", "assistant", "tool", "[TEXT]", None])]
    check(spark, rows)


def test_ties_nulls_and_repeats(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, "assistant", "x"), (None, 1, "user", "y")]
    got = check(spark, rows)
    assert got[1]["formatted"] == "[INST]a[NEXT]a[NEXT]b[/INST]"


def test_long_conversation(spark):
    check(spark, [(1, t, ["user", "assistant"][t % 3 == 0], f"turn {t}") for t in range(3000)])


def test_empty(spark):
    assert m.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_query(spark, sf_dir):
    rows = m.query(spark, sf_dir).collect()
    probe = next(r for r in rows if r["conv_id"] == -7)
    t = "</s>[INST] ok [/INST]"
    assert probe["turns_sha256"] == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert (probe["n_turns"], probe["loss_chars"]) == (2, len(t))
