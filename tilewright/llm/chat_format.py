"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted, adjacent turns of one role are
merged into blocks, and the blocks are concatenated under a template::

    [SYS]..[/SYS]   [INST]..[/INST]   <s>..</s>   [ROLE]name[TEXT]..[/ROLE]

for system, user, assistant and any other role. ``[NEXT]`` separates the turns that a block
merges, so that the original turns can be read back. A control string inside a text gets a
backslash after its first character (one more if it has some already), which is undone on reading.

Null text and null role count as empty, a null conv_id is a conversation of its own, turns with
equal numbers are ordered by role and text, repeated rows are turns of their own, an empty table
gives an empty result, and other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.session import table

#: What follows the first character of each control string.
TAILS = r"(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|TEXT\]|NEXT\])"
#: Opening and closing marks by role.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE]", "[TEXT]", "[/ROLE]")
NEXT = "[NEXT]"
BLOCK = r"(?s)(?:\[SYS\]|\[INST\]|<s>|\[ROLE\]).*?(?:\[/SYS\]|\[/INST\]|</s>|\[/ROLE\])"


def let(value: Column, body) -> Column:
    """``body`` of a variable bound to ``value``, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){TAILS}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){TAILS}", "$1$2$3")


def _opening(role: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]))
    for name, (start, _) in MARKS.items():
        out = F.when(role == name, start).otherwise(out)
    return out


def _closing(role: Column) -> Column:
    out = F.lit(OTHER[2])
    for name, (_, end) in MARKS.items():
        out = F.when(role == name, end).otherwise(out)
    return out


def _blocks(turns: Column) -> Column:
    """Runs of one role in sorted turns: array of (role, texts)."""
    n = F.size(turns)
    places = F.sequence(F.lit(0), n)
    role = lambda i: F.get(turns, i)["role"]
    starts = F.filter(places, lambda i: (i == 0) | (i == n) | (role(i) != role(i - 1)))
    return let(
        starts,
        lambda s: F.transform(
            F.slice(s, 1, F.size(s) - 1),
            lambda a, k: F.struct(
                role(a).alias("role"),
                F.transform(F.slice(turns, a + 1, F.get(s, k + 1) - a), lambda t: t["text"]).alias("texts"),
            ),
        ),
    )


def _segments(blocks: Column) -> Column:
    """The output cut into pieces (s, loss); loss marks the texts of the assistant."""
    piece = lambda s, loss: F.struct(s.alias("s"), loss.alias("loss"))
    no = F.lit(False)

    def block(b: Column) -> Column:
        inner = F.transform(
            b["texts"],
            lambda t, i: F.array(
                piece(F.when(i == 0, _opening(b["role"])).otherwise(F.lit(NEXT)), no),
                piece(escape(t), b["role"] == "assistant"),
            ),
        )
        return F.concat(F.flatten(inner), F.array(piece(_closing(b["role"]), no)))

    return F.flatten(F.transform(blocks, block))


def _spans(segments: Column) -> Column:
    """(start, length) in code points of the pieces under the loss mask.

    Starts are gathered as text, which grows by appending alone, however many turns there are.
    """
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        size = F.char_length(x["s"])
        span = F.when(x["loss"], F.concat(acc["at"].cast("string"), F.lit(" "), size.cast("string"), F.lit(","))).otherwise("")
        return F.struct((acc["at"] + size).alias("at"), F.concat(acc["spans"], span).alias("spans"))

    listed = F.aggregate(segments, zero, step, lambda acc: F.filter(F.split(acc["spans"], ","), lambda s: s != ""))
    number = lambda s, i: F.split_part(s, F.lit(" "), F.lit(i)).cast("int")
    return F.transform(listed, lambda s: F.struct(number(s, 1).alias("start"), number(s, 2).alias("length")))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, formatted, loss_spans, one row for each conversation.

    ``loss_spans`` lists where in ``formatted`` the texts of the assistant stand.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    grouped = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("_turns"))
    out = let(
        let(F.col("_turns"), lambda t: _segments(_blocks(t))),
        lambda s: F.struct(
            F.array_join(F.transform(s, lambda x: x["s"]), "").alias("formatted"), _spans(s).alias("loss_spans")
        ),
    )
    return grouped.select("conv_id", out.alias("_out")).select("conv_id", "_out.formatted", "_out.loss_spans")


def parse_formatted(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), one for each original turn."""

    def turns(block: Column) -> Column:
        other = F.startswith(block, F.lit(OTHER[0]))
        role = F.when(other, unescape(F.regexp_extract(block, r"(?s)^\[ROLE\](.*?)\[TEXT\]", 1)))
        for name, (start, _) in MARKS.items():
            role = role.when(F.startswith(block, F.lit(start)), name)
        body = F.when(other, F.regexp_extract(block, r"(?s)^\[ROLE\].*?\[TEXT\](.*)\[/ROLE\]$", 1))
        for start, end in MARKS.values():
            inside = F.substr(block, F.lit(len(start) + 1), F.char_length(block) - len(start) - len(end))
            body = body.when(F.startswith(block, F.lit(start)), inside)
        return let(
            role,
            lambda r: F.transform(
                F.split(body, r"\[NEXT\]", -1), lambda t: F.struct(r.alias("role"), unescape(t).alias("text"))
            ),
        )

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(BLOCK), F.lit(0)), turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    cut = lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))
    return F.array_join(F.transform(spans, cut), "")


def with_probe(conversations: DataFrame) -> DataFrame:
    """The conversations and conversation -7, whose texts are control strings."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(probe)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: formats all conversations and conversation -7, and reads the output back."""
    out = format_conversations(with_probe(table(spark, sf_dir, "conversations")))
    line = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    digest = let(
        parse_formatted(F.col("formatted")),
        lambda turns: F.struct(
            F.size(turns).cast("bigint").alias("n_turns"),
            F.sha2(F.array_join(F.transform(turns, line), ""), 256).alias("turns_sha256"),
        ),
    )
    loss = let(
        loss_text(F.col("formatted"), F.col("loss_spans")),
        lambda t: F.struct(
            F.char_length(t).cast("bigint").alias("loss_chars"), F.sha2(t, 256).alias("loss_sha256")
        ),
    )
    return out.select(
        "conv_id", digest.alias("_d"), loss.alias("_l"), F.char_length("formatted").cast("bigint").alias("formatted_chars")
    ).select("conv_id", "_d.*", "_l.*", "formatted_chars")


#: The same in DuckDB: digests straight from the rows, and the length of the output from the template.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), marked AS (
  SELECT *,
    role IS DISTINCT FROM lag(role) OVER w AS opens,
    regexp_replace(text, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|TEXT\]|NEXT\])', '\1\\\2\3', 'g') AS escaped,
    regexp_replace(role, '([<\[])(\\*)(/?s>|/?SYS\]|/?INST\]|/?ROLE\]|TEXT\]|NEXT\])', '\1\\\2\3', 'g') AS escaped_role
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + CASE WHEN NOT opens THEN 6 WHEN role = 'system' THEN 11 WHEN role = 'user' THEN 13
    WHEN role = 'assistant' THEN 7 ELSE 19 + length(escaped_role) END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
