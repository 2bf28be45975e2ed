"""Chat formatting: round trips, parts, masks."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spotgrid.llm import chat

NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>", "\\<|", "<\\|end|>", "\\\\", "<<SYS>> <</SYS>>", "<", "<|text|>", "a\nb", "", "é🦜", "$1 \\2", "[[/INST]]"]


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    pieces = st.sampled_from(NASTY + ["\\", "|", "<", ">", "[", "INST]", "/", "s>", "SYS>>", "end|>"])

    texts = set(NASTY)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(pieces, max_size=6))
    def gather(parts):
        texts.add("".join(parts))

    gather()
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    rows = df.select("t", "e", chat.unescape(F.col("e")).alias("u"), F.col("e").rlike(chat.CONTROL).alias("left")).collect()
    assert all(r["t"] == r["u"] and not r["left"] for r in rows)


def read(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("written", F.lit("mine"))
    made = chat.format_conversations(df.select("written", "conv_id", "turn", "role", chat.text_parts(F.col("text")).alias("parts")))
    out = made.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    return {r["conv_id"]: ([tuple(t) for t in r["turns"]], r["loss"]) for r in out.collect()}


def test_conversations_come_back(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)]
    rows += [(None, 0, None, None), (2, 1, "assistant", None), (2, None, "system", "s"), (3, 0, "we<|says|>ird\n", "x"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y")]
    rows += [(4, i, "assistant", "long " * 50) for i in range(400)]
    got = read(spark, rows)
    assert got[1] == ([(("user", "assistant")[i % 2], t) for i, t in enumerate(NASTY)], "".join(NASTY[1::2]))
    assert got[None] == ([("", "")], "")
    assert got[2] == ([("system", "s"), ("assistant", "")], "")
    assert got[3] == ([("assistant", "y"), ("assistant", "y"), ("we<|says|>ird\n", "x")], "yy")
    assert len(got[4][0]) == 400 and got[4][1] == "long " * 20000
    assert read(spark, rows[:0]) == {}


def test_typed_parts(spark):
    part = "struct<kind:string,text:string,ref:string,units:bigint>"
    parts = [("text", "see <|", None, None), ("text", "end|> this", None, None), ("image", None, "a.png", 4), None, ("audio", None, "b.ogg", None), (None, "ok", None, None), ("video", None, "c", 9)]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", [("document", None, "d.pdf", 2)]), (1, 2, "user", None)], f"conv_id long, turn long, role string, parts array<{part}>")
    row = chat.format_conversations(df).first()
    assert "<|image:1|><|audio:2|>ok<|video:3|>" in row["formatted"]
    assert [(a["turn"], a["number"], a["kind"], a["ref"], a["tokens"]) for a in row["attachments"]] == [
        (0, 1, "image", "a.png", 1024), (0, 2, "audio", "b.ogg", 50), (0, 3, "video", "c", 0), (1, 1, "document", "d.pdf", 1024),
    ]
    assert row["attachment_tokens"] == 2098
    turns = spark.createDataFrame([row]).select(chat.read_turns(F.col("formatted")).alias("t")).first()["t"]
    assert turns[0]["text"].startswith("see <|end|> this") and len(turns) == 3
