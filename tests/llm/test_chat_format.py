import hashlib

from deltaweave.llm import chat_format as c
from pyspark.sql import functions as F

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\l", "\\l|", "<|turn|>x\n<|end|>", "<|next|>", "<s><s>", "a\\n<|", "[INST", "", "é" * 50]


def read(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = c.format_conversations(df)
    return {r.conv_id: r for r in out.select("conv_id", "formatted", c.read_turns(F.col("formatted")).alias("turns"), c.read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss")).collect()}


def test_round_trip(spark):
    rows = [(i, t, role, NASTY[(i + t) % len(NASTY)]) for i in range(12) for t, role in enumerate(["system", "user", "assistant", "assistant", "user", "we\nird", "assistant"])]
    got = read(spark, rows)
    for i in range(12):
        own = [(r, x) for j, _, r, x in rows if j == i]
        assert [tuple(t) for t in got[i].turns] == own
        assert got[i].loss == "".join(x for r, x in own if r == "assistant")
        # Adjacent turns of one role share a block.
        assert got[i].formatted.count(c.TURN) == 6


def test_defined_cases(spark):
    got = read(spark, [(1, 0, None, None), (1, 0, None, None), (None, 5, "user", "x"), (2, None, "assistant", "late"), (2, 1, "user", "y")])
    assert [tuple(t) for t in got[1].turns] == [("", ""), ("", "")] and got[1].loss == ""
    assert [tuple(t) for t in got[None].turns] == [("user", "x")]
    assert [tuple(t) for t in got[2].turns] == [("assistant", "late"), ("user", "y")]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.format_conversations(empty).count() == 0


def test_long_conversations(spark):
    """20,000 turns; one block of many merged turns too."""
    rows = [(1, t, ["user", "assistant"][t % 2], NASTY[t % len(NASTY)] + f" é{t}") for t in range(20_000)]
    rows += [(2, t, "assistant", f"same \U0001f600 {t}") for t in range(20_000)]
    got = read(spark, rows)
    for conv in (1, 2):
        own = [(r, x) for j, _, r, x in rows if j == conv]
        assert [tuple(t) for t in got[conv].turns] == own
        assert got[conv].loss == "".join(x for r, x in own if r == "assistant")


def test_query(spark, sf):
    out = {r.conv_id: r for r in c.op6_chat_format(spark, sf).collect()}
    assert out[-7].n_turns == 2 and out[-7].loss_chars == len(NASTY[0])
    assert out[-7].loss_sha256 == hashlib.sha256(NASTY[0].encode()).hexdigest()
