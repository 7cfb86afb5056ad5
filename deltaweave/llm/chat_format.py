"""Chat formatting as relational expressions.

Turns look at their neighbours' roles in the conversation's order, and a turn whose role equals its predecessor's joins that one's
block; a running sum of lengths gives each text's place. The placed pieces of a conversation are then collected as structs, sorted,
and concatenated by array functions. (Merging inside the collected array would copy or look it up once for each turn; this
way the time is linear in the turns but for the sort: 100,000 turns of one conversation take seconds.) Everything runs in the JVM.

Layout: `<s>`, then for each block `<|turn|>role\\ntext<|end|>`, its merged turns divided by `<|next|>`.
Inside roles and texts a backslash is doubled and the first character of each control string becomes a backslash
and a letter, so that no control string can come from a text and `unescape` gives back
every text. `loss_mask` holds start and length, in code points of `formatted`, of each assistant text.

Defined cases: null texts and roles are empty; turns sort by turn, then role, then text, nulls first;
repeated rows are turns of their own; rows with a null conversation form one conversation; an empty
table gives no rows; other columns are not read. One conversation is one string and so one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from deltaweave.llm.common import table

BEGIN, TURN, NEXT, END = "<s>", "<|turn|>", "<|next|>", "<|end|>"
#: What is escaped: a control string's beginning and what stands for it. Fixed values.
ESCAPES = [("\\", "\\\\"), ("<|", "\\l|"), ("<s>", "\\ls>"), ("</s>", "\\l/s>"), ("[INST]", "\\bINST]"), ("[/INST]", "\\b/INST]")]


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    """Every backslash of an escaped text begins a pair, so dividing at doubled ones from the left is safe."""

    def letters(x: Column) -> Column:
        for safe, plain in (("\\l", "<"), ("\\b", "["), ("\\n", "\n")):
            x = F.replace(x, F.lit(safe), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\", -1), letters), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def format_conversations(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_mask array<struct<start, length>>."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    near = rows.select("*", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"))
    opens = F.concat(F.lit(TURN), escape_role(F.col("role")), F.lit("\n"))
    pieces = near.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.when(F.col("before") == F.col("role"), F.lit(NEXT)).otherwise(opens).alias("head"),
        escape(F.col("text")).alias("body"),
        F.when(F.col("after") == F.col("role"), F.lit("")).otherwise(F.lit(END)).alias("tail"),
    )
    size = (F.length("head") + F.length("body") + F.length("tail")).cast("long")
    earlier = w.rowsBetween(W.unboundedPreceding, -1)
    placed = pieces.select("*", F.row_number().over(w).alias("at"), (F.coalesce(F.sum(size).over(earlier), F.lit(0)) + len(BEGIN) + F.length("head")).alias("start"))
    struct = F.struct("at", F.concat("head", "body", "tail").alias("piece"), "start", F.length("body").cast("long").alias("length"), (F.col("role") == loss_role).alias("loss"))
    convs = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(struct)).alias("ps"))
    return convs.select(
        "conv_id",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("ps", lambda p: p["piece"]), "")).alias("formatted"),
        F.transform(F.filter("ps", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted conversation holds: array<struct<role, text>>."""
    blocks = F.slice(F.split(formatted, r"<\|turn\|>", -1), F.lit(2), F.size(F.split(formatted, r"<\|turn\|>", -1)))

    def block_turns(block: Column) -> Column:
        at = F.instr(block, F.lit("\n"))
        role = unescape(F.substr(block, F.lit(1), at - 1))
        body = F.substr(block, at + 1, F.length(block) - at - len(END))
        return F.transform(F.split(body, r"<\|next\|>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, block_turns))


#: Code points in one chunk of a string that is read at many places.
CHUNK = 1024


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped.

    The string is cut into chunks once (a lambda's variable holds them), so a place is found without counting from the beginning.
    """

    def under(chunks: Column) -> Column:
        def text(m: Column) -> Column:
            first = F.floor(m["start"] / CHUNK).cast("int")
            n = F.floor((m["start"] + m["length"]) / CHUNK).cast("int") - first + 1
            return F.substr(F.array_join(F.slice(chunks, first + 1, n), ""), (m["start"] - first * CHUNK + 1).cast("int"), m["length"].cast("int"))

        return F.array_join(F.transform(mask, text), "")

    cut = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))
    return unescape(F.get(F.transform(F.array(cut), under), F.lit(0)))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(extra).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = format_conversations(turns)
    read = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = r"replace(replace(replace(replace(replace(replace({}, '\', '\\'), '<|', '\l|'), '<s>', '\ls>'), '</s>', '\l/s>'), '[INST]', '\bINST]'), '[/INST]', '\b/INST]')"

OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, lag(role) OVER w AS before, lead(role) OVER w AS after FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), f AS (
  SELECT *, CASE WHEN before = role THEN '{NEXT}' ELSE '{TURN}' || replace({_ESC.format('role')}, chr(10), '\\n') || chr(10) END
    || {_ESC.format('text')} || CASE WHEN after = role THEN '' ELSE '{END}' END AS piece
  FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(length(piece)))::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
