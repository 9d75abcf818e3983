"""Chat formatting by prefix-target expansion, with SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    r"""Puts `\` after each `\`, `<` and `[`, so that no control string stays in a text."""
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def format_chats(
    turns: DataFrame,
    trainable: str = "assistant",
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Examples of all conversations: (id, example_no, n_turns, formatted, loss_start, loss_end).

    Every turn of the trainable role gives an example: all turns before it as context, then its
    own text, the only part under the loss mask, code points loss_start to loss_end of
    `formatted`. Turns after the last trainable one, or a conversation without one, give a last
    example without a mask (both ends equal), so that no turn is lost. A turn is written
    `<|im_start|>role<|im_sep|>text<|im_end|>` with role and text escaped.

    Turns go by turn, null first, equal ones by role and text; repeated rows are turns of their
    own. Null text or role is empty; null ids are one conversation. A conversation is one
    training document and built in one task, in size about its text times its trainable turns.
    An empty table gives no rows. Other columns are not read.
    """
    filled = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col)]
    chats = turns.groupBy(F.col(id_col).alias("_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(turn_col).alias("_t"), filled[0].alias("role"), filled[1].alias("text")))).alias("_all")
    )
    heads = F.transform("_all", lambda x: F.concat(F.lit(START), escape(x.role), F.lit(SEP)))
    bodies = F.transform("_all", lambda x: escape(x.text))
    chats = chats.select(
        "_id",
        heads.alias("_heads"),
        bodies.alias("_bodies"),
        F.filter(
            F.transform("_all", lambda x, i: F.when(x.role == trainable, i + 1).otherwise(F.lit(0))), lambda i: i > 0
        ).alias("_at"),
    )
    n = F.size("_heads")
    ends = F.when(F.coalesce(F.try_element_at("_at", F.lit(-1)) < n, F.lit(True)), F.concat("_at", F.array(-n))).otherwise(F.col("_at"))
    last = F.abs("_end")
    written = F.zip_with("_heads", "_bodies", lambda h, b: F.concat(h, b, F.lit(END)))
    # The turns before, the target's head, and the target's text where it is trainable.
    examples = (
        chats.select("_id", "_heads", "_bodies", written.alias("_written"), F.posexplode(ends).alias("example_no", "_end"))
        .withColumn("_context", F.array_join(F.slice("_written", F.lit(1), F.greatest(last - 1, F.lit(0))), ""))
        .withColumn("_head", F.concat("_context", F.element_at("_heads", last)))
        .withColumn("_body", F.element_at("_bodies", last))
    )
    start = F.length("_head")
    return examples.select(
        F.col("_id").alias(id_col),
        "example_no",
        last.alias("n_turns"),
        F.concat("_head", "_body", F.lit(END)).alias("formatted"),
        start.alias("loss_start"),
        (start + F.when(F.col("_end") > 0, F.length("_body")).otherwise(F.lit(0))).alias("loss_end"),
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted example."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    cut = F.transform(parts, lambda p: F.split(F.substring_index(p, END, 1), r"<\|im_sep\|>", 2))
    return F.transform(cut, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def read_target(formatted: Column, start: Column, end: Column) -> Column:
    """The text under the loss mask, read back from a formatted example."""
    return unescape(F.substring(formatted, start + 1, end - start))


def digest(examples: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns and trained text of each conversation, read back from its examples."""
    per = examples.groupBy(id_col).agg(
        F.max_by("formatted", "n_turns").alias("_longest"),
        F.array_sort(
            F.collect_list(F.struct("example_no", read_target(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("text")))
        ).alias("_trained"),
        F.sum(F.length("formatted")).alias("formatted_chars"),
    )
    turns = F.transform(read_turns(F.col("_longest")), lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    loss = F.array_join(F.transform("_trained", lambda t: t.text), "")
    return per.select(id_col, turns.alias("_turns"), loss.alias("_loss"), "formatted_chars").select(
        id_col,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_turns", ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def op4_chat(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of all conversations and of one that says control strings."""
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return digest(format_chats(turns.unionByName(odd)))


#: Escaping adds one character to each `\`, `<` and `[`; marks are 12, 10 and 10 long.
SQL_CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS no,
         32 + length(role) + length(text) + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) AS chars
  FROM t),
u AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY no) AS up_to,
             max(no) OVER (PARTITION BY conv_id) AS last FROM n)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY no)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY no) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(up_to) FILTER (role = 'assistant' OR no = last)::BIGINT AS formatted_chars
FROM u GROUP BY conv_id
"""
