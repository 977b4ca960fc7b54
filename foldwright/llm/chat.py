"""Operator 5: relational chat formatting with a reversible template and a loss mask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, table

#: Fixed values of the template. Every control string begins with "<", which escaped text never holds.
TURN_OPEN = "<turn "
HEAD_END = ">"
SEAM = "<seam>"
TURN_CLOSE = "</turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Escape so that no control character is left: backslash to backslash b, "<" to backslash l, ">" to backslash g."""
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def merged_turns(turns: Column) -> Column:
    """Blocks of adjacent turns of one role: array of (role, parts), by array functions over the sorted turns.

    The places where the role changes are found first, then each block is one slice, so the work grows with the turns.
    """

    def blocks(a: Column) -> Column:
        begins = F.filter(F.transform(a, lambda x, i: F.when(~F.get(a, i - 1)["role"].eqNullSafe(x["role"]), i)), lambda i: i.isNotNull())
        return bind(begins, lambda at: F.transform(at, lambda i, k: F.struct(F.get(a, i)["role"].alias("role"), F.transform(F.slice(a, i + 1, F.coalesce(F.get(at, k + 1), F.size(a)) - i), lambda x: x["text"]).alias("parts"))))

    return bind(turns, blocks)


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a conversation: ``formatted`` and ``loss_spans`` (code-point start and length of each loss part in it).

    The turns of a conversation are collected as structs and sorted by turn, role, text (null turns first); adjacent
    turns of one role become one block, with a seam between them; texts and roles are escaped. A null text or role is
    empty; repeated rows are turns of their own; rows with a null conversation form one. An empty table gives no rows.
    Other columns are ignored. A conversation is one string of the result, so it must fit a row.
    """
    piece = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    chats = rows.groupBy(conv).agg(F.sort_array(F.collect_list(piece)).alias("turns"))
    chats = chats.select(conv, merged_turns(F.col("turns")).alias("blocks"))

    def pieces(block: Column) -> Column:
        loss = block["role"] == LOSS_ROLE
        inner = F.transform(
            block["parts"],
            lambda t, i: F.array(
                F.struct(F.when(i > 0, F.lit(SEAM)).otherwise(F.lit("")).alias("s"), F.lit(False).alias("loss")),
                F.struct(escape(t).alias("s"), loss.alias("loss")),
            ),
        )
        head = F.array(F.struct(F.concat(F.lit(TURN_OPEN), escape(block["role"]), F.lit(HEAD_END)).alias("s"), F.lit(False).alias("loss")))
        tail = F.array(F.struct(F.lit(TURN_CLOSE).alias("s"), F.lit(False).alias("loss")))
        return F.concat(head, F.flatten(inner), tail)

    chats = chats.select(conv, F.flatten(F.transform("blocks", pieces)).alias("pieces"))
    zero = F.expr("named_struct('at', 0L, 'spans', CAST(array() AS array<struct<start:bigint,length:bigint>>))")

    def walk(acc: Column, x: Column) -> Column:
        n = F.char_length(x["s"]).cast("long")
        span = F.array(F.struct(acc["at"].alias("start"), n.alias("length")))
        return F.struct((acc["at"] + n).alias("at"), F.when(x["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return chats.select(conv, F.array_join(F.transform("pieces", lambda x: x["s"]), "").alias("formatted"), F.aggregate("pieces", zero, walk)["spans"].alias("loss_spans"))


def read_chats(chats: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The turns and the loss text read back from ``formatted`` and ``loss_spans``."""
    blocks = F.filter(F.split("formatted", TURN_CLOSE), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.substring_index(block, HEAD_END, 1)
        role = unescape(F.substr(head, F.lit(len(TURN_OPEN) + 1)))
        body = F.substr(block, F.char_length(head) + 2)
        return F.transform(F.split(body, SEAM), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    loss = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select(conv, "formatted", F.flatten(F.transform(blocks, turns)).alias("turns"), F.array_join(loss, "").alias("loss_text"))


def op5_relational_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    back = read_chats(format_chats(rows.unionByName(planted)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), marked AS (
  SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER w THEN 1 ELSE 0 END AS opens,
    length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) AS chars,
    length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g')) AS role_chars
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars + CASE WHEN opens = 1 THEN role_chars + 15 ELSE 6 END) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""
