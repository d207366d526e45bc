"""Operator 6, chat formatting with Spark expressions only.

A conversation's turns are collected, sorted, merged where neighbours have the same role, and joined:

    <|turn|>ROLE<|text|>TEXT<|next|>TEXT<|end|>\n<|turn|>ROLE ...

<|next|> keeps merged turns apart, so that the original turns can be read back. Inside roles and texts a
backslash is doubled and a backslash goes after the first sign of every control string; both are undone
by ``unescape``. The loss mask is a list of spans (start, length) of code points, one for each assistant
text.

Rows: a null text or role counts as empty. Turns are in the order of turn (nulls first), then role, then
text; repeated rows are turns of their own. Rows with a null conv_id are one conversation. Offsets are a
running sum over the sorted turns, made before they are collected, so cost is linear in text and turns
but for the sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import table

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>\n"
#: Strings that no text may hold as they are: this template's "<|" and other templates' marks.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_BACK = "\\"


def _hidden(mark: str) -> str:
    return mark[0] + _BACK + mark[1:]


def escape(text: Column, control: Sequence[str] = CONTROL) -> Column:
    out = F.replace(text, F.lit(_BACK), F.lit(_BACK * 2))
    for mark in control:
        out = F.replace(out, F.lit(mark), F.lit(_hidden(mark)))
    return out


def unescape(text: Column, control: Sequence[str] = CONTROL) -> Column:
    out = text
    for mark in control:
        out = F.replace(out, F.lit(_hidden(mark)), F.lit(mark))
    return F.replace(out, F.lit(_BACK * 2), F.lit(_BACK))


def format_chats(turns: DataFrame, learn: str = "assistant", control: Sequence[str] = CONTROL) -> DataFrame:
    """conv_id, formatted, loss (spans of the texts of the role to learn) of turns (conv_id, turn, role, text)."""
    if "<|" not in control:
        raise ValueError("the template's own marks must be among the control strings")
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role").alias("role"), empty("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "role", F.row_number().over(order).alias("n"), F.lag("role").over(order).alias("before"), escape(F.col("text"), control).alias("text"))
    # what stands before each text in the output: the mark within a run of one role, or that at the head of one
    head = F.when(F.col("n") > 1, F.lit(len(END))).otherwise(F.lit(0)) + len(TURN) + F.length(escape(F.col("role"), control)) + len(TEXT)
    rows = rows.withColumn("mark", F.when(F.col("before").eqNullSafe(F.col("role")), F.lit(len(NEXT))).otherwise(head).cast("long"))
    upto = F.sum(F.col("mark") + F.length("text")).over(Window.partitionBy("conv_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("start", upto - F.length("text"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("n", "role", "text", "start"))).alias("t")).withColumn("size", F.size("t"))
    # where a run of one role begins (positions from 1), and where it ends
    ordered = ordered.withColumn("b", F.filter(F.sequence(F.lit(1), F.col("size")), lambda i: (i == 1) | (F.get("t", i - 1)["role"] != F.get("t", F.greatest(i - 2, F.lit(0)))["role"])))
    merged = F.transform("b", lambda i, k: F.concat(
        F.lit(TURN), escape(F.get("t", i - 1)["role"], control), F.lit(TEXT),
        F.array_join(F.transform(F.slice("t", i, F.coalesce(F.get("b", k + 1), F.col("size") + 1) - i), lambda x: x["text"]), NEXT),
    ))
    formatted = F.concat(F.array_join(merged, END), F.lit(END))
    spans = F.transform(F.filter("t", lambda x: x["role"] == learn), lambda x: F.struct(x["start"].alias("start"), F.length(x["text"]).cast("long").alias("length")))
    return ordered.select("conv_id", formatted.alias("formatted"), spans.alias("loss"))


def read_chats(chats: DataFrame, control: Sequence[str] = CONTROL) -> DataFrame:
    """conv_id, turns (role, text) and loss_texts, read back from formatted and loss."""
    split = lambda c, mark: F.split(c, r"\Q" + mark + r"\E")
    body = F.substring(F.col("formatted"), F.lit(len(TURN) + 1), F.length("formatted") - len(TURN) - len(END))
    runs = F.transform(split(body, END + TURN), lambda x: split(x, TEXT))
    turns = F.flatten(F.transform(runs, lambda x: F.transform(split(F.get(x, F.lit(1)), NEXT), lambda s: F.struct(unescape(F.get(x, F.lit(0)), control).alias("role"), unescape(s, control).alias("text")))))
    texts = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")), control))
    return chats.select("conv_id", "formatted", turns.alias("turns"), texts.alias("loss_texts"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    says = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = read_chats(format_chats(turns))
    loss = F.array_join("loss_texts", "")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        digest(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        digest(loss).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '\\', '\\\\')"
    for mark in CONTROL:
        out = f"replace({out}, '{mark}', '{_hidden(mark)}')"
    return out


OP6_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), o AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM c
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({_sql_escape("text")}) + CASE WHEN before = role THEN {len(NEXT)} ELSE {len(TURN) + len(TEXT) + len(END)} + length({_sql_escape("role")}) END) AS BIGINT) AS formatted_chars
FROM o GROUP BY conv_id
"""
