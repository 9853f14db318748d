"""Preference pairs: a shared prompt and two masked completions.

Two conversations of a pair are compared turn by turn. The turns before the first one that differs
(role or text, or present on one side only) are their longest common prefix; it is rendered once as the
prompt. What follows is rendered as the chosen and the rejected completion. A completion's mask lists the
character spans that count for the loss: the texts and end marks of assistant turns.

Turns are first grouped by (pair, turn), so the two sides meet without a join, then by pair: one row is one
training example. Null pair ids belong to no conversation and are ignored. A null turn comes first, null roles and texts are
empty. Repeated rows count once; different rows of one turn follow each other by role and text. A pair with one side only has an
empty prompt. A pair without a difference is all prompt, with empty completions. Empty tables give no rows.
Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST = -(1 << 63)  # stands for a null turn
TURN = "array<struct<role:string,text:string>>"


def render(turn: Column) -> Column:
    """One turn of a conversation as text."""
    return F.concat(F.lit("<|im_start|>"), turn["role"], F.lit("\n"), turn["text"], F.lit("<|im_end|>\n"))


def _turns(df: DataFrame, side: int) -> DataFrame:
    empty = F.lit("")
    turn = F.struct(F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    return df.filter(F.col("pair_id").isNotNull()).select("pair_id", F.coalesce(F.col("turn").cast("long"), F.lit(FIRST)).alias("turn"), F.lit(side).alias("side"), turn.alias("t"))


def _mask(turns: Column) -> Column:
    """Character spans of the assistant turns' texts and end marks in the rendered completion."""
    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.char_length(F.concat(F.lit("<|im_start|>"), t["role"], F.lit("\n")))
        end = s["at"] + F.char_length(render(t))
        span = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(end.cast("long").alias("at"), F.when(t["role"] == "assistant", F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask and rejected_mask, from turns (pair_id, turn, role, text)."""
    both = _turns(chosen, 0).union(_turns(rejected, 1))
    by_turn = both.groupBy("pair_id", "turn").agg(*(F.sort_array(F.collect_set(F.when(F.col("side") == k, F.col("t")))).alias(n) for k, n in enumerate("ab")))
    pairs = by_turn.groupBy("pair_id").agg(F.sort_array(F.collect_list(F.struct("turn", "a", "b"))).alias("turns"))
    differs = F.array_position(F.transform("turns", lambda x: x["a"] != x["b"]), F.lit(True))
    pairs = pairs.withColumn("n_prompt_turns", F.when(differs == 0, F.size("turns")).otherwise(differs - 1).cast("long"))
    rest = F.slice("turns", F.col("n_prompt_turns").cast("int") + 1, F.greatest(F.size("turns"), F.lit(1)))
    pairs = pairs.select(
        "pair_id", "n_prompt_turns",
        F.flatten(F.transform(F.slice("turns", F.lit(1), F.col("n_prompt_turns").cast("int")), lambda x: x["a"])).alias("p"),
        F.flatten(F.transform(rest, lambda x: x["a"])).alias("a"),
        F.flatten(F.transform(rest, lambda x: x["b"])).alias("b"),
    )
    text = lambda c: F.array_join(F.transform(c, render), "")
    return pairs.select("pair_id", "n_prompt_turns", text("p").alias("prompt"), text("a").alias("chosen"), text("b").alias("rejected"), _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"))


def answers_of_next(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns out of one table of conversations (conv_id, turn, role, text).

    The rejected side answers like the next conversation: the text of the last assistant turn is that of the conversation with the next
    id; if that has none, the rejected side lacks the turn.
    """
    turns = conversations.select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    last = turns.filter("role = 'assistant' and pair_id is not null and turn is not null").groupBy("pair_id").agg(F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))).alias("l"))
    other = last.select((F.col("pair_id") - 1).alias("pair_id"), F.col("l.text").alias("other"))
    marks = last.select("pair_id", F.col("l.turn").alias("last")).join(other, "pair_id", "left")
    marked = turns.join(marks, "pair_id", "left")
    final = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    rejected = marked.filter(~F.coalesce(final, F.lit(False)) | F.col("other").isNotNull())
    return turns, rejected.select("pair_id", "turn", "role", F.when(final, F.col("other")).otherwise(F.col("text")).alias("text"))
