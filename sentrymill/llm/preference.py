"""Preference formatting, in DataFrame functions only.

The turns that a chosen and a rejected conversation open with in common are rendered
once, as the prompt; what follows in each is a completion of its own in which only the
assistant's words are to be learnt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>\n", "<|end|>\n"
LEARNT_ROLE = "assistant"


def _conversations(turns: DataFrame, key: str, name: str) -> DataFrame:
    """All turns of a conversation in order, as one array. Turns with one number are
    ordered by role and text; a null number comes first. Null roles and texts count as
    empty."""
    turn = F.struct(
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return turns.groupBy(F.col(key).cast("long").alias("pair_id")).agg(
        F.sort_array(F.collect_list(turn)).alias(name))


def _head(t: Column) -> Column:
    return F.concat(F.lit(ROLE_OPEN), t["role"], F.lit(ROLE_CLOSE))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(TURN_END))), "")


def _spans(turns: Column) -> Column:
    """Where the learnt text lies in the rendered turns: (start, end) in characters, the
    end mark of the turn included, the role line not."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("array()").cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(TURN_END)
        own = F.array(F.struct(begin.cast("long").alias("start"), end.cast("long").alias("end")))
        return F.struct(
            end.cast("long").alias("at"),
            F.when(t["role"] == LEARNT_ROLE, F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step)["spans"]


def format_pairs(chosen: DataFrame, rejected: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row for each pair: `pair_id`, `n_prompt` (turns in common), `prompt`,
    `chosen`, `rejected` (completions), `chosen_spans`, `rejected_spans` (parts to learn).

    `chosen` and `rejected` hold turns (`key`, turn, role, text). The prompt is the longest
    run of first turns that are equal in role and text; the turn numbers themselves do not
    matter, only their order. A completion may be empty: when one conversation opens the
    other, when both are equal, or when a side has no turns for the pair. Turns with a
    null key belong to no pair. Repeated turns are turns of their own; ties are ordered by
    role and text. Extra columns are ignored; no turns give no rows. A conversation is held
    whole in one row. Nothing runs when called.
    """
    known = F.col(key).isNotNull()
    both = _conversations(chosen.where(known), key, "c").join(
        _conversations(rejected.where(known), key, "r"), "pair_id", "full_outer")
    empty = F.expr("array()").cast("array<struct<turn:long,role:string,text:string>>")
    both = both.select("pair_id", F.coalesce("c", empty).alias("c"), F.coalesce("r", empty).alias("r"))
    same = F.zip_with("c", "r", lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, F.lit(False))
    n = F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int")
    cut = both.withColumn("n", n).select(
        "pair_id", F.col("n").cast("long").alias("n_prompt"),
        F.slice("c", F.lit(1), F.col("n")).alias("p"),
        F.slice("c", F.col("n") + 1, F.size("c")).alias("c"),
        F.slice("r", F.col("n") + 1, F.size("r")).alias("r"))
    return cut.select(
        "pair_id", "n_prompt", _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"), _render(F.col("r")).alias("rejected"),
        _spans(F.col("c")).alias("chosen_spans"), _spans(F.col("r")).alias("rejected_spans"))


def stale_replies(turns: DataFrame) -> DataFrame:
    """A rejected side made of the conversations themselves: the last assistant turn
    repeats the assistant's turn before it; where there is none before it, it is left
    out. `turns` holds (conv_id, turn, role, text); other turns stay as they are."""
    order = Window.partitionBy("conv_id", F.col("role") == LEARNT_ROLE).orderBy("turn", "text")
    backwards = Window.partitionBy("conv_id", F.col("role") == LEARNT_ROLE).orderBy(F.desc("turn"), F.desc("text"))
    return (
        turns.select("conv_id", "turn", "role", "text")
        .withColumn("_last", (F.col("role") == LEARNT_ROLE) & (F.row_number().over(backwards) == 1))
        .withColumn("_before", F.lag("text").over(order))
        .withColumn("_first", F.row_number().over(order) == 1)
        .where(F.coalesce(~(F.col("_last") & F.col("_first")), F.lit(True)))
        .select("conv_id", "turn", "role",
                F.when(F.col("_last"), F.col("_before")).otherwise(F.col("text")).alias("text"))
    )
