"""Preference formatting: one shared prompt, two masked completions.

A pair names a chosen and a rejected conversation. The longest common prefix of their turns
(equal role and equal text, turn by turn) is rendered once as the prompt; what follows in each
is rendered as its completion. A completion also comes as segments, each with a loss mask: 1 for
what the assistant says, 0 for all else.

Defined cases
-------------
* A null role or text counts as empty. Turns are taken by (turn, role, text), null turns first;
  repeated rows are turns of their own.
* A conversation that is missing has no turns: the prompt is empty and its completion too.
* Rows with a null conv_id belong to no conversation and are left out. Ids of any size pair exactly.
* Two equal conversations: everything is the prompt and both completions are empty.
* Further columns are ignored. An empty table gives no rows.

Everything is built-in column functions. Turns meet once, in a shuffle by pair; an
output row holds one pair of conversations, which is the record that the format asks for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def render(turns):
    """Text of an array of (role, text) turns."""
    return F.array_join(
        F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("<|end|>\n"))),
        "",
    )


def loss_mask(turns):
    """1 for each turn of the assistant, 0 for the others."""
    return F.transform(turns, lambda t: (t["role"] == "assistant").cast("int"))


def _turn():
    return F.struct(
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def preference_format(turns_of_pairs: DataFrame) -> DataFrame:
    """``(pair_id, chosen, rejected)`` with arrays of turns to prompt and masked completions."""
    empty = F.expr("cast(array() as array<struct<turn:bigint,role:string,text:string>>)")
    both = turns_of_pairs.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.coalesce("chosen", empty).alias("c"),
        F.coalesce("rejected", empty).alias("r"),
    )
    same = F.zip_with(
        "c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    both = both.withColumn("same", same).withColumn(
        "n",
        F.coalesce(F.nullif(F.array_position("same", F.lit(False)), F.lit(0)) - 1, F.size("same")).cast("int"),
    )
    tail = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    both = both.select(
        "pair_id", "chosen_id", "rejected_id", "n", F.slice("c", 1, F.col("n")).alias("p"), tail("c").alias("c"), tail("r").alias("r")
    )
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        F.col("n").alias("n_prompt_turns"),
        render("p").alias("prompt"),
        render("c").alias("chosen_completion"),
        render("r").alias("rejected_completion"),
        F.transform("c", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen_segments"),
        F.transform("r", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("rejected_segments"),
        loss_mask(F.col("c")).alias("chosen_mask"),
        loss_mask(F.col("r")).alias("rejected_mask"),
    )


def pair_neighbours(conversations: DataFrame) -> DataFrame:
    """Pairs conversation 2k (chosen) with 2k+1 (rejected); one without a partner stands alone.

    Rows without a conv_id belong to no pair and go. One shuffle, by the pair.
    """
    odd = F.pmod("conv_id", F.lit(2)) == 1
    turns = lambda side: F.sort_array(F.collect_list(F.when(side, _turn())))
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .select("conv_id", "turn", "role", "text", F.shiftright(F.col("conv_id").cast("long"), 1).alias("pair_id"))
        .groupBy("pair_id")
        .agg(
            F.min(F.when(~odd, F.col("conv_id"))).alias("chosen_id"),
            F.min(F.when(odd, F.col("conv_id"))).alias("rejected_id"),
            turns(~odd).alias("chosen"),
            turns(odd).alias("rejected"),
        )
    )
