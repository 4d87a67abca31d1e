"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once as the prompt; the
turns behind it become the two completions, with spans that mark what is to be learned (the words of the
assistant) by code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is rendered; what stands between is learned if the role is the assistant's.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "\n"


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and turns (role, text in order) of each conversation.

    A null role is `user`, a null text is empty, rows that repeat conv_id, turn, role and text count once, and
    different rows of one turn stand by role and text. Rows without a conv_id are left out.
    """
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.where("conv_id is not null").select("conv_id", turn.alias("t"))
    ordered = F.array_sort(F.array_distinct(F.collect_list("t")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_prefix(a: Column, b: Column) -> Column:
    """How many turns two lists share from the start on; null lists share none."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, False)
    return F.coalesce(F.when(first == 0, n).otherwise(first - 1), F.lit(0)).cast("int")


def rendered(turns: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE))), ""), F.lit(""))


def learned(turns: Column) -> Column:
    """Spans (start, end) of the rendered turns that are to be learned: an assistant's text and its close."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(state: Column, t: Column) -> Column:
        begin = state["at"] + F.length(t["role"]) + len(OPEN) + len(BETWEEN)
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(t["role"] == "assistant", F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.coalesce(F.aggregate(turns, start, step)["spans"], start["spans"])


def format_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask for each
    row of pairs (pair_id, chosen_id, rejected_id). A conversation without turns has an empty completion; a pair of
    equal conversations has two empty completions. The first turn that differs begins the completions."""
    told = conversations(turns)
    side = lambda name: told.select(F.col("conv_id").alias(f"{name}_id"), F.col("turns").alias(f"{name}_turns"))
    both = pairs.select("pair_id", "chosen_id", "rejected_id").join(side("chosen"), "chosen_id", "left").join(side("rejected"), "rejected_id", "left")
    empty = F.array().cast("array<struct<role:string,text:string>>")
    both = both.withColumns({f"{s}_turns": F.coalesce(f"{s}_turns", empty) for s in ("chosen", "rejected")})
    both = both.withColumn("prompt_turns", common_prefix(F.col("chosen_turns"), F.col("rejected_turns")))
    rest = lambda s: F.slice(f"{s}_turns", F.col("prompt_turns") + 1, F.greatest(F.size(f"{s}_turns"), F.lit(0)))
    return both.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "prompt_turns",
        rendered(F.slice("chosen_turns", 1, F.col("prompt_turns"))).alias("prompt"),
        rendered(rest("chosen")).alias("chosen"),
        rendered(rest("rejected")).alias("rejected"),
        learned(rest("chosen")).alias("chosen_mask"),
        learned(rest("rejected")).alias("rejected_mask"),
    )


def with_other_endings(turns: DataFrame) -> DataFrame:
    """Each conversation twice: as 2 * conv_id as it is, and as 2 * conv_id + 1 with the text of its last assistant
    turn replaced by that of conversation conv_id + 1; where that has none, the turn is left out.

    A conversation without such a turn stays alike. Nulls and repeated rows count as in `conversations`.
    """
    role, text = F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text).distinct()
    last = rows.where("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("own"))
    donors = last.select((F.col("conv_id") - 1).alias("conv_id"), F.col("own.text").alias("other"))
    met = rows.join(last, "conv_id", "left").join(donors, "conv_id", "left")
    ends = F.struct("turn", "role", "text").eqNullSafe(F.col("own"))
    changed = met.where(~ends | F.col("other").isNotNull()).select((2 * F.col("conv_id") + 1).alias("conv_id"), "turn", "role", F.when(ends, F.col("other")).otherwise(F.col("text")).alias("text"))
    return rows.withColumn("conv_id", 2 * F.col("conv_id")).unionByName(changed)


def neighbour_pairs(turns: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id: conversations 2k and 2k+1; the even one stands for the chosen, and one without
    its neighbour is paired with none."""
    ids = turns.where("conv_id is not null").select("conv_id", F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id")).distinct()
    even = F.col("conv_id") == 2 * F.col("pair_id")
    return ids.groupBy("pair_id").agg(F.max(F.when(even, F.col("conv_id"))).alias("chosen_id"), F.max(F.when(~even, F.col("conv_id"))).alias("rejected_id"))
