"""Preference formatting (DataFrame operations only).

A chosen and a rejected conversation share their first turns; the longest common prefix of turns (same
role and text) is rendered once as the prompt, and what follows on either side becomes a completion
with a character mask: ``1`` where the text of an assistant turn (and its end mark) is to be learned,
``0`` elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.llm.common import docs_of
from netsift.operators.ranking import with_position
from netsift.session import materialize

#: The end mark of a turn; its head is its role between ``<|`` and ``|>``, on a line.
END = "<|end|>\n"


def _head(role: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(
        F.transform(turns, lambda t: F.concat(_head(t["role"]), F.coalesce(t["text"], F.lit("")), F.lit(END))), ""
    )


def _mask(turns: Column) -> Column:
    def one(t: Column) -> Column:
        body = F.length(F.coalesce(t["text"], F.lit(""))) + len(END)
        learned = F.when(t["role"] == "assistant", F.lit("1")).otherwise(F.lit("0"))
        return F.concat(F.repeat(F.lit("0"), F.length(_head(t["role"]))), F.repeat(learned, body))

    return F.array_join(F.transform(turns, one), "")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order of turn (null first), then role, then
    text; repeated rows are turns of their own. Rows without conv_id belong to no conversation. One
    conversation is one record of the output, so its turns meet in one row."""
    rows = docs_of(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL")
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def preference_records(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """One record per conv_id found on both sides, each side (conv_id, turns) as from ``turns_of``:
    conv_id, n_prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask, usable. A record is
    usable if the completions differ and each has something to learn; equal conversations give empty
    completions. A null text renders as an empty one, a null role as an empty head."""
    pair = chosen.select("conv_id", F.col("turns").alias("c")).join(
        rejected.select("conv_id", F.col("turns").alias("r")), "conv_id"
    )
    shorter = F.least(F.size("c"), F.size("r"))
    same = lambda i: (F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"])) & (
        F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"])
    )
    places = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    first_other = F.array_min(F.filter(places, lambda i: ~same(i)))
    pair = pair.withColumn("n", F.coalesce(first_other, shorter).cast("int"))
    rest = lambda side: F.slice(side, F.col("n") + 1, F.greatest(F.size(side) - F.col("n"), F.lit(0)))
    out = pair.select(
        "conv_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        _rendered(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _rendered(rest("c")).alias("chosen"),
        _mask(rest("c")).alias("chosen_mask"),
        _rendered(rest("r")).alias("rejected"),
        _mask(rest("r")).alias("rejected_mask"),
    )
    useful = (F.col("chosen") != F.col("rejected")) & F.col("chosen_mask").contains("1") & F.col("rejected_mask").contains("1")
    return out.withColumn("usable", useful)


def neighbour_rejections(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns) of rejected conversations for a table without judged pairs: each conversation up
    to its last assistant turn, whose text is that of the last assistant turn of the neighbour. Of the
    conversations with an assistant turn, in order of conv_id, the first and second are neighbours, the third
    and fourth, and so on; an odd last one takes the one before it. A conversation that has no other has no
    turns here; those without an assistant turn have no row."""
    own = turns_of(conversations)
    last = F.array_max(
        F.transform(F.col("turns"), lambda t, i: F.when(t["role"] == "assistant", i))
    )
    told = materialize(own.withColumn("last", last).where("last IS NOT NULL"), "told-conversations")
    placed = materialize(with_position(told.select("conv_id"), ["conv_id"]), "conversation-places")
    total = placed.count()
    even = F.col("position") % 2 == 0
    partner = F.when(even | (F.col("position") == total), F.col("position") - 1).otherwise(F.col("position") + 1)
    replies = told.select("conv_id", F.get("turns", F.col("last"))["text"].alias("reply")).join(placed, "conv_id")
    replies = replies.select(F.col("position").alias("partner"), "reply", F.lit(True).alias("paired"))
    swapped = lambda t: F.struct(t["turn"].alias("turn"), t["role"].alias("role"), F.col("reply").alias("text"))
    met = told.join(placed.withColumn("partner", partner), "conv_id").join(replies, "partner", "left")
    whole = F.concat(F.slice("turns", F.lit(1), F.col("last")), F.array(swapped(F.get("turns", F.col("last")))))
    return met.select("conv_id", F.when(F.col("paired"), whole).otherwise(F.slice("turns", 1, 0)).alias("turns"))
