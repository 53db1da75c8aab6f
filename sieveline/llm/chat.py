"""Preference formatting, in DataFrame functions only.

Two conversations, chosen and rejected, share a longest common prefix of turns (same role
and same text, nulls equal to nulls). The prefix is rendered once, as the prompt; what
follows it on either side is rendered as a completion, with the spans of the completion
that a trainer may learn from: the texts of assistant turns, with their end marks.

Cases: a null text is rendered as an empty one and a null role as `unknown`; turns with
the same number are ordered by role and text, so ties and repeated rows have one order; an
empty side gives an empty completion; equal sides give the whole as prompt and two empty
completions; no rows give no rows; other columns are left out. A conversation is rendered
into one string, so its size is that of one row, whatever its number of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import running_starts

OPEN, SHUT = "<|im_start|>", "<|im_end|>"


def _turn(x: Column) -> Column:
    return F.concat(F.lit(OPEN), F.coalesce(x["role"], F.lit("unknown")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(SHUT + "\n"))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def _spans(turns: Column) -> Column:
    """start:end of the assistant's texts and end marks in the rendered turns."""
    size = F.transform(turns, lambda x: F.length(_turn(x)).cast("long"))

    def span(x, at):
        start = at + len(OPEN) + F.length(F.coalesce(x["role"], F.lit("unknown"))) + 1
        return F.when(x["role"] == "assistant", F.concat_ws(":", start.cast("string"), (at + F.length(_turn(x)) - 1).cast("string")))

    return F.array_join(F.zip_with(turns, running_starts(size), span), ",")


def common_turns(a: Column, b: Column) -> Column:
    """How many leading turns two arrays<struct<role, text>> share."""
    least = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, least), F.slice(b, 1, least), lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, F.lit(False))
    return F.when(first == 0, least).otherwise((first - 1).cast("int"))


def format_preferences(pairs: DataFrame, key: str, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """pairs: key, and two arrays<struct<role, text>>. One row for each of pairs'."""
    side = lambda name: F.coalesce(F.col(name), F.array().cast("array<struct<role:string,text:string>>")).alias(name)
    rest = lambda name: F.slice(F.col(name), F.col("n_common") + 1, F.greatest(F.size(name) - F.col("n_common"), F.lit(0)))
    ready = pairs.select(key, side(chosen), side(rejected)).withColumn("n_common", common_turns(F.col(chosen), F.col(rejected)))
    return ready.select(
        key,
        F.col("n_common").cast("long").alias("n_common"),
        _render(F.slice(F.col(chosen), F.lit(1), F.col("n_common"))).alias("prompt"),
        _render(rest(chosen)).alias("chosen"),
        _render(rest(rejected)).alias("rejected"),
        _spans(rest(chosen)).alias("chosen_spans"),
        _spans(rest(rejected)).alias("rejected_spans"),
    )


def conversation_pairs(turns: DataFrame) -> DataFrame:
    """A pair for each conversation of turns(conv_id, turn, role, text): it is the chosen
    side; the rejected one is the same up to its last turn, which is that of the
    conversation whose id differs in the lowest bit. Where there is none, or the id is
    null, the rejected side ends before the last turn."""
    whole = (
        turns.select("conv_id", F.struct("turn", "role", "text").alias("t"))
        .groupBy("conv_id")
        .agg(F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("chosen"))
    )
    last = whole.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.element_at("chosen", -1).alias("last"))
    body = F.slice("chosen", F.lit(1), F.size("chosen") - 1)
    return whole.join(last, "conv_id", "left").select(
        "conv_id", "chosen", F.when(F.col("last").isNull(), body).otherwise(F.concat(body, F.array("last"))).alias("rejected")
    )
