"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The turns that both conversations begin with are rendered once, as the prompt. What follows is rendered for each side, with the
character ranges that a model is trained on: what assistants say, with the mark that ends their turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """[start, end) of every assistant's words and end mark in the rendered turns."""
    step = lambda state, turn: F.struct(
        (state["at"] + F.length(_rendered(turn))).alias("at"),
        F.when(turn["role"] == "assistant", F.concat(state["spans"], F.array(F.struct(
            (state["at"] + F.length(turn["role"]) + 5).alias("start"), (state["at"] + F.length(_rendered(turn)) - 1).alias("end")))))
        .otherwise(state["spans"]).alias("spans"))
    start = F.expr("named_struct('at', 0, 'spans', cast(array() as array<struct<start: int, end: int>>))")
    return F.aggregate(turns, start, step, lambda state: state["spans"])


def preference_pairs(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(pair_id, prompt_turns, prompt, chosen, chosen_spans, rejected, rejected_spans) per pair that has both sides.

    ``pair`` names the pair of a row, ``chosen`` is true for turns of the preferred side; rows where either is null are left out.
    Turns stand in the order of (turn, role, text), null first; a null role or text counts as empty. A side that is a beginning of
    the other has an empty completion. Spans end before the line break behind the end mark.
    """
    rows = turns.select(pair.alias("pair_id"), chosen.alias("side"), F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    rows = rows.where("pair_id is not null and side is not null")
    # a conversation is one row of the result, as long as its turns
    sides = rows.groupBy("pair_id").agg(*(F.sort_array(F.collect_list(F.when(x, F.col("t")))).alias(y) for x, y in (
        (F.col("side"), "a"), (~F.col("side"), "b")))).where("size(a) > 0 and size(b) > 0")
    least = F.least(F.size("a"), F.size("b"))
    differs = F.transform(F.sequence(F.lit(0), least - 1), lambda i: ~(
        (F.col("a")[i]["role"] == F.col("b")[i]["role"]) & (F.col("a")[i]["text"] == F.col("b")[i]["text"])))
    at = F.array_position(differs, True).cast("int")
    sides = sides.withColumn("common", F.when(at == 0, least).otherwise(at - 1))
    rest = lambda name: F.slice(F.col(name), F.col("common") + 1, F.size(name))
    sides = sides.select("pair_id", "common", F.slice("a", 1, F.col("common")).alias("p"), rest("a").alias("a"), rest("b").alias("b"))
    return sides.select("pair_id", F.col("common").alias("prompt_turns"), _joined(F.col("p")).alias("prompt"), _joined(F.col("a")).alias("chosen"),
                        _spans(F.col("a")).alias("chosen_spans"), _joined(F.col("b")).alias("rejected"), _spans(F.col("b")).alias("rejected_spans"))
