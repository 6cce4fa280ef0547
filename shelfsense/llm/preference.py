"""Preference pairs: a shared prompt and two masked completions.

The longest common prefix of turns of a chosen and a rejected conversation is rendered once, as
the prompt; what follows in each is rendered as its completion. A completion's mask lists the
character ranges a model is trained on: the assistant's words and the mark that ends them, not
the headers and not what others say. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TURNS = "array<struct<role:string,text:string>>"
END = "<|end|>\n"


def conversations_of(rows: DataFrame) -> DataFrame:
    """``conv_id`` and ``turns`` (role, text in order of turn) of a table of turns.

    Rows equal in id, turn, role and text count once; those that share a turn go by role and
    text. Null roles and texts count as empty, null turns come first. Rows without id belong to no
    conversation. An empty table gives none; other columns are ignored.
    """
    turn = F.struct(
        F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_set(turn)).alias("ordered")).select(
        "conv_id",
        F.transform("ordered", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )


def opening_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations with the same first turn: the one with the smallest id is chosen, every
    other one is rejected against it. One hot opening gives a row per conversation, no more."""
    opened = conversations.select(
        "conv_id", "turns", F.sha2(F.to_json(F.element_at("turns", 1)), 256).alias("opening")
    )
    shared = (
        opened.groupBy("opening")
        .agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 and chosen_id is not null")
        .select("opening", "chosen_id")
    )
    chosen = shared.join(conversations, F.col("chosen_id") == F.col("conv_id")).select(
        "opening", "chosen_id", F.col("turns").alias("chosen")
    )
    return (
        opened.join(chosen, "opening")
        .where(~F.col("conv_id").eqNullSafe(F.col("chosen_id")))
        .select(
            F.lit("opening").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"),
            "chosen", F.col("turns").alias("rejected"),
        )
    )


def stale_pairs(conversations: DataFrame) -> DataFrame:
    """A conversation up to its last reply, against itself with the first reply in that place."""
    at = F.size("turns") - F.array_position(F.reverse(F.transform("turns", lambda t: t["role"])), "assistant") + 1
    replies = F.filter("turns", lambda t: t["role"] == "assistant")
    return (
        conversations.where(F.size(replies) > 1)
        .withColumn("last", at.cast("int"))
        .select(
            F.lit("stale").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
            F.slice("turns", 1, F.col("last")).alias("chosen"),
            F.concat(F.slice("turns", 1, F.col("last") - 1), F.array(F.element_at(replies, 1))).alias("rejected"),
        )
    )


def _unmarked(turns: Column) -> Column:
    """Turns in whose roles and texts nothing reads as a mark: a word joiner parts ``<`` from ``|``."""
    def broken(said: Column) -> Column:
        return F.replace(F.coalesce(said, F.lit("")), F.lit("<|"), F.lit("<\u2060|"))

    return F.transform(turns, lambda t: F.struct(broken(t["role"]).alias("role"), broken(t["text"]).alias("text")))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(END))), "")


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _mask(turns: Column) -> Column:
    """Ranges (start, end) of the rendered turns to train on; characters from 0, end exclusive."""
    kind = "array<struct<start:bigint,end:bigint>>"
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(kind).alias("spans"))

    def step(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_header(t))
        end = start + F.length(t["text"]) + len(END)
        span = F.struct(start.alias("start"), end.alias("end"))
        spans = F.when(t["role"] == "assistant", F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return F.aggregate(turns, zero, step, lambda s: s["spans"])


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with columns ``chosen`` and ``rejected`` (arrays of role and text), formatted.

    Adds ``n_common`` (turns of the common prefix), ``prompt``, ``chosen_text``, ``rejected_text``,
    ``chosen_mask``, ``rejected_mask`` and ``usable`` (both completions hold something to train
    on), in place of columns of these names. Null arrays, roles and texts count as empty. Equal
    conversations have empty completions. What reads as a mark (``<|``) in a role or text is broken
    by U+2060, so no turn can be forged. Repeated rows give repeated rows, no rows none.
    """
    empty = F.array().cast(TURNS)
    rows = pairs.withColumns(
        {name: _unmarked(F.coalesce(name, empty)) for name in ("chosen", "rejected")}
    )
    apart = F.array_position(F.zip_with("chosen", "rejected", lambda a, b: ~a.eqNullSafe(b)), True)
    shorter = F.least(F.size("chosen"), F.size("rejected"))
    common = F.when(apart > 0, apart.cast("int") - 1).otherwise(shorter)
    rows = rows.withColumn("n_common", F.least(common, shorter))

    def rest(name: str) -> Column:
        return F.slice(name, F.col("n_common") + 1, F.greatest(F.size(name) - F.col("n_common"), F.lit(0)))

    return (
        rows.withColumns({"chosen_rest": rest("chosen"), "rejected_rest": rest("rejected")})
        .withColumns(
            {
                "prompt": _rendered(F.slice("chosen", 1, F.col("n_common"))),
                "chosen_text": _rendered(F.col("chosen_rest")),
                "rejected_text": _rendered(F.col("rejected_rest")),
                "chosen_mask": _mask(F.col("chosen_rest")),
                "rejected_mask": _mask(F.col("rejected_rest")),
            }
        )
        .withColumn("usable", (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0))
        .drop("chosen", "rejected", "chosen_rest", "rejected_rest")
    )


def preference_pairs(turns: DataFrame) -> DataFrame:
    """Formatted pairs of both kinds from a table of turns (``conv_id, turn, role, text``)."""
    conversations = stored(conversations_of(turns), "conversations")
    return format_pairs(opening_pairs(conversations).unionByName(stale_pairs(conversations)))
