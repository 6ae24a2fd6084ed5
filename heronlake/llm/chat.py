"""Collapse of conversation snapshots and chat rendering (DataFrame operations only)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turns are numbered in stretches of so many turn values, so that one very long conversation is no single task.
STRETCH = 256
#: The stretch of turns without a number, which come before all others.
FIRST = -(1 << 62)


def _by_part(frame: DataFrame, *aggs) -> DataFrame:
    return frame.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(*aggs)


def _back(frame: DataFrame, side: DataFrame) -> DataFrame:
    return frame.join(side, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("part") == F.col("p"))).drop("c", "p")


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> tuple[DataFrame, DataFrame]:
    """(turns with part, k and two hashes of role and text; of each part the turns before it and those of the conversation).

    Turns are in order of turn (null first), ties of role, then text; k counts within a stretch. This is the one step that moves texts.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), "role", "text")
    rows = rows.withColumn("part", F.coalesce(F.floor(F.col("turn") / STRETCH).cast("long"), F.lit(FIRST)))
    inner = Window.partitionBy("conv_id", "part").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    said = {"x": F.xxhash64(F.lit(1), "role", F.lit(2), "text"), "y": F.xxhash64(F.lit(7), "text", F.lit(8), "role")}
    rows = cut(rows.withColumn("k", F.row_number().over(inner)).withColumns(said).drop("turn"))
    earlier = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = _by_part(rows, F.count(F.lit(1)).alias("m"))
    return rows, cut(sizes.select("c", "p", F.coalesce(F.sum("m").over(earlier), F.lit(0)).alias("before"), F.sum("m").over(Window.partitionBy("c")).alias("n")))


def prefixes(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), n (turns of the conversation) and a, b: rolling hashes of turns 1 to pos.

    The hash of a prefix is the exclusive-or of two 64-bit hashes of each (position, role, text): it rolls from turn to turn,
    and over stretches. Null roles and texts differ from empty ones.
    """
    placed = _back(rows.select("conv_id", "part", "k", "x", "y"), sizes).withColumn("pos", F.col("before") + F.col("k"))
    placed = placed.withColumns({"x": F.xxhash64("pos", "x"), "y": F.xxhash64("y", "pos")})
    earlier = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    totals = _by_part(placed, F.bit_xor("x").alias("tx"), F.bit_xor("y").alias("ty"))
    totals = totals.select("c", "p", *[F.coalesce(F.bit_xor(t).over(earlier), F.lit(0)).alias(f"b{t}") for t in ("tx", "ty")])
    run = Window.partitionBy("conv_id", "part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rolled = _back(placed.withColumns({"rx": F.bit_xor("x").over(run), "ry": F.bit_xor("y").over(run)}), totals)
    return rolled.select("conv_id", "pos", "n", F.expr("rx ^ btx").alias("a"), F.expr("ry ^ bty").alias("b"))


def maximal(turns: DataFrame) -> DataFrame:
    """Conversations that are no proper prefix of another: conv_id (smallest of equal ones), n_turns, copies (equal conversations).

    turns: what ``prefixes`` returns. Equal conversations are one row before the anti-join and prefixes are made distinct
    before it, so its keys are unique on both sides and no group of copies meets another.
    """
    whole = turns.where("pos = n").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    shorter = turns.where("pos < n").select(F.col("pos").alias("n"), "a", "b").distinct()
    return whole.join(shorter, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "copies")


def escaped(text, mark: str):
    """text in which each ``mark`` has one more backslash after its first character, so that none is left and the text can be had back."""
    if len(mark) < 2:
        raise ValueError("a mark of one character can't be escaped")
    first, rest = re.escape(mark[0]), re.escape(mark[1:])
    back = lambda x: x.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{first}(\\\\*){rest}", f"{back(mark[0])}$1\\\\{back(mark[1:])}")


def collapse(conversations: DataFrame, opening: str = "<|", closing: str = "|>\n", ending: str = "\n") -> DataFrame:
    """conv_id, n_turns, copies, rendered: each maximal conversation once, its turns as opening + role + closing + text + ending.

    What reads as ``opening`` in a text or role, or as ``closing`` in a role, gets a backslash after its first character, and one more
    where there are some, so no text forges a turn. A null role or text is rendered as empty. A conversation becomes one string, so
    its turns meet in one task; no rows give no rows. A null conv_id is a conversation like any other; equal turns are turns of their
    own; other columns aren't read.
    """
    rows, sizes = numbered(conversations)
    kept = cut(maximal(cut(prefixes(rows, sizes))).withColumnRenamed("conv_id", "kept_id"))
    placed = _back(rows.select("conv_id", "part", "k", "role", "text"), sizes).withColumn("pos", F.col("before") + F.col("k"))
    joined = placed.select("conv_id", "pos", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("kept_id")))
    role = escaped(escaped(F.col("role"), opening), closing)
    said = F.concat(F.lit(opening), role, F.lit(closing), escaped(F.col("text"), opening), F.lit(ending))
    lists = joined.groupBy("conv_id", "n_turns", "copies").agg(F.array_sort(F.collect_list(F.struct("pos", said.alias("said")))).alias("all"))
    return lists.select("conv_id", "n_turns", "copies", F.concat_ws("", F.transform("all", lambda x: x.said)).alias("rendered"))
