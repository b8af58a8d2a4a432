"""Chat formatting with cumulative-snapshot collapse, DataFrame functions only.

A chat that is logged after every turn leaves one conversation per snapshot. Rolling hashes of each
conversation's turn prefixes are compared: one whose full hash is a proper prefix hash of a longer
one is a snapshot of it and goes (anti-join); of equal ones the smallest conv_id stays. What is left
is rendered with role marks. The rolling hash of a prefix is the bitwise exclusive or of two 64-bit
hashes of (place, role, text) of its turns: 128 bits that depend on the order.

Only hashes are shuffled to find the snapshots, and the prefix hashes are written once for all that is
read from them. Copies and shared prefixes are reduced to distinct hashes before the anti-join, so a
common first turn or a conversation with many copies is no hot key. Then turns with their texts move
once, by conversation: the same exchange serves the join with the kept conversations and the rendering
(if those are few, they are broadcast and only turns that are rendered move). A conversation is one
output value, so its turns are expected to fit one task.

Cases: turns go by ``turn`` (nulls last), then by the hash of role and text, so ties and repeated
rows have a fixed order and count as turns; null role and null text differ from empty ones in hashes
and are rendered as empty; rows with null conv_id form one conversation; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _turn_hash(salt: int, *more: Column) -> Column:
    return F.xxhash64(F.lit(salt), *more, F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turns, a, b): for each turn, the rolling hash (a, b) up to its place."""
    rows = conversations.select("conv_id", "turn", _turn_hash(1).alias("x"), _turn_hash(2).alias("y"))
    order = [F.col("turn").asc_nulls_last(), "x", "y"]
    mine = Window.partitionBy("conv_id")
    placed = rows.select("conv_id", "turn", "x", "y", F.row_number().over(mine.orderBy(*order)).alias("place"), F.count("*").over(mine).alias("turns"))
    so_far = mine.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    roll = lambda c, salt: F.bit_xor(F.xxhash64(F.lit(salt), "place", c)).over(so_far)
    return placed.select("conv_id", "place", "turns", roll("x", 3).alias("a"), roll("y", 4).alias("b"))


def maximal(conversations: DataFrame) -> DataFrame:
    """(conv_id, copies) of the conversations that no longer one starts with, one of each."""
    hashed = materialize(prefix_hashes(conversations), "prefixes")
    whole = hashed.where("place = turns").groupBy("turns", "a", "b").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    starts = hashed.where("place < turns").select(F.col("place").alias("p"), F.col("a").alias("pa"), F.col("b").alias("pb")).distinct()
    return whole.join(starts, (F.col("turns") == F.col("p")) & (F.col("a") == F.col("pa")) & (F.col("b") == F.col("pb")), "left_anti").select("conv_id", "copies")


def _plain(c: str) -> Column:
    """A text in which no role mark can be read: ``<|`` is opened by a space."""
    return F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, text): the maximal conversations, rendered turn by turn."""
    kept = materialize(maximal(conversations), "maximal")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumns({"x": _turn_hash(1), "y": _turn_hash(2)})
    line = F.concat(F.lit(OPEN), _plain("role"), F.lit("\n"), _plain("text"), F.lit(CLOSE + "\n"))
    turn = F.struct(F.col("turn").isNull().alias("last"), "turn", "x", "y", line.alias("line"))

    def rendered(rows: DataFrame) -> DataFrame:
        chats = rows.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.max("copies").alias("n_copies"), F.sort_array(F.collect_list(turn)).alias("all"))
        return chats.select("conv_id", "n_turns", "n_copies", F.array_join(F.col("all.line"), "").alias("text"))

    named = rendered(rows.where("conv_id IS NOT NULL").join(kept.where("conv_id IS NOT NULL"), "conv_id"))
    unnamed = kept.where("conv_id IS NULL")
    if not unnamed.head(1):
        return named
    # One row: the conversation of all rows without a conv_id.
    return named.unionByName(rendered(rows.where("conv_id IS NULL").join(F.broadcast(unnamed.select("copies")))))
