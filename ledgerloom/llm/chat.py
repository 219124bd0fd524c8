"""Chat formatting with cumulative-snapshot collapse.

Logs often hold a conversation once for each turn it grew by. Rolling hashes of a conversation's turns identify every
prefix of it; a conversation whose own hash is a proper prefix of another's is dropped by an anti-join, equal ones are
kept once, and what remains is rendered. Turns are placed by sorted ranges and the hash rolls by blocks of a conversation,
without its texts, so that a long one is many tasks; only those that are rendered are gathered, each into the one text that
it becomes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, placed, running, spread_join

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Turns of a conversation that are hashed in one piece.
BLOCK = 4096


def _turn_hash(k: int) -> Column:
    """60 bits of the SHA-256 of a turn at its place; null differs from empty, and role from text."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    digest = F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), part("role"), part("text")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1 + 15 * k, 15), 16, 10).cast("long")


def placed_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, place, role, text): the distinct turns of each conversation, a struct of its conv_id, in order; settled."""
    turns = scratch.settle(conversations.select(F.struct("conv_id").alias("conv"), "turn", "role", "text").distinct())
    return scratch.settle(placed(turns, ["conv"], ["turn", "role", "text"], "place", scratch).select("conv", "place", "role", "text"))


def prefix_hashes(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv, last, h0, h1) of placed turns: the hash of all turns up to each, 120 bits, the exclusive or of those of the turns."""
    hashed = scratch.settle(turns.select("conv", "place", _turn_hash(0).alias("h0"), _turn_hash(1).alias("h1")))
    rolled = running(hashed, "conv", "place", {"h0": F.bit_xor, "h1": F.bit_xor}, BLOCK, total=True)
    return scratch.settle(rolled.select("conv", (F.col("place") + 1 == F.col("n_places")).alias("last"), "h0", "h1"))


def render(turns: Column) -> Column:
    """One block a turn: its role, its text, the close mark. Marks inside a text are broken up with a blank, so that no text
    opens or closes a turn; a null role is unknown, a null text empty."""
    safe = lambda x: F.replace(F.replace(x, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    block = lambda t: F.concat(F.lit(OPEN), safe(F.coalesce(t["role"], F.lit("unknown"))), F.lit("\n"), safe(F.coalesce(t["text"], F.lit(""))), F.lit(CLOSE + "\n"))
    return F.array_join(F.transform(turns, block), "")


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_same, rendered) of the maximal conversations of (conv_id, turn, role, text).

    n_same counts the conversations with just these turns; the smallest conv_id, null after all, stands for them. Turns
    go by turn, null first; turns of the same number by role and text; rows that repeat count once. Turn numbers place
    turns but need not match between snapshots. Other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch()
    turns = placed_turns(conversations, scratch)
    whole = prefix_hashes(turns, scratch)
    first = F.min(F.struct(F.col("conv.conv_id").isNull().alias("none"), "conv"))
    distinct = whole.where("last").groupBy("h0", "h1").agg(first.alias("first"), F.count("*").alias("n_same"))
    prefixes = whole.where("NOT last").select("h0", "h1").distinct()
    maximal = scratch.settle(distinct.join(prefixes, ["h0", "h1"], "left_anti").select("first.conv", "n_same"))
    scratch.keep(turns, maximal)
    kept = spread_join(turns, maximal, ["conv"])
    done = kept.groupBy("conv", "n_same").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    return done.select("conv.conv_id", F.size("turns").cast("long").alias("n_turns"), "n_same", render(F.col("turns")).alias("rendered"))
