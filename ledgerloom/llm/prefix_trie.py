"""The trie of the turn prefixes of conversations, by truncation peeling.

Every conversation ends in one node, and conversations of the same turns in the same one. From the deepest level upwards,
the conversations that end at a depth are merged with the nodes that survive from below; each node then loses its last turn
and what remains is grouped again. A node is found, counted and summed in the one pass that reaches its depth. Below the
deepest turn that two different conversations share, every node holds one conversation's turns alone: those are stripped in
one go, so that the number of rounds is that of the shared turns and not that of the longest conversation.

A prefix goes by 120 bits, the exclusive or of a digest of each turn and its place; so a long conversation is worked out in
blocks, and the prefix without its last turn is known without another look at the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, placed, running, spread_join

#: Turns of a conversation that are summed in one piece, and bits of a conv_id within a piece of a list of members.
BLOCK, PIECE_BITS = 4096, 12
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
_KEY = ["k0", "k1"]


@dataclass(frozen=True)
class Rebuild:
    """How logged conversations are put together: the first head(conv_id) turns of base(conv_id), then the own ones after as many."""

    base: Column
    head: Column
    most: int


def by_fives() -> Rebuild:
    """The rebuilding of the registered query."""
    c = F.col("conv_id")
    return Rebuild(c - c % 5, (F.crc32(c.cast("string").cast("binary")) % 9).cast("long"), 8)


def turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, place, turn_sha, n_bytes) of each row that has a conv_id, in order of turn, null first, then of the digest of
    role and text. Null roles and texts are empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    slim = scratch.settle(conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", sha.alias("turn_sha"), F.octet_length(text).cast("long").alias("n_bytes")))
    return placed(slim, ["conv_id"], ["turn", "turn_sha"], "place", scratch).drop("turn")


def rebuilt(own: DataFrame, rule: Rebuild | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations, and (conv_id, length) of all of them; without a rule they stay as they are."""
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("n"))
    if rule is None:
        return own, scratch.settle(sizes.withColumnRenamed("n", "length"))
    known = scratch.settle(sizes.select("conv_id", "n", rule.base.alias("base"), rule.head.alias("head")))
    bases = known.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = scratch.settle(known.join(bases, "base", "left").select("conv_id", "base", "head", F.least("head", F.coalesce("base_n", F.lit(0))).alias("from_base"), "n"))
    tails = spread_join(own, convs.select("conv_id", "head", "from_base"), ["conv_id"]).where("place >= head")
    tails = tails.select("conv_id", (F.col("place") - F.col("head") + F.col("from_base")).alias("place"), "turn_sha", "n_bytes")
    first = own.where(F.col("place") < rule.most).withColumnRenamed("conv_id", "base")
    heads = first.join(convs.select("conv_id", "base", "head"), "base").where("place < head").select("conv_id", "place", "turn_sha", "n_bytes")
    return heads.unionByName(tails), convs.select("conv_id", (F.col("from_base") + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length"))


def prefixes(rows: DataFrame, lengths: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, depth, k0, k1, p0, p1, n_bytes, all_bytes, ends): the key of each prefix, that of the prefix without its last
    turn, the bytes of the last text and of all, and whether the conversation ends there; settled, by depth within files."""
    piece = lambda k: F.conv(F.substring(F.sha2(F.concat(F.col("place").cast("string"), F.lit(":"), "turn_sha").cast("binary"), 256), 1 + 15 * k, 15), 16, 10).cast("long")
    rows = rows.withColumns({"o0": piece(0), "o1": piece(1)}).withColumns({"k0": F.col("o0"), "k1": F.col("o1"), "all_bytes": F.col("n_bytes")})
    found = running(rows, "conv_id", "place", {"k0": F.bit_xor, "k1": F.bit_xor, "all_bytes": F.sum}, BLOCK)
    found = spread_join(found, lengths, ["conv_id"])
    parents = [F.col("k0").bitwiseXOR(F.col("o0")).alias("p0"), F.col("k1").bitwiseXOR(F.col("o1")).alias("p1")]
    out = found.select("conv_id", (F.col("place") + 1).alias("depth"), *_KEY, *parents, "n_bytes", "all_bytes", (F.col("place") + 1 == F.col("length")).alias("ends"))
    return scratch.settle(out.sortWithinPartitions("depth"))


def endings(ends: DataFrame) -> DataFrame:
    """(depth, k0, k1, conv_id, n_convs, ends_sha256) of the distinct conversations among ends (depth, k0, k1, conv_id).

    The members of one are listed in pieces of neighbouring ids, each of 4096 at most; what reads a list as a whole only
    passes over its sorted pieces and keeps the state of one digest.
    """
    piece = F.shiftright(F.col("conv_id"), PIECE_BITS)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = ends.groupBy("depth", *_KEY, piece.alias("piece")).agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), listed.alias("members"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["depth", *_KEY, "conv_id", "n_convs", "ends_sha256"]
        now, first, n, state, done = None, 0, 0, hashlib.sha256(), []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), [pa.int64()] * 5 + [pa.string()], strict=True)], names)

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("depth", *_KEY, "first", "n", "members")], strict=True):
                if row[:3] != now:
                    if now:
                        done.append((*now, first, n, state.hexdigest()))
                    now, first, n, state = row[:3], row[3], 0, hashlib.sha256()
                else:
                    state.update(b",")
                n += row[4]
                state.update(row[5].encode())
            if done:
                yield flush()
                done = []
        if now:
            done = [(*now, first, n, state.hexdigest())]
            yield flush()

    ordered = pieces.repartition("depth", *_KEY).sortWithinPartitions("depth", *_KEY, "piece").select("depth", *_KEY, "first", "n", "members")
    return ordered.mapInArrow(run, "depth long, k0 long, k1 long, conv_id long, n_convs long, ends_sha256 string")


def trie(conversations: DataFrame, rule: Rebuild | None = None) -> DataFrame:
    """One row for each node of the trie of conversations (conv_id, turn, role, text), the root included: conv_id (its smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty, null turns come first, turns of one number go by the SHA-256 of role and text, and rows
    that repeat are turns of their own. Rows without a conv_id belong to no conversation. A conversation that is rebuilt to no
    turns ends in the root. Other columns are ignored; no conversations give no nodes, not even the root.
    """
    scratch = Scratch()
    own = turns(conversations, scratch)
    rows, lengths = rebuilt(own, rule, scratch)
    rows = rows if rule is None else scratch.settle(rows)
    paths = prefixes(rows, lengths, scratch)
    ends = paths.where("ends").select("depth", *_KEY, "conv_id")
    turnless = lengths.where("length = 0").select(F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in _KEY], "conv_id")
    ended = scratch.settle(endings(ends.unionByName(turnless)))
    one = ended.where("depth > 0").select("conv_id", "n_convs", F.col("depth").alias("length"), "ends_sha256")
    alone = spread_join(paths.drop("ends"), one, ["conv_id"])
    shared = alone.groupBy("depth", *_KEY).agg(F.count("*").alias("n")).where("n > 1").agg(F.max("depth")).first()[0] or 0

    at_end = F.col("depth") == F.col("length")
    rest = alone.where(F.col("depth") > shared)
    below = spread_join(rest, rest.where(at_end).select("conv_id", F.col("all_bytes").alias("to_end")), ["conv_id"])
    saved = (F.col("n_convs") - 1) * (F.col("to_end") - F.col("all_bytes") + F.col("n_bytes"))
    deep = below.select("conv_id", "depth", *_KEY, "p0", "p1", "n_convs", F.when(at_end, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), saved.alias("saved_tokens"), F.when(at_end, F.col("ends_sha256")).otherwise(F.lit(NO_MEMBERS)).alias("ends_sha256"))
    found = [scratch.settle(deep)]
    for depth in range(shared, -1, -1):
        found.append(scratch.settle(peel(found[-1], ended, paths, depth)))
    nodes = found[0]
    for more in found[1:]:
        nodes = nodes.unionByName(more)
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("k0").alias("p0"), F.col("k1").alias("p1"), F.col("conv_id").alias("parent_conv_id"))
    out = spread_join(nodes, parents, ["depth", "p0", "p1"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def peel(below: DataFrame, ended: DataFrame, paths: DataFrame, depth: int) -> DataFrame:
    """The nodes at a depth: those of one turn more without that turn, merged with the conversations that end here."""
    up = below.where(F.col("depth") == depth + 1).select(F.col("p0").alias("k0"), F.col("p1").alias("k1"), "conv_id", "n_convs", F.lit(1).alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
    here = ended.where(F.col("depth") == depth).select(*_KEY, "conv_id", "n_convs", F.lit(0).alias("child"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends_sha256")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved_tokens")]
    met = up.unionByName(here).groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.sum("child").alias("n_children"), F.max("ends_sha256").alias("ends_sha256"), *sums)
    if depth:
        last = paths.where(F.col("depth") == depth).select("conv_id", "p0", "p1", "n_bytes")
        met = met.join(last, "conv_id")
    else:
        met = met.withColumns({c: F.lit(0).cast("long") for c in ("p0", "p1", "n_bytes")})
    leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves"))
    saved = F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("n_bytes")
    return met.select("conv_id", F.lit(depth).cast("long").alias("depth"), *_KEY, "p0", "p1", "n_convs", "n_children", leaves.alias("n_leaves"), saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_MEMBERS)).alias("ends_sha256"))
