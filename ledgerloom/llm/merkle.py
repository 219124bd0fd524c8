"""Merkle manifest of a dataset: a tree of hashes for each language and one over the languages' roots.

Each level is a slot pivot: conditional aggregates spread the children of a node into one column for each slot; the columns
joined together hash to the node, and all but a child's own are its siblings. The levels are gone down again from the root,
each node with the siblings of all levels above it, so that what a proof shares with its neighbours is worked out once for
them. Rows are placed by sorted ranges, so that a language may hold any share of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, placed, spread_join

FANOUT = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def written(value: Column) -> Column:
    """A value as it goes into a leaf: the count of its UTF-8 bytes, a colon and the value; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    return digest(F.concat(*[written(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], written(text)))


def lower_third(doc_id: Column) -> Column:
    """The rows that the registered query tampers with: 3 divides the CRC-32 of the decimal doc_id; a null one isn't."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))


def _slots(nodes: DataFrame, fanout: int) -> DataFrame:
    """The parents (tree, place, height, s0, s1 ...) of nodes (tree, place, height, node), a struct that begins with its digest."""
    slot = lambda k: F.max(F.when(F.col("place") % fanout == k, F.col("node"))).alias(f"s{k}")
    return nodes.groupBy("tree", F.floor(F.col("place") / fanout).cast("long").alias("place")).agg(F.max("height").alias("height"), *[slot(k) for k in range(fanout)])


def _joined(slots: range) -> Column:
    """The digests of some slots in order; empty slots add nothing."""
    return F.concat_ws("", F.lit(""), *[F.col(f"s{k}.digest") for k in slots])


def _children(parents: DataFrame, fanout: int) -> DataFrame:
    """A row for each filled slot of parents (.., head, path): (tree, place, node, head, path), its own step first in the path."""
    step = lambda k: F.struct(_joined(range(k)).alias("before"), _joined(range(k + 1, fanout)).alias("after"))
    one = lambda k: F.struct((F.col("place") * fanout + k).alias("place"), F.col(f"s{k}").alias("node"), step(k).alias("step"))
    filled = F.filter(F.array(*[one(k) for k in range(fanout)]), lambda x: x["node"].isNotNull())
    flat = parents.select("tree", "head", "path", F.explode(filled).alias("one"))
    return flat.select("tree", "one.place", "one.node", "head", F.concat(F.array("one.step"), "path").alias("path"))


def forest(leaves: DataFrame, fanout: int, over: Callable[[DataFrame], DataFrame], scratch: Scratch) -> DataFrame:
    """(tree, place, node, head, path) of the leaves (tree, place, node) of any number of trees.

    path holds the steps from a leaf to the root, struct(before, after) of the siblings. over(roots) gives each root (tree,
    height, digest) what its leaves get as head and the steps that go on from the root. Levels are settled; there are as
    many as the largest tree is high, and each has an eighth of the rows of the one before.
    """
    sizes = scratch.settle(leaves.groupBy("tree").agg(F.max("place").alias("last")))
    last = sizes.agg(F.max("last")).first()[0] or 0
    heights = next(k for k in range(64) if last < fanout**k)
    height = F.coalesce(*[F.when(F.col("last") < F.lit(fanout**k), F.lit(k)) for k in range(heights + 1)])
    level = spread_join(leaves, sizes.select("tree", height.alias("height")), ["tree"])
    singles, parents, roots = level.where("height = 0"), [], []
    for k in range(heights + 1):
        roots.append(level.where(f"height = {k}").select("tree", "height", F.col("node.digest").alias("digest")))
        if k < heights:
            parents.append(scratch.settle(_slots(level.where(f"height > {k}"), fanout)))
            level = parents[-1].select("tree", "place", "height", F.struct(digest(_joined(range(fanout))).alias("digest")).alias("node"))
    found = roots[0]
    for more in roots[1:]:
        found = found.unionByName(more)
    above = scratch.settle(over(scratch.settle(found)))
    starts = lambda k: above.where(f"height = {k}").select("tree", F.lit(0).cast("long").alias("place"), "head", "path")
    down = starts(heights)
    for k in range(heights - 1, -1, -1):
        down = _children(parents[k].join(down, ["tree", "place"]), fanout)
        if k:
            down = down.drop("node").unionByName(starts(k))
    alone = singles.join(above.where("height = 0").drop("height"), "tree").select("tree", "place", "node", "head", "path")
    return down.unionByName(alone) if heights else alone


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the steps of its path lead to."""
    return F.aggregate(path, start, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def manifest(docs: DataFrame, changed: Column | None = None, text: Column | None = None, fanout: int = FANOUT) -> DataFrame:
    """One row for each row of docs (doc_id, text, lang, source, n_chars): doc_id, leaf, subroot, root, proof_sha256 (of all
    siblings from leaf to root), folded_root and verified, whether that equals root.

    folded_root starts from the leaf of the row with text in place of its own where changed holds; by default nothing is
    changed. Null is a language of its own, first in order; null doc_ids come first, rows of one doc_id by their leaves;
    rows that repeat are leaves of their own. Null and empty values differ. Other columns are ignored; no rows give none.
    """
    scratch = Scratch()
    own = leaf(F.col("text"))
    forged = own if changed is None else F.when(changed, leaf(F.col("text") if text is None else text)).otherwise(own)
    leaves = scratch.settle(docs.select(F.struct("lang").alias("tree"), "doc_id", own.alias("leaf"), forged.alias("forged")))
    node = F.struct(F.col("leaf").alias("digest"), "doc_id", "forged").alias("node")
    at = placed(leaves, ["tree"], ["doc_id", "leaf"], "place", scratch).select("tree", "place", node)

    def whole(roots: DataFrame) -> DataFrame:
        """One tree over the roots of the languages; each gets (subroot, root) and its steps."""
        of = F.struct("digest", "tree", "height").alias("node")
        top = placed(roots.withColumn("all", F.lit(0)), ["all"], ["tree"], "place", scratch).select(F.col("all").alias("tree"), "place", of)
        one = lambda r: r.select("tree", "height", F.col("digest").alias("head"), F.array().cast("array<struct<before:string,after:string>>").alias("path"))
        done = forest(top, fanout, one, scratch)
        return done.select("node.tree", "node.height", F.struct(F.col("node.digest").alias("subroot"), F.col("head").alias("root")).alias("head"), "path")

    scratch.drop(leaves)
    rows = forest(at, fanout, whole, scratch)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    out = rows.select("node.doc_id", F.col("node.digest").alias("leaf"), "head.subroot", "head.root", digest(siblings).alias("proof_sha256"), folded(F.col("node.forged"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
