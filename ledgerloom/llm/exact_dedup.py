"""Exact duplicates by deterministic block naming.

Every normalised text is cut into blocks of equal size. The distinct blocks of the corpus are sorted and named by
integers; then the names of adjacent blocks are paired, the distinct pairs sorted and named, and so on until each text
has one name. Two texts get the same name exactly if they are equal.

Text moves once, to the step that names blocks. It goes with a 64-bit hash, and there the blocks themselves are
compared: if each hash turns out to belong to one block only, it stands for the block afterwards. If two blocks share a
hash, the texts' blocks are compared in full instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, numbered, settle, spread_join

#: Code points in a block, and in the longer pieces from which blocks are cut (a long text isn't scanned for each block).
BLOCK, PIECE = 4096, 65536


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. ASCII texts take lower(); in others only the ASCII runs do."""
    runs = F.regexp_extract_all(text, F.lit(r"([\x00-\x7F]+|[^\x00-\x7F]+)"), F.lit(1))
    lowered = F.transform(runs, lambda r: F.when(F.octet_length(r) == F.char_length(r), F.lower(r)).otherwise(r))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.array_join(lowered, ""))


def blocks_of(text: Column, block: int, piece: int = PIECE) -> Column:
    """The blocks of a text in order; the empty text has one empty block."""

    def cut(x: Column, step: int) -> Column:
        last = F.greatest(F.lit(0), F.floor((F.char_length(x) - 1) / step).cast("int"))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(x, i * step + 1, F.lit(step)))

    pieces = F.transform(cut(text, piece), lambda p: cut(p, block))
    return F.when(F.char_length(text) <= piece, cut(text, block)).otherwise(F.flatten(pieces))


def _named(distinct: DataFrame, *keys: str) -> DataFrame:
    """The rows, which are distinct, with an integer name that rises with the keys in each partition.

    A task that runs again sorts the same rows and so gives the same names; settling keeps them from then on.
    """
    return settle(distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id()))


def exact_groups(docs: DataFrame, block: int = BLOCK, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, row.

    Null texts count as empty. Of equal texts (A-Z lower-cased) the row with the largest doc_id stays, null being least;
    of rows with the same doc_id and text one stays. Other columns of docs are ignored; an empty docs gives no rows.
    row tells the rows of this result apart.
    """
    return _groups(docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row")), block, hash_of)


def _groups(docs: DataFrame, block: int = BLOCK, hash_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """exact_groups of docs (doc_id, text, row). Rows are read with their text once, so row need not outlast a scan."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "row")
    docs = docs.select("doc_id", "row", lower_ascii(F.col("text")).alias("text"))
    pieces = docs.select("doc_id", "row", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"), blocks_of(F.col("text"), block).alias("blocks"))
    slim = settle(pieces.withColumn("blocks", F.transform("blocks", lambda b: hash_of(b))))

    blocks = docs.select(F.explode(blocks_of(F.col("text"), block)).alias("block"))
    names = _named(blocks.select(hash_of(F.col("block")).alias("h"), "block").distinct(), "h", "block")
    if names.groupBy("h").count().where("count > 1").isEmpty():
        by, names = "h", names.select("h", "name")
    else:
        by, slim = "block", settle(pieces)
    level = slim.select("row", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", by))
    level = settle(spread_join(level, names.select(by, "name"), [by]).select("row", "n", "pos", "name"))

    longest, depth, done = slim.select(F.max(F.size("blocks"))).first()[0] or 0, 0, []
    while True:
        done.append(level.where("n = 1").select("row", F.lit(depth).alias("depth"), "name"))
        if longest <= 1:
            break
        left, right = (F.max(F.when(F.col("pos") % 2 == k, F.col("name"))) for k in (0, 1))
        half = (F.col("pos") / 2).cast("int").alias("pos")
        pairs = level.where("n > 1").groupBy("row", "n", half).agg(left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b"))
        names = _named(pairs.select("a", "b").distinct(), "a", "b")
        halved = F.ceil(F.col("n") / 2).cast("int").alias("n")
        level = settle(spread_join(pairs, names, ["a", "b"]).select("row", halved, "pos", "name"))
        longest, depth = (longest + 1) // 2, depth + 1

    identity = done[0]
    for more in done[1:]:
        identity = identity.unionByName(more)
    rows = slim.select("row", "doc_id", "text_sha256").join(identity, "row")
    groups = rows.groupBy("depth", "name").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
    out = spread_join(rows, groups, ["depth", "name"])
    return out.select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("keep.row")).alias("kept"), "text_sha256", "row")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that exact_groups keeps."""
    row = free_name(docs, "_row")
    docs = numbered(docs, row)
    kept = _groups(docs.select("doc_id", "text", F.col(row).alias("row"))).where("kept").select(F.col("row").alias(row))
    return docs.join(kept, row, "left_semi").drop(row)
