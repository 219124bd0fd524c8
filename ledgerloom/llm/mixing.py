"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key whose rate is its quality weight, so heavier ones come early. A source takes its
complete epochs first; what its target leaves over is filled in the order of the keys, cut where the running sum of
sizes reaches it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, numbered, settle, spread_join

#: Rows of a key range at most, about; a source of any size is cut into as many ranges as that asks for.
RANGE_ROWS = 1_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"({WORD})")).cast("long")


def quality_weight(text: Column) -> Column:
    """Of a text: 1 without symbols, falling with symbols a word; between 0 and 1, never 0."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"([#*$%&|<>])"))
    return F.lit(1.0) / (F.lit(1.0) + n.cast("double") / F.greatest(word_count(text), F.lit(1)).cast("double"))


def exponential_key(doc_id: Column, weight: Column, seed: str) -> Column:
    """-ln(u) / weight with u in (0, 1) from the md5 of seed and doc_id."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary")), 1, 12)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**12)
    return -F.log(u) / weight


def key_range(key: Column, n_rows: Column) -> Column:
    """The range of a key among n_rows of a source, rising with the key: equal steps of its logarithm. Of exponential keys
    of whatever rates a step d of the logarithm holds a share of d / e at most, so no mixture of weights makes a large range."""
    return F.floor(F.log(key) * F.ceil(n_rows / (2.718281828459045 * RANGE_ROWS))).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(source, source_size) with target added: shares of the whole by weight, none above cap times its source's size.

    Sources by the least ratio of cap to weight meet their cap first, so the capped ones are a prefix of that order; the
    rest share what is left by weight.
    """
    everything, order = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), Window.orderBy(F.col("source").asc_nulls_last())
    w = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1))
    w = w.withColumn("most", F.lit(float(cap)) * F.col("source_size"))
    full = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    shares = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    w = w.withColumn("level", rest / shares)
    # the first source that stays below its cap sets the level of all after it
    w = w.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(everything)["level"])
    return w.select("source", "source_size", F.least(F.col("most"), F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, seed: str = "mix", weight: Column | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text, source): doc_id, size, source_size, target, taken, row.

    taken is how many words the mix takes of a document, repeats counted: its size for each complete epoch of its source,
    once more if the fractional epoch reaches it. A document is reached if at least half of it fits, so a source misses
    its target by half of one document at most. Null and empty texts have size 0 and taken 0; a null source is a source
    of its own, last in order. Rows with the same doc_id draw the same key and are ordered by size. Other columns are
    ignored; an empty docs gives no rows. row tells the rows of this result apart.
    """
    return _mix(docs.withColumn("_row", F.monotonically_increasing_id()), weights, cap, seed, weight)


def _mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3, seed: str = "mix", weight: Column | None = None) -> DataFrame:
    """mix of docs with their rows' numbers in _row, which become row."""
    slim = settle(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), (quality_weight(F.col("text")) if weight is None else weight).alias("weight"), F.col("_row").alias("row")))
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    targets = settle(source_targets(sizes.drop("n_rows"), weights, cap).withColumn("source", F.struct("source")).join(sizes.select(F.struct("source").alias("source"), "n_rows"), "source"))
    keyed = slim.withColumn("key", exponential_key(F.col("doc_id"), F.col("weight"), seed)).withColumn("source", F.struct("source"))
    keyed = settle(spread_join(keyed, targets, ["source"]))
    keyed = keyed.withColumn("range", key_range(F.col("key"), F.col("n_rows")))
    sums = keyed.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("range_size").over(before), F.lit(0))).drop("range_size")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.join(sums, ["source", "range"]).withColumn("before", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    once = F.when(F.lit(2.0) * (rest - F.col("before")) >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    return run.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + once).cast("long").alias("taken"), "row")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it whole."""
    row, times = free_name(docs, "_row"), free_name(docs, "_times")
    docs = numbered(docs, row)
    found = _mix(docs.withColumn("_row", F.col(row)), **settings).where("taken > 0").select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias(times))
    return docs.join(found, row).withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).drop(row, times)
