"""Helpers that the operators share: settled tables and vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = found.get() if found.isDefined() else None
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


#: Removes the shuffle files of a query as soon as it ends; a settled table is what later plans read instead.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _settled(df: DataFrame) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    schema, was = df.schema, spark.conf.get(_FREE_SHUFFLES)
    spark.conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_FREE_SHUFFLES, was)
    return spark.read.schema(schema).parquet(path), path


def settle(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it again: the plan starts anew there and lost executors cost nothing before it."""
    return _settled(df)[0]


#: Bytes of a file of a table whose size is known, about, and the fewest files.
FILE_BYTES, LEAST_FILES = 32 << 20, 8


def plan_bytes(df: DataFrame) -> int:
    """Spark's estimate of the bytes of df, by which it chooses joins; of a settled table the size of its files."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


class Scratch:
    """The settled tables of one job, so that those which nothing reads any more can go before the job ends."""

    def __init__(self) -> None:
        self._tables: list[tuple[DataFrame, str]] = []

    def settle(self, df: DataFrame, *like: DataFrame) -> DataFrame:
        """df settled. Given the settled tables that it is about as large as, in as many files as their bytes ask for."""
        if like:
            df = df.coalesce(max(LEAST_FILES, sum(map(plan_bytes, like)) // FILE_BYTES))
        self._tables.append(_settled(df))
        return self._tables[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        """Deletes these settled tables; no plan may read them from now on."""
        self.keep(*[t for t, _ in self._tables if not any(t is x for x in tables)])

    def keep(self, *tables: DataFrame) -> None:
        """Deletes all settled tables but these; no plan may read the others from now on."""
        kept = [(t, path) for t, path in self._tables if any(t is x for x in tables)]
        for table, path in self._tables:
            if not any(path == p for _, p in kept):
                where = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
        self._tables = kept


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores before it until docs has no such column."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def _plain_parquet(docs: DataFrame) -> bool:
    """Whether docs are rows of Parquet files, each once at most, by columns and filters that always give the same."""
    plan = docs._jdf.queryExecution().analyzed()
    if "_metadata" in docs.columns or not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    files = plan.nodeName() == "LogicalRelation" and plan.relation().getClass().getSimpleName() == "HadoopFsRelation"
    return files and plan.relation().fileFormat().toString() == "Parquet"


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with an integer column, different for each row, that every scan of the result gives to the same row again,
    however the files are split by then.

    It is the number of the file among the sorted paths, and the place in the file, which the reader knows. Rows that
    don't come straight from Parquet files are settled with their numbers instead.
    """
    if not _plain_parquet(docs):
        return settle(docs.withColumn(name, F.monotonically_increasing_id()))
    paths = sorted(r[0] for r in docs.select("_metadata.file_path").distinct().collect())
    path, first, place = (free_name(docs, c) for c in ("_path", "_first", "_place"))
    files = docs.sparkSession.createDataFrame([(p, k << 36) for k, p in enumerate(paths)], f"{path} string, {first} long")
    placed = docs.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    found = placed.join(F.broadcast(files), path)
    return found.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col(first) + F.col(place)).alias(name))


def placed(rows: DataFrame, group: list[str], order: list[str], place: str, scratch: Scratch) -> DataFrame:
    """Settled rows with their place (from 0) among those of the same group, by order; equal rows in any order.

    All rows are sorted by ranges of (group, order), so that a large group is dealt over many tasks. What a range adds to
    the places of a group that began before it is one row a range at most. Rows should be settled: they are read twice.
    """
    keys = [*group, *order, "_tie"]
    ranges = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    in_range = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    written = scratch.settle(ranges.select(F.struct(*group).alias("_group"), *rows.columns, F.spark_partition_id().alias("_range"), in_range.alias("_at")))
    parts = written.groupBy("_group", "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = scratch.settle(parts.select("_group", "_range", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift")))
    return written.join(parts, ["_group", "_range"]).withColumn(place, F.col("_at") + F.col("_shift")).drop("_group", "_range", "_at", "_shift")


def running(rows: DataFrame, key: str, place: str, columns: dict[str, Callable[[Column | str], Column]], block: int, total: bool = False) -> DataFrame:
    """rows with the named columns summed up to and with each row of its key, in order of place (from 0, without gaps), by
    bit_xor or sum; with total, also the number of rows of the key as n_places.

    A key is worked out in blocks of places, which are then put together by their totals; so a large one is many tasks. rows
    should be settled: they are read twice. key isn't null (a struct of nulls is no null).
    """
    rows = rows.withColumn("_block", F.floor(F.col(place) / block).cast("long"))
    inside = Window.partitionBy(key, "_block").orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = rows.withColumns({c: of(c).over(inside) for c, of in columns.items()})
    blocks = rows.groupBy(key, "_block").agg(F.count("*").alias("_n"), *[of(c).alias(f"_{c}") for c, of in columns.items()])
    before = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    more = [F.sum("_n").over(Window.partitionBy(key)).alias("n_places")] if total else []
    earlier = blocks.select(key, "_block", *more, *[of(f"_{c}").over(before).alias(f"_{c}") for c, of in columns.items()])
    earlier = earlier if total else earlier.where("_block > 0")
    out = summed.join(earlier, [key, "_block"], "inner" if total else "left")
    plus = lambda c: F.col(c).bitwiseXOR(F.coalesce(f"_{c}", F.lit(0))) if columns[c] is F.bit_xor else F.col(c) + F.coalesce(f"_{c}", F.lit(0))
    return out.withColumns({c: plus(c) for c in columns}).drop("_block", *[f"_{c}" for c in columns])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the rows that no model learns from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def salts(spark: SparkSession) -> int:
    """Into how many parts a hot key is dealt: as many as there are shuffle partitions."""
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


def texts_of(column: pa.Array) -> pa.Array:
    """Null texts as empty ones, with 64-bit offsets so that long texts fit."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


class Words:
    """The ASCII-blank separated words of a batch: row[i] is the text of word i, code[i] its place in distinct."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(texts)
        row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        encoded = lists.flatten().dictionary_encode()
        code = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        full = pc.binary_length(encoded.dictionary).to_numpy(zero_copy_only=False) > 0
        keep = full[code] if len(code) else np.zeros(0, bool)
        self.rows = len(texts)
        self.row, self.code, self.distinct = row[keep], code[keep], encoded.dictionary
        self.n_words = np.bincount(self.row, minlength=self.rows)
        self.starts = np.concatenate([[0], np.cumsum(self.n_words)])

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, in text order; each distinct word is hashed once."""
        if not len(self.distinct):
            return np.zeros(0, np.uint64)
        return hash_strings(self.distinct)[self.code]


def hash_strings(strings: pa.Array) -> np.ndarray:
    return pd.util.hash_array(strings.to_numpy(zero_copy_only=False).astype(object), categorize=False).astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return mix(mix(left + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(3) + right)


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join (inner or left) with right, whose keys are unique, where one key may hold much of left.

    The rows of a key are dealt over as many salts as there are shuffle partitions. right's row is sent once to each
    (key, salt) that occurs; those are few for a hot key, since they are made distinct before the shuffle. A right that is
    within Spark's own bound for broadcasting needs none of that: left stays where it is.
    """
    spark = left.sparkSession
    if plan_bytes(right) <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold():
        return left.join(right, keys, how)
    n = salts(spark)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(n)).cast("int"))
    reached = salted.select(*keys, "_salt").distinct().join(right, keys)
    return salted.join(reached, [*keys, "_salt"], how).drop("_salt")


def bites(texts: pa.Array, most: int = 3_000_000) -> Iterator[tuple[int, pa.Array]]:
    """Slices of texts of about `most` bytes, whole texts each, with the row where they start."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield start, texts.slice(start, end - start)
        start = end
