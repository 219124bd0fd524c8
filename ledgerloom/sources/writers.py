"""Flat CSV, nested JSON and text of finished statements."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from itertools import groupby

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F

from ..functions.scalars import plain_number
from .shared import mounted

_CSV = {"header": True, "escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
#: Files of a folder at most, so that many files are listed by many tasks.
FOLDER = 2000


def bank_csv_rows(lines: DataFrame) -> DataFrame:
    """The columns of the bank CSV, numbers as text, with doc_id and seq to order by."""
    return lines.select("doc_id", "seq", "date", "description", plain_number(F.col("amount")).alias("amount"), "currency", plain_number(F.col("balance")).alias("balance"), "reference")


def municipal_csv_rows(lines: DataFrame) -> DataFrame:
    """The columns of the municipal CSV: all charges of a document, then its payments."""
    return lines.select("doc_id", "seq", F.col("kind").alias("type"), "date", "description", plain_number(F.col("amount")).alias("amount"), "currency", "reference")


def csv_field(x: Column) -> Column:
    """Quoted only where it holds a quotation mark, a comma or a line end."""
    x = F.coalesce(x, F.lit(""))
    return F.when(x.rlike('[",\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)


def csv_line(*columns: str) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(c).cast("string")) for c in columns])


def write_csv(rows: DataFrame, path: str) -> None:
    """Rows in order within each file; a document isn't split between files."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(n, "doc_id").sortWithinPartitions("doc_id", "seq").drop("doc_id", "seq").write.options(**_CSV).csv(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a document; absent fields are left out."""
    results.write.option("ignoreNullFields", True).json(path)


def write_text(docs: DataFrame, path: str) -> None:
    """(doc_id, text) as Parquet."""
    docs.select("doc_id", "text").write.parquet(path)


def write_text_files(docs: DataFrame, path: str) -> None:
    """(doc_id, text) as a text file for each document; the text ends with a line end more. Where the folder is mounted, a task
    writes its files doc_id=....txt into folders of FOLDER files; in other stores Spark writes each into a folder doc_id=... of its own."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartition(n, "doc_id")
    folder = mounted(spark, path)
    if folder is None:
        docs.write.partitionBy("doc_id").text(path)
        return
    os.makedirs(folder)
    rows = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("binary"))
    rows.sortWithinPartitions("doc_id").foreachPartition(lambda part: _write_files(part, folder, FOLDER))


def _write_files(rows: Iterable[Row], folder: str, most: int) -> None:
    """Rows of the same doc_id, which come one after the other, go into one file. A file gets its name once it is whole and its
    place follows from the order, so a task may run twice."""
    task = TaskContext.get()
    for k, (name, same) in enumerate(groupby(rows, lambda row: _path_name(row.doc_id))):
        if k % most == 0:
            own = os.path.join(folder, f"part-{task.partitionId():05d}-{k // most:05d}")
            os.makedirs(own, exist_ok=True)
        unfinished = os.path.join(own, f".{task.taskAttemptId()}")
        with open(unfinished, "wb") as file:
            for row in same:
                file.write(row.text)
                file.write(b"\n")
        os.replace(unfinished, os.path.join(own, f"doc_id={name}.txt"))


def _path_name(value: str | None) -> str:
    """As Spark names the folder of a value."""
    return re.sub(r"""[\x00-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"


def route(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that succeeded, and those that failed: these keep their errors and no data."""
    return results.where("ok"), results.where("NOT ok")


def write_routed(results: DataFrame, path: str, mode: str = "errorifexists") -> dict[str, int]:
    """Writes finished documents in one pass, those that succeeded and those that failed into folders of their own, and returns
    how many there are of each: {"ok": .., "failed": ..}."""
    seen = Observation("routes")
    counts = [F.count_if(F.col("ok")).alias("ok"), F.count_if(~F.col("ok")).alias("failed")]
    results.observe(seen, *counts).write.partitionBy("ok").mode(mode).parquet(path)
    return {k: int(v) for k, v in seen.get.items()}
