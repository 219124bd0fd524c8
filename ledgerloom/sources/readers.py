"""Statement documents as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name

#: The codes and messages of documents that can't be read.
INVALID = ("INVALID_PDF", "Input file does not look like a PDF.")
UNREADABLE = "FILE_NOT_READABLE"
ITEMS_SCHEMA = "doc_id string, page int, text string, x double, y double, width double, height double"


def read_pdf_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_file_name, content, error_code, error_message) of the files in a folder; a file that doesn't start as
    a PDF carries the error and no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    good = F.substring("content", 1, 5) == F.lit(b"%PDF-")
    fault = lambda text: F.when(~good, F.lit(text))
    return files.select(F.col("path").alias("doc_id"), file_name(F.col("path")).alias("source_file_name"), F.when(good, F.col("content")).alias("content"), fault(INVALID[0]).alias("error_code"), fault(INVALID[1]).alias("error_message"))


def missing_files(requested: DataFrame, loaded: DataFrame) -> DataFrame:
    """Issues for the requested (doc_id) that weren't loaded."""
    gone = requested.join(loaded.select("doc_id"), "doc_id", "left_anti")
    return gone.select("doc_id", F.lit("error").alias("level"), F.lit(0).alias("seq"), F.lit(UNREADABLE).alias("code"), F.concat(F.lit("File is not readable: "), "doc_id").alias("message"))


def read_extracted_text(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_file_name, text): one whole text a file."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_name").alias("source_file_name"), F.col("value").alias("text"))


def read_layout_items(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Positioned items as written by an extractor, Parquet or JSON lines; blank ones and coordinates are cleaned where they
    are laid out."""
    return spark.read.format(kind).schema(ITEMS_SCHEMA).load(path)
