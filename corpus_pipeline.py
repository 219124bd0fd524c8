"""A corpus pipeline: toxic documents go, copies and near copies go, sources are mixed, and what is left is encoded.

Each stage reads the Parquet that the one before it wrote. All stages take documents with further columns, whatever their
names, and all but the last keep them; an empty table gives an empty one. Null texts are empty texts throughout.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from ledgerloom.llm.common import documents, settle


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score below one half; texts without words score by the bias alone. Without labelled rows to learn from
    all rows stay."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each text, A-Z lower-cased: that of the largest doc_id, null being least; all empty texts are one."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each group of similarity 0.8 or more on five-word shingles: that of the smallest doc_id, null being last;
    texts without words stay."""
    return near_dedup.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, three times at most; texts without words are never taken. A null source is one
    of its own, and rows of the same doc_id are ordered by size."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and of the decoded bytes, one row for each row."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("byte bpe", encode),
]
#: Scores, MinHash and BPE are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, settle(docs) if k else docs, sf_dir)
    return docs
