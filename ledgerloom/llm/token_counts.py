"""Token counts from the pieces of distinct pre-tokens.

The tokenizer drops white space and splits at it before merging, so a text has as many tokens as its ASCII-blank
separated words have together. Each distinct word of the corpus is tokenized once. Words that make up at least one part
in 2**21 of all occurrences and aren't long, so 2**21 words and 112 MiB with their counts at most, are broadcast and summed
inside the scan; the frequencies of the others are joined with the vocabulary. No ids are kept.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bites, hash_strings, settle, texts_of

#: A word is frequent if it makes up this share of all words, as at most 1 / SHARE words do, and has so many bytes at most.
SHARE, LONGEST = 2.0**-21, 48


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def vocabulary(docs: DataFrame, path: str) -> DataFrame:
    """(word, n, pieces) of the distinct words of all texts: occurrences in the corpus and tokens in one of them."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in bites(texts_of(batch.column(0))):
                found = Words(texts)
                n = np.bincount(found.code, minlength=len(found.distinct))
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([found.distinct.take(pa.array(some)).cast(pa.string()), pa.array(n[some])], ["word", "n"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            counts = [len(x) for x in tokenizer.encode_batch_fast(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], ["word", "n", "pieces"])

    distinct = docs.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return settle(distinct.mapInArrow(pieces, "word string, n long, pieces long"))


def token_counts(docs: DataFrame, path: str, share: float = SHARE) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of docs (doc_id, text), as the tokenizer at path counts without added
    special tokens; special strings in a text are one token each, its default.

    Null counts as empty: no bytes, no tokens. Rows that repeat stay rows. Other columns are ignored.
    """
    known = vocabulary(docs, path)
    total = known.agg(F.sum("n")).first()[0] or 0
    frequent_word = (F.col("n") >= share * total) & (F.octet_length("word") <= LONGEST)
    head = known.where(frequent_word).select("word", "pieces").toPandas()
    shared = docs.sparkSession.sparkContext.broadcast((head["word"].tolist(), head["pieces"].to_numpy(np.int64)))
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, known_pieces = pa.array(shared.value[0], pa.large_string()), np.append(shared.value[1], 0)
        for batch in batches:
            texts = texts_of(batch.column(1))
            digests = hash_strings(texts).view(np.int64)  # tells rows of one doc_id apart
            for start, some in bites(texts):
                found = Words(some)
                at = pc.fill_null(pc.index_in(found.distinct, value_set=frequent), -1).to_numpy(zero_copy_only=False)
                at = at[found.code]
                summed = np.bincount(found.row, weights=known_pieces[at], minlength=found.rows).astype(np.int64)
                rare = at < 0
                width = max(1, len(found.distinct))
                pairs, n = np.unique(found.row[rare] * width + found.code[rare], return_counts=True)
                row = np.concatenate([np.arange(found.rows), pairs // width])
                ids = batch.column(0).take(pa.array(row + start))
                # what is summed already goes along under a key that no word can have, different for each text
                own = pa.array([f" {k} {x}" for k, x in zip(ids[: found.rows].to_pylist(), digests[start : start + found.rows], strict=True)], pa.string())
                word = pa.concat_arrays([own, found.distinct.take(pa.array(pairs % width)).cast(pa.string())])
                n_bytes = np.concatenate([pc.binary_length(some).to_numpy(zero_copy_only=False), np.zeros(len(pairs), np.int64)]).astype(np.int64)
                base = np.arange(len(row)) < found.rows
                columns = [ids, digests[start + row], word, np.concatenate([summed, n]), n_bytes, base.astype(np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "digest", "word", "times", "n_bytes", "copies"])

    rows = docs.select("doc_id", "text").mapInArrow(frequencies, f"doc_id {kind}, digest long, word string, times long, n_bytes long, copies long")
    counted = rows.join(known.where(~frequent_word).select("word", "pieces"), "word", "left")
    tokens = F.sum(F.col("times") * F.coalesce("pieces", F.lit(1))).alias("n_tokens")
    out = counted.groupBy("doc_id", "digest").agg(tokens, F.sum("n_bytes").alias("n_bytes"), F.sum("copies").alias("copies"))
    each = [(F.col(c) / F.col("copies")).cast("long").alias(c) for c in ("n_bytes", "n_tokens")]
    return out.select("doc_id", *each, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).drop("_copy")
