"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .common import texts_of

#: Code points after which a text is cut at the next safe boundary.
CHUNK = 65536
#: A blank after something that isn't one: no pre-token of PATTERN goes on over it, and blanks look ahead only within their own run.
_BOUNDARY = re.compile(r"(?<=\S)[ \n]")


@lru_cache(maxsize=4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Parts of the text that encode separately to what the whole encodes to; a text without boundaries stays whole."""
    start = 0
    while len(text) - start > size and (found := _BOUNDARY.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def encode_text(codec: tiktoken.Encoding, text: str) -> np.ndarray:
    parts = [codec.encode_to_numpy(part, disallowed_special=()) for part in chunks(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text); ids array<int>. Null and empty texts have no ids; special
    strings are ordinary text; rows that repeat stay rows; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(path, pattern)
        for batch in batches:
            ids = [encode_text(codec, text.as_py()).astype(np.int32) for text in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, bytes) for each row of rows (doc_id, ids): the raw bytes, which need not be valid UTF-8; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(path, pattern)
        for batch in batches:
            raw = [codec.decode_bytes(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], ["doc_id", "bytes"])

    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each row of docs (doc_id, text) in one pass: doc_id, n_tokens, ids_sha256 of the decimal ids
    joined by one space, decoded_sha256 of the decoded bytes. Cases as for encode; no ids give the digest of nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(path, pattern)
        words = [f"{i} ".encode() for i in range(codec.n_vocab)]
        width = max(map(len, words))
        digits = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        for batch in batches:
            counts, ids_digests, digests = [], [], []
            for text in texts_of(batch.column(1)):
                ids = encode_text(codec, text.as_py())
                decimal = digits[ids].ravel()
                counts.append(len(ids))
                ids_digests.append(hashlib.sha256(decimal[decimal != 0][:-1].tobytes()).hexdigest())
                digests.append(hashlib.sha256(codec.decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(digests, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
