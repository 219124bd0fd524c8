"""Secrets, and who owns them.

Each text is scanned for three base kinds and for other long mixed tokens. Every value found is hashed; over the whole
corpus the distinct owners and repositories of a hash are counted. A value that many owners have, or that many repositories
have, is a copied example; one that few have, and that looks random, is taken for live. Base spans always stay; a token becomes a span if it is live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, spread_join, texts_of

#: Kinds in the order that breaks ties; the first three are the base.
KINDS = ("assign", "access", "hex", "token")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}")
#: What a text with any of these has; only such texts are scanned for offsets.
_ANY = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]|AKIA[A-Z0-9]{16}|[0-9a-f]{24}|[0-9][A-Za-z0-9+/_-]{10}|[A-Za-z0-9+/_-]{10}[0-9]"""
#: Owners and repositories up to which a value is specific, and bits a sign from which it looks random.
MOST_OWNERS, MOST_REPOSITORIES, LEAST_BITS = 2, 10, 3.0

_CANDIDATE = "struct<start:long, rank:int, end:long, hash:string, random:boolean>"


def bits_a_sign(value: str) -> float:
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def find(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, value) in order; tokens that touch a base span are left out."""
    found = [(m.start(), 0, m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in _HEX.finditer(text)]
    covered = sorted((s, e) for s, _, e, _ in found)
    at, reach = 0, 0
    for m in _TOKEN.finditer(text):
        while at < len(covered) and covered[at][0] < m.end():
            reach, at = max(reach, covered[at][1]), at + 1
        if reach <= m.start() and re.search("[A-Za-z]", m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


def _spans(candidates):
    return F.array_join(F.transform(candidates, lambda c: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), c["rank"] + 1), c["start"].cast("string"), c["end"].cast("string"))), ",")


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS, least_bits: float = LEAST_BITS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """One row for each row of docs (doc_id, text, owner, repository): doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, and n_live, n_example: the values found there that are live or copied.

    Spans are kind:start:end in code points, end exclusive. Null and empty texts have none; a null owner or repository
    counts as one of its own; rows that repeat stay rows; other columns are ignored.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("end", pa.int64()), ("hash", pa.string()), ("random", pa.bool_())]))
        for batch in batches:
            texts = texts_of(batch.column(3))
            out: list[list] = [[] for _ in range(len(texts))]
            for k in pc.indices_nonzero(pc.match_substring_regex(texts, _ANY)).to_pylist():
                out[k] = [{"start": s, "rank": r, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest(), "random": bits_a_sign(v) >= least_bits} for s, r, e, v in find(texts[k].as_py())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, kind)], ["doc_id", "owner", "repository", "found"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    slim = docs.select("doc_id", F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), "text")
    scanned = slim.mapInArrow(scan, f"doc_id {kind}, owner string, repository string, found array<{_CANDIDATE}>")
    scanned = settle(scanned.withColumn("row", F.monotonically_increasing_id()))

    values = scanned.select("row", "owner", "repository", F.explode("found").alias("c")).select("*", F.col("c.hash").alias("hash"))
    distinct = lambda of: values.select("hash", of).distinct().groupBy("hash").agg(F.count("*").alias(f"n_{of}"))
    spread = distinct("owner").join(distinct("repository"), "hash")
    spread = spread.select("hash", ((F.col("n_owner") > most_owners) | (F.col("n_repository") > most_repositories)).alias("example"))
    judged = spread_join(values.select("row", "c", "hash"), spread, ["hash"])
    judged = judged.withColumn("live", ~F.col("example") & F.col("c.random"))
    count = lambda name: F.sum(F.col(name).cast("long")).alias(f"n_{name}")
    added = F.collect_list(F.when(F.col("live") & (F.col("c.rank") == 3), F.col("c"))).alias("added")
    by_row = judged.groupBy("row").agg(count("live"), count("example"), added)

    base = F.array_sort(F.filter("found", lambda c: c["rank"] < 3))
    number = lambda rank: F.size(F.filter("found", lambda c: c["rank"] == rank)).cast("long")
    spans = F.array_sort(F.concat(base, F.coalesce("added", F.array().cast(f"array<{_CANDIDATE}>"))))
    zero = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    counts = [number(rank).alias(f"n_{KINDS[rank]}") for rank in range(3)]
    return scanned.join(by_row, "row", "left").select("doc_id", *counts, F.sha2(_spans(base).cast("binary"), 256).alias("base_sha256"), _spans(spans).alias("spans"), zero("n_live"), zero("n_example"))
