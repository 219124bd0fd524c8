"""Sparse logistic regression over hashed features, trained with FTRL-proximal updates.

Features are places in a table of 2**bits weights and count once a document. A model is fitted on a bounded sample of
labelled documents, one for each doc_id however often it occurs: their features come from the executors, and one task, which
keeps no more than a stated number of documents and of features, runs the updates. L1
leaves few weights; those go to the driver and with the scan, at most 2**bits of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Words, bites, held_out, texts_of

#: Gives the (row, 64-bit hash) of the features of a batch of words.
Features = Callable[[Words], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Settings:
    bits: int = 20
    alpha: float = 0.1  #: rate
    beta: float = 1.0
    l1: float = 1.0
    l2: float = 1.0
    epochs: int = 3
    most_rows: int = 20_000  #: labelled documents to learn from at most, the first by hash of doc_id
    most_features: int = 1 << 27  #: features of all of them together at most, four bytes each; the first by the same hash
    seed: int = 42


def _places(found: Words, features: Features, bits: int) -> tuple[np.ndarray, np.ndarray]:
    row, hashed = features(found)
    return row, (hashed >> np.uint64(64 - bits)).astype(np.int64)


def labelled_sample(labels: DataFrame, label: str, settings: Settings) -> DataFrame:
    """(doc_id, y) of the rows to learn from: not held out, label 0 or 1, one for each doc_id, at most most_rows."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    return rows.orderBy(_drawn(settings), "doc_id").limit(settings.most_rows)


def _drawn(settings: Settings) -> Column:
    return F.xxhash64("doc_id", F.lit(settings.seed))


def examples(rows: DataFrame, settings: Settings) -> DataFrame:
    """(doc_id, y, at) of rows (doc_id, y, at), one for each doc_id: of several texts of one doc_id that with the fewest features,
    the least of these lists. In the order in which they are taken, in one partition; copies go before they are moved."""
    chosen = rows.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(F.size("at").alias("n"), "at")).alias("least"))
    return chosen.select("doc_id", "y", "least.at").repartition(1).sortWithinPartitions(_drawn(settings), "doc_id")


def updates(examples: Iterator[tuple[np.ndarray, float]], z: np.ndarray, n: np.ndarray, settings: Settings) -> None:
    """One pass of FTRL-proximal over (places, y); z and n change in place."""
    for at, y in examples:
        w = weights(z[at], n[at], settings)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - y
        sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / settings.alpha
        z[at] += g - sigma * w
        n[at] += g * g


def weights(z: np.ndarray, n: np.ndarray, settings: Settings) -> np.ndarray:
    w = -(z - np.sign(z) * settings.l1) / ((settings.beta + np.sqrt(n)) / settings.alpha + settings.l2)
    return np.where(np.abs(z) <= settings.l1, 0.0, w)


def train(docs: DataFrame, labels: DataFrame, label: str, features: Features, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that aren't zero; place 2**bits is the bias.

    Only doc_id and text of docs are used, and of labels doc_id and the label. Without labelled rows the bias is the
    only weight and 0.
    """
    bits = settings.bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in bites(texts_of(batch.column(1))):
                found = Words(texts)
                row, at = _places(found, features, bits)
                own = np.arange(found.rows + 1) << (bits + 1)
                pairs = np.unique(np.concatenate([(row << (bits + 1)) | at, own[:-1] | (1 << bits)]))
                ends = np.searchsorted(pairs, own)
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((pairs & ((2 << bits) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, found.rows), batch.column(2).slice(start, found.rows), lists], ["doc_id", "y", "at"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, room = [], settings.most_features  # views of the batches: four bytes a feature
        for b in batches:
            flat, ends = b.column(1).flatten().to_numpy(), np.concatenate([[0], np.cumsum(pc.list_value_length(b.column(1)).to_numpy())])
            fitting = int(np.searchsorted(ends[1:], room, side="right")) if room > 0 else 0
            learned += [(flat[ends[k] : ends[k + 1]], y) for k, y in enumerate(b.column(0).to_pylist()[:fitting])]
            room = room - int(ends[fitting]) if fitting == len(b.column(0)) else 0
        z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        order = np.random.default_rng(settings.seed)
        for _ in range(settings.epochs):
            updates((learned[i] for i in order.permutation(len(learned))), z, n, settings)
        w = weights(z, n, settings)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["place", "weight"])

    sample = F.broadcast(labelled_sample(labels, label, settings))
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    rows = docs.join(sample, "doc_id").select("doc_id", "text", "y").mapInArrow(extract, f"doc_id {kind}, y double, at array<int>")
    fitted = examples(rows, settings).select("y", "at").mapInArrow(fit, "place long, weight double").toPandas()
    return fitted["place"].to_numpy(np.int64), fitted["weight"].to_numpy(np.float64)


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], features: Features, settings: Settings) -> DataFrame:
    """(own, score): each row of docs as a struct, and its score: the sparse dot product through the logistic function.

    Null and empty texts have no features and score by the bias. Rows that repeat stay rows. All columns are carried
    along in own, whatever their names; select fewer to carry less.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = settings.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values = shared.value
        dense = np.zeros((1 << bits) + 1)
        dense[places] = values
        for batch in batches:
            parts = [np.zeros(0)]
            for _, texts in bites(texts_of(batch.column(1))):
                found = Words(texts)
                row, at = _places(found, features, bits)
                hit = dense[at] != 0
                pairs = np.unique((row[hit] << bits) | at[hit])
                dot = np.bincount(pairs >> bits, weights=dense[pairs & ((1 << bits) - 1)], minlength=found.rows)
                parts.append(1 / (1 + np.exp(-np.clip(dot + dense[1 << bits], -35, 35))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(parts))], ["own", "score"])

    rows = docs.select(F.struct("*").alias("own"), "text")
    return rows.mapInArrow(run, T.StructType([rows.schema["own"], T.StructField("score", T.DoubleType())]))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], features: Features, settings: Settings) -> DataFrame:
    """(doc_id, held_out, score) for each row of docs (doc_id, text); a null doc_id counts as held out."""
    out = scored(docs.select("doc_id", "text"), model, features, settings)
    return out.select("own.doc_id", F.coalesce(held_out(F.col("own.doc_id")), F.lit(True)).alias("held_out"), "score")
