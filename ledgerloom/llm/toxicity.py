"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chain, hash_strings
from .ftrl import Settings, score, scored, train

#: Punctuation that may surround a word.
MARKS = ".,;:!?\"'()[]{}<>#*$%&|_-"
#: Code points of the stems that stand for the inflected forms of a word.
STEMS = (4, 5)
SETTINGS = Settings(l1=2.0, alpha=1.0, epochs=4)
THRESHOLD = 0.5


def features(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words, their stems, pairs of neighbours, and pairs with one word between; words in lower case without marks around."""
    if not len(found.code):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    words = pc.utf8_lower(pc.utf8_trim(found.distinct, MARKS))
    word = hash_strings(words)[found.code]
    rows, hashes = [found.row], [chain(word, np.uint64(0))]
    for size in STEMS:
        stem = hash_strings(pc.utf8_slice_codeunits(words, 0, size))
        longer = (pc.utf8_length(words).to_numpy(zero_copy_only=False) > size)[found.code]
        rows.append(found.row[longer])
        hashes.append(chain(stem, np.uint64(size))[found.code][longer])
    for gap in (1, 2):
        same = found.row[:-gap] == found.row[gap:]
        rows.append(found.row[gap:][same])
        hashes.append(chain(word[:-gap][same], word[gap:][same] + np.uint64(gap)))
    return np.concatenate(rows), np.concatenate(hashes)


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels has (doc_id, toxic).

    Learns from at most settings.most_rows labelled rows that aren't held out. Cases: see ftrl.score.
    """
    model = train(docs, labels, "toxic", features, settings)
    return score(docs, model, features, settings).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all their columns, that score below the threshold; no row is moved for it. A model that has
    learned nothing rejects nothing."""
    model = train(docs, labels, "toxic", features, settings)
    if not len(model[0]):
        return docs
    return scored(docs, model, features, settings).where(F.col("score") < threshold).select("own.*")
