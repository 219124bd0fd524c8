"""Quality classifier: hashed word n-gram logistic regression with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, chain, hash_strings
from .ftrl import Settings, score, train

SETTINGS = Settings(l1=2.0, alpha=1.0, epochs=4)
THRESHOLD = 0.3


def features(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of one to three words in lower case, and of one to three word shapes (runs of capitals, of letters and of digits
    as one sign each, other signs as they are); and pairs that are one word twice, as one feature."""
    if not len(found.code):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    word = hash_strings(pc.utf8_lower(found.distinct))[found.code]
    shapes = found.distinct
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}\p{M}]+", "a"), (r"\p{N}+", "0")):
        shapes = pc.replace_substring_regex(shapes, pattern, sign)
    shape = chain(hash_strings(shapes), np.uint64(1))[found.code]
    rows, hashes = [], []
    for of in (chain(word, np.uint64(0)), shape):
        gram = of
        for n in (1, 2, 3):
            if n > 1:
                gram = chain(gram[:-1], of[n - 1 :])
            same = found.row[: len(gram)] == found.row[n - 1 :]
            rows.append(found.row[n - 1 :][same])
            hashes.append(gram[same])
    twice = (found.row[:-1] == found.row[1:]) & (word[:-1] == word[1:])
    rows.append(found.row[1:][twice])
    hashes.append(np.full(int(twice.sum()), 0x9E3779B97F4A7C15, np.uint64))
    return np.concatenate(rows), np.concatenate(hashes)


def quality(docs: DataFrame, labels: DataFrame, settings: Settings = SETTINGS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text); labels has (doc_id, quality).

    Learns from at most settings.most_rows labelled rows that aren't held out. Cases: see ftrl.score.
    """
    model = train(docs, labels, "quality", features, settings)
    return score(docs, model, features, settings).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
