"""Quality rules: an isolation forest on rule statistics, its threshold calibrated on labelled rows.

The forest is grown on a bounded sample of documents, each tree on 64 of them (few, so that a common kind of junk does not
hide itself), by random splits of random statistics; a document that few splits set apart is an anomaly. The trees have a
fixed size and go with the scan of the statistics. All labelled rows set the threshold, by their counts at each score:
statistics are steps, so there are at most 6**5 scores however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, bites, held_out, settle, spread_join, texts_of

#: Documents that trees are drawn from, at most: the first by hash of doc_id.
SAMPLE_ROWS = 8192
TREES, TREE_ROWS, SEED = 100, 64, 7
#: Share of the labelled good rows that the threshold keeps at least.
KEEP = 0.995

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks"]


def repeated_words(code: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Of each text the words that lie in a window of three that it has twice or more."""
    out = np.zeros(len(starts) - 1, np.int64)
    if len(code) < 3:
        return out
    if width < 2**21:
        window = (code[:-2] * width + code[1:-1]) * width + code[2:]
    else:
        pair = np.unique(code[:-1] * width + code[1:], return_inverse=True)[1]
        window = pair[:-1] * width + code[2:]
    for k in range(len(out)):
        start, end = starts[k], starts[k + 1]
        if end - start < 4:
            continue
        own = window[start : end - 2]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            hit = np.zeros(end - start, bool)
            at = np.concatenate([order[1:][same], order[:-1][same]])
            hit[at] = hit[at + 1] = hit[at + 2] = True
            out[k] = hit.sum()
    return out


def statistics_of(texts: pa.Array) -> list[np.ndarray]:
    found = Words(texts)
    by_row = lambda values: np.bincount(found.row, weights=values[found.code], minlength=found.rows).astype(np.int64)
    count = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)
    lines = pc.split_pattern(texts, "\n")
    encoded = lines.flatten().dictionary_encode()
    line, line_row = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
    worded = pc.match_substring_regex(encoded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[line] if len(line) else np.zeros(0, bool)
    line, line_row = line[worded], line_row[worded]
    first = np.unique(line_row * max(1, len(encoded.dictionary)) + line)
    distinct_lines = np.bincount(first // max(1, len(encoded.dictionary)), minlength=found.rows)
    chars = pc.utf8_length(found.distinct).to_numpy(zero_copy_only=False)
    n_dup = np.bincount(line_row, minlength=found.rows) - distinct_lines
    upper = pc.count_substring_regex(found.distinct, r"\p{Lu}").to_numpy(zero_copy_only=False)
    return [found.n_words, by_row(chars), count(r"[#*$%&|<>]"), n_dup, repeated_words(found.code, found.starts, max(1, len(found.distinct))), by_row(upper), count("[!?]")]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the counts) for each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in bites(texts_of(batch.column(1))):
                columns = [pa.array(c.astype(np.int64)) for c in statistics_of(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), *columns], ["doc_id", *_COUNTS])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS))


def rule_values(counts: np.ndarray) -> np.ndarray:
    """The statistics that trees split on, in steps of a tenth up to a half: symbols, repeated words, lines found before
    and marks a word, and the share of capitals. Usual documents fall on few steps, so they stay together for long."""
    n, chars, symbols, dup, repeat, upper, marks = counts.astype(np.float64).T
    n = np.maximum(n, 1)
    shares = np.stack([symbols / n, repeat / n, 10 * dup / n, upper / np.maximum(chars, 1), marks / n], 1)
    return np.floor(np.minimum(shares, 0.5) * 10)


def grow(values: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> np.ndarray:
    """trees x nodes x (statistic, split, path length): node k has the children 2k + 1 and 2k + 2; -1 marks a leaf."""
    draw = np.random.default_rng(seed)
    depth = max(1, int(np.ceil(np.log2(max(2, min(rows, len(values)))))))
    forest = np.zeros((trees, 2 ** (depth + 1) - 1, 3))
    forest[:, :, 0] = -1
    for tree in forest:
        stack = [(0, 0, values[draw.choice(len(values), min(rows, len(values)), replace=False)] if len(values) else values)]
        while stack:
            node, level, own = stack.pop()
            spread = np.flatnonzero(own.max(0) > own.min(0)) if len(own) > 1 else []
            if level == depth or not len(spread):
                tree[node] = -1, 0, level + expected(len(own))
                continue
            f = draw.choice(spread)
            split = draw.uniform(own[:, f].min(), own[:, f].max())
            tree[node] = f, split, 0
            stack += [(2 * node + 1, level + 1, own[own[:, f] <= split]), (2 * node + 2, level + 1, own[own[:, f] > split])]
    return forest


def expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def anomaly(values: np.ndarray, forest: np.ndarray, rows: int = TREE_ROWS) -> np.ndarray:
    """Of each row 2 ** (-mean path / expected path): near 1 for anomalies, below a half for usual ones."""
    total = np.zeros(len(values))
    for tree in forest:
        node = np.zeros(len(values), np.int64)
        while (inner := tree[node, 0] >= 0).any():
            at = node[inner]
            right = values[inner, tree[at, 0].astype(np.int64)] > tree[at, 1]
            node[inner] = 2 * at + 1 + right
        total += tree[node, 2]
    # rounded, so that rows of the same statistics have the same score wherever they are computed
    return np.round(2.0 ** (-total / len(forest) / expected(rows)), 9)


def threshold_of(scores: np.ndarray, good: np.ndarray, bad: np.ndarray, keep: float = KEEP) -> float:
    """The threshold with the most labelled rows right among those that keep the share of the good ones; scores rise, good
    and bad are the labelled rows at each. Of thresholds that are equally right the least. Without good rows 1, which keeps all."""
    if not good.sum():
        return 1.0
    kept, dropped = np.cumsum(good), np.cumsum(bad)
    least = int(np.searchsorted(kept, np.ceil(keep * (kept[-1] - 1)), side="right"))
    wrong = kept[-1] - kept + dropped
    return float(scores[least + int(np.argmin(wrong[least:]))])


def quality_rules(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, anomaly; labels has (doc_id, quality).

    base_failed: fewer than 50 words, or more than half of them in repeated windows of three. kept: not base_failed and
    not more anomalous than the threshold; without labelled good rows base_failed alone decides. Null texts count as empty; rows
    that repeat stay rows, and each counts for the threshold; a doc_id with several labels is good if one of them is;
    labels of null doc_ids or other values than 0 and 1 are ignored, and so are other columns. Held-out rows set no
    threshold. Trees are grown on at most sample_rows documents; all labelled rows set the threshold.
    """
    counts = settle(statistics(docs).withColumn("row", F.monotonically_increasing_id()))
    failed = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    sample = counts.where(~failed).orderBy(F.xxhash64("doc_id"), "row").limit(sample_rows).select(*_COUNTS).toPandas()
    shared = docs.sparkSession.sparkContext.broadcast(grow(rule_values(sample.to_numpy())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = rule_values(np.stack([c.to_numpy() for c in batch.columns[1 : 1 + len(_COUNTS)]], 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(anomaly(values, shared.value))], ["doc_id", *_COUNTS[:5], "anomaly"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    scored = counts.select("doc_id", *_COUNTS).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in _COUNTS[:5]) + ", anomaly double")
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    seen = spread_join(scored.where(~failed).select("doc_id", "anomaly"), marked, ["doc_id"])
    at = seen.groupBy("anomaly").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).orderBy("anomaly").toPandas()
    limit = threshold_of(*(at[c].to_numpy() for c in ("anomaly", "good", "bad")), keep)
    return scored.select("doc_id", *_COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("anomaly") <= limit)).alias("kept"), "anomaly")
