"""The corpus pipeline against a plain version in Python on a small corpus."""

import hashlib
import re

import numpy as np

import corpus_pipeline
from ledgerloom.llm import toxicity
from tests.llm.test_operators import WORD, components


def plain_mix(rows, mixed):
    """Times each row is taken, from the targets and an order that only the mix decides; its sums are checked here."""
    for source in {s for _, _, s, *_ in rows}:
        own = [r for r in rows if r[2] == source]
        size = sum(len(WORD.findall(t)) for _, t, *_ in own)
        taken = sum(mixed.get(i, 0) * len(WORD.findall(t)) for i, t, *_ in own)
        yield source, size, taken


def test_against_a_plain_version(spark, tmp_path):
    draw = np.random.default_rng(9)
    rows, labels = [], []
    for k in range(400):
        words = [f"w{draw.integers(3000)}" for _ in range(60)]
        if k % 3 == 0:
            words[draw.integers(60)] = "vile"
        rows.append((k, " ".join(words), "en", f"s{k % 3}", 0))
        labels.append((k, 1, int(k % 3 == 0)))
    for k in range(400, 440):
        text = rows[k - 397][1]
        rows.append((k, text.upper() if k % 2 else re.sub(r"^\S+", "other", text), "en", "s0", 0))
    rows += [(440, None, "en", None, 0), (441, "", "en", "s1", 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == documents.columns
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        left.append([tuple(r) for r in docs.collect()])
    scores = {r.doc_id: r.score for r in toxicity.toxicity(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()}
    clean = [r for r in rows if scores[r[0]] < 0.5]
    assert sorted(r[0] for r in left[0]) == sorted(r[0] for r in clean) and sum("vile" in (r[1] or "").lower() for r in left[0]) <= 4
    last = {(r[1] or "").lower(): r for r in clean}  # rows are in order of doc_id
    assert sorted(r[0] for r in left[1]) == sorted(r[0] for r in last.values())
    texts = [(r[0], r[1] or "") for r in left[1]]
    assert sorted(r[0] for r in left[2]) == sorted({c for _, _, c in components(texts, 5)})
    times = {i: sum(r[0] == i for r in left[3]) for i in {r[0] for r in left[3]}}
    total = sum(len(WORD.findall(r[1] or "")) for r in left[2])
    assert abs(sum(taken for _, _, taken in plain_mix([(i, t or "", *rest) for i, t, *rest in left[2]], times)) - total) <= 4 * 60
    assert max(times.values()) <= 3
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_id = {r[0]: r[1] for r in left[3]}
    assert sorted((r.doc_id, r.decoded_sha256) for r in out) == sorted((i, hashlib.sha256(by_id[i].encode()).hexdigest()) for i, n in times.items() for _ in range(n))


def test_stages_take_empty_tables_and_any_columns(spark, tmp_path):
    """Further columns have the names that stages give inside."""
    more = ["_row", "_times", "_path", "_first", "_place", "row", "own", "score", "kept"]
    rows = [(k, f"w{k} " * 3 + "a b c", "en", "s", 0, *range(len(more))) for k in range(6)] + [(6, None, None, None, None, *[None] * len(more))]
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in more)
    spark.createDataFrame(rows, kinds).write.parquet(str(tmp_path / "docs"))
    spark.createDataFrame([(k, 1, 0) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.where("false"), str(tmp_path))
        assert none.count() == 0 and none.columns == out.columns, name
        if name != "byte bpe":
            assert out.columns == docs.columns and {tuple(r) for r in out.collect()} <= set(rows) and out.count() >= 6, name
    assert out.count() == 7
