"""Features, fits, forests and secrets against plain loops."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from ledgerloom.llm import common, ftrl, quality, quality_rules, secrets, toxicity

TEXTS = ["", "One", "one One ONE two", "A1b2 c-d É! É! x_9", "the cat sat on the mat the cat", "b%%% b%%% 12 ab12", "“hé” (hello) hello-there, a bb ccc dddd eeeee ffffff"]


def hashed(word):
    return common.hash_strings(pa.array([word]))


def seeded(n):
    return np.array([n], np.uint64)


def quality_features(text):
    words = text.split()
    shape = lambda w: regex.sub(r"\p{N}+", "0", regex.sub(r"[\p{Ll}\p{Lo}\p{Lm}\p{Lt}\p{M}]+", "a", regex.sub(r"\p{Lu}+", "A", w)))
    lists = [[common.chain(hashed(w.lower()), seeded(0)) for w in words], [common.chain(hashed(shape(w)), seeded(1)) for w in words]]
    found = set()
    for units in lists:
        for k in range(len(units)):
            gram = units[k]
            found.add(int(gram[0]))
            for n in (1, 2):
                if k + n < len(units):
                    gram = common.chain(gram, units[k + n])
                    found.add(int(gram[0]))
    if any(a.lower() == b.lower() for a, b in zip(words, words[1:], strict=False)):
        found.add(0x9E3779B97F4A7C15)
    return found


def toxic_features(text):
    words = [w.strip(toxicity.MARKS).lower() for w in text.split()]
    found = {int(common.chain(hashed(w), seeded(0))[0]) for w in words}
    found |= {int(common.chain(hashed(w[:n]), seeded(n))[0]) for w in words for n in toxicity.STEMS if len(w) > n}
    for gap in (1, 2):
        found |= {int(common.chain(hashed(a), hashed(b) + seeded(gap))[0]) for a, b in zip(words, words[gap:], strict=False)}
    return found


@pytest.mark.parametrize(("features", "plain"), [(quality.features, quality_features), (toxicity.features, toxic_features)])
def test_features(features, plain):
    row, hashes = features(common.Words(common.texts_of(pa.array(TEXTS))))
    for k, text in enumerate(TEXTS):
        assert {int(h) for h in hashes[row == k]} == plain(text), text


def test_scores(spark):
    settings = ftrl.Settings(bits=10)
    draw = np.random.default_rng(1)
    dense = np.where(draw.random(1025) < 0.5, draw.normal(size=1025), 0)
    at = np.flatnonzero(dense)
    docs = spark.createDataFrame(list(enumerate([*TEXTS, None])), "doc_id long, text string")
    for r in ftrl.score(docs, (at, dense[at]), toxicity.features, settings).collect():
        text = [*TEXTS, None][r.doc_id] or ""
        dot = dense[1024] + sum(dense[p] for p in {h >> 54 for h in toxic_features(text)})
        assert r.score == pytest.approx(1 / (1 + math.exp(-dot)))


def sampled(spark, n):
    docs = [(k, f"w{k % 7} {'vile' if k % 3 == 0 else 'kind'} x{k}") for k in range(n)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(n)], "doc_id long, toxic int")


def test_a_repeated_doc_id_is_one_example(spark):
    """50,000 rows of one doc_id, of differing texts in whatever order, teach as much as the one with the fewest features."""
    docs, labels = sampled(spark, 60)
    mine = docs.where(~common.held_out(F.col("doc_id"))).first().doc_id
    many = spark.range(50_000).select(F.lit(mine).alias("doc_id"), F.when(F.col("id") % 2 == 0, "vile one").otherwise("vile other words here").alias("text"))
    base = docs.where(F.col("doc_id") != mine)
    settings = ftrl.Settings(bits=12, l1=0.1)
    models = [ftrl.train(x, labels, "toxic", toxicity.features, settings) for x in (base.unionByName(many), base.unionByName(many.orderBy(F.desc("text"))).repartition(7), base.unionByName(many.limit(1)))]
    assert all(np.array_equal(a, b) for m in models[1:] for a, b in zip(models[0], m, strict=True)) and len(models[0][0]) > 5
    rows = many.select("doc_id", F.lit(1.0).alias("y"), F.array(F.length("text")).alias("at"))
    assert [tuple(r) for r in ftrl.examples(rows, settings).collect()] == [(mine, 1.0, [8])]


def test_the_fit_keeps_to_its_bounds(spark):
    """Documents beyond the bound of rows, or of features, don't count: the rest is fitted as if they weren't there."""
    docs, labels = sampled(spark, 80)
    few = ftrl.Settings(bits=12, l1=0.1, most_rows=20)
    taken = ftrl.labelled_sample(labels, "toxic", few).toPandas()
    assert len(taken) == 20
    same = [ftrl.train(docs, x, "toxic", toxicity.features, few) for x in (labels, labels.where(F.col("doc_id").isin(taken.doc_id.tolist())))]
    assert all(np.array_equal(a, b) for a, b in zip(*same, strict=True))
    place = lambda text: len({h >> 52 for h in toxic_features(text)}) + 1
    sizes = [place(docs.where(F.col("doc_id") == i).first().text) for i in taken.doc_id[:5]]
    bounded = ftrl.Settings(bits=12, l1=0.1, most_rows=20, most_features=sum(sizes))
    first = labels.where(F.col("doc_id").isin(taken.doc_id[:5].tolist()))
    same = [ftrl.train(docs, labels, "toxic", toxicity.features, bounded), ftrl.train(docs, first, "toxic", toxicity.features, few)]
    assert all(np.array_equal(a, b) for a, b in zip(*same, strict=True))


@pytest.mark.parametrize("seed", range(5))
def test_forest(seed):
    draw = np.random.default_rng(seed)
    values = draw.integers(0, 6, (200, 5)).astype(float)
    forest = quality_rules.grow(values, trees=1, rows=64, seed=seed)
    own = values[np.random.default_rng(seed).choice(200, 64, replace=False)]

    def leaf(tree, x):
        node = level = 0
        while tree[node][0] >= 0:
            node = 2 * node + (2 if x[int(tree[node][0])] > tree[node][1] else 1)
            level += 1
        return node, level

    for node, n in Counter(leaf(forest[0], x) for x in own).items():
        assert forest[0][node[0]][2] == pytest.approx(node[1] + quality_rules.expected(n))
        assert n == 1 or node[1] == 6 or len({tuple(x) for x in own if leaf(forest[0], x) == node}) == 1
    several = quality_rules.grow(values, trees=20, rows=64, seed=seed)
    for x, score in zip(values, quality_rules.anomaly(values, several, 64), strict=True):
        mean = sum(tree[leaf(tree, x)[0]][2] for tree in several) / 20
        assert score == pytest.approx(2 ** (-mean / quality_rules.expected(64)), abs=1e-8)


def plain_secrets(rows):
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example) by the rules as they are stated."""
    named = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found, owners, repositories = [], defaultdict(set), defaultdict(set)
    for doc, text, source in rows:
        text, own = text or "", []
        own += [(m.start(), "assign", m.end(), m[2]) for m in named.finditer(text) if len(m[2]) >= 6]
        own += [(m.start(), "access", m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        own += [(m.start(), "hex", m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        base = list(own)
        for m in re.finditer("[A-Za-z0-9+/_-]+", text):
            if len(m[0]) >= 20 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and all(e <= m.start() or s >= m.end() for s, _, e, _ in base):
                own.append((m.start(), "token", m.end(), m[0]))
        for _, _, _, value in own:
            owners[value].add(source)
            repositories[value].add(doc)
        found.append((doc, own))
    example = {v for v in owners if len(owners[v]) > secrets.MOST_OWNERS or len(repositories[v]) > secrets.MOST_REPOSITORIES}
    bits = lambda v: -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values())
    live = lambda v: v not in example and bits(v) >= secrets.LEAST_BITS
    rank = {k: i for i, k in enumerate(secrets.KINDS)}
    out = []
    for doc, own in found:
        written = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e, _ in sorted(spans, key=lambda x: (x[0], rank[x[1]])))
        base = [x for x in own if x[1] != "token"]
        kinds = Counter(x[1] for x in base)
        shown = base + [x for x in own if x[1] == "token" and live(x[3])]
        out.append((doc, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(written(base).encode()).hexdigest(), written(shown), sum(live(x[3]) for x in own), sum(x[3] in example for x in own)))
    return out


def test_secrets_of_random_owners(spark):
    """Values of one, few and many owners and repositories, in assignments, URLs and bare."""
    draw = random.Random(4)
    letters = "ABCDEFGHabcdefgh0123456789"
    values = ["".join(draw.choices(letters, k=draw.choice([8, 20, 26, 40]))) for _ in range(30)] + ["AKIA" + "".join(draw.choices("ABCDEF0123456789", k=16)) for _ in range(5)] + ["".join(draw.choices("0123456789abcdef", k=32)) for _ in range(5)] + ["a1" * 12]
    forms = ["password: {}", "API_KEY='{}'", "see https://h.example/x?token={}&y=é", "https://h.example/{}/z", "{}", "“{}”", "secret {}", "x{}"]
    rows = []
    for doc in range(240):
        picks = [draw.choice(values[: draw.choice([3, 12, len(values)])]) for _ in range(draw.randint(0, 3))]
        rows.append((doc, "é " + " and ".join(draw.choice(forms).format(v) for v in picks), draw.choice(["a", "b", "c", "d"])))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = plain_secrets(rows)
    found = secrets.secrets(docs).collect()
    assert sorted(map(tuple, found)) == sorted(wanted)
    assert any("token" in w[5] for w in wanted) and any(w[7] for w in wanted) and any(w[6] for w in wanted)
