"""Corpus operators on small tables: hard cases, and brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ledgerloom.llm import bpe, chat, common, exact_dedup, ftrl, mixing, near_dedup, quality, quality_rules, secrets, token_counts, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RANKS, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
#: Odd texts; extra columns have the names that operators use inside.
ODD = ["", None, " \t\n", "one", "One", "ÀB é 日本語 İΣſ", "a b c a b c a b c", "x  y\n\n z \x85 \x1c", "<|endoftext|> it's 12 <|startoftext|>no", "long " * 30000, "word" * 9000, "line\nline\n\nother\nline", "#$% | <>"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(k, t, "s", k, -1.0, True, "n") for k, t in enumerate(ODD)] + [(3, "one", "s", 0, 0.0, True, "n"), (None, "one", None, 0, 0.0, True, "n"), (20, "ONE", "t", 0, 0.0, False, "n")]
    path = str(tmp_path_factory.mktemp("odd") / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, source string, row long, score double, kept boolean, name string").coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


def texts(docs):
    return [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]


def same(found, wanted):
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_exact_groups(odd, none):
    def norm(t):
        return re.sub("[A-Z]", lambda m: m[0].lower(), t)

    for block, hash_of in ((4096, F.xxhash64), (7, F.xxhash64), (7, lambda b: F.pmod(F.xxhash64(b), F.lit(3)))):
        docs = odd if block == 4096 else odd.where("length(text) < 100 OR text IS NULL")
        rows = texts(docs)
        keep, size = {}, Counter(norm(t) for _, t in rows)
        for i, t in rows:
            keep[norm(t)] = max(keep.get(norm(t), -1), -1 if i is None else i)
        found = exact_dedup.exact_groups(docs, block, hash_of).collect()
        same([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found], [(i, keep[norm(t)], size[norm(t)], hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows])
        assert sum(r.kept for r in found) == len(size) and all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup.exact_groups(none).count() == 0
    assert exact_dedup.drop_copies(odd).columns == odd.columns


def test_mix(odd, none, spark):
    found = mixing.mix(odd).collect()
    same([(r.doc_id, r["size"]) for r in found], [(i, len(WORD.findall(t))) for i, t in texts(odd)])
    assert all(r.taken <= 3 * r["size"] for r in found) and mixing.mix(none).count() == 0
    rows = [(k, "w " * (1 + k % 7), "abcd"[k % 4] if k % 3 else "a") for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    found = mixing.mix(docs).toPandas()
    sizes = found.groupby("source_size").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(sizes.taken - sizes.target) <= 4).all() and abs(sizes.target.sum() - found["size"].sum()) < 1e-6
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert found.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    heavy = mixing.mix(docs, (1, 1000), weight=F.when(F.col("doc_id") % 2 == 0, 50.0).otherwise(0.02)).toPandas()
    part = heavy[(heavy.taken > 0) & (heavy.target < heavy.source_size)]
    assert (part.doc_id % 2 == 0).mean() > 0.7


def test_token_counts(odd, none):
    tokenizer = Tokenizer.from_file(WORDS)
    wanted = [(i, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False))) for i, t in texts(odd)]
    for share in (0.5, 0.01, 1e-9):
        same([tuple(r) for r in token_counts.token_counts(odd, WORDS, share).select("doc_id", "n_bytes", "n_tokens").collect()], wanted)
    assert token_counts.token_counts(none, WORDS).count() == 0


def test_token_counts_tell_texts_of_one_doc_id_apart(spark):
    """Two texts whose hashes have their upper 31 bits in common."""
    pair = ["t4038 x x", "t151129 x"]
    assert len(set((common.hash_strings(pa.array(pair, pa.large_string())) >> np.uint64(33)).tolist())) == 1
    tokenizer = Tokenizer.from_file(WORDS)
    for doc_id in (1, None):
        docs = spark.createDataFrame([(doc_id, t) for t in pair], "doc_id long, text string")
        found = token_counts.token_counts(docs, WORDS).select("doc_id", "n_bytes", "n_tokens").collect()
        same([tuple(r) for r in found], [(doc_id, len(t), len(tokenizer.encode(t, add_special_tokens=False))) for t in pair])


def test_bpe(odd, none):
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {(i, t): plain.encode_ordinary(t) for i, t in texts(odd)}
    same([(r.doc_id, r.ids) for r in bpe.encode(odd, RANKS, public_tokenizers.PATTERN).collect()], [(i, wanted[i, t]) for i, t in texts(odd)])
    digest = lambda b: hashlib.sha256(b).hexdigest()
    found = [tuple(r) for r in bpe.round_trip(odd, RANKS, public_tokenizers.PATTERN).collect()]
    same(found, [(i, len(wanted[i, t]), digest(" ".join(map(str, wanted[i, t])).encode()), digest(t.encode())) for i, t in texts(odd)])
    back = bpe.decode(bpe.encode(odd, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    same([(r.doc_id, bytes(r.bytes)) for r in back.collect()], [(i, t.encode()) for i, t in texts(odd)])
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    text = "ab  c\n\nd \t e's 12"
    for size in range(1, len(text)):
        assert plain.encode_ordinary(text) == [x for part in bpe.chunks(text, size) for x in plain.encode_ordinary(part)]


def shingles(t, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
    return frozenset(zip(*[w[k:] for k in range(width)], strict=False)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def components(rows, width, percent=80):
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = [shingles(t, width) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    return [(i, len(sets[k]), least[root(k)]) for k, (i, _) in enumerate(rows)]


def test_near_groups_odd(odd, none):
    docs = odd.where("doc_id IS NOT NULL")
    found = near_dedup.near_groups(docs, width=2).collect()
    same([(r.doc_id, r.n_shingles, r.component_id) for r in found], components(texts(docs), 2))
    assert len([r for r in found if r.kept]) == len({r.component_id for r in found}) and near_dedup.near_groups(none, width=2).count() == 0
    assert {r.component_id for r in near_dedup.near_groups(odd, width=2).collect() if r.doc_id is None} == {3}


def test_near_groups_random(spark, tmp_path):
    draw = np.random.default_rng(3)
    words = [f"w{k}" for k in range(400)]
    bases = [[words[k] for k in draw.integers(0, 400, 60)] for _ in range(6)]
    rows = []
    for k in range(240):
        text = list(bases[0] if k % 2 else bases[k % 6])
        for at in draw.integers(0, 60, draw.integers(0, 9)):
            text[at] = words[draw.integers(0, 400)]
        rows.append((k, " ".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    found = near_dedup.near_groups(spark.read.parquet(str(tmp_path / "d")), width=2)
    same([(r.doc_id, r.n_shingles, r.component_id) for r in found.collect()], components(rows, 2))


def test_rows_stay_themselves_when_splits_change(spark, tmp_path, monkeypatch):
    """The files are packed into other partitions at each step, as after executors join or are lost."""
    draw, turn = np.random.default_rng(4), iter(range(10**6))
    rows = [(k, " ".join(f"w{x}" for x in draw.integers(0, 5000, 40)), f"s{k % 2}") for k in range(60)]
    rows += [(k + 60, t + " more", s) for k, t, s in rows[:20]] + [(k + 80, t.upper(), s) for k, t, s in rows[20:40]]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6).write.parquet(str(tmp_path / "d"))

    plain = common._settled

    def settled(df):
        out = plain(df)
        spark.conf.set("spark.sql.files.minPartitionNum", "1" if next(turn) % 2 else "50")
        return out

    monkeypatch.setattr(common, "_settled", settled)
    docs = spark.read.parquet(str(tmp_path / "d"))
    try:
        same([r.doc_id for r in near_dedup.drop_near_copies(docs).collect()], range(60))
        for table in (docs, docs.union(docs.where("false"))):
            same([r.doc_id for r in exact_dedup.drop_copies(table).collect()], [*range(20), *range(40, 80), *range(100, 120)])
            taken = {r.doc_id: r.taken // r["size"] for r in mixing.mix(table).collect()}
            assert Counter(r.doc_id for r in mixing.mixed(table).collect()) == Counter({i: n for i, n in taken.items() if n})
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")


def test_quality_rule_counts(odd):
    def counts(t):
        w, seen, dup = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            dup += bool(WORD.search(line)) and line in seen
            seen.add(line)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) for j in range(3) if windows[w[k], w[k + 1], w[k + 2]] > 1}
        return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)]

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    same([[r.doc_id, *[r[c] for c in names]] for r in quality_rules.statistics(odd).collect()], [[i, *counts(t)] for i, t in texts(odd)])
    code = np.array([0, 1, 2, 0, 1, 2, 3])
    for width in (4, 2**22):
        assert quality_rules.repeated_words(code, np.array([0, 7]), width).tolist() == [6]


def sample(spark, n=900):
    """Documents of random words with labels: a fifth toxic by one of two words, a fifth of low quality by its signs."""
    draw = np.random.default_rng(5)
    rows, labels = [], []
    for k in range(n):
        words = [f"{'abcdefgh'[draw.integers(8)]}{draw.integers(500)}x" for _ in range(80)]
        toxic, low = k % 5 == 0, k % 5 == 1
        if toxic:
            words[draw.integers(80)] = "Vile!" if k % 2 else "foul,"
        if low:
            words = [w + "%%%" for w in words]
        rows.append((k, " ".join(words)))
        labels.append((k, int(not low), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers_held_out(spark, odd, none):
    docs, labels = sample(spark)
    for name, run in (("toxic", toxicity.toxicity), ("quality", quality.quality)):
        found = run(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
        assert len(found) > 100 and (found.predicted == found[name]).mean() > 0.98
        assert found.held_out.tolist() == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]
        rest = run(odd, labels).collect()
        same([r.doc_id for r in rest], [i for i, _ in texts(odd)])
        assert all(0 <= r.score <= 1 for r in rest) and run(none, labels).count() == 0
        assert {r.score for r in run(odd, labels.where("false")).collect()} == {0.5}
    kept = toxicity.drop_toxic(docs.withColumn("score", F.lit("s")), labels)
    assert toxicity.drop_toxic(docs, labels.where("false")).count() == docs.count()
    assert kept.columns == ["doc_id", "text", "score"] and kept.join(labels.where("toxic = 1"), "doc_id").count() < 10


def test_held_out_labels_are_not_learned(spark):
    docs, labels = sample(spark, 300)
    turned = labels.withColumn("toxic", F.when(common.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [sorted(toxicity.toxicity(docs, x).select("doc_id", "score").collect()) for x in (labels, turned)]
    assert scores[0] == scores[1]


def test_ftrl_weights_are_sparse():
    settings = ftrl.Settings(bits=4, l1=1.0)
    z, n = np.zeros(17), np.zeros(17)
    ftrl.updates(((np.array([1, k % 16]), float(k % 2)) for k in range(200)), z, n, settings)
    w = ftrl.weights(z, n, settings)
    assert w[3] > 0 > w[2] and (w == 0).any()


def test_quality_rules(spark, odd, none):
    docs, labels = sample(spark)
    found = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").toPandas()
    assert found[found.quality == 1].kept.mean() > 0.99 and found[found.quality == 0].kept.mean() < 0.05
    rest = quality_rules.quality_rules(odd, labels).collect()
    assert len(rest) == odd.count() and all(r.base_failed for r in rest) and quality_rules.quality_rules(none, labels.where("false")).count() == 0


def test_secrets(spark, odd, none):
    token, copied = "Ab3dEf6hIj9kLm2nOp5q", "Zx9Yw8Vu7Ts6Rq5Pp4Oo"
    key, hexes = "AKIA" + "Q1W2E3R4T5Y6U7I8", "0123456789abcdef01234567"
    rows = [(k, f"note {copied}", f"s{k}") for k in range(5)]
    rows += [(10, f"é PASSWORD = '{token}x' and {key} then {hexes} end {token}", "s1"), (11, "token: abc secret=abcdef", "s2"), (10, "plain", "s1")]
    found = [r.asDict() for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).orderBy("doc_id", "spans").collect()]
    by = {(r["doc_id"], r["n_access"]): r for r in found}
    text = rows[5][1]
    at = lambda x, kind: f"{kind}:{text.index(x)}:{text.index(x) + len(x)}"
    base = [at(f"PASSWORD = '{token}x", "assign"), at(key, "access"), at(hexes, "hex")]
    last = text.rindex(token)
    assert by[10, 1]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
    assert by[10, 1]["spans"] == ",".join([*base, f"token:{last}:{last + 20}"])
    assert (by[11, 0]["n_assign"], by[11, 0]["spans"]) == (1, "assign:11:24")
    assert by[0, 0]["spans"] == "" and by[0, 0]["n_example"] == 1 and by[10, 0]["spans"] == ""
    same([r.doc_id for r in secrets.secrets(odd).collect()], [i for i, _ in texts(odd)])
    assert secrets.secrets(none).count() == 0


def test_secrets_copied_inside_one_source(spark):
    copied, live = "Zx9Yw8Vu7Ts6Rq5Pp4Oo", "Ab3dEf6hIj9kLm2nOp5q"
    rows = [(k, f"note {copied}", "s") for k in range(40)] + [(99, f"note {live}", "s")] * 20
    found = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.doc_id == 99, r.spans, r.n_live, r.n_example) for r in found} == {(False, "", 0, 1), (True, "token:5:25", 1, 0)}
    few = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"), most_repositories=40).collect()
    assert all((r.n_live, r.n_example) == (1, 0) for r in few)


def test_chat(spark):
    one, two, three = ("user", "hi"), ("assistant", None), ("user", "more <|im_end|>")
    talks = {1: [one], 2: [one, two], 3: [one, two, three], 4: [one, two, three], 5: [one, three], None: [two], 7: [("user", "h"), ("i", "")]}
    rows = [(c, t, r, x, 0) for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    table = spark.createDataFrame([*rows, rows[0]], "conv_id long, turn long, role string, text string, hash int")
    found = {r.conv_id: r for r in chat.collapse(table).collect()}
    assert {k: (r.n_turns, r.n_same) for k, r in found.items()} == {3: (3, 2), 5: (2, 1), None: (1, 1), 7: (2, 1)}
    assert found[3].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\nmore <| im_end|><|im_end|>\n"
    assert chat.collapse(table.where("false")).count() == 0


def test_chat_of_many_turns(spark):
    """A conversation of 20,000 turns and its snapshot without the last, each row twice; columns named as those inside."""
    turns = spark.range(20_000).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    turns = turns.where("conv_id = 1 OR turn < 19999").withColumns({c: F.lit(0) for c in ("place", "last", "seen", "h0", "first", "conv")})
    (found,) = chat.collapse(turns.union(turns)).collect()
    assert (found.conv_id, found.n_turns, found.n_same) == (1, 20_000, 1)
    assert found.rendered == "".join(f"<|im_start|>user\nt{k}<|im_end|>\n" for k in range(20_000))


def test_key_ranges_stay_small_at_any_weight(spark):
    rows = spark.range(300_000).select("id", F.pow(F.lit(10.0), -(F.col("id") % 4)).alias("weight"))
    keys = rows.select(mixing.exponential_key(F.col("id"), F.col("weight"), "s").alias("key"))
    ranges = keys.groupBy(mixing.key_range(F.col("key"), F.lit(300_000)).alias("range")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("range").collect()
    assert max(r.n for r in ranges) < 1.1 * mixing.RANGE_ROWS
    assert all(a.hi < b.lo for a, b in zip(ranges, ranges[1:], strict=False))


def test_threshold_against_a_plain_version():
    draw = np.random.default_rng(6)
    for n in (1, 3, 40, 900):
        score, good = draw.integers(0, 12, n) / 12, draw.random(n) < 0.7
        at = np.unique(score)
        counts = [np.array([(score[kind] == s).sum() for s in at]) for kind in (good, ~good)]
        found = quality_rules.threshold_of(at, *counts, 0.9)
        if not good.any():
            assert found == 1.0
            continue
        able = [s for s in at if (good & (score <= s)).sum() > np.ceil(0.9 * (good.sum() - 1))]
        wrong = {s: (good & (score > s)).sum() + (~good & (score <= s)).sum() for s in able}
        assert found == min(able, key=lambda s: (wrong[s], s))
    assert quality_rules.threshold_of(np.zeros(0), np.zeros(0), np.zeros(0)) == 1.0


def test_threshold_takes_all_labelled_rows(spark):
    """Rows of one doc_id many times over; the verdicts are the same however the rows lie."""
    docs, labels = sample(spark, 300)
    docs = docs.union(docs.where("doc_id < 3").withColumn("_", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("_"))
    verdicts = [sorted(map(tuple, quality_rules.quality_rules(docs.repartition(n), labels).select("doc_id", "kept").collect())) for n in (2, 5)]
    assert verdicts[0] == verdicts[1] and len(verdicts[0]) == 1800
    assert all(r.kept != r.base_failed for r in quality_rules.quality_rules(docs, labels.where("false")).collect())


def test_ftrl_against_a_plain_version():
    """Coordinate by coordinate, by the published rule."""
    settings, draw = ftrl.Settings(bits=4), np.random.default_rng(2)
    examples = [(np.unique(draw.integers(0, 17, 5)), float(draw.integers(2))) for _ in range(300)]
    z, n = np.zeros(17), np.zeros(17)
    ftrl.updates(iter(examples), z, n, settings)
    pz, pn = [0.0] * 17, [0.0] * 17

    def weight(i):
        if abs(pz[i]) <= settings.l1:
            return 0.0
        return -(pz[i] - (1 if pz[i] > 0 else -1) * settings.l1) / ((settings.beta + pn[i] ** 0.5) / settings.alpha + settings.l2)

    for at, y in examples:
        w = {i: weight(i) for i in at}
        g = 1 / (1 + 2.718281828459045 ** -sum(w.values())) - y
        for i in at:
            pz[i] += g - ((pn[i] + g * g) ** 0.5 - pn[i] ** 0.5) / settings.alpha * w[i]
            pn[i] += g * g
    assert np.allclose(z, pz) and np.allclose(n, pn) and np.allclose(ftrl.weights(z, n, settings), [weight(i) for i in range(17)])


def test_words_split_like_the_pattern():
    for t in ODD:
        found = common.Words(pa.array([t or ""], pa.large_string()))
        assert [found.distinct[int(c)].as_py() for c in found.code] == WORD.findall(t or "")
