"""Prefix tries, Merkle manifests and SentencePiece encoding on small tables: brute force, hard cases, the library."""

import hashlib
import random
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import common, merkle, pieces, prefix_trie

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def same(found, wanted):
    assert sorted(repr(tuple(x)) for x in found) == sorted(map(repr, wanted))


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- prefix tries


def nodes_of(rows, rule=True):
    convs = defaultdict(list)
    for r in rows:
        if r["conv_id"] is not None:
            role, text = r["role"] or "", r["text"] or ""
            convs[r["conv_id"]].append((r["turn"] is not None, r["turn"] or 0, sha(f"{len(role.encode())}:{role}{text}"), role, text))
    convs = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9 if rule else 0
        built[c] = tuple(convs.get(c - c % 5, [])[:h] + own[h:])
    members, kids = defaultdict(set), defaultdict(set)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    for path in [p for p in members if p]:
        kids[path[:-1]].add(path)
    leaves, saved, out = {}, {}, []
    for path in sorted(members, key=len, reverse=True):
        at = members[path]
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(at) - 1) * (len(path[-1][1].encode()) if path else 0)
        ends = ",".join(map(str, sorted(c for c in at if len(built[c]) == len(path))))
        out.append((min(at), len(path), min(members[path[:-1]]) if path else None, len(at), len(kids[path]), leaves[path], saved[path], sha(ends)))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, depth string, k0 string, child int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)


def test_trie_of_random_conversations(spark):
    draw = random.Random(3)
    rows = []
    for c in range(60):
        for t in range(draw.choice([1, 2, 3, 3, 5, 9, 12])):
            rows.append((c + 3, t, draw.choice(["user", "bot"]), draw.choice(["a", "é", ""])))
    rows += [(200, t, "user", "same") for t in range(30)] + [(c, t, "user", "same") for c in (205, 206) for t in range(30 - c % 5)]
    table = conversations(spark, rows)
    for rule in (prefix_trie.by_fives(), None):
        same(prefix_trie.trie(table, rule).collect(), nodes_of([r.asDict() for r in table.collect()], rule is not None))


def test_trie_hard_cases(spark, monkeypatch):
    # null turns, roles and texts, rows that repeat, no conv_id, turns that no base has, a long text, negative ids
    rows = [(7, None, "user", None), (7, 0, None, "b"), (7, 0, None, "b"), (7, 0, "user", "a"), (None, 0, "user", "lost"), (11, 1, "user", "x" * 200_000), (-4, 0, "user", "q"), (-8, 0, "user", "q"), (10, 0, "user", "a"), (12, 0, "user", "a")]
    rows += [(c, 0, "user", "copy") for c in range(1000, 1100)]
    table = conversations(spark, rows)
    wanted = nodes_of([r.asDict() for r in table.collect()], False)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 2)
    same(prefix_trie.trie(table).collect(), wanted)
    assert prefix_trie.trie(table.where("false"), prefix_trie.by_fives()).count() == 0
    assert prefix_trie.trie(table.where("conv_id IS NULL")).count() == 0


def test_trie_of_a_long_conversation_in_blocks(spark, monkeypatch):
    # one conversation holds most rows; another shares all but its last turns
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(1, t, "user", f"t{t}") for t in range(300)] + [(2, t, "user", f"t{t}") for t in range(3)] + [(3, 0, "user", "t0")]
    table = conversations(spark, rows)
    same(prefix_trie.trie(table).collect(), nodes_of([r.asDict() for r in table.collect()], False))


def test_trie_without_turns(spark):
    # conversation 1 ends within its first h turns and has no base, so nothing is left of it
    h = zlib.crc32(b"1") % 9
    assert h > 0
    found = prefix_trie.trie(conversations(spark, [(1, t, "user", "a") for t in range(h)]), prefix_trie.by_fives()).collect()
    same(found, [(1, 0, None, 1, 0, 1, 0, sha("1"))])


def test_placed_over_ranges(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.col("id").cast("string")).alias("g"), (F.col("id") * 7 % 10).alias("x"))
    found = common.placed(rows, ["g"], ["x"], "place", common.Scratch()).toPandas()
    assert len(found) == 5000
    for _, group in found.groupby("g", dropna=False):
        group = group.sort_values("place")
        assert group.place.tolist() == list(range(len(group))) and group.x.is_monotonic_increasing


# --- manifests


def written(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(r, text):
    return sha(*map(written, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def grown(leaves, fanout):
    """The root and, for each leaf, what stands before and after it at each level."""
    paths, level = [[] for _ in leaves], [(d, [k]) for k, d in enumerate(leaves)]
    while len(level) > 1:
        runs = [level[i : i + fanout] for i in range(0, len(level), fanout)]
        for run in runs:
            for j, (_, below) in enumerate(run):
                for k in below:
                    paths[k].append(("".join(x[0] for x in run[:j]), "".join(x[0] for x in run[j + 1 :])))
        level = [(sha(*[x[0] for x in run]), [k for x in run for k in x[1]]) for run in runs]
    return (level[0][0] if level else None), paths


def manifest_of(rows, changed, fanout=8):
    langs = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = []
    for lang in langs:
        own = sorted([(r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), k) for k, r in enumerate(rows) if r["lang"] == lang])
        groups.append((own, *grown([x[2] for x in own], fanout)))
    root, tops = grown([g[1] for g in groups], fanout)
    out = []
    for (own, subroot, paths), top in zip(groups, tops, strict=True):
        for (_, _, digest, k), path in zip(own, paths, strict=True):
            r, steps = rows[k], path + top
            lowered = None if r["text"] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            folded = leaf(r, lowered) if changed(r) else digest
            for before, after in steps:
                folded = sha(before, folded, after)
            out.append((r["doc_id"], digest, subroot, root, sha(*[b + a for b, a in steps]), folded, folded == root))
    return out


def third(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0


@pytest.mark.parametrize("fanout", [8, 2])
def test_manifest(spark, fanout):
    # a language of one leaf, runs of one, null and empty values, rows that repeat, a null doc_id, a long text, clashing names
    rows = [(k, f"Text {k} É", "en" if k % 3 else None, "s", k) for k in range(140)] + [(500, "", "", "s", 0), (501, None, "é", None, None), (None, "A", "zz", "s", 1), (7, "Text 7 É", "en", "s", 7), (7, "text 7", "en", "s", 7), (7, "text 7", "en", "s", 7), (502, "Long " * 50_000, "de", "s", 9)]
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, place int, node string, path string")
    found = merkle.manifest(docs, merkle.lower_third(F.col("doc_id")), F.translate("text", merkle.UPPER, merkle.LOWER), fanout).collect()
    same(found, manifest_of([r.asDict() for r in docs.collect()], third, fanout))
    assert {r.verified for r in found} == {True, False}
    assert all(r.verified for r in merkle.manifest(docs, fanout=fanout).collect())
    assert merkle.manifest(docs.where("false"), fanout=fanout).count() == 0
    one = merkle.manifest(docs.where("doc_id = 500"), fanout=fanout).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == sha("")


# --- pieces


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(MODEL)


def test_pieces_as_the_library(codec):
    draw = random.Random(1)
    known, texts = sorted(codec.known), sorted(codec.text.values())
    for k in range(4000):
        n = draw.randint(0, 30)
        text = [
            lambda: "".join(draw.choice("ab  \n▁<s>é中\x00") for _ in range(n)),
            lambda: "".join(draw.choice(known) for _ in range(n)),
            lambda: "".join(draw.choice(texts) for _ in range(n // 2)).replace("▁", " "),
            lambda: " " * draw.randint(0, 70) + draw.choice(["", "the", "\n", "<0x0A>"]) + " " * n,
            lambda: "".join(chr(draw.choice([draw.randint(1, 0x2FFF), draw.randint(0xE000, 0x1FFFF)])) for _ in range(n)),
        ][k % 5]()
        ids = codec.encode(text)
        assert ids == codec.library.encode(text), repr(text)
        assert codec.decode(ids) == text.replace("▁", " "), repr(text)


def test_pieces_of_long_runs_and_small_caches(codec, monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_PAIRS", 50)
    monkeypatch.setattr(pieces, "KEPT_WORDS", 50)
    small = pieces.Codec(MODEL)
    for text in ("x=-abc" * 20_000, "a" * 50_000, "日本語テキスト" * 3000, "one two three " * 9000, " " * 5000 + "x"):
        assert small.encode(text) == codec.library.encode(text)
    assert small.n_pairs <= 50 and len(small.seen) <= 50


def test_backtracking_takes_pieces_back(codec):
    # the longest pieces first don't always stand: the encoding differs from the greedy one somewhere
    greedy = lambda run: [x for _, (_, x) in codec.automaton.iter_long(run)]
    words = [x for x in ("▁unanswerable", "▁internationalen", "▁abcdefghij", "▁thematically", "▁xylophonist", "▁hereinbefore") if greedy(x) != codec.backtrack(x)]
    assert words and all(codec.backtrack(x) == codec.library.encode(x[1:]) for x in words)


def test_round_trip_rows(spark, codec):
    texts = ["", None, " ", "one", "One\n\ntwo", "İΣſ 日本 <s> </s> \x00", "word " * 20_000]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)] + [(3, "one", 1, "x"), (None, "one", 1, "x")], "doc_id long, text string, ids int, n_tokens string")
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    wanted = []
    for i, t in rows:
        ids = codec.library.encode(t)
        wanted.append((i, len(ids), sha(",".join(map(str, ids))), sha(codec.library.decode(ids))))
    same(pieces.round_trip(docs, MODEL).collect(), wanted)
    back = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    same(back.collect(), [(i, codec.library.decode(codec.library.encode(t))) for i, t in rows])
    assert pieces.round_trip(docs.where("false"), MODEL).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), MODEL).first().text == ""
