"""Near duplicates by MinHash with tensored banding, every link verified on the full shingle sets.

Two small collections of minhash bands are computed for a document; its table keys are all pairs of a band of the one
and a band of the other. SIDE bands each of HALF minhashes give SIDE**2 tables of 2 * HALF minhashes from only
2 * SIDE * HALF hash functions. Two sets of similarity 0.8 miss each other with a chance of 2 * (1 - 0.8**HALF)**SIDE,
0.00001 here, and closer ones less.

Equal sets are collapsed first. What is wanted are the connected components, so a pair need not be verified once its
ends are connected: in a few rounds every document is compared with a member of its buckets that shares most of them.
The documents of the buckets that then still hold several components are reduced to what sets them apart from the
majority of their cluster. Similar ones are both close to the majority, or share a rare element of that difference: each
is compared with the one closest to the majority, then in a few rounds with the closest one of its elements' lists, and
what is then still apart is joined exactly. Sizes, places and sketches bound what two can share, which leaves few pairs
to verify, and those are verified on the differences. No bucket is expanded into its pairs, and none is cut. Tables that
a later one supersedes are deleted as it goes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, Words, bites, chain, free_name, numbered, spread_join, texts_of

#: Bands in each of the two collections, and minhashes in a band.
SIDE, HALF = 12, 2
#: Rounds of comparing with one member of a bucket, and of a list of deltas, before the exact join takes the rest.
ROUNDS = 2
#: Bits of the map that keeps texts from being moved in vain, at most 2**18 longs; with far more rows than bits it spares nothing.
FILTER_BITS = 2**24
#: Longs in the sketch of a delta.
SKETCH = 8


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text; fewer words than width are one shingle, no words none."""
    found = Words(pc.ascii_lower(texts))
    gram = found.hashes()
    for n in range(1, width):
        gram = chain(gram[:-1], found.hashes()[n:]) if len(gram) else gram
    out = []
    for k in range(found.rows):
        start, end = found.starts[k], found.starts[k + 1]
        if end - start >= width:
            out.append(np.unique(gram[start : end - width + 1]))
        else:
            whole = hashlib.blake2b(found.hashes()[start:end].tobytes(), digest_size=8).digest()
            out.append(np.frombuffer(whole, np.uint64) if end > start else np.zeros(0, np.uint64))
    return out


def _bands(sets: list[np.ndarray], side: int, half: int) -> np.ndarray:
    """2 * side band hashes of each set, none of which is empty."""
    draw = np.random.default_rng(8)
    flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = []
    for _ in range(2 * side):
        band = np.zeros(len(sets), np.uint64)
        for _ in range(half):
            factor, offset = draw.integers(0, 2**63, 2, np.uint64)
            band = chain(band, np.minimum.reduceat(flat * (factor * np.uint64(2) + np.uint64(1)) + offset, starts))
        out.append(band)
    return np.stack(out, 1).view(np.int64)


def signatures(docs: DataFrame, width: int, side: int, half: int) -> DataFrame:
    """(doc_id, row, n_shingles, digest of the set, bands a, bands b) of docs (doc_id, text, row); null bands for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in bites(texts_of(batch.column(1))):
                sets = shingle_sets(texts, width)
                full = [k for k, s in enumerate(sets) if len(s)]
                bands: list = [None] * len(sets)
                for k, band in zip(full, _bands([sets[k] for k in full], side, half) if full else [], strict=True):
                    bands[k] = band
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                halves = [pa.array([None if b is None else b[x] for b in bands], pa.list_(pa.int64())) for x in (slice(0, side), slice(side, None))]
                own = [batch.column(c).slice(start, len(sets)) for c in (0, 2)]
                yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), *halves], ["doc_id", "row", "n_shingles", "digest", "a", "b"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text", "row").mapInArrow(run, f"doc_id {kind}, row long, n_shingles long, digest binary, a array<long>, b array<long>")


def sets_of(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(row, shingles) of the given rows of docs (text, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in bites(texts_of(batch.column(1))):
                sets = [s.view(np.int64) for s in shingle_sets(texts, width)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pa.array(sets, pa.list_(pa.int64()))], ["row", "shingles"])

    # texts that no given row needs mostly stay where they are: a bit map of FILTER_BITS, whatever the rows, goes with the scan
    place = F.xxhash64("row").bitwiseAND(FILTER_BITS - 1)
    word, bit = F.shiftright(place, 6).alias("word"), place.bitwiseAND(63).cast("int")
    words = rows.groupBy(word).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    likely = docs.select("row", "text", word).join(F.broadcast(words), "word").where(F.bit_get("bits", bit) == 1)
    # an inner join, since a semi join would be pushed below the bit map; rows are distinct
    some = likely.select("row", "text").join(rows.select("row"), "row")
    return some.mapInArrow(run, "row long, shingles array<long>")


def _similar(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets of n and m elements that share so many have the similarity."""
    return shared * 100 >= (n + m - shared) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets have at least that similarity; many pairs may have the same x."""
    both = spread_join(pairs, sets.select(F.col("row").alias("x"), F.col("shingles").alias("sx")), ["x"])
    both = both.join(sets.select(F.col("row").alias("y"), F.col("shingles").alias("sy")), "y")
    shared = F.size(F.array_intersect("sx", "sy"))
    return both.where(_similar(shared, F.size("sx"), F.size("sy"), percent)).select("x", "y")


def _verified_deltas(pairs: DataFrame, deltas: DataFrame, percent: int) -> DataFrame:
    """As verified, for pairs within clusters: two sets differ by just what their deltas differ by, so those are enough."""
    of = lambda x: deltas.select(F.col("row").alias(x), F.col("delta").alias(f"d{x}"), F.col("n_shingles").alias(f"n{x}"))
    both = spread_join(pairs, of("x"), ["x"]).join(of("y"), "y")
    apart = F.size("dx") + F.size("dy") - 2 * F.size(F.array_intersect("dx", "dy"))
    return both.where(_similar((F.col("nx") + F.col("ny") - apart) / 2, F.col("nx"), F.col("ny"), percent)).select("x", "y")


def components(links: DataFrame, *like: DataFrame, steps: int | None = None) -> DataFrame:
    """(row, comp) of the rows in links (x, y), comp the smallest row that can be reached; with steps, one that is reached
    after so many of them. like: see Scratch.settle.

    Each step takes the least label among the neighbours and then the last label of that label, so paths shorten fast.
    """
    scratch = Scratch()
    edges = scratch.settle(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), *like)
    labels = edges.groupBy(F.col("x").alias("row")).agg(F.min("y").alias("comp")).select("row", F.least("row", "comp").alias("comp"), F.lit(-1).alias("was"))
    labels, k, done = scratch.settle(labels, edges), 1, steps == 1
    while not done:
        near = spread_join(edges, labels.select(F.col("row").alias("y"), "comp"), ["y"]).groupBy(F.col("x").alias("row")).agg(F.min("comp").alias("near"))
        step = labels.drop("was").join(near, "row").select("row", F.least("comp", "near").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("row").alias("comp"), F.col("comp").alias("next"))
        labels = scratch.settle(spread_join(step, jump, ["comp"]).select("row", F.least("comp", "next").alias("comp"), "was"), edges)
        k += 1
        done = k == steps or labels.where("comp <> was").isEmpty()
        scratch.keep(labels, *([] if done else [edges]))
    return labels.select("row", "comp")


def _merged(comps: DataFrame, links: DataFrame, steps: int | None = None) -> DataFrame:
    """comps (row, comp) after links (x, y): the components are joined among themselves, so few edges are left to follow."""
    label = lambda x: comps.select(F.col("row").alias(x), F.col("comp").alias(f"c{x}"))
    between = spread_join(spread_join(links, label("x"), ["x"]), label("y"), ["y"]).where("cx <> cy")
    joined = components(between.select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct(), comps, steps=steps)
    renamed = joined.select(F.col("row").alias("comp"), F.col("comp").alias("now"))
    return spread_join(comps, renamed, ["comp"], "left").select("row", F.coalesce("now", "comp").alias("comp"))


def _open(members: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, row, n_shingles, comp) of the buckets that hold more than one component."""
    known = members.select("key", "row", "n_shingles").join(comps, "row")
    several = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return known.join(several, "key", "left_semi")


def _close(percent: int) -> Column:
    """Whether the sizes n_shingles and m of two sets allow the similarity."""
    return F.least("n_shingles", "m") * 100 >= F.greatest("n_shingles", "m") * percent


def _round_pairs(rows: DataFrame, seed: int, percent: int) -> DataFrame:
    """(x, y): for each row y of the open buckets one member x of another component, the chosen member of most of y's buckets."""
    centre = F.min(F.struct(F.xxhash64("row", F.lit(seed)), F.col("row").alias("x"), F.col("comp").alias("other"), F.col("n_shingles").alias("m")))
    centres = rows.groupBy("key").agg(centre.alias("c")).select("key", "c.x", "c.other", "c.m")
    near = spread_join(rows, centres, ["key"]).where((F.col("comp") != F.col("other")) & _close(percent))
    return near.groupBy(F.col("row").alias("y"), "x").count().groupBy("y").agg(F.max_by("x", F.struct("count", "x")).alias("x"))


def _deltas(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """(row, cluster, n_shingles, delta) of rows (row, cluster, n_shingles): delta is what sets a row apart from the shingles
    that most rows of its cluster have, those it has besides and those it lacks. |x| + |y| - 2|x & y| is the same for deltas
    as for sets."""
    own = rows.join(sets, "row")
    grams = own.select("cluster", F.explode("shingles").alias("gram")).groupBy("cluster", "gram").count()
    sizes = rows.groupBy("cluster").agg(F.count("*").alias("size"))
    usual = grams.join(sizes, "cluster").where("2 * count > size").groupBy("cluster").agg(F.collect_list("gram").alias("usual"))
    usual = sizes.select("cluster").join(usual, "cluster", "left").withColumn("usual", F.coalesce("usual", F.array().cast("array<long>")))
    delta = F.concat(F.array_except("shingles", "usual"), F.array_except("usual", "shingles"))
    return spread_join(own, usual, ["cluster"]).select("row", "cluster", "n_shingles", delta.alias("delta"))


def _sketched(deltas: DataFrame) -> DataFrame:
    return deltas.select("*", *_sketch(F.col("delta")))


def _star_pairs(deltas: DataFrame, comps: DataFrame, percent: int) -> DataFrame:
    """(x, y): each row y with the row x of its cluster whose size allows most for its delta. Two similar rows whose deltas
    share nothing are both similar to x, so these pairs connect all such rows."""
    room = (F.size("delta") * (100 + percent) - F.col("n_shingles") * (100 - percent)).alias("need")
    rows = deltas.select("row", "cluster", room).join(comps, "row")
    best = rows.groupBy("cluster").agg(F.min(F.struct("need", "row", "comp")).alias("b")).select("cluster", F.col("b.row").alias("x"), F.col("b.need").alias("least"), F.col("b.comp").alias("other"))
    return spread_join(rows, best, ["cluster"]).where((F.col("comp") != F.col("other")) & (F.col("need") + F.col("least") <= 0)).select("x", F.col("row").alias("y"))


def _sketch(delta: Column) -> list[Column]:
    """SKETCH longs in which every element of the delta turns one bit over, chosen by the element. As many bits as differ
    between two sketches, so many elements at least differ between the deltas."""
    place = lambda g: F.shiftrightunsigned(F.xxhash64(g), 40)
    turned = lambda k: F.aggregate(delta, F.lit(0).cast("long"), lambda bits, g: F.when(place(g) % SKETCH == k, bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(place(g) / SKETCH).cast("int") % 64))).otherwise(bits))
    return [turned(k).alias(f"s{k}") for k in range(SKETCH)]


_OWN = ["n_shingles", "size", "place", *[f"s{k}" for k in range(SKETCH)]]


def _prefixes(deltas: DataFrame, percent: int) -> DataFrame:
    """(cluster, gram, row and _OWN): the elements of each delta, rarest of the cluster first, up to the place where sets
    of the similarity must have shared one; place counts those before. Elements that one row alone has are left out."""
    flat = deltas.select("row", "cluster", "n_shingles", F.size("delta").alias("size"), F.explode("delta").alias("gram"))
    ranked = spread_join(flat, flat.groupBy("cluster", "gram").count(), ["cluster", "gram"])
    place = F.row_number().over(Window.partitionBy("row").orderBy("count", "gram")) - 1
    ranked = ranked.withColumn("place", place).where((F.col("count") > 1) & (F.col("place") * percent <= F.col("n_shingles") * (100 - percent)))
    sketches = deltas.select("row", *[f"s{k}" for k in range(SKETCH)])
    return ranked.join(sketches, "row").select("cluster", "gram", "row", *_OWN)


def _lists(prefixes: DataFrame, comps: DataFrame) -> DataFrame:
    """prefixes with comp, of the lists (the rows of a cluster with an element) that hold more than one component."""
    known = prefixes.join(comps, "row")
    several = known.groupBy("cluster", "gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("cluster", "gram")
    return known.join(several, ["cluster", "gram"], "left_semi")


def _apart() -> Column:
    """How many elements the sets of a row and of its partner (named with m and o...) differ by at least: of two deltas with
    p and q elements before the first that they share, at most min(|d| - p, |e| - q) are shared; and by their sketches."""
    shared = F.least(F.col("size") - F.col("place"), F.col("o_size") - F.col("o_place"))
    turned = sum(F.bit_count(F.col(f"s{k}").bitwiseXOR(F.col(f"o_s{k}"))) for k in range(SKETCH))
    return F.greatest(F.col("size") + F.col("o_size") - 2 * shared, turned)


def _may_link(percent: int) -> Column:
    return (F.col("comp") != F.col("other")) & _close(percent) & (_apart() * (100 + percent) <= (F.col("n_shingles") + F.col("m")) * (100 - percent))


def _partner(row: str = "row") -> list[Column]:
    return [F.col(row).alias("x"), F.col("comp").alias("other"), F.col("n_shingles").alias("m"), *[F.col(c).alias(f"o_{c}") for c in _OWN[1:]]]


def _list_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """(x, y): for each row y one x of another component, the closest by their sketches among the rows of least delta of y's lists."""
    least = F.min_by(F.struct(*_partner()), F.struct(F.col("size") * (100 + percent) - F.col("n_shingles") * (100 - percent), F.col("row")))
    centres = lists.groupBy("cluster", "gram").agg(least.alias("c")).select("cluster", "gram", "c.*")
    near = spread_join(lists, centres, ["cluster", "gram"]).where(_may_link(percent))
    return near.groupBy(F.col("row").alias("y")).agg(F.min_by("x", F.struct(_apart() / (F.col("n_shingles") + F.col("m")), F.col("x"))).alias("x"))


def _off_main(lists: DataFrame) -> DataFrame:
    """(cluster, gram, _partner()): of each list the rows outside the component that has most of it."""
    main = lists.groupBy("cluster", "gram", "comp").count().groupBy("cluster", "gram").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"))
    return spread_join(lists, main, ["cluster", "gram"]).where("comp <> main").select("cluster", "gram", *_partner())


def _delta_pairs(lists: DataFrame, off_main: DataFrame, percent: int) -> DataFrame:
    """(x, y): all pairs of different components whose deltas share something and that can have the similarity. A list that
    one component fills is not paired within it."""
    pairs = lists.join(off_main, ["cluster", "gram"]).where(_may_link(percent))
    return pairs.select(F.greatest("x", "row").alias("x"), F.least("x", "row").alias("y")).distinct()


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80, side: int = SIDE, half: int = HALF, rounds: int = ROUNDS) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, n_shingles, component_id, kept, row.

    Documents are linked if the sets of their width-word shingles (A-Z lower-cased) have a similarity of percent / 100 or
    more. component_id is the smallest doc_id that links reach; kept marks its row, or one of them if rows repeat. Fewer
    words than width are one shingle; null, empty and blank texts have none, and are linked with nothing and kept. A null
    doc_id comes after all others. Other columns are ignored; an empty docs gives no rows. row is the column of numbered().
    """
    return _groups(numbered(docs.select("doc_id", "text"), "row"), width, percent, side, half, rounds)


def _groups(docs: DataFrame, width: int = 5, percent: int = 80, side: int = SIDE, half: int = HALF, rounds: int = ROUNDS) -> DataFrame:
    """near_groups of docs (doc_id, text, row), whose rows stay the same from scan to scan."""
    scratch = Scratch()
    rows = scratch.settle(signatures(docs, width, side, half))
    full = rows.where("n_shingles > 0")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = scratch.settle(full.groupBy("digest").agg(F.min("row").alias("row"), least.alias("first")))
    reps = rows.join(classes.select("row"), "row", "left_semi")
    keys = reps.select("row", "n_shingles", F.posexplode("a").alias("i", "u"), "b").select("row", "n_shingles", "i", "u", F.posexplode("b").alias("j", "v"))
    keys = keys.select(F.xxhash64("i", "j", "u", "v").alias("key"), "row")
    shared = scratch.settle(keys.groupBy("key").count().where("count > 1").select("key"))  # and what it shuffled goes
    members = scratch.settle(keys.join(shared, "key", "left_semi"))
    members = scratch.settle(members.join(reps.select("row", "n_shingles"), "row"), members)
    comps = scratch.settle(members.select("row", F.col("row").alias("comp")).distinct(), members)
    sets = scratch.settle(sets_of(docs, comps.select("row"), width))

    found: list[DataFrame] = []

    def linked(pairs: DataFrame, by: DataFrame, check: Callable[[DataFrame, DataFrame, int], DataFrame]) -> bool:
        """Takes the pairs that hold as links, and merges components by them as far as two steps go; by has what pairs are
        checked on. What stays apart though linked costs a needless check later; all links are followed in the end."""
        nonlocal comps
        more = scratch.settle(check(scratch.settle(pairs, by), by, percent), by)
        if more.isEmpty():
            return False
        found.append(more)
        comps = scratch.settle(_merged(comps, more, 2), comps)
        return True

    for k in range(rounds):
        members = scratch.settle(_open(members, comps), members)  # a bucket of one component stays one
        linked(_round_pairs(members, k, percent), sets, verified)
        scratch.keep(rows, classes, members, comps, sets, *found)

    members = scratch.settle(_open(members, comps), members)
    centre = members.groupBy("key").agg(F.min("comp").alias("y"))
    clusters = components(spread_join(members.select("key", F.col("comp").alias("x")).distinct(), centre, ["key"]).select("x", "y").distinct(), comps)
    left = scratch.settle(members.select("row", "n_shingles", "comp").distinct().join(clusters.select(F.col("row").alias("comp"), F.col("comp").alias("cluster")), "comp").drop("comp"), comps)
    deltas = scratch.settle(_sketched(scratch.settle(_deltas(left, sets), sets)), sets)
    scratch.keep(rows, classes, comps, deltas, *found)
    linked(_star_pairs(deltas, comps, percent), deltas, _verified_deltas)
    lists = scratch.settle(_prefixes(deltas, percent))
    for _ in range(rounds):
        lists = scratch.settle(_lists(lists.select("cluster", "gram", "row", *_OWN), comps), lists)
        if not linked(_list_pairs(lists, percent), deltas, _verified_deltas):
            break
        scratch.keep(rows, classes, comps, deltas, lists, *found)
    else:
        lists = scratch.settle(_lists(lists.select("cluster", "gram", "row", *_OWN), comps), lists)
    linked(_delta_pairs(lists, scratch.settle(_off_main(lists), lists), percent), deltas, _verified_deltas)
    if found:
        comps = scratch.settle(_merged(comps, reduce(DataFrame.unionByName, found)), comps)
    scratch.keep(rows, classes, comps)

    grouped = scratch.settle(classes.join(comps, "row", "left").withColumn("comp", F.coalesce("comp", "row")), classes)
    scratch.keep(rows, grouped)
    firsts = grouped.groupBy("comp").agg(F.min("first").alias("keep"))
    verdicts = spread_join(grouped.select("digest", "comp"), firsts, ["comp"]).select("digest", "keep")
    slim = full.select("doc_id", "row", "n_shingles", "digest")
    out = spread_join(slim, verdicts, ["digest"]).select("doc_id", "n_shingles", F.col("keep.doc_id").alias("component_id"), (F.col("row") == F.col("keep.row")).alias("kept"), "row")
    alone = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), "row")
    return out.unionByName(alone)


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs, with all their columns, that near_groups keeps."""
    row = free_name(docs, "_row")
    docs = numbered(docs, row)
    kept = _groups(docs.select("doc_id", "text", F.col(row).alias("row")), **settings).where("kept").select(F.col("row").alias(row))
    return docs.join(kept, row, "left_semi").drop(row)
