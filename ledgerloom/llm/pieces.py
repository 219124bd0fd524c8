"""SentencePiece encoding and decoding of merge-type (BPE) models, by backtracking.

A text is cut where no merge can reach: before a mark for blanks that follows another character, and around characters
that no piece holds, which go by their bytes. What lies between is encoded from left to right. At each place the longest
piece that an Aho-Corasick automaton finds there is tried, then its shorter prefixes. A piece stands if the pair with the
piece before it, merged anew by the model's own rule, comes out as these two; a place from which nothing goes on is marked
in a bit field, and the last piece is taken back. A prefix of a text has one encoding only, so that a marked place needs
no second visit.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from .common import texts_of

#: The mark that stands for a blank in pieces; a fixed value of the format.
BLANK = "▁"
#: Stands for the start of a run where the piece before is asked for.
START = -1
#: Entries that a worker keeps of pairs before it starts anew and of words before the older ones go, and the longest word kept.
KEPT_PAIRS, KEPT_WORDS, LONGEST_KEPT = 1 << 19, 1 << 17, 48


def merged(text: str, cost: dict[str, float]) -> list[str]:
    """The pieces of a short text by the model's rule: of all neighbours whose join is a piece, the cheapest merges first,
    of equal ones the leftmost."""
    parts, never = list(text), float("inf")
    joins = [cost.get(a + b, never) for a, b in zip(parts, parts[1:], strict=False)]
    while joins and (least := min(joins)) < never:
        i = joins.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del joins[i]
        if i:
            joins[i - 1] = cost.get(parts[i - 1] + parts[i], never)
        if i < len(joins):
            joins[i] = cost.get(parts[i] + parts[i + 1], never)
    return parts


class Codec:
    """Encodes by the pieces of the model at path, which must be of the BPE type with byte fallback and leave texts as
    they are but for blanks. Shared by the tasks of a worker."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        model, ids = self.library, range(self.library.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.cost = {model.id_to_piece(i): -model.get_score(i) for i in plain}
        self.known = {x for x in self.cost if len(x) == 1}
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in ids if model.is_byte(i)}
        if len(self.bytes) != 256 or any(model.is_unused(i) for i in ids) or not set("".join(self.cost)) <= self.known:
            raise ValueError("the model needs byte fallback, no unused pieces, and a piece for each character of its pieces")
        if model.normalize("  å ﬁ\n a  ") != "".join([BLANK * 3, "å", BLANK, "ﬁ\n", BLANK, "a", BLANK * 2]):
            raise ValueError("the model changes more of a text than its blanks")
        if any(re.search(f"[^{BLANK}]{BLANK}", x) for x in self.cost):
            raise ValueError("the model has pieces that go on after a blank")
        # a piece that merging its own characters doesn't make is never part of an encoding
        reached = {x: i for i in plain if merged(x := model.id_to_piece(i), self.cost) == [x]}
        self.reached, self.text = reached, {i: x for x, i in reached.items()}
        prefixes = lambda x: (reached[x[:k]] for k in range(len(x) - 1, 0, -1) if x[:k] in reached)
        self.size = [len(self.text.get(i, "")) for i in ids]
        self.shorter = [next(prefixes(self.text[i]), -1) if i in self.text else -1 for i in ids]
        self.automaton = ahocorasick.Automaton()
        for x, i in reached.items():
            if len(x) > 1:
                self.automaton.add_word(x, (len(x) - 1, i))
        self.automaton.make_automaton()
        others = re.escape("".join(sorted(self.known)))
        self.unknown = re.compile(f"[^{others}]")
        self.known_runs = re.compile(f"[{others}]+|[^{others}]")
        lines = "" if "\n" in self.known else "\n"
        self.words = re.compile(f"{BLANK}+[^{BLANK}{lines}]*|[^{BLANK}{lines}]+|\n")
        #: Which pieces fit after which, and the ids of words: those of late, and those of before that haven't come again.
        self.after: dict[int, dict[int, bool]] = defaultdict(dict)
        self.n_pairs = 0
        self.seen: dict[str, list[int]] = {}
        self.seen_before: dict[str, list[int]] = {}

    def fits(self, left: int, right: int) -> bool:
        """Whether two pieces that follow each other stay these two when their text is merged anew; any piece follows START."""
        if self.n_pairs >= KEPT_PAIRS:
            self.after, self.n_pairs = defaultdict(dict), 0
        found = left == START or merged(self.text[left] + self.text[right], self.cost) == [self.text[left], self.text[right]]
        self.after[left][right] = found
        self.n_pairs += 1
        return found

    def backtrack(self, run: str) -> list[int]:
        """The ids of a run of known characters."""
        if run in self.reached:
            return [self.reached[run]]
        size, shorter, n = self.size, self.shorter, len(run)
        longest = [self.reached[x] for x in run]
        longest.append(-1)
        for end, (before, piece) in self.automaton.iter(run):
            longest[end - before] = piece  # matches come by their ends, so that the last one to start here is the longest
        failed, done, at, piece, last = None, [], 0, longest[0], START
        after = self.after[last]
        while at < n:
            end = at + size[piece]
            fits = after.get(piece)
            if fits is None:
                fits = self.fits(last, piece)
            if fits and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                done.append(piece)
                at, last, after, piece = end, piece, self.after[piece], longest[end]
            elif (piece := shorter[piece]) < 0:
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                piece = done.pop()
                at, last = at - size[piece], done[-1] if done else START
                after = self.after[last]
        return done

    def word(self, text: str) -> list[int]:
        """The ids of a part of a text that no merge crosses the ends of; kept for when it comes again."""
        found = self.seen_before.get(text)
        if found is None:
            if self.unknown.search(text):
                parts = self.known_runs.findall(text)
                found = [*chain.from_iterable(self.backtrack(x) if x[0] in self.known else (self.bytes[b] for b in x.encode()) for x in parts)]
            else:
                found = self.backtrack(text)
        if len(text) <= LONGEST_KEPT:
            if len(self.seen) >= KEPT_WORDS:
                self.seen_before, self.seen = self.seen, {}
            self.seen[text] = found
        return found

    def encode(self, text: str) -> list[int]:
        """As the library encodes, without begin or end ids: a blank goes before the text unless it is empty."""
        if not text:
            return []
        word, ids = self.word, []
        for x in self.words.findall(BLANK + text.replace(" ", BLANK)):
            ids += self.seen.get(x) or word(x)
        return ids

    def decode(self, ids: list[int]) -> str:
        return self.library.decode(ids)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _kind(rows: DataFrame) -> str:
    return rows.select("doc_id").schema[0].dataType.simpleString()


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) for each row of docs (doc_id, text); ids array<int>. Null and empty texts have no ids; the names of
    control pieces in a text are ordinary text; rows that repeat stay rows; other columns are ignored; no rows give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            ids = [own.encode(text.as_py()) for text in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(docs)}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for each row of rows (doc_id, ids), as the library decodes; null ids are none and give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {_kind(rows)}, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes each row of docs (doc_id, text) in one pass: doc_id, n_tokens, ids_sha256 of the decimal ids
    joined by commas, decoded_sha256 of the decoded text. Cases as for encode; no ids give the digest of nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text in texts_of(batch.column(1)):
                ids = own.encode(text.as_py())
                rows.append((len(ids), digest(",".join(map(str, ids))), digest(own.decode(ids))))
            counts, ids_digests, digests = zip(*rows, strict=True) if rows else ((), (), ())
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {_kind(docs)}, n_tokens long, ids_sha256 string, decoded_sha256 string")
