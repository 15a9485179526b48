"""Best-fit packing by exact-complement hashing.

Texts are tokenised and cut into pieces of at most one sequence. How pieces combine is worked out on their length
histogram, which has one number a length however many pieces there are: every length first looks up the single, the
pair and the triple of lengths that fill the rest of its sequence exactly, and takes as many as are available; what is
left is packed best fit. The plan gives ranges of pieces (numbered within their length) their sequences, so every task
places its own pieces.
"""

from __future__ import annotations

import codecs
import functools
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.bpe import byte_alphabet
from quire.llm.common import give_back, lower_ascii, numbered, pieces, stored
from quire.session import ship, small_batches

CAPACITY = 4096
END_TOKEN = 1
PIECE_BYTES = 1 << 19  # bytes of text tokenised at once


_MARK = re.compile("[\u0300-\u036f]")
_PLAIN = re.compile(r"([a-zß-öø-ÿ]*)([!-/:-@\[-`{-~]*)")  # letters, then signs
_STOP = re.compile("[,.](?<=[a-z].)(?= |$)")  # the mark first, so that the search skips to marks


class WordTokenizer:
    """Token ids of whole texts, for byte-level vocabularies that lower texts, part letters from signs at white space and
    between them, and end words by `</w>`.

    Such a tokenizer gives a text the ids of its words one after another, so each distinct word is tokenised once; at
    most `most_words` are remembered at a time. Texts are parted at spaces, at line feeds and before a comma or full
    stop that ends a word. What other white space there is stays inside a word and is left to the tokenizer.
    """

    def __init__(self, path: str, most_words: int = 400_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._most = self._tokenizer.model, most_words
        self._shown = "".join(sorted(alphabet := byte_alphabet(), key=alphabet.get))  # the character of each byte
        self.forget()

    def forget(self) -> None:
        """Remember no word."""
        self._places: dict[str, int] = {}
        self._sizes, self._ids = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self._begins = np.zeros(0, np.int64)

    @staticmethod
    def parted(text: str) -> str:
        """The text's words with one space between each two; a space more is an empty word."""
        if text.isascii():
            text = text.lower()
        elif not _MARK.search(text):  # a mark could join a small letter, but not its capital
            text = lower_ascii(text).decode("utf-8", "surrogatepass")
        return _STOP.sub(r" \g<0>", text.replace("\n", " "))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        split = pa.compute.split_pattern(pa.array(map(self.parted, texts), pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = [self._look_up(words[at:at + self._most]) for at in range(0, len(words), self._most)]
        ids, sizes = (np.concatenate(x) for x in zip(*found))
        every, sizes = _gather(ids, np.cumsum(sizes) - sizes, sizes, coded.indices.to_numpy())
        ends = np.concatenate([[0], np.cumsum(sizes)])[split.offsets.to_numpy()]
        return [every[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def _look_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words one after another, and how many each has."""
        places = list(map(self._places.get, words))
        if None in places:
            missing = [i for i, p in enumerate(places) if p is None]
            if len(self._places) + len(missing) > self._most:
                self.forget()
                missing = range(len(words))
            first = len(self._places)
            self._learn([words[i] for i in missing])
            for place, i in enumerate(missing, first):
                places[i] = place
        return _gather(self._ids, self._begins, self._sizes, np.array(places, np.int64))

    def _learn(self, words: list[str]) -> None:
        made: list[int] = []
        ends = []
        for word in words:
            if word.isascii() and word.isalpha() and word.islower():
                made += [t.id for t in self._model.tokenize(word)]
            elif plain := _PLAIN.fullmatch(word):  # the tokenizer too has letters and signs apart, and no more than that
                for part in filter(None, plain.groups()):
                    if not part.isascii():
                        part = codecs.charmap_decode(part.encode(), "strict", self._shown)[0]
                    made += [t.id for t in self._model.tokenize(part)]
            else:
                made += self._tokenizer.encode(word, add_special_tokens=False).ids
            ends.append(len(made))
        first = len(self._places)
        self._places.update(zip(words, range(first, first + len(words))))
        sizes = np.diff(np.array(ends, np.int64), prepend=0)
        self._sizes = np.concatenate([self._sizes, sizes])
        self._begins = np.concatenate([self._begins, len(self._ids) + np.cumsum(sizes) - sizes])
        self._ids = np.concatenate([self._ids, np.array(made, np.uint32)])


def _gather(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of ids one after another, the ones at these places, and their sizes."""
    sizes = sizes[at]
    ends = np.cumsum(sizes)
    return ids[np.repeat(begins[at] - ends + sizes, sizes) + np.arange(sizes.sum())], sizes


@functools.lru_cache(maxsize=1)
def _tokenizer(path: str) -> WordTokenizer:
    """One a Python worker, which keeps the words of its earlier tasks. Spark has a worker a core, so it needs no threads."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return WordTokenizer(path)


def cut(docs: DataFrame, keep: list[str], path: str, text: str = "text", capacity: int = CAPACITY,
        end_token: int = END_TOKEN) -> DataFrame:
    """Columns `keep`, piece, start, length, ids_crc32: each text's ids and the end token, in pieces of `capacity` ids.

    A null is empty text, whose only id is the end token. Repeated rows are cut each.
    """
    ship(docs.sparkSession)
    small_batches(docs.sparkSession)
    source = docs.select(*keep, F.col(text).cast("string").alias("__text__"))
    added = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
                         T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    out = T.StructType([*source.select(*keep).schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        for batch in batches:
            kept = batch.select(keep)
            for at, texts in pieces(batch.column("__text__"), PIECE_BYTES):
                rows: list[tuple] = []
                owner = []
                for i, made in enumerate(tokenizer.encode([t or "" for t in texts])):
                    ids = np.append(made, np.uint32(end_token)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start:start + capacity]
                        rows.append((piece, start, len(part), zlib.crc32(part.tobytes())))
                        owner.append(at + i)
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
                same = kept.take(pa.array(owner, pa.int64())).columns
                yield pa.RecordBatch.from_arrays([*same, *columns], names=out.names)
            give_back()

    return source.mapInArrow(run, out)


# A pattern: how often it occurs, and the lengths (with how many of each) that one sequence of it holds, in order.
Pattern = tuple[int, list[tuple[int, int]]]


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns that use up the histogram. Work and memory depend on the capacity, not on the number of pieces."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    patterns: list[Pattern] = []

    have = (left > 0).astype(np.float64)
    sums = np.convolve(have, have) > 0.5  # which sums two lengths may have; one that has failed fails for good

    def pair(total: int) -> list[int] | None:
        found = _pair(left, total) if sums[total] else None
        sums[total] = found is not None
        return found

    def complement(gap: int) -> list[int] | None:
        """One, two or three available lengths that add up to `gap`, with the largest first length possible."""
        if left[gap]:
            return [gap]
        if (two := pair(gap)) is not None:
            return two
        for first in np.flatnonzero((left[:gap] > 0) & sums[gap:0:-1])[::-1].tolist():
            left[first] -= 1
            two = _pair(left, gap - first)
            left[first] += 1
            if two is not None:
                return [first, *two]
            pair(gap - first)
        return None

    for length in range(capacity, 0, -1):
        while left[length]:
            if length == capacity:
                lengths = [length]
            else:
                left[length] -= 1
                rest = complement(capacity - length)
                left[length] += 1
                if rest is None:
                    break
                lengths = [length, *rest]
            uses = Counter(lengths)
            times = int(min(left[n] // k for n, k in uses.items()))
            for n, k in uses.items():
                left[n] -= times * k
            patterns.append((times, sorted(uses.items(), reverse=True)))
    return patterns + _best_fit(left, capacity)


def _pair(left: np.ndarray, total: int) -> list[int] | None:
    """Two available lengths with this sum, the larger one as large as possible."""
    low = (total + 1) // 2
    both = np.flatnonzero((left[low:total] > 0) & (left[total - low:0:-1] > 0))[::-1] if total > 1 else []
    for at in both:
        larger = low + int(at)
        if larger * 2 != total or left[larger] > 1:
            return [larger, total - larger]
    return None


def _best_fit(left: np.ndarray, capacity: int) -> list[Pattern]:
    """Longest first, each into the open sequences with the least room that is enough; alike sequences move together."""
    open_: dict[int, list[list]] = {}  # room: [count, lengths]
    rooms = np.zeros(capacity + 1, bool)

    def add(room: int, group: list) -> None:
        open_.setdefault(room, []).append(group)
        rooms[room] = True

    for length in np.flatnonzero(left)[::-1].tolist():
        count = int(left[length])
        while count:
            fits = np.flatnonzero(rooms[length:])
            if not len(fits):
                each = capacity // length
                whole, rest = divmod(count, each)
                if whole:
                    add(capacity - each * length, [whole, [(length, each)]])
                if rest:
                    add(capacity - rest * length, [1, [(length, rest)]])
                break
            room = length + int(fits[0])
            group = open_[room].pop()
            rooms[room] = bool(open_[room])
            times, held = group
            each = min(room // length, -(-count // times))
            if each * times > count:
                times = count // each
                add(room, [group[0] - times, held])
            count -= each * times
            add(room - each * length, [times, [*held, (length, each)]])
    return [(times, held) for groups in open_.values() for times, held in groups]


def places(patterns: list[Pattern]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, ranges of piece numbers: first number, first sequence, pieces a sequence, offset in it."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = 0
    for times, held in patterns:
        offset = 0
        for length, each in held:
            found.setdefault(length, []).append((used[length], sequence, each, offset))
            used[length] += times * each
            offset += length * each
        sequence += times
    return {length: tuple(np.array(c, np.int64) for c in zip(*rows)) for length, rows in found.items()}


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces. Only the histogram, at most `capacity` numbers, reaches the driver."""
    # Stored first: a task that cuts and numbers needs two Python workers at once, and both kinds come to hold a tokenizer.
    ranked = numbered(stored(cuts, "cuts"), ["length"], "pieces", rank="__rank__")
    histogram = {r["length"]: r["n"] for r in ranked.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    shared = cuts.sparkSession.sparkContext.broadcast(places(plan(histogram, capacity)))  # a few rows a length
    out = T.StructType([*cuts.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    names = cuts.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "__rank__"))
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                first, begin, each, at = shared.value[length]
                row = np.searchsorted(first, ranks[mine], side="right") - 1
                done = ranks[mine] - first[row]
                sequence[mine] = begin[row] + done // each[row]
                offset[mine] = at[row] + done % each[row] * length
            same = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*same, pa.array(sequence), pa.array(offset)], names=out.names)

    return ranked.mapInArrow(place, out)


def pack_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    `path` names the tokenizer's file, which every executor must be able to read.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return pack(cut(docs.select("doc_id", "text"), ["doc_id"], path))
