"""Benchmark decontamination: find runs of words that benchmark items hold, mark them, or cut them out.

The items' windows (10 consecutive words) are a hash set that every task gets; texts are scanned word by word against
it, and every hash hit is verified by comparing the words. The set is sent in slices of a fixed number of windows. A
benchmark of any size thus takes more passes over a text inside the same task, never a larger broadcast.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lower_ascii, pieces, with_cleaned_text, with_text_results
from quire.session import ship

WINDOW = 10
# Windows broadcast at a time: at some 100 bytes each this is about 100 MB in a worker.
SLICE_WINDOWS = 500_000

# Bytes of words: digits, letters and everything beyond ASCII, after A-Z are lowered. All others part words.
_BLANK = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8; a null has none."""
    return lower_ascii(text).translate(_BLANK).split() if text else []


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0  # no benchmark word, in no window


class Windows:
    """A hash set of word windows, with the items that hold each."""

    def __init__(self, rows: list[tuple[bytes, str | None]]):
        import xxhash

        self._ids = _Vocabulary()
        self.items: dict[bytes, list[str]] = {}
        for window, item in rows:
            held = self.items.setdefault(window, [])
            if item is not None:
                held.append(item)
        for window in self.items:
            for word in window.split():
                if word not in self._ids:
                    self._ids[word] = xxhash.xxh3_64_intdigest(word) | 1
        by_length: dict[int, list[bytes]] = {}
        for window in self.items:
            by_length.setdefault(window.count(b" ") + 1, []).append(window)
        self._hashes = {n: np.unique(np.array([self._hash(w) for w in found], np.uint64))
                        for n, found in by_length.items()}
        bits = max(16, (4 * len(self.items)).bit_length())
        self._shift = np.uint64(64 - bits)
        self._sieve = {n: np.zeros(1 << bits, bool) for n in self._hashes}
        for n, hashes in self._hashes.items():
            self._sieve[n][hashes >> self._shift] = True

    def _hash(self, window: bytes) -> int:
        value = 0
        for word in window.split():
            value = (value * int(_STEP) + self._ids[word]) & 0xFFFFFFFFFFFFFFFF
        return value

    def hits(self, words: list[bytes]) -> list[tuple[int, int, bytes]]:
        """Start, length and words of every window that occurs, verified."""
        ids = np.fromiter(map(self._ids.__getitem__, words), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        found, value = [], np.zeros(len(words), np.uint64)
        for n in range(1, max(self._hashes, default=0) + 1):
            if n > len(words):
                break
            value = value[:len(words) - n + 1] * _STEP + ids[n - 1:]
            if n not in self._hashes:
                continue
            maybe = np.flatnonzero((known[n:] - known[:-n] == n) & self._sieve[n][value >> self._shift])
            at = np.searchsorted(self._hashes[n], value[maybe])
            at[at == len(self._hashes[n])] = 0
            for start in maybe[self._hashes[n][at] == value[maybe]].tolist():
                window = b" ".join(words[start:start + n])
                if window in self.items:
                    found.append((start, n, window))
        return found


def benchmark_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text",
                      size: int = WINDOW) -> DataFrame:
    """window (words with single spaces), item: each once. An item of fewer words is one window; of none, no row."""
    ship(benchmark.sparkSession)
    rows = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = batch.column("item").to_pylist()
            for at, texts in pieces(batch.column("text")):
                windows, owners = [], []
                for item, content in zip(items[at:at + len(texts)], texts):
                    words = words_of(content)
                    found = {b" ".join(words[i:i + size]) for i in range(max(len(words) - size, 0) + 1)} - {b""}
                    windows.extend(found)
                    owners.extend([item] * len(found))
                yield pa.RecordBatch.from_arrays([pa.array(windows, pa.binary()), pa.array(owners, pa.string())],
                                                 names=["window", "item"])

    return rows.mapInArrow(cut, "window binary, item string").distinct()


def window_slices(windows: DataFrame, limit: int = SLICE_WINDOWS) -> list:
    """The windows as broadcast sets of about `limit` rows each, with a name for each."""
    spark = windows.sparkSession
    count = windows.count()
    parts = max(1, math.ceil(count / limit))
    slices = []
    for part in range(parts):
        mine = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(parts)) == part)
        rows = spark.sparkContext.broadcast([(bytes(r.window), r.item) for r in mine.toLocalIterator()])
        slices.append((uuid.uuid4().hex, rows))
    return slices


_SETS: dict[str, Windows] = {}  # what a worker has built; two slices at most


def _set(part: tuple) -> Windows:
    name, rows = part
    if name not in _SETS:
        if len(_SETS) > 1:
            _SETS.clear()
        _SETS[name] = Windows(rows.value)
    return _SETS[name]


def _hits(texts: list[list[bytes]], slices: list) -> tuple[list[list], list[set]]:
    """Hits and item ids of each list of words, slice by slice."""
    hits: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for part in slices:
        known = _set(part)
        for words, found, held in zip(texts, hits, items):
            for hit in known.hits(words):
                found.append(hit)
                held.update(known.items[hit[2]])
    return hits, items


def covered(length: int, hits: list[tuple[int, int, bytes]]) -> np.ndarray:
    """Which of `length` words lie inside a hit."""
    edges = np.zeros(length + 1, np.int64)
    for start, n, _ in hits:
        edges[start] += 1
        edges[start + n] -= 1
    return np.cumsum(edges[:-1]) > 0


def scan(df: DataFrame, slices: list, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, then n_words, n_hit, n_items, items_sha256, contaminated of every row's whole text.

    A null or wordless text has no words and no hits. Repeated rows get one result each; items are counted by id, so
    that rows of one id count once, and an item without id marks words but is no item. The digest is over the sorted
    ids, the empty string when there are none.
    """
    def start():
        def work(texts: list[str | None]) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            cut = [words_of(content) for content in texts]
            for words, hits, items in zip(cut, *_hits(cut, slices)):
                n_hit = int(covered(len(words), hits).sum())
                digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
                for column, value in zip(out, (len(words), n_hit, len(items), digest, n_hit > 0)):
                    column.append(value)
            return out

        return work

    return with_text_results(df, text, keep, "n_words long, n_hit long, n_items long, items_sha256 string, "
                                             "contaminated boolean", start)


def without(content: str, words: list[bytes], hits: list[tuple[int, int, bytes]]) -> str:
    """The text without the words inside hits and what stands between them."""
    marked = covered(len(words), hits)
    spans = [m.span() for m in _WORD.finditer(content)]
    kept, at = [], 0
    for i in np.flatnonzero(marked).tolist():
        if i == 0 or not marked[i - 1]:
            kept.append(content[at:spans[i][0]])
        at = spans[i][1]
    return "".join(kept) + content[at:]


def remove_spans(df: DataFrame, slices: list, text: str = "text", cleaned: str = "cleaned") -> DataFrame:
    """All columns, and the text without benchmark passages in `cleaned`; null texts stay null.

    A cut may join words to a new window, so it is repeated until none is left.
    """
    def start():
        def work(texts: list[str | None]) -> list[list]:
            out, open_ = list(texts), [i for i, t in enumerate(texts) if t]
            while open_:
                cut = [words_of(out[i]) for i in open_]
                found, _ = _hits(cut, slices)
                for i, words, hits in zip(open_, cut, found):
                    if hits:
                        out[i] = without(out[i], words, hits)
                open_ = [i for i, hits in zip(open_, found) if hits]
            return out

        return work

    return with_cleaned_text(df, text, cleaned, start)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document; an empty benchmark hits nothing."""
    return scan(docs, window_slices(benchmark_windows(benchmark)), ["doc_id"])
