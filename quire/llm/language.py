"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound by multiplying its letters' vectors, each rotated by
its place; a text is the sum (bundle) of its trigrams; a language is the sum of its texts' unit vectors. A text gets the
language whose prototype has the largest cosine with it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc32_text, give_back, pieces, with_text_results
from quire.session import ship, small_batches

UNKNOWN = "und"
# Unit vectors are summed as whole numbers of this fraction, so that a sum does not depend on the order of its rows.
FINE = 1_000_000
PIECE_BYTES = 1 << 20  # bytes of text bundled at once


class Profiles:
    """Texts to bundled trigram vectors. `dims` and `seed` fix the space; letters get their vectors when first met."""

    def __init__(self, dims: int = 512, seed: int = 20, slice_chars: int = 1 << 20):
        self.dims, self.seed, self.slice_chars = dims, seed, slice_chars
        self._symbol = np.full(0x110000, -1, np.int32)  # code point to symbol; 0 is the gap between words
        self._letters = [np.ones(dims, np.int8)]

    def _learn(self, points: np.ndarray) -> None:
        for point in np.unique(points).tolist():
            if chr(point).isalpha():
                random = np.random.Generator(np.random.Philox(key=[self.seed, point]))
                self._symbol[point] = len(self._letters)
                self._letters.append((random.integers(0, 2, self.dims) * 2 - 1).astype(np.int8))
            else:
                self._symbol[point] = 0

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """One vector a text, and whether it holds a letter. Letter case and runs of other characters do not count."""
        sums = np.zeros((len(texts), self.dims))
        letters = np.zeros(len(texts), bool)
        lowered = [(t or "").lower() for t in texts]
        points = np.frombuffer((" " + " ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lowered])
        text = np.concatenate([[0], text]).astype(np.int32)  # a gap belongs to the text before it
        if (new := self._symbol[points] < 0).any():
            self._learn(points[new])
        symbols = self._symbol[points]
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
        symbols, text = symbols[keep], text[keep]
        letters[text[symbols != 0]] = True
        for at in range(0, max(len(symbols) - 2, 0), self.slice_chars):
            self._add(sums, symbols[at:at + self.slice_chars + 2], text[at:at + self.slice_chars + 2])
        return sums, letters

    def _add(self, sums: np.ndarray, symbols: np.ndarray, text: np.ndarray) -> None:
        present = np.flatnonzero(np.bincount(symbols, minlength=1))
        dense = np.zeros(present[-1] + 1, np.int64)
        dense[present] = np.arange(len(present))
        s, n = dense[symbols], len(present)
        owner = text[1:-1]
        mine = (symbols[1:-1] != 0) | (text[2:] == text[:-2])  # not a last and a first letter of two texts
        code = ((s[:-2] * n + s[1:-1]) * n + s[2:])[mine]
        owner = owner[mine]
        if not len(code):
            return
        if n ** 3 <= 1 << 22:
            used = np.flatnonzero(np.bincount(code, minlength=n ** 3))
            place = np.zeros(n ** 3, np.int64)
            place[used] = np.arange(len(used))
            column = place[code]
        else:
            used, column = np.unique(code, return_inverse=True)
        table = np.array([self._letters[p] for p in present], np.float32)
        first, second = np.roll(table, 2, axis=1), np.roll(table, 1, axis=1)
        low, high = int(owner[0]), int(owner[-1]) + 1
        for begin in range(0, len(used), 8192):
            part = used[begin:begin + 8192]
            bound = first[part // (n * n)] * second[part // n % n] * table[part % n]
            inside = (column >= begin) & (column < begin + 8192) if len(used) > 8192 else slice(None)
            cell = (owner[inside] - low).astype(np.int64) * len(part) + column[inside] - begin
            counts = np.bincount(cell, minlength=(high - low) * len(part)).reshape(high - low, len(part))
            sums[low:high] += counts.astype(np.float32) @ bound


def unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, length, out=np.zeros_like(vectors), where=length > 0)


@dataclass
class Prototypes:
    languages: list[str]
    vectors: np.ndarray  # one unit row a language
    dims: int
    seed: int

    def predict(self, profiles: Profiles, texts: list[str | None]) -> tuple[list[str], list[float]]:
        vectors, letters = profiles.bundle(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        cosine = np.round(unit(vectors) @ self.vectors.T, 6)
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(texts)), best], 0.0, 1.0)
        return ([self.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)],
                [float(s) if ok else 0.0 for s, ok in zip(score, letters)])


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", dims: int = 512, seed: int = 20,
          max_languages: int = 4096) -> Prototypes:
    """Prototypes from every labelled row: sums per task and language, then one sum a language and dimension.

    Rows without text, letters or language teach nothing. Only languages x dims numbers reach the driver; more than
    `max_languages` labels are refused, as they are no set of languages.
    """
    ship(labelled.sparkSession)
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dims, seed), {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, texts in pieces(batch.column("text"), PIECE_BYTES):
                vectors, letters = profiles.bundle(texts)
                whole = np.rint(unit(vectors) * FINE).astype(np.int64)
                names, which = np.unique(np.array(langs[at:at + len(texts)], object), return_inverse=True)
                for i, name in enumerate(names):
                    if (mine := (which == i) & letters).any():
                        sums[name] = sums.get(name, 0) + whole[mine].sum(axis=0)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "sums": pa.array(
            [v.tolist() for v in sums.values()], pa.list_(pa.int64()))})
        give_back()

    parts = rows.mapInArrow(add_up, "lang string, sums array<bigint>")
    totals = (parts.select("lang", F.posexplode("sums").alias("dim", "value"))
              .groupBy("lang", "dim").agg(F.sum("value").alias("value")))
    found = totals.limit(max_languages * dims + 1).collect()
    if len(found) > max_languages * dims:
        raise ValueError(f"more than {max_languages} different labels")
    languages = sorted({r.lang for r in found})
    vectors = np.zeros((len(languages), dims))
    for r in found:
        vectors[languages.index(r.lang), r.dim] = r.value
    return Prototypes(languages, unit(vectors), dims, seed)


def identify(df: DataFrame, prototypes: Prototypes, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep`, lang_pred and score (cosine with the best prototype, 0 to 1) of every row.

    Texts without a letter, null and empty ones included, are `und` with score 0, and so is every text when nothing was
    learned. Ties go to the language first in the alphabet. Repeated rows get one result each.
    """
    def start():
        profiles = Profiles(prototypes.dims, prototypes.seed)

        def work(texts: list[str | None]) -> list[list]:
            return list(prototypes.predict(profiles, texts))

        return work

    return with_text_results(df, text, keep, "lang_pred string, score double", start, PIECE_BYTES)


def held_out(doc_id: Column) -> Column:
    """Rows that teach nothing: crc32 of the id as text leaves 2 when divided by 4."""
    return crc32_text(doc_id) % 4 == 2


def identify_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the rows that are not held out."""
    prototypes = learn(docs.where(~held_out(F.col("doc_id"))))
    return (identify(docs.select("doc_id", "text"), prototypes, ["doc_id"])
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))
