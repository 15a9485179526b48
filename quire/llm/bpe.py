"""Byte-pair encoding by speculation and verification, and decoding.

A word is first cut greedily into its longest tokens. That cut is what byte-pair merging gives if and only if merging
never joins across one of its seams, which depends on the two tokens beside a seam alone: so all adjacent pairs of many
words are checked at once, and only words with a failing pair are merged step by step.

Vocabularies are those whose merges stand in order of their tokens' ids, whose words end in `</w>` and whose symbols are
bytes; texts are brought to composed form and small letters, and white space only parts words.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re

import numpy as np
from pyspark.sql import DataFrame

from quire.llm.common import with_text_results

END = "Ā"  # the end of a word, in strings that hold one character (to U+00FF) a byte
NONE = 1 << 40  # beyond every rank

# White space, letters and digits of U+0000 to U+00FF, as the tokenizer's own patterns part words.
_LATIN_WORD = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼-¾]"
                         "|[^\\t\\n\\x0b\\x0c\\r \u0085 a-zªµºß-öø-ÿ0-9²³¹¼-¾]+")


class Merges:
    """Tokens as merges: each one's two parts, and which pairs of tokens may stand side by side."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], bytes_of: dict[str, int]):
        self.first = len(vocabulary) - len(merges)  # ids below are symbols
        self.size = len(vocabulary)
        self.left, self.right = (np.array([vocabulary[m[side]] for m in merges], np.int64) for side in (0, 1))
        made = np.array([vocabulary[a + b] for a, b in merges], np.int64)
        if not np.array_equal(made, np.arange(self.first, self.size)):
            raise ValueError("tokens must be numbered in the order of their merges")
        self.left, self.right = (np.concatenate([np.full(self.first, -1), x]) for x in (self.left, self.right))
        codes = self.left * self.size + self.right
        order = np.argsort(codes[self.first:])
        self._codes, self._made = codes[self.first:][order], order + self.first
        self.made = dict(zip(codes[self.first:].tolist(), range(self.first, self.size)))
        self.strings = [""] * self.size
        for token, i in vocabulary.items():
            body, end = (token[:-4], END) if token.endswith("</w>") and len(token) > 4 else (token, "")
            self.strings[i] = "".join(chr(bytes_of[c]) for c in body) + end
        self.ends = np.array([s.endswith(END) for s in self.strings])
        self.symbols = {s: i for i, s in enumerate(self.strings[:self.first])}
        self._keys, self._fits = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def joined(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """The token that each pair merges into, NONE where it does not."""
        code = u * self.size + v
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._made[at], NONE)

    def _seam(self, u: np.ndarray, v: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Whether merging leaves the seam between two tokens alone, as far as merges before `below` go.

        Merges apply in order of rank. Back from the end, the later made one of the two tokens at the seam is taken
        apart; each pair that stood at the seam is looked at. A pair merges if its merge comes before the one that used
        up the left token, and not after the one that used up the right one (of equal merges the left one comes first).
        """
        u, v = u.copy(), v.copy()
        fine = np.ones(len(u), bool)
        over_u, over_v = np.full(len(u), NONE), np.full(len(u), NONE)
        live = np.arange(len(u))
        while len(live):
            a, b = u[live], v[live]
            merged = self.joined(a, b)
            cross = (merged < over_u[live]) & (merged <= over_v[live]) & (merged < below[live])
            fine[live[cross]] = False
            apart_u = (a > b) & (a >= self.first)
            apart_v = ~apart_u & (b >= self.first)
            one, two = live[apart_u], live[apart_v]
            over_u[one], u[one] = u[one], self.right[u[one]]
            over_v[two], v[two] = v[two], self.left[v[two]]
            live = live[(apart_u | apart_v) & ~cross]
        return fine

    def whole(self) -> np.ndarray:
        """Tokens whose own string merges into that one token."""
        tokens = np.arange(self.first, self.size)
        good = [True] * self.first + self._seam(self.left[tokens], self.right[tokens], tokens).tolist()
        left, right = self.left.tolist(), self.right.tolist()
        for i in range(self.first, self.size):
            good[i] = good[i] and good[left[i]] and good[right[i]]
        return np.array(good)

    def compatible(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Whether each pair of whole tokens may stand side by side. Pairs met before are remembered, 2^20 at most."""
        code = u.astype(np.int64) * self.size + v
        slot = (code * 0x9E3779B1 >> 11) & (len(self._keys) - 1)
        found = self._fits[slot]
        new = np.flatnonzero(self._keys[slot] != code)
        if len(new):
            found[new] = self._seam(u[new].astype(np.int64), v[new].astype(np.int64), np.full(len(new), NONE))
            self._fits[slot[new]] = found[new]  # of two codes in one slot, both arrays keep the same last one
            self._keys[slot[new]] = code[new]
        return found

    def exact(self, word: str) -> list[int]:
        """Merging step by step: the lowest rank first, of equal ones the leftmost."""
        symbols = self.symbols
        ids = [symbols[c] for c in word[:-1]]
        ids[-1] = symbols[word[-2:]]
        n, size, made, push, pop = len(ids), self.size, self.made, heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i) for i in range(n - 1) if (m := made.get(ids[i] * size + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            token, i = pop(heap)
            j = after[i]
            if ids[i] < 0 or j == n or made.get(ids[i] * size + ids[j]) != token:
                continue
            ids[i], ids[j] = token, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (m := made.get(token * size + ids[k])) is not None:
                    push(heap, (m, i))
            if (h := before[i]) >= 0 and (m := made.get(ids[h] * size + token)) is not None:
                push(heap, (m, h))
        return [t for t in ids if t >= 0]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class Encoder:
    """Ids of whole texts, and texts of ids. At most `most_words` words (of `most_chars` in all) are remembered."""

    def __init__(self, path: str, most_words: int = 400_000, most_chars: int = 16 << 20):
        import ahocorasick
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)  # its normaliser and word pattern, for texts beyond U+00FF; never its model
        self._normal, self._words = library.normalizer, library.pre_tokenizer
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        self._alphabet = byte_alphabet()
        model = parts["model"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges = Merges(model["vocab"], pairs, self._alphabet)
        self._special = {t["content"]: t["id"] for t in parts["added_tokens"]}
        self._part = re.compile("(" + "|".join(map(re.escape, self._special)) + ")") if self._special else None
        self._shown = [t.encode() for t, _ in sorted(model["vocab"].items(), key=lambda x: x[1])]
        self._shown += [b""] * (max([len(self._shown) - 1, *self._special.values()]) + 1 - len(self._shown))
        for token, i in self._special.items():
            self._shown[i] = token.encode()
        self._longest = ahocorasick.Automaton()
        for i in np.flatnonzero(self.merges.whole()).tolist():
            self._longest.add_word(self.merges.strings[i], i)
        self._longest.add_word(END, self.merges.size)  # left over where only a token without an end fits the rest
        self._longest.make_automaton()
        self._most, self._most_chars = most_words, most_chars
        self._forget()

    def _forget(self) -> None:
        self._places: dict[str, int] = {}
        self._chars = 0
        self._ids, self._sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        self._add(list(self._special), np.array(list(self._special.values()), np.uint32), np.ones(len(self._special), np.int64))

    def words(self, text: str) -> list[str]:
        """Words in order; special tokens are words of their own."""
        if self._part is None or "<|" not in text:
            return self._plain(text)
        return [w for i, part in enumerate(self._part.split(text)) for w in ([part] if i % 2 else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or max(text) <= "ÿ":
            return _LATIN_WORD.findall(text.lower())
        found = []
        for piece in text.replace("\n", " ").split(" "):
            if piece.isascii() or max(piece) <= "ÿ":  # no mark here that could join a letter of a neighbour
                found += _LATIN_WORD.findall(piece.lower())
            else:
                for word, _ in self._words.pre_tokenize_str(self._normal.normalize_str(piece)):
                    found.append(bytes(map(self._alphabet.__getitem__, word)).decode())
        return found

    def propose(self, words: list[str]) -> np.ndarray:
        """The words' longest tokens from left to right, one word after another.

        A word whose last token does not hold its end gets the number beyond all tokens for the end alone.
        """
        line = END.join([w.encode().decode("latin-1") for w in words]) + END
        return np.array([i for _, i in self._longest.iter_long(line)], np.int64)

    def _learn(self, words: list[str]) -> None:
        ids = self.propose(words)
        bare = ids == self.merges.size
        ends = bare | self.merges.ends[np.where(bare, 0, ids)]
        word = np.cumsum(ends) - ends
        inner = np.flatnonzero(~ends[:-1] & ~bare[1:])
        unfit = inner[~self.merges.compatible(ids[inner], ids[inner + 1])]
        failing = np.unique(np.concatenate([word[bare], word[unfit]]))
        sizes = np.bincount(word, minlength=len(words))
        if len(failing):
            exact = [self.merges.exact(words[i].encode().decode("latin-1") + END) for i in failing.tolist()]
            good = np.ones(len(words), bool)
            good[failing] = False
            ids, sizes = ids[good[word]], sizes[good]
            words = [w for w, g in zip(words, good.tolist()) if g] + [words[i] for i in failing.tolist()]
            ids = np.concatenate([ids, np.array([i for e in exact for i in e], np.int64)])
            sizes = np.concatenate([sizes, np.array(list(map(len, exact)), np.int64)])
        self._add(words, ids.astype(np.uint32), sizes)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        self._places.update(zip(words, range(len(self._places), len(self._places) + len(words))))
        self._chars += sum(map(len, words))
        self._ids.append(ids)
        self._sizes.append(sizes)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [self.words(t) for t in texts]
        flat = [w for words in split for w in words]
        asked = set(flat)
        new = asked.difference(self._places)
        if len(self._places) + len(new) > self._most or self._chars > self._most_chars:
            self._forget()
            new = asked.difference(self._places)
        if new:
            self._learn(list(new))
        if len(self._ids) > 1:
            self._ids, self._sizes = [np.concatenate(self._ids)], [np.concatenate(self._sizes)]
            self._begins = np.cumsum(self._sizes[0]) - self._sizes[0]
        at = np.fromiter(map(self._places.__getitem__, flat), np.int64, len(flat))
        sizes = self._sizes[0][at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self._ids[0][np.repeat(self._begins[at] - ends + sizes, sizes) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, split)])]
        return [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the tokens with single spaces between, special ones too: the vocabulary names no decoder."""
        return b" ".join(map(self._shown.__getitem__, ids.tolist()))


@functools.lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One a Python worker, which keeps the words of its earlier tasks."""
    return Encoder(path)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(df: DataFrame, keep: list[str], path: str, text: str = "text") -> DataFrame:
    """Columns `keep`, then ids (array<long>) and decoded of every row's whole text; a null is empty text."""
    def start():
        encoder = _encoder(path)

        def work(texts):
            found = encoder.encode([t or "" for t in texts])
            return [[f.tolist() for f in found], [encoder.decode(f).decode() for f in found]]

        return work

    return with_text_results(df, text, keep, "ids array<long>, decoded string", start)


def digests(df: DataFrame, keep: list[str], path: str | None = None, text: str = "text") -> DataFrame:
    """Columns `keep`, then n_tokens, ids_sha256, decoded_sha256 of every row's whole text.

    A null or empty text has no tokens and decodes to empty text. Repeated rows are encoded each; `path` names the
    tokenizer's file, which every executor must be able to read. A column of `keep` named as a result gives way to it.
    """
    path = path or vocabulary_path()

    def start():
        encoder = _encoder(path)

        def work(texts):
            found = encoder.encode([t or "" for t in texts])
            return [[len(f) for f in found],
                    [hashlib.sha256(f.astype("<u4").tobytes()).hexdigest() for f in found],
                    [hashlib.sha256(encoder.decode(f)).hexdigest() for f in found]]

        return work

    return with_text_results(df, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", start)
