"""Spelling variants: words one insertion, deletion or replacement apart, each led to its most frequent relative.

Words are cut into variable grams: at each place the shortest gram, made longer while it is frequent among all words. An
edit changes only those grams whose making looked at its place, so for each place a word has a bound: the grams that an
edit there cannot affect, each of which a neighbour must share at the same distance from the start or the end. The lists
of these grams are merged by one hash of them all. A short word may keep a single gram, whose list grows with the
vocabulary; so the letters between the kept grams and the place, which verification would compare, are hashed with them.
Words that meet then differ at that place alone, and no more meet than there are letters (but for equal hashes, which the
distance settles).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import lower_ascii, pieces, stored
from quire.session import ship

MIN_LENGTH = 6
MIN_COUNT = 5
STRONGER = 5  # a form is this many times as frequent as its variant
SHORTEST, LONGEST = 2, 4  # lengths of grams
FREQUENT = 1000  # a gram in more than one of so many words is made longer
MUTATED = 199
TASK_WORDS = 300_000  # words that a task counts before it hands them on

_RUN = re.compile("[a-zÀ-ÿ]+")


def counted_words(docs: DataFrame) -> DataFrame:
    """word, n over all texts: letter runs in small letters, a letter lost where the crc of id and run says so.

    Null texts have no words; a null id counts as empty text. Tasks add up their own words before they are shuffled.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for at, texts in pieces(batch.column(1)):
                for doc_id, text in zip(ids[at:at + len(texts)], texts):
                    if text:
                        first = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                        runs = Counter(_RUN.findall(lower_ascii(text).decode("utf-8", "surrogatepass")))
                        for run, n in runs.items():
                            if len(run) >= MIN_LENGTH:
                                h = zlib.crc32(run.encode(), first)
                                if h % MUTATED == 0:
                                    h %= len(run)
                                    run = run[:h] + run[h + 1:]
                                    if len(run) < MIN_LENGTH:
                                        continue
                                total[run] += n
                        if len(total) > TASK_WORDS:
                            yield rows()
                            total.clear()
        yield rows()

    parts = docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def frequent_grams(words: DataFrame) -> set[str]:
    """Grams that stand in more than one of FREQUENT words: FREQUENT times the mean length of a word at most."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                total.update({word[p:p + k] for k in range(SHORTEST, LONGEST) for p in range(len(word) - k + 1)})
        yield pa.RecordBatch.from_arrays(
            [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["gram", "n"])

    least = words.count() // FREQUENT
    grams = words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r.gram for r in grams.where(F.col("n") > least).collect()}


def grams_of(word: str, frequent: set[str]) -> list[tuple[str, int]]:
    """The gram at each place, and the end of what its making looked at (one more than the length: at the word's end)."""
    found = []
    for p in range(len(word) - SHORTEST + 1):
        end = p + SHORTEST
        seen = end
        while end - p < LONGEST and word[p:end] in frequent:
            seen = end + 1
            if end == len(word):
                break
            end += 1
        found.append((word[p:end], seen))
    return found


# What a place of a word is for: a gap where a letter is missing, a letter to take out, a letter to replace only.
GAP, LETTER, REPLACED = 0, 1, 2


def places(word: str, frequent: set[str]) -> Iterator[tuple[int, str]]:
    """Each place's role and all that an edit there leaves: the grams it cannot affect, and the letters between them.

    Of equal letters in a row only the first is one to take out, so that each pair of words meets at one place.
    """
    size, grams = len(word), grams_of(word, frequent)
    for place in range(size + 1):
        left = [(p, g) for p, (g, seen) in enumerate(grams[:place]) if seen <= place]
        start = max((p + len(g) for p, g in left), default=0)
        before = f"{left}\t{word[start:place]}"
        for role in (GAP, LETTER):
            after = place + role
            if after <= size:
                right = [(size - p, grams[p][0]) for p in range(after, len(grams))]
                rest = f"{size - role}\t{before}\t{right}\t{word[after:] if not right else ''}"
                again = role == LETTER and place and word[place] == word[place - 1]
                yield (REPLACED if again else role), rest


def near_words(words: DataFrame) -> DataFrame:
    """a, b, n_b for every ordered pair of `words` (word, n) that are exactly one edit apart; each once."""
    import xxhash

    ship(words.sparkSession)
    frequent = frequent_grams(words)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                keys, roles, of = [], [], []
                for i, word in enumerate(part.column(0).to_pylist()):
                    for role, rest in places(word, frequent):
                        keys.append(digest(rest) - (1 << 63))
                        roles.append(role)
                        of.append(i)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(roles, pa.int8()), *part.take(pa.array(of, pa.int32())).columns],
                    names=["key", "role", "word", "n"])

    lists = words.select("word", "n").mapInArrow(merge, "key long, role byte, word string, n long")
    met = (lists.groupBy("key").agg(F.collect_list(F.struct("role", "word", "n")).alias("met"))
           .where((F.size("met") > 1) & F.exists("met", lambda m: m.role > GAP)))
    pairs = (met.select("met", F.explode("met").alias("a")).select("a", F.explode("met").alias("b"))
             .where((F.col("a.word") != F.col("b.word")) & (F.least("a.role", "b.role") != F.lit(GAP))
                    | (F.least("a.role", "b.role") == F.lit(GAP)) & (F.greatest("a.role", "b.role") == F.lit(LETTER)))
             .where(F.levenshtein("a.word", "b.word", 1) == 1))
    return pairs.select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("b.n").alias("n_b"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms from `word` on. Counts grow on the way, so it ends; steps double each round."""
    found = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while not found.where("moved").isEmpty():
        on = found.select(F.col("word").alias("__at__"), F.col("root").alias("__next__"))
        found = stored(found.join(on, F.col("root") == F.col("__at__"), "left").select(
            "word", F.coalesce("__next__", "root").alias("root"), F.col("__next__").isNotNull().alias("moved")), "roots")
    return found.select("word", "root")


def group_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of at least MIN_LENGTH letters and MIN_COUNT occurrences.

    The form is the near word of largest n (ties: smallest in code-point order) where that n is at least STRONGER times the
    word's own, else null. Null and empty texts add no words, repeated rows count each, an empty table gives no rows.
    """
    words = stored(counted_words(docs), "words")
    best = F.min(F.struct((-F.col("n_b")).alias("less"), F.col("b").alias("form")))
    near = near_words(words).groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    strong = -F.col("best.less") >= STRONGER * F.col("n")
    linked = stored(words.join(near, F.col("word") == F.col("a"), "left").select(
        "word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(strong, -F.col("best.less")).alias("form_n")), "linked")
    ends = roots(linked.where(F.col("form").isNotNull())).withColumnRenamed("word", "__of__")
    return linked.join(ends, F.col("word") == F.col("__of__"), "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
