"""Toxicity scores: gradient-boosted trees over dense features of whole texts, calibrated by isotonic regression.

Besides short lists of insults, a lexicon of any language is learned from the labelled rows that may teach. What a row's own
label adds to the lexicon is taken out again where that row's features fit the trees.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import crc32_text, pieces, stored, with_text_results
from quire.session import ship, small_side

# Words that insult a person or wish harm, and weaker ones that are rude at times.
INSULTS = frozenset(
    "arschloch asshole bastard bitch clown clowns coward cretin cretino cunt degenerate dickhead disgusting dumbass "
    "estúpido fool freak fuck fucker fucking hideous hure idiot idiota idiote idiots imbecile imbécile imbécil jackass "
    "jerk kill liar loser losers lowlife maggot miserable moron morons motherfucker nazi parasite pathetic perra pig "
    "prick puta putain retard retarded salaud scum scumbag shit slut stupid subhuman trash vermin wanker whore wichser "
    "worthless wretch abschaum connard dummkopf vollidiot enculé gilipollas mierda basura escoria patético".split())
RUDE = frozenset("annoying awful crap crazy damn disgrace dumb fake garbage gross hate hell horrible ignorant insane "
                 "lazy mad nasty nonsense rubbish shame shut sick silly suck sucks terrible ugly useless weird".split())
YOU = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre usted tú tus "
                "vosotros".split())

# Look-alikes of letters.
_PLAIN = str.maketrans("013457@$!|€", "oieastasile")
_WORD = re.compile(r"\w+")
_OBFUSCATED = re.compile(r"(?=\S*[0-9@$!|*._-])(?=\S*[^\W\d_])\S+")
_JOINERS = re.compile(r"(?<=\w)[*._-]+(?=\w)")
_SHOUT = re.compile(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b")
_LETTERS = re.compile(r"[^\W\d_]{3,}")
_REPEATED = re.compile(r"[!?]{2,}")
STEADY = 20.0
NEAR = 6  # words between an insult and a second person that still belong together
LEAST, SHARE = 4, 0.002  # a learned word stands in so many toxic texts, and in this share of them
LOG_ODDS = 3.0
TASK_WORDS = 300_000  # words that a task counts before it hands them on

FEATURES = ["insults", "insults_log", "rude", "near_you", "you", "capitals", "shouts", "exclamations", "questions",
            "repeated_marks", "punctuation", "digits", "obfuscated", "obfuscated_insults", "densest", "words_log",
            "learned", "learned_rate"]
_PUNCTUATION = [i for i in range(33, 127) if not chr(i).isalnum()]


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for words, kind in ((INSULTS, 0), (RUDE, 1), (YOU, 2)):
        for word in words:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _hits(automaton, text: str) -> tuple[list[int], list[int], list[int]]:
    """Where whole words of the three lists begin."""
    found: tuple[list[int], list[int], list[int]] = ([], [], [])
    last = len(text) - 1
    for end, (kind, size) in automaton.iter(text):
        begin = end - size + 1
        if (begin == 0 or not text[begin - 1].isalnum()) and (end == last or not text[end + 1].isalnum()):
            found[kind].append(begin)
    return found


class Lexicon:
    """Words that stand in toxic texts far oftener than in others, from counts of texts by word and label."""

    def __init__(self, counts: list[tuple[str, int, int]], toxic: int, clean: int):
        def telling(t: int, c: int, all_t: int, all_c: int) -> bool:
            if t < max(LEAST, SHARE * all_t):
                return False
            return math.log((t + 0.5) / (all_t - t + 0.5)) - math.log((c + 0.5) / (all_c - c + 0.5)) > LOG_ODDS

        # By the label of the text that asks: as if that text had not been counted.
        self.words = {None: frozenset(w for w, t, c in counts if telling(t, c, toxic, clean)),
                      1: frozenset(w for w, t, c in counts if telling(t - 1, c, toxic - 1, clean)),
                      0: frozenset(w for w, t, c in counts if telling(t, max(c - 1, 0), toxic, clean - 1))}


def learn_lexicon(labelled: DataFrame, text: str = "text") -> Lexicon:
    """The lexicon of rows with text and label. Tasks count texts by word; what comes to the driver are words of at least
    SHARE of the toxic texts that tell, so 1 / SHARE times a text's mean number of words at most."""
    ship(labelled.sparkSession)
    totals = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    toxic, clean = totals.get(1.0, 0), totals.get(0.0, 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def rows():
            words = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), *[pa.array([seen[i][w] for w in words], pa.int64()) for i in (1, 0)]],
                names=["word", "toxic", "clean"])

        for batch in batches:
            marks = batch.column(1).to_pylist()
            for at, texts in pieces(batch.column(0)):
                for one, mark in zip(texts, marks[at:at + len(texts)]):
                    seen[int(mark)].update(set(_LETTERS.findall((one or "").lower())))
                if len(seen[0]) + len(seen[1]) > TASK_WORDS:
                    yield rows()
                    seen[0].clear()
                    seen[1].clear()
        yield rows()

    t, c = F.col("toxic"), F.col("clean")
    odds = F.log((t + 0.5) / (toxic - t + 0.5)) - F.log((F.greatest(c - 1, F.lit(0)) + 0.5) / (clean - c + 1.5))
    counts = (labelled.select(F.col(f"`{text}`").cast("string"), "label").mapInArrow(count, "word string, toxic long, clean long")
              .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
              .where((t >= max(LEAST, math.floor(SHARE * toxic))) & (odds > LOG_ODDS - 0.01)))
    return Lexicon([tuple(r) for r in counts.collect()], toxic, clean)


def features(text: str | None, automaton, lexicon: Lexicon, label: int | None = None) -> list[float]:
    """One number a name in FEATURES: rates per 100 words or characters, and logarithms of counts.

    `label` is given for texts that fit the trees only: the lexicon then leaves the text itself out.
    """
    text = text or ""
    low = text.lower()
    insults, rude, you = _hits(automaton, low)
    words = max(1, low.count(" ") + low.count("\n") + 1)
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    upper = int(counts[65:91].sum())
    letters = max(1, upper + int(counts[97:123].sum()))
    size = max(1, len(text))
    odd = _OBFUSCATED.findall(low) if counts[[42, 33, 36, 46, 45, 64, 95, 124, *range(48, 58)]].any() else []
    hidden = 0
    for word in odd:
        plain = _JOINERS.sub("", word).translate(_PLAIN)
        hidden += any(w in INSULTS for w in _WORD.findall(plain)) and not any(w in INSULTS for w in _WORD.findall(word))
    near = densest = 0
    if insults:
        at, others = np.array(insults), np.array(sorted(you) or [1 << 60])
        after = others[np.minimum(np.searchsorted(others, at), len(others) - 1)]
        before = others[np.maximum(np.searchsorted(others, at) - 1, 0)]
        near = int((np.minimum(np.abs(after - at), np.abs(before - at)) <= 6 * NEAR).sum())
        densest = int((np.searchsorted(at, at + 200) - np.arange(len(at))).max())
    per = 100 / words
    learned = len(lexicon.words[label].intersection(_LETTERS.findall(low)))
    return [len(insults) * per, math.log1p(len(insults)), len(rude) * per, near * per, len(you) * per, 100 * upper / letters,
            len(_SHOUT.findall(text)) * per, int(counts[33]) * per, int(counts[63]) * per, len(_REPEATED.findall(text)) * per,
            100 * int(counts[_PUNCTUATION].sum()) / size, 100 * int(counts[48:58].sum()) / size, len(odd) * per,
            hidden * per, densest, math.log(words), learned, learned * per]


def with_features(df: DataFrame, keep: list[str], lexicon: Lexicon, label: int | None = None, text: str = "text") -> DataFrame:
    """Columns `keep` and features of every row's whole text; a null is empty text."""
    def start():
        automaton = _automaton()
        return lambda texts: [[features(t, automaton, lexicon, label) for t in texts]]

    return with_text_results(df, text, keep, "features array<double>", start)


def _few_parts(df: DataFrame, rows: int) -> DataFrame:
    """Training passes over the rows dozens of times: no more partitions than cores and size ask for."""
    wanted = max(df.sparkSession.sparkContext.defaultParallelism, rows // 100_000)
    return df.coalesce(min(wanted, df.rdd.getNumPartitions()))


class Scorer:
    """Trees and calibration; with one class only, or no labels, the share of label 1 for every text."""

    def __init__(self, trees=None, calibration=None, constant: float = 0.0):
        self._trees, self._calibration, self._constant = trees, calibration, constant

    @classmethod
    def fit(cls, labelled: DataFrame, calibrate: Column, trees: int = 20, depth: int = 3) -> Scorer:
        """`labelled` has features and label (0.0 or 1.0). Rows that `calibrate` picks fit the calibration, the others the trees."""
        found = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
        total = sum(found.values())
        rows = labelled.select(array_to_vector("features").alias("vector"), "label", calibrate.alias("calibrate"))
        fitting = _few_parts(rows.where(~F.col("calibrate")), total)
        if len(found) < 2 or fitting.select("label").distinct().count() < 2:
            return cls(constant=found.get(1.0, 0) / total if total else 0.0)
        model = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2,
                              seed=9, minInstancesPerNode=max(20, total // 500)).fit(fitting)
        # Scores to two digits: at most 101 rows, whatever number of texts is behind them. Each is drawn towards the
        # trees' own score as by STEADY texts, so that a handful of odd texts does not move it.
        steps = (model.transform(_few_parts(rows.where("calibrate"), total))
                 .groupBy(F.round(vector_to_array("probability")[1], 2).alias("raw"))
                 .agg(F.sum("label").alias("toxic"), F.count(F.lit(1)).cast("double").alias("n"))
                 .select("raw", ((F.col("toxic") + STEADY * F.col("raw")) / (F.col("n") + STEADY)).alias("label"),
                         (F.col("n") + STEADY).alias("weight")))
        if steps.isEmpty():
            return cls(model)
        calibration = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight",
                                         predictionCol="calibrated").fit(steps.coalesce(1))
        return cls(model, calibration)

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds score. A thousandth of the uncalibrated score keeps the order inside the steps of the calibration."""
        if self._trees is None:
            return rows.withColumn("score", F.lit(float(self._constant)))
        found = self._trees.transform(rows.withColumn("vector", array_to_vector("features")))
        found = found.withColumn("raw", vector_to_array("probability")[1])
        if self._calibration is None:
            return found.withColumn("score", F.col("raw"))
        found = self._calibration.transform(found.withColumn("raw", F.round("raw", 6)))
        return found.withColumn("score", F.least(F.lit(1.0), F.greatest(
            F.lit(0.0), 0.999 * F.col("calibrated") + 0.001 * F.col("raw"))))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels teach nothing: crc32 of the id as text is divisible by 5."""
    return crc32_text(doc_id) % 5 == 0


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Every labelled row that is not held out teaches; a document with several labels is toxic if one says so, and null
    labels say nothing. Empty texts are scored like any other. Repeated rows get one result each.
    """
    told = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
            .groupBy("doc_id").agg((F.max("toxic") > 0).cast("double").alias("label")))
    teaching = docs.select("doc_id", "text").join(small_side(stored(told, "told")), "doc_id")
    lexicon = learn_lexicon(teaching)
    labelled = stored(with_features(teaching.where("label = 1"), ["doc_id", "label"], lexicon, 1).unionByName(
        with_features(teaching.where("label = 0"), ["doc_id", "label"], lexicon, 0)), "labelled")
    texts = with_features(docs, ["doc_id"], lexicon)
    scorer = Scorer.fit(labelled, F.floor(crc32_text(F.col("doc_id")) / 5) % 5 == 0)
    return scorer.score(texts).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
