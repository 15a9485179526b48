"""Encoding against the tokenizers library; spelling variants and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from quire.llm import bpe, importance, spelling

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def docs(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    hard = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "One."), (-4, "One."), (-6, LONG), (-7, LONG + "end"), (-8, "12 !? 34"),
            (-9, "Don't <|endoftext|> stoṕ İ ÜBER ﬁ 日本語"), (-10, "x" * 3000 + " " + "é" * 900),
            (None, "a row without any id at all"), (-11, "colour " * 60 + "color " * 7 + "colours " * 11 + "kolour " * 6),
            (-12, "bookkeeper " * 30 + "bokkeeper " * 6 + "bookkeepers " * 6 + "übermut " * 25 + "ubermut " * 5)]
    more = spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in hard], given.schema)
    clash = given.unionByName(more).withColumn("score", F.lit("mine")).withColumn("n_tokens", F.lit(7))
    return clash.withColumn("word", F.lit("w")).withColumn("rank", F.lit(1)).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(bpe.vocabulary_path())
    made.no_truncation()
    made.no_padding()
    return made


def test_encoding_is_the_librarys(docs, texts, library):
    def expected(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())

    got = bpe.digests(docs, ["doc_id"]).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == \
        Counter((i, *expected(t)) for i, t in texts)
    assert bpe.digests(docs.limit(0), ["doc_id"]).collect() == []


def test_encoding_of_random_signs(library):
    encoder, rng = bpe.Encoder(bpe.vocabulary_path(), most_words=500), random.Random(3)
    signs = [chr(i) for span in ((0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x1100, 0x1180), (0x2000, 0x2070)) for i in range(*span)]
    made = ["".join(rng.choice(signs if rng.random() < 0.3 else "abcdeIS' \n01<|>.") for _ in range(rng.randint(0, 40)))
            for _ in range(3000)] + ["<|endoftext|>a<|startoftext|>", "<|EndOfText|>", "'ve'S d'ont", "ab" * 3000, "\x1c a\x85b"]
    for at in range(0, len(made), 100):
        part = made[at:at + 100]
        for ids, known in zip(encoder.encode(part), library.encode_batch(part, add_special_tokens=False)):
            assert ids.tolist() == known.ids
            assert encoder.decode(ids).decode() == library.decode(known.ids, skip_special_tokens=False)


def test_encoded_lists(docs, library):
    row = bpe.encode(docs.where("doc_id = -9"), ["doc_id"], bpe.vocabulary_path()).first()
    assert row.decoded == library.decode(row.ids, skip_special_tokens=False)


def apart_by_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 199 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and apart_by_one(v, w)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    found = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        found.add((w, form[w], root, n[w], len(near[w]), form[w] and n[form[w]]))
    return found


def test_variants_are_those_of_all_pairs(docs, texts):
    got = [(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.group_variants(docs).collect()]
    want = brute_variants(texts)
    assert len(got) == len(want) > 100 and set(got) == want
    assert {"colour", "bookkeeper"} <= {r[1] for r in want}
    assert spelling.group_variants(docs.limit(0)).collect() == []


@pytest.mark.parametrize("frequent", [1, 4, 1000])
def test_dense_words_meet_once(spark, monkeypatch, frequent):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(250)})
    got = Counter((r.a, r.b) for r in spelling.near_words(spark.createDataFrame([(w, 5) for w in words], "word string, n long")).collect())
    assert got == Counter((a, b) for a in words for b in words if apart_by_one(a, b))


def test_crc_of_spans():
    rng = np.random.default_rng(2)
    line = rng.integers(0, 256, 300_000).astype(np.uint8)
    begins = rng.integers(0, 200_000, 300)
    ends = begins + np.concatenate([rng.integers(1, 200, 200), rng.integers(1, 5000, 97), [64, 65, 100_000]])
    assert importance.crc32_spans(line, begins, ends).tolist() == [zlib.crc32(line[a:b].tobytes()) for a, b in zip(begins, ends)]


def brute_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(words), Counter(zlib.crc32(" ".join(words[i:i + k]).encode()) % 10000
                               for k in (1, 2, 3) for i in range(len(words) - k + 1))


def brute_resample(rows, target):
    made = [(i, *brute_features(t)) for i, t in rows]
    s, t = (sum((f for *_, f in x), Counter()) for x in (made, [brute_features(x) for x in target]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + 10000) / ((s[b] + 1) * (t_all + 10000)))) for b in range(10000)]
    found = []
    for i, n, f in made:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] * c for b, c in f.items())
        found.append([i, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    may = sorted((r for r in found if r[5] >= 20), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for rank, row in enumerate(may[:5 * len(may) // 100]):
        row[4] = rank + 1
    return Counter(tuple(r[:5]) for r in found)


@pytest.mark.parametrize("chunk", [10, importance.CHUNK])
def test_features_of_runs(texts, monkeypatch, chunk):
    monkeypatch.setattr(importance, "CHUNK", chunk)
    part = [t for _, t in texts if len(t or "") < 20_000]
    found = [(np.bincount(w, minlength=len(part)), o, b) for w, o, b in importance.features(part)]
    words = sum(n for n, _, _ in found)
    buckets = [Counter() for _ in part]
    for _, owner, bucket in found:
        for i, b in zip(owner.tolist(), bucket.tolist()):
            buckets[i][b] += 1
    assert [(n, b) for n, b in zip(words.tolist(), buckets)] == [brute_features(t) for t in part]


def test_resampling_is_exact(spark, docs, texts):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance.resample(docs, target).collect()
    want = brute_resample(texts, [r.text for r in target.collect()])
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in got) == want
    assert sum(r.rank is not None for r in got) > 3


def test_resampling_of_empty_tables(spark, docs):
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert importance.resample(docs.limit(0), target).collect() == []
    few = docs.where("doc_id in (-1, -4, -8)")
    assert Counter(tuple(r) for r in importance.resample(few, target.limit(0)).collect()) == \
        brute_resample([(-1, None), (-4, "One."), (-4, "One."), (-8, "12 !? 34")], [])
