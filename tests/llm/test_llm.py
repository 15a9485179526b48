"""Each training-data operator against a brute-force version, and on nulls, empty and repeated rows, ties, empty tables."""

import hashlib
import os
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from quire.llm import chat, decontamination, graphs, html, language, neardup, packing, secrets, sharding, topk, toxicity

SF = "/root/testdata/sf0.001"
LONG = "word " * 60_000


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest tables, with hard rows and columns whose names the operators use themselves."""
    given = spark.read.parquet(f"{SF}/documents.parquet")
    hard = [(-1, None), (-2, ""), (-3, " \n\t"), (-4, "One."), (-4, "One."), (-5, "one."), (-6, LONG), (-7, LONG + "end"),
            (-8, "12 !? 34"), (-9, 'k = "abc123DEF456"\npassword = k\npasswd: hunter2x'), (None, "a row without any id at all")]
    more = spark.createDataFrame([(i, t, None, "x", len(t or "")) for i, t in hard], given.schema)
    return given.unionByName(more).withColumn("score", F.lit("mine")).withColumn("cleaned", F.lit(7)).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


def test_language_learns_and_rejects(spark, docs):
    rows = language.identify_documents(docs).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    asked = [r for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in asked]) > 0.95
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (-1, -2, -3, -8)} == {"und"}
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language.identify_documents(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_learning_languages_takes_small_batches(spark, docs):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.unset(name)
    try:
        assert language.learn(docs).languages
        assert int(spark.conf.get(name)) <= 8 << 20
    finally:
        spark.conf.set(name, before)


def test_bundles_do_not_depend_on_company():
    profiles = language.Profiles(64)
    texts = ["Hello world", None, "", "ärger 12", "日本語"]
    together, letters = profiles.bundle(texts)
    assert letters.tolist() == [True, False, False, True, True]
    for i, t in enumerate(texts):
        assert np.allclose(language.Profiles(64, slice_chars=3).bundle([t])[0][0], together[i])


def brute_components(rows):
    sets = {}
    for n, (_, t) in enumerate(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        sets[n] = frozenset(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()
    comp = {n: n for n in sets}
    for a in sets:
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= 75 * (len(x) + len(y) - both) and comp[a] != comp[b]:
                    old, new = max(comp[a], comp[b]), min(comp[a], comp[b])
                    comp = {k: new if v == old else v for k, v in comp.items()}
    least = {}
    for n, c in comp.items():
        if rows[n][0] is not None:
            least[c] = min(rows[n][0], least.get(c, rows[n][0]))
    return Counter((rows[n][0], len(sets[n]), least.get(comp[n])) for n in sets)


def test_near_duplicates_are_exact(spark, docs, texts):
    got = neardup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(docs.limit(0)).collect() == []


def test_near_copies_in_one_large_group(spark):
    base = [f"w{i}" for i in range(120)]
    rows = [(n, " ".join([*base[:n % 100], f"x{n}", *base[n % 100 + 1:]])) for n in range(700)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.component_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_near_pairs_among_many_on_one_template(spark):
    base = [f"w{i}" for i in range(104)]  # any two texts are alike by 100 / 142, the planted pairs by 105 / 137
    tails = [[f"x{n}n{i}" for i in range(21)] for n in range(600)]
    for n in range(0, 600, 20):
        tails[n + 11][:5] = tails[n][:5]
    rows = [(n, " ".join(base + tail)) for n, tail in enumerate(tails)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {n: n - 11 if n % 20 == 11 else n for n in range(600)}


def test_pairs_just_below_on_one_template_are_not_all_confirmed(spark, monkeypatch):
    """Near copies of one text, each with its own words at its own places: 79 of them reach no other one, all meet all."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for n in range(400):
        words = base.copy()
        for at in rng.choice(30, 4 if n % 5 else 6, replace=False) * 5:
            words[at] = f"x{n}n{at}"
        rows.append((n, " ".join(words)))
    confirmed, seen = neardup.confirmed, []
    monkeypatch.setattr(neardup, "confirmed", lambda pairs, *rest: (seen.append(pairs.count()), confirmed(pairs, *rest))[1])
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(seen) < 20 * len(rows)


def test_crowded_regions_meet_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(n, n, b"\0" * 256, rng.bytes(32)) for n in range(40)]
    rows[33] = (33, *rows[33][1:3], rows[2][3])
    nodes = spark.createDataFrame(rows, "node long, component long, labels binary, sketch binary")
    monkeypatch.setattr(neardup, "TILE", 8)
    assert [(r.a, r.b) for r in neardup.rest(nodes, None).collect()] == [(2, 33)]


def test_tokenising_workers_start_no_threads(tmp_path):
    """Threads of the tokenizer, one a core and worker, each hold memory of their own."""
    code = ("import os; from quire.llm import packing; import public_tokenizers\n"
            "made = packing._tokenizer(public_tokenizers.path('word_bpe_49k.json'))\n"
            "before = len(os.listdir('/proc/self/task'))\n"
            "made.encode([' '.join(f'ab{i} cd-{i}' for i in range(20_000))])\n"
            "assert len(os.listdir('/proc/self/task')) == before")
    env = {k: v for k, v in os.environ.items() if k != "TOKENIZERS_PARALLELISM"}
    folder = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    assert subprocess.run([sys.executable, "-c", code], cwd=folder, env=env).returncode == 0


@pytest.mark.parametrize("few", [0, graphs.FEW_LINKS])
def test_components_both_ways(spark, few):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (103, 101)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(links, "a long, b long"), few=few).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


@pytest.mark.parametrize("limit", [10, decontamination.SLICE_WINDOWS])
def test_decontamination_is_exact(spark, docs, texts, limit):
    given = spark.read.parquet(f"{SF}/benchmark.parquet")
    benchmark = given.unionByName(spark.createDataFrame([(900, "ONE."), (901, None), (902, "!"), (None, "12 34")], given.schema))
    if limit == 10:
        benchmark = benchmark.where("item_id is null or item_id >= 900 or item_id < 2")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for r in benchmark.collect():
        w = word.findall(lower(r.text or ""))
        for i in range(max(len(w) - 10, 0) + 1):
            if w:
                windows[tuple(w[i:i + 10])].add(r.item_id)
    want = []
    for i, t in texts:
        w, hit, items = word.findall(lower(t or "")), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (key := tuple(w[k:k + n])) in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[key] - {None}
        want.append((i, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest(), bool(hit)))
    slices = decontamination.window_slices(decontamination.benchmark_windows(benchmark), limit)
    assert Counter(map(tuple, decontamination.scan(docs, slices, ["doc_id"]).collect())) == Counter(want)
    cleaned = decontamination.remove_spans(docs, slices, cleaned="made")
    assert not any(r.contaminated for r in decontamination.scan(cleaned, slices, ["doc_id"], text="made").collect())
    same = {w[0] for w in want if not w[5]}
    assert all(r.made == r.text for r in cleaned.collect() if r.doc_id in same)


def test_secrets(spark, docs, texts):
    got = secrets.scan(docs, ["doc_id"]).collect()
    want = Counter()
    for i, t in texts:
        found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(
            r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t or "") if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t or "") if len(m[0]) >= 24]
        line = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        kinds = Counter(f[3] for f in found)
        want[i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(line.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    spans = next(r.spans for r in got if r.doc_id == -9)
    assert spans == "literal:5:17,assign:32:48,literal:40:48"  # the constant that password is set from
    assert secrets.redacted('k = "abc123DEF456"\npassword = k') == 'k = "[SECRET]"\npassword = k'
    assert secrets.literal_spans("Secret: the meeting is at noon. a == b, http://x.y") == []


@pytest.mark.parametrize("name", sorted(secrets.SENSITIVE))
def test_every_sensitive_name_can_give_a_literal(name):
    for literal in ("Zq8!vR2xLm4#Tw", "k3j4h5g6f7d8s9a0q1w2", "Correct-Horse!Battery"):
        assert secrets.literal_spans(f'{name} = "{literal}"') == [("literal", len(name) + 4, len(name) + 4 + len(literal))]
    for word in ("user-name", "morning", "Left.Right", "SomeValue", "docs/read-me.txt", "The end of it, so far!"):
        assert secrets.literal_spans(f'{name}: "{word}"') == []


def test_packing(spark, docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")) for i, t in texts]
    want = Counter((i, p, p * 4096, len(x), zlib.crc32(x.tobytes())) for i, v in ids
                   for p, x in enumerate(np.split(v, range(4096, len(v), 4096))))
    got = packing.pack_documents(docs).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    held = defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(held) <= 1 + -(-sum(len(v) for _, v in ids) // 4096)
    assert packing.pack_documents(docs.limit(0)).collect() == []


def test_word_tokenizer_equals_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["", "a", "  a  b ", "Don't, it's.", "x<|endoftext|>y", "ΑΣ ΟΔΟΣ.", "H̱a, Àb", "É,É.", "!!,a.,b", "3.14, 1,000.",
           "\x1c a b c\u0085d", "İstanbul, ﬁ.", "日本語。", "a\tb\r\nc", "'s 't 'rex.", "ß. ẞ,"]
    whole = Tokenizer.from_file(path)
    for most in (1000, 3):
        assert [x.tolist() for x in packing.WordTokenizer(path, most).encode(odd)] == \
            [whole.encode(t, add_special_tokens=False).ids for t in odd]


def test_word_tokenizer_looks_distinct_words_up_and_equals_the_library(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    odd = ["lichöbe%%% çà'' ñ̃ ü̈!", "é A e\u0301 B", "a b, a b. a", "ö÷ø× ªºµ x'll ÿ'.", "%%% b%%% B%%%", "ä" * 50]
    asked = []
    look_up = packing.WordTokenizer._look_up
    monkeypatch.setattr(packing.WordTokenizer, "_look_up", lambda self, words: asked.extend(words) or look_up(self, words))
    whole = Tokenizer.from_file(path)
    assert [x.tolist() for x in packing.WordTokenizer(path).encode(odd)] == \
        [whole.encode(t, add_special_tokens=False).ids for t in odd]
    assert len(asked) == len(set(asked))


def test_packing_takes_one_python_worker_a_task(spark, monkeypatch):
    from quire.llm import common

    plans = []

    def stored(df, name, store=common.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, name)

    monkeypatch.setattr(common, "stored", stored)
    monkeypatch.setattr(packing, "stored", stored, raising=False)
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert packing.pack_documents(docs).count() == 2
    assert plans and all(p.count("MapInArrow") <= 1 for p in plans)


def test_pages(spark):
    assert html.main_text(None) == html.main_text("") == ""
    page = ('<nav><a>x</a></nav><div class="cookie-notice">Cookies</div><article><h1>A &amp; B</h1><p>one <i>two</i>three<br>'
            'four<aside>side</aside> tail</p><form>f</form><p>end</article><section id="comments"><p>me</p></section>')
    assert html.main_text(page) == "A & B\none twothree four\ntail\nend"
    bare = "<ul><li><a>Home</a><li><a>About</a></ul><div>" + "Long text. " * 20 + "</div><p>short</p><div class=footer>c</div>"
    assert html.main_text(bare).endswith("\nshort") and "Home" not in html.main_text(bare)
    rows = html.extract(spark.read.parquet(f"{SF}/pages.parquet"), ["page_id", "url"]).collect()
    assert rows and all(r.n_chars == len(r.text) > 0 for r in rows)


def test_pages_keep_every_stretch_and_layout_containers():
    body = "Long text of the article. " * 8
    links = "<ul><li><a>Other</a><li><a>Pages</a><li><a>Here</a><li><a>Too</a></ul>"
    long = body.strip()
    assert html.main_text(f"<p>{body}</p>{links}<p>{body} end</p>") == f"{long}\n{long} end"
    for page in ("<body class='single has-sidebar'><p>{}</p>", "<body><article class='post comments-open'><p>{}</p></article>",
                 "<main class='no-share'><p>{}</p></main>", "<div class='layout sidebar-right'><p>{}</p></div><p>c</p>",
                 "<div class='no-share'><p>{}</p></div><div class=comments>" + "<p>me too, and at length</p>" * 9 + "</div>"):
        assert html.main_text(page.format(body)).split("\n")[0] == long and "me too" not in html.main_text(page.format(body))


def test_shards(spark, docs, texts):
    hot = spark.range(300).select((F.col("id") + 10_000).alias("doc_id"), F.lit("the same text").alias("text"))
    rows = docs.select("doc_id", "text").unionByName(hot)
    got = sharding.shard_documents(rows).collect()
    count = Counter(r.shard for r in got)
    assert len(got) == rows.count() and set(count) == set(range(8)) and max(count.values()) - min(count.values()) <= 1
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))
    size = {i: (len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts}
    assert all((r["size"], r.text_crc32) == size[r.doc_id] for r in got if r.doc_id in size)
    assert len({r.shard for r in got if r.doc_id and r.doc_id >= 10_000}) <= 6
    assert sharding.shard_documents(rows.limit(0)).collect() == []


def test_chats(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 3, None, "[ROLE x] \\ ]"), (2, 1, "tool]", " <s>"), (2, 2, "assistant", "")]
    rows += [(3, i, "user" if i % 2 else "assistant", f"turn {i} </s>") for i in range(90)]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    want = defaultdict(list)
    for c, _, r, t in sorted(rows, key=lambda x: x[:2]):
        want[c].append((r or "", t or ""))
    want[-7] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    got = {r.conv_id: r for r in chat.format_conversations(given).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars, got[c].formatted_chars) == (len(turns), len(loss), len(chat.instruct(turns)))
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_rewritten_history_is_seen(spark):
    def forgetful(turns, before=0):  # shows only what the last turn says of the ones before
        return "".join(f"<{r}>" if i < len(turns) - 1 else f"<{r}>{t}" for i, (r, t) in enumerate(turns))

    given = spark.createDataFrame([(1, i, "user", f"t{i}") for i in range(3)], "conv_id long, turn long, role string, text string")
    assert [r.rewritten for r in chat.format_chats(given, forgetful).collect()] == [False, True, True]


def test_late_rewriting_is_seen_in_long_conversations(spark):
    def late(turns):  # a real one-argument template: from 20 turns on the first one is dropped
        return "".join(f"<{r}>{t}" for r, t in (turns[1:] if len(turns) >= 20 else turns))

    def claimed(turns, before=0):  # declared append-only, and not
        return late([("user", "x")] * before + turns)[6 * before if len(turns) + before < 20 else 0:]

    claimed.append_only = True
    given = spark.createDataFrame([(1, i, "user", f"t{i:02}") for i in range(24)], "conv_id long, turn long, role string, text string")
    for template in (late, claimed):
        assert [r.rewritten for r in chat.format_chats(given, template).collect()] == [i == 19 for i in range(24)]


def test_top_products(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(260)]
    rows += [(i + 300, rows[i][1]) for i in range(20)] + [(400, None), (450, [1.0, None] + [0.0] * 6), (500, [float("nan")] * 8),
             (None, [9.0] * 8), (550, [1.0, 2.0]), (600, [])]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        scores = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q and len(v) == len(whole[q]))[:5]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)}
    got = topk.top_products(given, lambda v: v % 50 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert topk.top_products(given.limit(0), lambda v: v % 50 == 0).collect() == []


def test_top_products_of_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.choice([0, 5, 7, 12, 20, 307])).tolist()) for i in range(160)]
    rows += [(i, rng.normal(size=4).tolist()) for i in range(160, 300)] + [(300, [16385.0, 0.0, 0.0, 0.0])]
    whole = {i: [int(np.floor(256 * x)) if abs(x) < 1e300 else 256 * int(x) for x in v] for i, v in rows}
    want = set()
    for q in range(0, 301, 50):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want |= {(q, n + 1, i, max(-1 << 63, min((1 << 63) - 1, -s))) for n, (s, i) in enumerate(scores)}
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_products(given, lambda v: v % 50 == 0).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string")
    got = toxicity.score_documents(docs.select("doc_id", "text").unionByName(more), labels).collect()
    assert len(got) == docs.count() + 2 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    insults = re.compile(r"\b(stupid|idiot|loser|pathetic|scum|worthless|moron|clown|trash|disgusting)\b", re.I)
    bad = {r.doc_id for r in docs.collect() if len(insults.findall(r.text)) >= 3}
    assert np.mean([r.predicted == (r.doc_id in bad) for r in got if r.held_out]) > 0.95
    none = toxicity.score_documents(more, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def test_toxicity_in_every_language(spark):
    """Held-out labels, of which a few are noise."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score_documents(docs.select("doc_id", "text"), labels).where("held_out").join(labels, "doc_id").join(
        docs.select("doc_id", "lang"), "doc_id").collect()
    for lang in ("de", "en", "es", "fr"):
        caught = [r.predicted for r in got if r.lang == lang and r.toxic == 1]
        assert len(caught) > 4 and np.mean(caught) > 0.85
        assert np.mean([r.predicted for r in got if r.lang == lang and r.toxic == 0]) < 0.02


def test_lexicon_leaves_the_asking_text_out(spark):
    rows = [("grok zorb", 1.0)] * 4 + [("grok", 1.0), ("plain mist", 0.0)] + [("plain", 0.0)] * 200
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label double"))
    assert lexicon.words == {None: {"grok", "zorb"}, 1: {"grok"}, 0: {"grok", "zorb"}}


def test_pipeline_stages_keep_columns(spark, docs):
    import corpus_pipeline

    rows = docs
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, rows, SF)
        if name == "best_fit_packing":
            assert {r.doc_id for r in made.collect()} == {r.doc_id for r in rows.collect()}
            break
        assert made.columns == docs.columns
        assert {r.score for r in made.select("score").distinct().collect()} == {"mine"}
        assert made.where("n_chars <> length(text)").count() == 0
        rows = made.cache()
        if name == "language_id":
            assert rows.where("doc_id in (-1, -2, -3, -8)").count() == 0
        if name == "near_duplicates":
            kept = [r.doc_id for r in rows.collect()]
            assert -5 in kept and -4 not in kept and len(kept) == len(set(kept))  # -5 is the smaller id of the group
        if name == "secret_scan":
            assert not any("abc123" in r.text or "hunter2" in r.text for r in rows.collect())
