"""Text, vector, answer and status functions on small given inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions import answers as an
from quire.functions import status, text as tx, vectors as vx
from quire.operators import context as cx
from quire.operators import hooks, quality


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize("query, kind, confidence", [
    ("How to complete the steps to submit a form", "procedural", 0.9),
    ("Define and compare the terms", "definitional", 0.7),
    ("Compare the structure of both", "analytical", 0.8),
    ("hello", "general", 0.5),
    ("é-submit it", "procedural", 0.7),
])
def test_classification(spark, query, kind, confidence):
    got = one(spark, an.classify_query(F.lit(query)))
    assert (got["type"], got["confidence"]) == (kind, confidence)


def test_model_answers(spark):
    raws = [
        '{"answer": "A", "confidence": 1.7, "citations": []}',
        'text {"answer": "B", "confidence": "high", "citations": [{"source": "M", "page": "4"}]} more',
        '{"answer": "C", "confidence": 0.5}', "no json", "{'answer': 'D', 'confidence': 1, 'citations': []}",
    ]
    got = [one(spark, an.parse_model_answer(F.lit(r))) for r in raws]
    assert [g["parsed"] for g in got] == [True, True, False, False, False]
    assert [g["confidence"] for g in got] == [1.0, 0.0, 0.1, 0.1, 0.1]
    assert got[1]["citations"][0]["page"] == 4.0
    assert got[3]["answer"] == an.UNREADABLE


def test_extract_answer(spark):
    def take(answer, raw):
        return one(spark, an.extract_answer(F.lit(answer), F.lit(raw)))
    assert take("plain", "x") == "plain"
    assert take('{"answer": "inner"}', "x") == "inner"
    assert take('{"answer": broken', "x") == '{"answer": broken'
    assert take(None, 'so {"answer": "raw"}') == "raw"
    assert take(None, "just text") == "just text"
    assert take(None, None) == an.NO_ANSWER


def test_citations(spark):
    sources = F.array(*[F.struct(F.lit(n).alias("document_name"), F.lit(p).alias("page_number"), F.lit(c).alias("confidence"))
                        for n, p, c in (("A", 1, 0.5), ("B", 2, 0.9), ("B", 2, 0.8))])
    assert one(spark, an.cite(F.lit("Do it (1.2) now."), sources)) == "Do it now (B, Page 2)."
    assert one(spark, an.cite(F.lit("See (Manual, Page 3)"), sources)) == "See (Manual, Page 3)"


def test_confidence(spark):
    def score(n, top, text):
        return one(spark, an.answer_confidence(F.lit(n), F.lit(top).cast("double"), F.lit(text)))
    assert score(0, None, "x") == 0.1
    assert score(5, 1.0, "x" * 200) == pytest.approx(1.0)
    assert score(1, 0.4, "x" * 50) == pytest.approx(0.2 + 0.06 + 0.1)


def test_context_budget(spark):
    hits = spark.createDataFrame(
        [(1, 1, "D", 1, None, 0.9, "x" * 400), (1, 2, "D", 2, None, 0.8, "y" * 4000), (1, 3, "D", 3, None, 0.7, "z")],
        "query_id long, rank int, document_name string, page_number int, section_title string, similarity double, chunk_text string")
    asked = spark.createDataFrame([(1, "general"), (2, "general")], "query_id long, query_type string")
    got = {r["query_id"]: r for r in cx.pack_context(hits, asked, 300).collect()}
    assert got[1]["packed_hits"] == 1            # stops at the second, the third is not taken
    assert got[2]["context"] == an.NO_CONTEXT
    tokens = got[1]["context_tokens"]
    exact = {r["query_id"]: r for r in cx.pack_context(hits, asked, tokens).collect()}
    assert exact[1]["packed_hits"] == 1          # a sum exactly at the budget is kept
    none = {r["query_id"]: r for r in cx.pack_context(hits, asked, tokens - 1).collect()}
    assert none[1]["packed_hits"] == 0 and none[1]["context"] == an.CONTEXT_HEADERS["general"]


def test_vectors(spark):
    def v(*values):
        return F.array(*[F.lit(float(x)) for x in values])
    assert one(spark, vx.cosine_similarity(v(1, 2), v(1, 2))) == pytest.approx(1)
    assert one(spark, vx.cosine_similarity(v(1, 0), v(0, 1))) == 0
    assert one(spark, vx.cosine_similarity(v(1, 0), v(-1, 0))) == pytest.approx(-1)
    assert one(spark, vx.cosine_similarity(v(0, 0), v(1, 0))) == 0
    assert one(spark, vx.l2_normalise(v(0, 0))) == [0, 0]
    assert one(spark, vx.fit_dimension(v(1, 2, 3), 4)) == [1, 2, 3, 0]
    assert one(spark, vx.fit_dimension(v(1, 2, 3, 4, 5), 4)) == [1, 2, 3, 4]
    assert [one(spark, vx.is_valid_vector(x)) for x in (v(0, 0), v(2, 2), v(1, 2))] == [False, False, True]
    with pytest.raises(Exception, match="same length"):
        one(spark, vx.cosine_similarity(v(1, 0), v(1, 0, 0)))


def test_hash_embedding_by_hand():
    expected = np.zeros(16)
    for i, word in enumerate("ab  Cd".lower().split()):
        for j, c in enumerate(word):
            expected[(ord(c) + i + j) % 16] += 0.1
    assert np.allclose(vx.hash_embedding(["ab  Cd"], 16)[0], expected / np.linalg.norm(expected))
    assert vx.hash_embedding([""], 4)[0].tolist() == [0, 0, 0, 0]


def test_embedder_keeps_row_errors(spark):
    class Picky(hooks.Embedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return [[1.0, 2.0]] * len(texts)

    df = spark.createDataFrame([(1, "fine"), (2, "bad"), (3, "  "), (4, "x" * 9000)], "id long, chunk_text string").coalesce(1)
    got = {r["id"]: (r["embedding"], r["embedding_error"]) for r in hooks.embed(df, Picky()).collect()}
    assert got[1] == ([1.0, 2.0], None) and got[2] == (None, "bad text")
    assert got[3] == (None, "text is empty") and got[4][0] is None


def test_answerer_errors_become_rows(spark):
    class Broken(hooks.Answerer):
        def answer(self, prompts):
            raise RuntimeError("model is away")

    prompts = spark.createDataFrame([(1, "s", "u", "c")], "query_id long, system_prompt string, user_prompt string, context string")
    row = hooks.answer(prompts, Broken()).first()
    assert row["error"] == "model is away" and row["response_text"] is None


def test_request_checks(spark):
    def problem(prompt, tokens, temperature):
        return one(spark, hooks.request_problem(F.lit(prompt), F.lit(tokens), F.lit(temperature), 4000))
    assert problem("hi", 100, 0.5) is None
    assert problem(" ", 100, 0.5) == "prompt is empty"
    assert "max_tokens" in problem("hi", 5000, 0.5)
    assert "temperature" in problem("hi", 100, 2.5)


def test_progress_of_unknown_status(spark):
    got = one(spark, status.progress(F.lit("lost"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    assert tuple(got) == (0, "unknown", "Unknown status")


def test_split_rules(spark):
    rows = spark.createDataFrame([("u1", 5), ("bad id", 50)], "user_id string, n int")
    valid, rejects = quality.split_valid(rows, {"id": ~F.col("user_id").rlike("^[a-z0-9]+$"), "n": F.col("n") > 20})
    assert [r["user_id"] for r in valid.collect()] == ["u1"]
    assert rejects.first()["violations"] == ["id", "n"]


def test_short_texts(spark):
    assert one(spark, tx.clean_text(F.lit("  café  a@b \n c! "))) == "caf ab c!"
    assert one(spark, tx.split_at_budget(F.lit("abcdefghij k"), 1))["head"] == ""
    assert one(spark, tx.format_bytes(F.lit(0))) == "0 Bytes"
    assert one(spark, tx.format_bytes(F.lit(1536))) == "1.5 KB"
    assert one(spark, tx.format_bytes(F.lit(5 * 1024 ** 4))) == "5 TB"
    assert one(spark, tx.strip(F.lit("  a ﻿\n"))) == "a"
