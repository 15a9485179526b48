"""Sources, sinks and streaming ingest with real folders."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire.operators import listing
from quire.operators.hooks import Answerer, Embedder, embed
from quire.plans import answering
from quire.plans.ingest import ingest, prepare
from quire.sources import files, pages, tables
from quire.streaming import jobs


@pytest.fixture
def documents(spark):
    rows = [(i, "u%d" % (i % 2), f"doc_{i}.pdf", f"Topic {i} is here. " + "More words follow on. " * (40 * i)) for i in range(1, 5)]
    return spark.createDataFrame(rows, "document_id long, user_id string, filename string, text string")


def test_files(spark, tmp_path):
    folder = tmp_path / "u1"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"hello")
    (folder / "b.txt").write_bytes(b"0123456789")
    got = {r["name"]: r for r in files.file_metadata(spark, str(folder)).collect()}
    assert got["a.pdf"]["mime_type"] == "application/pdf" and got["b.txt"]["size"] == 10
    assert files.user_files(spark, str(tmp_path), "u1", 1).count() == 1
    manifest = {r["path"].rsplit("/", 1)[1]: r for r in files.file_manifest(spark, str(folder), max_size=6).collect()}
    assert manifest["a.pdf"]["file_hash"].startswith("2cf24dba") and manifest["a.pdf"]["type_allowed"]
    assert manifest["b.txt"]["too_large"] and manifest["b.txt"]["file_hash"] is None


def test_page_numbers_survive_blank_pages(spark):
    df = spark.createDataFrame([(1, "one\f \fthree"), (2, "x")], "document_id long, text string")
    got = [tuple(r) for r in pages.split_pages(df, None).orderBy("document_id", "page_number").collect()]
    assert got == [(1, 1, "one"), (1, 3, "three"), (2, 1, "x")]
    assert pages.split_pages(df, None, first_pages=2).count() == 2


def test_even_pages_fill_up(spark):
    df = spark.createDataFrame([(1, "aaaa\nbb\ncc\nd", 3), (2, "x", 3), (3, "keep ", 1), (4, "", 2)], "document_id long, text string, page_count int")
    got = [tuple(r) for r in pages.even_pages(df).select("document_id", "page_number", "text").orderBy("document_id", "page_number").collect()]
    assert got == [(1, 1, "aaaa"), (1, 2, "bb\ncc"), (1, 3, "d"), (2, 1, "x"), (2, 2, ""), (2, 3, ""), (3, 1, "keep "), (4, 1, "")]


def test_ingest_and_answer(spark, documents, tmp_path):
    counts = ingest(documents, str(tmp_path / "chunks"), str(tmp_path / "rejects"), Embedder(64), size=100, overlap=10)
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    assert counts == {"stored": stored.count(), "failed": 0} and counts["stored"] > 4
    assert {d.name for d in (tmp_path / "chunks").iterdir() if d.is_dir()} == {"user_id=u0", "user_id=u1"}

    asked = spark.createDataFrame([(1, "u1", "what is topic 3"), (2, "u9", "nothing here")], "query_id long, user_id string, query_text string")
    got = {r["query_id"]: r for r in answering.answer_questions(asked, stored, documents, Embedder(64), threshold=0.1).collect()}
    assert got[1]["sources_found"] > 0 and got[1]["query_type"] == "definitional"
    assert got[1]["sources"][0]["document_name"] in ("doc_1.pdf", "doc_3.pdf")
    assert got[2]["sources_found"] == 0 and got[2]["confidence_score"] == pytest.approx(0.1)

    answers = answering.answer_questions(asked, stored, documents, Embedder(64), threshold=0.1)
    log = answers.withColumns({"processing_time_ms": F.lit(5).cast("long"), "created_at": F.current_timestamp()})
    tables.append_queries(log, str(tmp_path / "log"))
    logged = spark.read.parquet(str(tmp_path / "log"))
    assert logged.count() == 2
    again = answering.reprocess(spark.createDataFrame([(1, "u1"), (2, "u1")], "query_id long, user_id string"), logged, stored, documents,
                                embedder=Embedder(64), threshold=0.1)
    assert [r["original_query_id"] for r in again.collect()] == [1]     # the other is not owned
    wanted = spark.createDataFrame([(1, "u1", [3]), (1, "u1", [3]), (2, "u9", [])], "query_id long, user_id string, document_ids array<long>")
    again = answering.reprocess(wanted, logged, stored, documents, embedder=Embedder(64), threshold=0.1, scoped=True)
    found = {r["original_query_id"]: {s["document_name"] for s in r["sources"] or []} for r in again.collect()}
    assert found == {1: {"doc_3.pdf"}, 2: set()}                          # the scope asked for now


def test_structured_answers(spark, documents):
    class Json(Answerer):
        def answer(self, prompts):
            text = '{"answer": "Go on (1.2).", "steps": ["a"], "confidence": 0, "citations": [{"source": "doc_1.pdf", "page": 1}, {"source": "zz", "page": 9}]}'
            return prompts.assign(response_text=text, prompt_tokens=0, completion_tokens=0, finish_reason="length")

    chunks = embed(prepare(documents), Embedder(64))
    asked = spark.createDataFrame([(1, "u1", "topic 1 is here")], "query_id long, user_id string, query_text string")
    got = answering.answer_questions(asked, chunks, documents, Embedder(64), Json(), threshold=0.1, structured=True).first()
    assert [s["document_name"] for s in got["sources"]] == ["doc_1.pdf", "zz"]
    assert got["sources"][1]["confidence"] == 0.8 and got["finish_reason"] == "max_tokens"
    assert got["response_text"].startswith("Go on. Steps: 1. a") and "Page" in got["response_text"]
    assert got["confidence_score"] > 0.1                                 # zero confidence is worked out instead


def test_rejects_keep_their_reason(spark, documents, tmp_path):
    chunks = spark.createDataFrame(
        [(1, "u1", 0, "text", [1.0]), (1, "u1", 1, " ", [1.0]), (1, "u1", 2, "text", None), (1, "other", 3, "text", [1.0])],
        "document_id long, user_id string, chunk_index long, chunk_text string, embedding array<float>").withColumn("page_number", F.lit(1))
    counts = tables.store_chunks(chunks, documents, str(tmp_path / "c"), str(tmp_path / "r"))
    assert counts == {"stored": 1, "failed": 2}
    reasons = {r["chunk_index"]: r["violations"] for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    assert reasons == {1: ["missing text"], 2: ["missing embedding"]}


def test_delete_needs_confirmation(spark, documents):
    with pytest.raises(ValueError):
        tables.delete_user("u1", "u2", {"documents": documents})
    assert tables.delete_user("u1", "u1", {"documents": documents})["documents"].count() == 2


def test_listing_arguments(documents):
    with pytest.raises(ValueError):
        listing.sort_columns("owner")
    with pytest.raises(ValueError):
        listing.page_of(documents, [F.asc("document_id")], 1, 101)


def test_copies_of_one_upload(spark):
    """A third of all uploads are one file."""
    rows = [(i, "u", "same" if i % 3 == 0 else f"h{i}", datetime(2024, 1, 1, 0, i % 60)) for i in range(300)]
    df = spark.createDataFrame(rows, "document_id long, user_id string, file_hash string, created_at timestamp")
    got = listing.duplicate_uploads(df).collect()
    assert len(got) == 99 and {r["first_document_id"] for r in got} == {0}


def test_streaming_ingest_records_failures(spark, documents, tmp_path):
    documents.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(documents.schema).parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / p) for p in ("chunks", "rejects", "status", "state")]
    jobs.start_ingest(stream, *paths, Embedder(16)).awaitTermination()
    assert spark.read.parquet(paths[0]).select("document_id").distinct().count() == 4
    assert {r["status"] for r in spark.read.parquet(paths[2]).collect()} == {"completed"}

    class Away(Embedder):
        def load(self):
            raise RuntimeError("no model")

    paths = [str(tmp_path / p) for p in ("chunks2", "rejects2", "status2", "state2")]
    jobs.start_ingest(stream, *paths, Away(16)).awaitTermination()
    failed = spark.read.parquet(paths[2]).first()
    assert failed["status"] == "failed" and failed["processing_stage"] == "storing"


def test_a_repeated_batch_changes_nothing(spark, documents, tmp_path):
    where = (str(tmp_path / "c"), str(tmp_path / "r"))
    first = ingest(documents, *where, Embedder(16), batch_id=0)
    ingest(documents, *where, Embedder(16), batch_id=0)
    assert spark.read.parquet(where[0]).count() == first["stored"]
    ingest(documents, *where, Embedder(16), batch_id=1)
    assert spark.read.parquet(where[0]).count() == 2 * first["stored"]


def test_search_reads_only_the_users_partitions(spark, documents, tmp_path):
    from quire.operators import search

    ingest(documents, str(tmp_path / "c"), str(tmp_path / "r"), Embedder(16))
    stored = spark.read.parquet(str(tmp_path / "c"))
    asked = spark.createDataFrame([(1, "u1", [1.0] * 16)], "query_id long, user_id string, embedding array<float>")
    plan = search.batched_search(stored, asked, 3, 0.0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(user_id" in plan or "user_id#" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_each_chunk_is_embedded_once(spark, documents, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    class Counting(Embedder):
        def embed(self, texts):
            seen.add(len(texts))
            return super().embed(texts)

    counts = ingest(documents, str(tmp_path / "c"), str(tmp_path / "r"), Counting(16), size=100, overlap=10)
    assert seen.value == counts["stored"] + counts["failed"] > 4


def test_failed_batches_are_taken_up_again(spark, documents, tmp_path):
    documents.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(documents.schema).parquet(str(tmp_path / "in"))
    *paths, state = [str(tmp_path / p) for p in ("chunks", "rejects", "status", "state")]

    class Away(Embedder):
        def load(self):
            raise RuntimeError("no model")

    jobs.start_ingest(stream, *paths, state, Away(16)).awaitTermination()
    assert jobs.retry_failed(documents, *paths, Embedder(16)) == 1
    assert {(r["document_id"], r["status"]) for r in spark.read.parquet(paths[2]).collect()} == {(i, "completed") for i in range(1, 5)}
    stored = spark.read.parquet(paths[0])
    assert stored.select("document_id").distinct().count() == 4
    assert stored.select("document_id", "chunk_index").distinct().count() == stored.count()
    assert jobs.retry_failed(documents, *paths, Embedder(16)) == 0


def test_failed_answers_say_so_and_are_logged(spark, documents, tmp_path):
    ingest(documents, str(tmp_path / "chunks"), str(tmp_path / "rejects"), Embedder(64), size=100, overlap=10)
    stored = spark.read.parquet(str(tmp_path / "chunks"))
    asked = spark.createDataFrame([(1, "u1", "what is topic 3"), (2, "u1", "what is topic 1")], "query_id long, user_id string, query_text string")

    class Picky(Answerer):
        def answer(self, prompts):
            if prompts["user_prompt"].str.contains("topic 3").any():
                raise RuntimeError("refused")
            return super().answer(prompts)

    answers = answering.answer_questions(asked, stored, documents, Embedder(64), Picky(), threshold=0.1)
    tables.append_queries(answers, str(tmp_path / "log"))
    got = {r["query_id"]: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert got[1]["confidence_score"] == 0 and got[1]["response_text"].startswith("I apologize") and not got[1]["sources"]
    assert got[2]["confidence_score"] > 0.1 and got[2]["sources"] and got[2]["created_at"] is not None
