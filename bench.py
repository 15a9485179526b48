"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Beside the seconds of each query it reports the two figures the targets are stated in:
pages a minute through cutting, embedding and writing, and questions a second through
exact top-k and context packing over 30,400 vectors (the expected size of one user's set).
"""

from __future__ import annotations

import json
import math
import os
import tempfile
import time

from pyspark.sql import functions as F

from checks import QUERIES
from checks.views import Views
from quire.operators import context as cx
from quire.operators import search
from quire.operators.hooks import Embedder
from quire.plans.ingest import ingest
from quire.session import local_session
from quire.sources.pages import split_pages

HEADLINES = (
    "chunk_documents", "stride_chunks", "section_map", "chunk_by_sections", "hash_embedding",
    "batched_topk", "batched_topk_blocks", "pack_context", "distinct_vectors", "duplicate_uploads",
    "user_statistics", "query_analytics", "common_topics", "activity", "running_means",
    "rate_limit_audit", "storage_issues", "parse_answers", "answer_questions",
)
TARGET_VECTORS = 30_400


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(action) -> float:
    began = time.perf_counter()
    action()
    return round(time.perf_counter() - began, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "quire-bench")
    views = Views(spark, sf_dir)
    spark.range(1000).select(F.sum("id")).collect()

    seconds = {}
    for name in HEADLINES:
        try:
            seconds[name] = timed(lambda: run(QUERIES[name](spark, sf_dir)))
        except Exception as problem:  # one broken query must not hide the others
            seconds[name] = None
            print(f"{name}: {type(problem).__name__}: {str(problem)[:300]}", file=os.sys.stderr)

    # documents -> chunks -> embeddings -> table
    documents = views.user_documents.select("document_id", "user_id", "text")
    pages = split_pages(documents).count()
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    seconds["ingest_to_table"] = timed(
        lambda: ingest(documents, f"{folder}/chunks", f"{folder}/rejects", Embedder(384)))

    # one user's set of vectors, replicated with small shifts up to the expected size
    vectors = views.chunk_vectors
    copies = math.ceil(TARGET_VECTORS / vectors.count())
    many = (
        vectors.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        .select(
            (F.col("chunk_id") * copies + F.col("copy")).alias("chunk_id"), F.lit(1).alias("user_id"), "document_id", "page_number",
            F.transform("embedding", lambda x, i: x + F.lit(0.01).cast("float") * F.when(i % copies == F.col("copy"), 1).otherwise(0)).alias("embedding"),
        ).limit(TARGET_VECTORS)
    )
    many.write.mode("overwrite").parquet(f"{folder}/vectors")
    many = spark.read.parquet(f"{folder}/vectors")
    asked = views.query_vectors.withColumn("user_id", F.lit(1)).withColumn("query_type", F.lit("general"))
    names = views.user_documents.select("document_id", F.col("filename").alias("document_name"), F.col("title").alias("chunk_text"))

    def questions(rows) -> None:
        hits = search.batched_search(many.drop("document_id", "page_number"), rows, 10, 0.2)
        shown = (
            hits.join(many.select("chunk_id", "document_id", "page_number"), "chunk_id").join(names, "document_id")
            .withColumn("section_title", F.lit(None).cast("string"))
        )
        run(cx.pack_context(shown, rows.select("query_id", "query_type")))

    one = asked.orderBy("query_id").limit(1)
    seconds["one_question"] = timed(lambda: questions(one))
    n_asked = asked.count()
    seconds["all_questions"] = timed(lambda: questions(asked))

    done = [s for s in seconds.values() if s is not None]
    print(json.dumps({
        "metric": "headline queries", "value": round(sum(done), 3), "unit": "sec", "queries": seconds, "sf": sf_dir,
        "cpus": cpus, "pages": pages, "pages_per_minute": round(pages / seconds["ingest_to_table"] * 60),
        "vectors": TARGET_VECTORS, "questions": n_asked,
        "questions_per_second": round(n_asked / seconds["all_questions"], 1),
    }))


if __name__ == "__main__":
    main()
