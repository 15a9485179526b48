"""A table of questions to a table of cited answers, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import answers as an
from quire.operators import context as cx
from quire.operators import search as se
from quire.operators.hooks import Answerer, Embedder, answer, embed
from quire.session import checkpoint, small_side


def retrieve(questions: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = se.DEFAULT_K,
             threshold: float = se.DEFAULT_THRESHOLD, scoped: bool = False, **options) -> DataFrame:
    """Ranked hits of embedded questions with chunk text, page, section and document name.

    With `scoped`, questions carry document_ids and are searched in those documents only: null means
    all of the user's documents, an empty list none, repeated ids count once.
    """
    vectors = chunks.select("chunk_id", "user_id", "document_id", "embedding")
    asked = questions.select("query_id", "user_id", "embedding")
    if not scoped:
        hits = se.search_with_fallback(vectors, asked, k, threshold, scope=("user_id",), **options)
    else:
        inside = questions.select("query_id", "user_id", "embedding",
                                  F.explode(F.array_distinct("document_ids")).alias("document_id"))
        everywhere = questions.where(F.col("document_ids").isNull()).select(*asked.columns)
        hits = (
            se.search_with_fallback(vectors, inside, k, threshold, scope=("user_id", "document_id"), **options)
            .unionByName(se.search_with_fallback(vectors, everywhere, k, threshold, scope=("user_id",), **options))
        )
    found = small_side(checkpoint(hits))
    detail = chunks.select("chunk_id", "document_id", "page_number", "section_title", "chunk_text")
    # the ids go to the chunk table, so its texts are not shuffled
    return se.attach_filename(detail.join(found, "chunk_id"), documents, small=False)


def answer_questions(questions: DataFrame, chunks: DataFrame, documents: DataFrame,
                     embedder: Embedder | None = None, answerer: Answerer | None = None,
                     k: int = se.DEFAULT_K, threshold: float = se.DEFAULT_THRESHOLD,
                     budget: int = cx.CONTEXT_TOKENS, structured: bool = False, **options) -> DataFrame:
    """questions (query_id, user_id, query_text) -> response_text, sources, confidence_score, tokens.

    `structured` expects JSON from the answerer: it is parsed, its steps and citations are
    written into the text, and its own confidence is used. Questions that differ in their id only are answered once.
    """
    asked, members = once_each(questions)
    kind = an.classify_query(F.col("query_text"))
    typed = asked.withColumn("_c", kind).withColumn("query_type", F.col("_c.type")).drop("_c")
    vectors = typed
    if "embedding" not in questions.columns:
        vectors = embed(typed, embedder or Embedder(), "query_text")
    # the search reads every vector; its few hits are kept, as four later steps need them
    hits = checkpoint(retrieve(vectors, chunks, documents, k, threshold, **options))
    packed = cx.pack_context(hits, typed.drop("embedding"), budget)
    texts = answer(cx.build_prompts(packed), answerer or Answerer())
    merged = texts.join(cx.answer_sources(hits), "query_id", "left").join(cx.hit_statistics(hits), "query_id", "left")
    done = finish(merged, hits, structured)
    return members.join(done.withColumnRenamed("query_id", "_asked"), "_asked").select(*done.columns)


def once_each(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions that differ in more than their id, one row each, and (_asked, query_id): by which id each is answered.

    Equal questions of a user, on the same documents, have equal hits and prompts, so searching and answering grow with the
    different ones.
    """
    same = [c for c in questions.columns if c != "query_id"]
    keyed = questions.withColumn("_key", F.sha2(F.to_json(F.struct(*same)), 256))
    asked = checkpoint(keyed.groupBy("_key", *same).agg(F.min("query_id").alias("query_id")))
    first = asked.select("_key", F.col("query_id").alias("_asked"))
    members = keyed.select("_key", "query_id").join(small_side(first), "_key").select("_asked", "query_id")
    return asked.select(*questions.columns), members


def finish(merged: DataFrame, hits: DataFrame, structured: bool) -> DataFrame:
    """Texts, sources and scores. A question whose answer failed gets an apology, no sources and confidence 0."""
    raw = F.col("response_text")
    failed = F.col("error").isNotNull()
    usage = an.token_usage(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("user_prompt"), F.coalesce(raw, F.lit("")))
    confidence = an.answer_confidence(F.col("hits"), F.col("top3_mean"), raw)
    text, own = raw, confidence
    if structured:
        merged = merged.withColumn("_a", an.parse_model_answer(raw))
        cited = (
            merged.select("query_id", F.posexplode("_a.citations").alias("_at", "_x"))
            .select("query_id", "_at", F.col("_x.source").alias("source"),
                    F.col("_x.page").cast("int").alias("page"), F.col("_x.section").alias("section"))
        )
        resolved = (
            cx.resolve_citations(cited, hits)
            .groupBy("query_id")
            .agg(F.array_sort(F.collect_list(F.struct(
                "_at", F.col("source").alias("document_name"), F.col("page").alias("page_number"),
                F.lit("").alias("excerpt"), "confidence", F.col("section").alias("section_title"),
            ))).alias("_cited"))
        )
        merged = (
            merged.join(resolved, "query_id", "left")
            # a structured answer names its own sources; none named means none shown
            .withColumn("sources", F.coalesce(
                F.transform("_cited", lambda s: s.dropFields("_at")), F.slice("sources", 1, 0)))
        )
        text = an.append_steps(an.extract_answer(F.col("_a.answer"), raw), F.col("_a.steps"))
        text = an.cite(text, F.col("sources"))
        own = F.coalesce(F.nullif("_a.confidence", F.lit(0.0)), confidence)
    return merged.select(
        "query_id", "user_id", "query_text", "query_type",
        F.when(failed, an.APOLOGY).otherwise(text).alias("response_text"),
        F.when(failed, F.slice("sources", 1, 0)).otherwise(F.col("sources")).alias("sources"),
        F.when(failed, 0.0).otherwise(own).alias("confidence_score"),
        F.coalesce("hits", F.lit(0)).alias("sources_found"), "packed_hits", usage.alias("usage"),
        F.when(failed, "failed").otherwise(an.finish_reason(F.col("finish_reason"))).alias("finish_reason"), "error",
    )


def reprocess(query_ids: DataFrame, log: DataFrame, chunks: DataFrame, documents: DataFrame, **options) -> DataFrame:
    """Answer logged questions again; query_ids (query_id, user_id) must own the logged question.

    With `scoped`, document_ids of query_ids, where that column is there, replace the logged ones, as retrieve reads
    them. A question asked for twice is answered once.
    """
    keys = ["query_id", "user_id"]
    scope = ["document_ids"] if "document_ids" in query_ids.columns else []
    wanted = query_ids.select(*keys, *scope).dropDuplicates(keys)
    again = log.drop(*scope).join(wanted, keys)
    kept = [c for c in ("document_ids",) if c in again.columns]
    asked = again.select(*keys, "query_text", *kept)
    return answer_questions(asked, chunks, documents, **options).withColumnRenamed("query_id", "original_query_id")
