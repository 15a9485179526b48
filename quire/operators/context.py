"""From ranked hits to prompts, and from model texts to cited answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import answers as an
from quire.functions import text as tx

CONTEXT_TOKENS = 3000
ENHANCED_CONTEXT_TOKENS = 5000
SOURCES_PER_ANSWER = 5
DEFAULT_CITATION_SIMILARITY = 0.8


def pack_context(hits: DataFrame, queries: DataFrame, budget: int = CONTEXT_TOKENS) -> DataFrame:
    """One row per query: class, context text, tokens and number of packed hits.

    hits: query_id, rank, document_name, page_number, section_title, similarity, chunk_text.
    queries: query_id, query_type. Hits are taken in rank order up to the first that would
    exceed the budget; as every block has tokens, that is a running sum within the budget.
    A query has at most k hits, so its window stays small.
    """
    block = an.excerpt_block(
        F.col("query_type"), F.col("document_name"), F.col("page_number"), F.col("section_title"),
        F.col("similarity"), F.col("chunk_text"),
    )
    in_order = Window.partitionBy("query_id").orderBy("rank")
    running = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (
        hits.join(queries.select("query_id", "query_type"), "query_id")
        .withColumn("_block", block)
        .withColumn("_tokens", tx.estimate_tokens(F.col("_block")))
        .withColumn("_running", F.sum("_tokens").over(running))
    )
    fits = F.col("_running") <= budget
    packed = blocks.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.when(fits, F.struct("rank", "_block")))).alias("_blocks"),
        F.coalesce(F.sum(F.when(fits, F.col("_tokens"))), F.lit(0)).alias("context_tokens"),
        F.count_if(fits).alias("packed_hits"),
    )
    text = F.concat(an.context_header(F.col("query_type")), F.array_join(F.transform("_blocks", lambda b: b["_block"]), ""))
    return queries.join(packed, "query_id", "left").select(
        *queries.columns,
        F.when(F.col("_blocks").isNull(), an.NO_CONTEXT).otherwise(text).alias("context"),
        F.coalesce("context_tokens", F.lit(0)).cast("bigint").alias("context_tokens"),
        F.coalesce("packed_hits", F.lit(0)).cast("bigint").alias("packed_hits"),
    )


def answer_sources(hits: DataFrame, n: int = SOURCES_PER_ANSWER) -> DataFrame:
    """Per query its first n hits as an ordered array of sources."""
    source = F.struct(
        "rank", "document_name", "page_number", tx.excerpt(F.col("chunk_text")).alias("excerpt"),
        F.col("similarity").alias("confidence"), "section_title",
    )
    return (
        hits.filter(F.col("rank") <= n)
        .groupBy("query_id").agg(F.array_sort(F.collect_list(source)).alias("_s"))
        .select("query_id", F.transform("_s", lambda s: s.dropFields("rank")).alias("sources"))
    )


def hit_statistics(hits: DataFrame) -> DataFrame:
    """Per query: number of hits and mean similarity of the first three."""
    return hits.groupBy("query_id").agg(
        F.count("*").alias("hits"),
        F.avg(F.when(F.col("rank") <= 3, F.col("similarity"))).alias("top3_mean"),
    )


def first_hit_per_page(hits: DataFrame) -> DataFrame:
    """Best-ranked hit of each (query, document name, page)."""
    return hits.groupBy("query_id", "document_name", "page_number").agg(
        F.min_by("similarity", "rank").alias("similarity"), F.min_by("document_id", "rank").alias("document_id")
    )


def resolve_citations(citations: DataFrame, hits: DataFrame) -> DataFrame:
    """citations (query_id, source, page, section) with the similarity and document id of the hit they name.

    A citation without a hit on its page gets 0.8; one whose document is no hit gets `unknown`.
    """
    pages = first_hit_per_page(hits).select(
        "query_id", F.col("document_name").alias("source"), F.col("page_number").alias("page"), "similarity"
    )
    names = hits.groupBy("query_id", F.col("document_name").alias("source")).agg(
        F.min_by("document_id", "rank").alias("document_id")
    )
    return (
        citations.join(pages, ["query_id", "source", "page"], "left")
        .join(names, ["query_id", "source"], "left")
        .withColumn("confidence", F.coalesce(F.nullif("similarity", F.lit(0.0)), F.lit(DEFAULT_CITATION_SIMILARITY)))
        .withColumn("document_id", F.coalesce(F.col("document_id").cast("string"), F.lit("unknown")))
        .drop("similarity")
    )


# --- prompts ----------------------------------------------------------------------

_CITE = (
    "Cite every claim in the text as (Document Name, Page X) and list it under \"citations\" "
    "with source, page and section."
)
_JSON = '{"answer": "...", %s"confidence": 0.8, "sections": ["1.1"], "citations": [{"source": "name", "page": 1, "section": "1.1"}]}'

# Question class -> (system text, instruction after the question, temperature, answer tokens).
# The wording is this project's own; pass another table to `build_prompts` to replace it.
PROMPTS = {
    "procedural": (
        "You extract complete procedures from the given excerpts. Keep every step, its order and its number. " + _CITE,
        "List the full procedure, one action a step. Reply with JSON only: " + _JSON % '"steps": ["1. ..."], ',
        0.05, 3000,
    ),
    "definitional": (
        "You answer from the given excerpts only and keep section numbers as written. " + _CITE,
        "Explain clearly and completely. Reply with JSON only: " + _JSON % "",
        0.1, 2500,
    ),
    "analytical": (
        "You analyse the given excerpts: structure, relations and dependencies between sections. " + _CITE,
        "Analyse thoroughly and support each point. Reply with JSON only: " + _JSON % "",
        0.15, 3500,
    ),
    "general": (
        "You answer from the given excerpts only and keep section numbers as written. " + _CITE,
        "Answer from the excerpts; say what is missing if they do not suffice. Reply with JSON only: " + _JSON % "",
        0.1, 2500,
    ),
}
STYLE_LINE = "Response style: %s"


def build_prompts(packed: DataFrame, templates: dict = PROMPTS, prompt_tokens: int | None = None) -> DataFrame:
    """packed contexts (query_id, query_text, query_type, context) with system and user prompt and settings."""
    spark = packed.sparkSession
    table = spark.createDataFrame(
        [(kind, *values) for kind, values in templates.items()],
        "query_type string, system_prompt string, _ask string, temperature double, max_tokens int",
    )
    prompt = F.concat("context", F.lit("\n\nQUERY: "), "query_text", F.lit("\n\n"), "_ask")
    if prompt_tokens:
        prompt = an.fit_prompt(prompt, prompt_tokens)
    out = packed.join(F.broadcast(table), "query_type", "left")  # four rows
    if "response_style" in packed.columns:
        style = F.format_string("\n\n" + STYLE_LINE, "response_style")
        out = out.withColumn("system_prompt", F.concat(
            "system_prompt", F.when(F.col("response_style").isNotNull(), style).otherwise("")))
    return out.withColumn("user_prompt", prompt).drop("_ask")


# --- conversations ------------------------------------------------------------------

def last_messages(messages: DataFrame, n: int = 5) -> DataFrame:
    """The last n messages a conversation; blank ones are dropped after taking n."""
    order = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return (
        messages.withColumn("_rn", F.row_number().over(order))
        .filter(F.col("_rn") <= n).drop("_rn")
        .filter(~tx.is_blank(F.col("text")))
        .withColumn("role", F.when(F.col("role") == "assistant", "assistant").otherwise("user"))
    )


def source_blocks(sources: DataFrame, key: str, order: str) -> DataFrame:
    """All sources of an answer as one text, numbered in order; an answer holds few sources."""
    packed = F.array_sort(F.collect_list(F.struct(order, "kind", "title", "url", "filename", "content")))
    lines = F.transform(
        "_s",
        lambda s, i: an.source_line(i + 1, s["kind"], s["title"], s["url"], s["filename"], s["content"]),
    )
    return sources.groupBy(key).agg(packed.alias("_s")).select(
        key, F.concat(F.lit("Additional Sources:\n"), F.array_join(lines, "\n\n")).alias("source_text")
    )


def combined_context(given: Column, source_text: Column) -> Column:
    """Given context and source text, joined by a rule line."""
    first = F.when(given.isNotNull() & ~tx.is_blank(given), F.concat(F.lit("Context Information:\n"), given))
    return F.array_join(F.array_compact(F.array(first, source_text)), "\n\n---\n\n")
