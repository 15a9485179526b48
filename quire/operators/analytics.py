"""Reports over documents, chunks, query logs and usage logs, for all users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators.scans import running_totals

# Words that are no topics.
STOP_WORDS = (
    "the", "is", "at", "which", "on", "what", "how", "when", "where", "why", "who", "and", "or", "but", "in",
    "with", "to", "for", "of", "as", "by", "from", "up", "about", "into", "through", "during", "before",
    "after", "above", "below", "between", "among", "can", "could", "would", "should", "may", "might", "will",
    "shall",
)
# Dollars per 1000 prompt and completion tokens.
PRICES = {
    "gpt-4": (0.03, 0.06),
    "gpt-4-turbo": (0.01, 0.03),
    "gpt-4-turbo-preview": (0.01, 0.03),
    "gpt-3.5-turbo": (0.0005, 0.0015),
    "gpt-3.5-turbo-16k": (0.003, 0.004),
}
DEFAULT_PRICE_MODEL = "gpt-3.5-turbo"
# Dollars per embedding token.
EMBEDDING_PRICES = {"text-embedding-3-small": 0.00002 / 1000000, "text-embedding-3-large": 0.00013 / 1000000}
DEFAULT_EMBEDDING_PRICE_MODEL = "text-embedding-3-small"
# Capacity assumed for one user, and sizes used in storage estimates.
DOCUMENT_CAPACITY, CHUNK_CAPACITY = 8, 30000
VECTOR_DIM, CHUNK_CHARS = 1536, 500


def _sum(column: str) -> Column:
    return F.coalesce(F.sum(F.coalesce(F.col(column), F.lit(0))), F.lit(0)).cast("bigint")


def _mean(column: str) -> Column:
    """Mean with missing values as zero; zero without rows."""
    return F.coalesce(F.avg(F.coalesce(F.col(column), F.lit(0))), F.lit(0.0))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def half_up(value: Column, digits: int) -> Column:
    """Shown figures: halves go up. Noise of the order of summation is removed first, so it cannot tip a half."""
    scale = F.lit(float(10 ** digits))
    return F.floor(F.round(value, 9) * scale + 0.5) / scale


def chunks_per_document(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def collection_stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Completed documents of each user: documents, chunks, pages, chunks a page, size in MB.

    Chunks are counted per document before the join, so pages and sizes are not multiplied.
    """
    done = documents.filter(F.col("status") == "completed").select("document_id", "user_id", "total_pages", "file_size")
    per_user = done.join(chunks_per_document(chunks), "document_id", "left").groupBy("user_id").agg(
        F.count("*").alias("total_documents"), _sum("chunk_count").alias("total_chunks"),
        _sum("total_pages").alias("total_pages"), _sum("file_size").alias("_bytes"),
    )
    return per_user.select(
        "user_id", "total_documents", "total_chunks", "total_pages",
        F.round(_ratio(F.col("total_chunks"), F.col("total_pages")), 6).alias("avg_chunks_per_page"),
        F.round(F.col("_bytes") / 1048576, 6).alias("total_size_mb"),
    )


def user_statistics(documents: DataFrame, queries: DataFrame, now) -> DataFrame:
    now = F.lit(now).cast("timestamp")
    d = documents.groupBy("user_id").agg(
        F.count("*").alias("documents"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "processing", "failed")],
        _sum("total_pages").alias("total_pages"), _sum("total_chunks").alias("total_chunks"),
        _sum("file_size").alias("total_size"),
    )
    def after(days: int) -> Column:
        return F.count_if(F.col("created_at") > now - F.make_interval(days=F.lit(days)))

    q = queries.groupBy("user_id").agg(
        F.count("*").alias("queries"), F.round(_mean("confidence_score"), 6).alias("avg_confidence"),
        F.round(_mean("processing_time_ms"), 6).alias("avg_response_time"),
        after(7).alias("last_7_days"), after(30).alias("last_30_days"),
    )
    both = d.join(q, "user_id", "full")
    return both.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in both.columns if c != "user_id"])


def document_statistics(documents: DataFrame, since) -> DataFrame:
    rows = documents.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("total_documents"),
        F.count_if(F.col("status") == "completed").alias("completed_documents"),
        F.count_if(F.col("status") == "failed").alias("failed_documents"),
        F.round(F.count_if(F.col("status") == "completed") / F.count("*") * 100, 6).alias("success_rate"),
        half_up(_mean("total_pages"), 1).alias("avg_pages"),
        _sum("total_pages").alias("total_pages"), _sum("total_chunks").alias("total_chunks"),
    )


def query_statistics(queries: DataFrame, since) -> DataFrame:
    rows = queries.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    days = F.count_distinct(F.to_date("created_at"))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("total_queries"), half_up(_mean("confidence_score"), 2).alias("avg_confidence"),
        half_up(_mean("processing_time_ms"), 0).alias("avg_response_time"), days.alias("active_days"),
        half_up(_ratio(F.count("*"), days), 1).alias("avg_queries_per_day"),
    )


def storage_usage(documents: DataFrame, chunks: DataFrame, dim: int = 384) -> DataFrame:
    d = documents.groupBy("user_id").agg(
        _sum("file_size").alias("total_size"), F.count("*").alias("total_documents"),
        F.round(_mean("file_size"), 6).alias("average_size"),
    )
    c = chunks.groupBy("user_id").agg(F.count("*").alias("total_chunks"))
    out = (
        d.join(c, "user_id", "left")
        .withColumn("total_chunks", F.coalesce("total_chunks", F.lit(0)))
        .withColumn("vector_bytes", F.col("total_chunks") * dim * 4)
        .withColumn("text_bytes", F.col("total_chunks") * CHUNK_CHARS)
        .withColumn("total_bytes", F.col("total_size") + F.col("vector_bytes") + F.col("text_bytes"))
    )
    return out.withColumn("formatted_size", tx.format_bytes(F.col("total_bytes")))


def query_analytics(queries: DataFrame, since, days: int) -> DataFrame:
    """Totals, means, query frequency and the confidence bands of each user."""
    rows = queries.filter(F.col("created_at") >= F.lit(since).cast("timestamp"))
    confidence = F.coalesce("confidence_score", F.lit(0.0))
    rows = rows.withColumn("_sources", F.coalesce(F.greatest(F.size("sources"), F.lit(0)), F.lit(0)))
    return rows.groupBy("user_id").agg(
        F.count("*").alias("total_queries"), half_up(_mean("confidence_score"), 2).alias("avg_confidence"),
        half_up(_mean("processing_time_ms"), 0).alias("avg_processing_time"),
        half_up(F.avg("_sources"), 1).alias("avg_sources_per_query"),
        half_up(F.count("*") / F.lit(days), 2).alias("query_frequency"),
        F.count_if(confidence > 0.8).alias("high_confidence"),
        F.count_if((confidence >= 0.5) & (confidence <= 0.8)).alias("medium_confidence"),
        F.count_if(confidence < 0.5).alias("low_confidence"),
    )


def top_rows(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group with their position, or of the whole table."""
    if not by:
        return df.orderBy(*order).limit(n)
    position = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("position", position).filter(F.col("position") <= n)


def top_documents(queries: DataFrame, by=("user_id",), n: int = 5) -> DataFrame:
    """Most cited document names."""
    cited = queries.select(*by, F.explode("sources").alias("_s")).select(*by, F.col("_s.document_name").alias("name"))
    counts = cited.filter(F.col("name") != "").groupBy(*by, "name").agg(F.count("*").alias("query_count"))
    return top_rows(counts, list(by), [F.desc("query_count"), F.asc("name")], n)


def common_topics(queries: DataFrame, by=("user_id",), n: int = 10) -> DataFrame:
    """Most frequent words of the questions that occur more than once.

    Questions are dealt by `by` before their words are counted, so that a task counts the words of its own users only; counted
    where the rows lie, each task would hold the words of all users.
    """
    # stop words go after the count: far fewer rows to look at
    queries = queries.select(*by, "query_text")
    if by:
        queries = queries.repartition(*by)
    words = queries.select(*by, F.explode(tx.topic_words(F.col("query_text"), ())).alias("topic"))
    counts = (
        words.groupBy(*by, "topic").agg(F.count("*").alias("frequency"))
        .filter((F.col("frequency") > 1) & ~F.col("topic").isin(*STOP_WORDS))
    )
    return top_rows(counts, list(by), [F.desc("frequency"), F.asc("topic")], n)


def activity_bounds(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """First document and last activity of each user."""
    d = documents.select("user_id", "created_at", F.col("created_at").alias("_document_at"))
    q = queries.select("user_id", "created_at", F.lit(None).cast("timestamp").alias("_document_at"))
    return d.unionByName(q).groupBy("user_id").agg(
        F.min("_document_at").alias("first_document"), F.max("created_at").alias("last_activity"),
    )


def document_storage_stats(chunks: DataFrame) -> DataFrame:
    """Per document: chunks, chunks with and without embedding, mean dimension."""
    return chunks.groupBy("document_id").agg(
        F.count("*").alias("total_chunks"), F.count("embedding").alias("stored_chunks"),
        (F.count("*") - F.count("embedding")).alias("failed_chunks"),
        F.round(F.coalesce(F.avg(F.when(F.col("embedding").isNotNull(), F.size("embedding"))), F.lit(0.0)), 6).alias("avg_dimension"),
    )


def capacity(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    d = documents.groupBy("user_id").agg(F.count("*").alias("documents"))
    c = chunks.groupBy("user_id").agg(F.count("*").alias("chunks"))
    both = d.join(c, "user_id", "full").select(
        "user_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("chunks", F.lit(0)).alias("chunks"))
    percent = F.greatest(F.col("documents") / DOCUMENT_CAPACITY * 100, F.col("chunks") / CHUNK_CAPACITY * 100)
    return both.select(
        "*", half_up(F.col("chunks") * VECTOR_DIM * 4 / F.lit(float(2 ** 30)), 3).alias("estimated_vectors_gb"),
        half_up(percent, 1).alias("percent_of_limit"),
    )


def table_counts(**tables: DataFrame) -> DataFrame:
    """table_name, rows; parquet tables are counted from their footers."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def database_stats(documents: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """Documents, chunks, queries, users and chunks a document; users are counted, not guessed."""
    d = documents.agg(F.count("*").alias("documents"), F.count_distinct("user_id").alias("users"))
    c = chunks.agg(F.count("*").alias("chunks"))
    q = queries.agg(F.count("*").alias("queries"))
    both = d.withColumn("chunks", c.scalar()).withColumn("queries", q.scalar())
    return both.withColumn("avg_chunks_per_document", F.round(_ratio(F.col("chunks"), F.col("documents")), 6))


def chunking_totals(chunks: DataFrame, by=("document_id",)) -> DataFrame:
    return chunks.groupBy(*by).agg(
        F.count("*").alias("chunks"), F.sum("chunk_tokens").cast("bigint").alias("tokens"),
        F.round(F.avg("chunk_tokens"), 6).alias("avg_tokens"),
    )


def page_statistics(pages: DataFrame) -> DataFrame:
    return pages.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.sum(F.length("text")).alias("characters"),
        F.round(F.avg(F.length("text")), 0).alias("avg_characters"),
        F.count_if(F.coalesce(F.col("section_title"), F.lit("")) != "").alias("pages_with_title"),
    )


# --- usage and service logs -----------------------------------------------------------

def usage_stats(usage: DataFrame) -> DataFrame:
    """Per model: requests, tokens, mean latency, error rate, last request."""
    return usage.groupBy("model").agg(
        F.count("*").alias("requests"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.round(F.avg(F.when(F.col("ok"), 0.0).otherwise(1.0)), 6).alias("error_rate"),
        F.max("ts").alias("last_request"),
    )


def running_means(usage: DataFrame, order=("ts", "event_id")) -> DataFrame:
    """Mean latency of each model after every request; few models, so each spans many partitions."""
    out = running_totals(
        usage, ["model"], list(order),
        {"requests_so_far": F.lit(1), "_latency": F.col("latency_ms"),
         "_errors": F.when(F.col("ok"), 0).otherwise(1)},
    )
    return out.select(
        *usage.columns, "requests_so_far",
        F.round(F.col("_latency") / F.col("requests_so_far"), 6).alias("mean_latency_ms"),
        F.round(F.col("_errors") / F.col("requests_so_far"), 6).alias("error_rate_so_far"),
    )


def pipeline_stats(answers: DataFrame) -> DataFrame:
    """Totals, success rate, and means over the successful answers only."""
    def mean(column: str) -> Column:
        return F.round(F.coalesce(F.avg(F.when(F.col("success"), F.col(column))), F.lit(0.0)), 6)

    return answers.groupBy("user_id").agg(
        F.count("*").alias("total_queries"),
        F.round(F.avg(F.when(F.col("success"), 1.0).otherwise(0.0)), 6).alias("success_rate"),
        mean("processing_time_ms").alias("avg_response_ms"), mean("search_ms").alias("avg_search_ms"),
        mean("generation_ms").alias("avg_generation_ms"), mean("source_count").alias("avg_sources"),
    )


def search_stats(lookups: DataFrame) -> DataFrame:
    """Per user: searches, mean duration, mean results, share answered from the cache."""
    return lookups.groupBy("user_id").agg(
        F.count("*").alias("searches"), F.round(F.avg("search_ms"), 6).alias("avg_search_ms"),
        F.round(F.avg("results"), 6).alias("avg_results"),
        F.round(F.avg(F.when(F.col("cache_hit"), 1.0).otherwise(0.0)), 6).alias("cache_hit_rate"),
    )


def with_prices(usage: DataFrame) -> DataFrame:
    """Add the price per 1000 tokens of each row's model; unknown models cost what the default does."""
    spark = usage.sparkSession
    table = spark.createDataFrame(
        [(m, p, c) for m, (p, c) in PRICES.items()], "model string, _prompt double, _completion double"
    )
    prompt, completion = PRICES[DEFAULT_PRICE_MODEL]
    return (
        usage.join(F.broadcast(table), "model", "left")  # a handful of models
        .withColumn("prompt_price", F.coalesce("_prompt", F.lit(prompt)))
        .withColumn("completion_price", F.coalesce("_completion", F.lit(completion)))
        .drop("_prompt", "_completion")
    )


def with_cost(usage: DataFrame) -> DataFrame:
    cost = (
        F.col("prompt_tokens") / 1000 * F.col("prompt_price")
        + F.col("completion_tokens") / 1000 * F.col("completion_price")
    )
    return with_prices(usage).withColumn("cost", cost)


def embedding_cost(tokens: Column, model: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in EMBEDDING_PRICES.items() for x in pair])
    return tokens * F.coalesce(F.try_element_at(table, model), F.lit(EMBEDDING_PRICES[DEFAULT_EMBEDDING_PRICE_MODEL]))


def cost_analysis(usage: DataFrame) -> DataFrame:
    """Per model: cost, cost a request and a token, tokens a second and a dollar."""
    totals = with_cost(usage).groupBy("model").agg(
        F.sum("cost").alias("_cost"), F.count("*").alias("requests"),
        F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"),
        F.sum("latency_ms").alias("_ms"),
    )
    cost = half_up(F.col("_cost"), 4)
    return totals.select(
        "model", "requests", "tokens", cost.alias("total_cost"),
        half_up(_ratio(F.col("_cost"), F.col("requests")), 4).alias("cost_per_request"),
        half_up(_ratio(F.col("_cost"), F.col("tokens")), 6).alias("cost_per_token"),
        half_up(_ratio(F.col("tokens"), F.col("_ms") / 1000), 1).alias("tokens_per_second"),
        half_up(_ratio(F.col("tokens"), cost), 0).alias("tokens_per_dollar"),
    )


def usage_buckets(usage: DataFrame, seconds: int, by: list[str] | None = None) -> DataFrame:
    """Requests, errors, mean and 95th percentile of latency per time bucket."""
    bucket = F.window("ts", f"{seconds} seconds")["start"].alias("bucket")
    return usage.groupBy(*(by or []), bucket).agg(
        F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("errors"),
        F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
        F.round(F.percentile("latency_ms", 0.95), 6).alias("p95_latency_ms"),
    )


# Fixed values: (seconds a bucket, number of buckets) of a metrics timeframe.
METRIC_BUCKETS = {"1h": (300, 12), "24h": (3600, 24)}
DEFAULT_METRIC_BUCKETS = (3600, 7)


def usage_metrics(usage: DataFrame, now, timeframe: str = "24h") -> DataFrame:
    """The last buckets of a timeframe before `now`."""
    seconds, n = METRIC_BUCKETS.get(timeframe, DEFAULT_METRIC_BUCKETS)
    end = F.lit(now).cast("timestamp")
    start = end - F.make_interval(secs=F.lit(seconds * n).cast("decimal(18,6)"))
    return usage_buckets(usage.filter((F.col("ts") >= start) & (F.col("ts") < end)), seconds)


def history_page_stats(queries: DataFrame, page: DataFrame) -> DataFrame:
    """Total of the whole result, means of the page only."""
    total = queries.agg(F.count("*").alias("total_queries"))
    means = page.agg(
        half_up(_mean("confidence_score"), 2).alias("avg_confidence"),
        half_up(_mean("processing_time_ms"), 0).alias("avg_processing_time"),
    )
    return means.withColumn("total_queries", total.scalar())


# --- evaluation -----------------------------------------------------------------------

# Shares a labelled set must reach.
PAGE_BAR, KEYWORD_BAR, FORMAT_BAR = 0.8, 0.6, 0.8
CITATION_FORMAT = r"\(.*[Pp]age \d+.*\)"


def retrieval_hits(answers: DataFrame) -> DataFrame:
    """Per answer (answer, sources, expected_page, expected_keywords): page found, keyword recall, citation form."""
    lower = F.lower("answer")
    found = F.filter("expected_keywords", lambda k: lower.contains(F.lower(k)))
    return (
        answers.withColumn("page_found", F.exists("sources", lambda s: s["page_number"] == F.col("expected_page")))
        .withColumn("keyword_recall", _ratio(F.size(found), F.size("expected_keywords")))
        .withColumn("citation_format", F.col("answer").rlike(CITATION_FORMAT) | (F.size("sources") > 0))
    )


def retrieval_evaluation(answers: DataFrame, by: list[str]) -> DataFrame:
    """Shares over a labelled set and whether all three bars are reached."""
    def share(column: str) -> Column:
        return F.avg(F.when(F.col(column), 1.0).otherwise(0.0))

    scored = retrieval_hits(answers).groupBy(*by).agg(
        F.count("*").alias("questions"), share("page_found").alias("_page"),
        F.avg("keyword_recall").alias("_keyword"), share("citation_format").alias("_format"),
    )
    passed = (F.col("_page") >= PAGE_BAR) & (F.col("_keyword") >= KEYWORD_BAR) & (F.col("_format") >= FORMAT_BAR)
    return scored.select(
        *by, "questions", F.round("_page", 6).alias("page_accuracy"), F.round("_keyword", 6).alias("keyword_match"),
        F.round("_format", 6).alias("citation_format_accuracy"), passed.alias("passed"),
    )
