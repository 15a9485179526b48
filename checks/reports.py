"""Reports over documents, chunks, query logs and usage."""

from pyspark.sql import functions as F

from checks.registry import check
from checks.views import NOW
from quire.operators import analytics as an
from quire.operators import integrity, listing


def stamp(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


_S = "'%Y-%m-%d %H:%M:%S'"
_WEEK, _MONTH = "2024-01-24 00:00:00", "2024-01-01 00:00:00"


@check("collection_stats", "D1 C2", """
    SELECT user_id, count(*) AS total_documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS total_chunks, CAST(sum(total_pages) AS BIGINT) AS total_pages,
           round(coalesce(sum(n), 0) / sum(total_pages), 6) AS avg_chunks_per_page, round(sum(file_size) / 1048576, 6) AS total_size_mb
    FROM user_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunks GROUP BY document_id) USING (document_id)
    WHERE status = 'completed' GROUP BY user_id
""", ("user_documents", "chunks"))
def collection_stats(v):
    return an.collection_stats(v.user_documents, v.chunks)


@check("chunks_per_document", "C2", """
    SELECT document_id, filename, coalesce(n, 0) AS chunk_count
    FROM user_documents LEFT JOIN (SELECT document_id, count(*) AS n FROM chunk_vectors GROUP BY document_id) USING (document_id)
""", ("user_documents", "chunk_vectors"))
def chunks_per_document(v):
    joined = v.user_documents.select("document_id", "filename").join(an.chunks_per_document(v.chunk_vectors), "document_id", "left")
    return joined.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)))


def owned_log(v):
    return v.query_log.withColumn("user_id", F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")))


_LOG = "log AS (SELECT * REPLACE ('src' || (user_id % 25) AS user_id) FROM query_log)"


@check("user_statistics", "D2", f"""
    WITH {_LOG},
    d AS (SELECT user_id, count(*) AS documents, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'processing') AS processing,
                 count(*) FILTER (status = 'failed') AS failed, CAST(sum(total_pages) AS BIGINT) AS total_pages,
                 CAST(sum(total_chunks) AS BIGINT) AS total_chunks, CAST(sum(file_size) AS BIGINT) AS total_size FROM user_documents GROUP BY user_id),
    q AS (SELECT user_id, count(*) AS queries, round(avg(confidence_score), 6) AS avg_confidence, round(avg(processing_time_ms), 6) AS avg_response_time,
                 count(*) FILTER (created_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY) AS last_7_days,
                 count(*) FILTER (created_at > TIMESTAMP '{NOW}' - INTERVAL 30 DAY) AS last_30_days FROM log GROUP BY user_id)
    SELECT user_id, coalesce(documents, 0) AS documents, coalesce(completed, 0) AS completed, coalesce(processing, 0) AS processing,
           coalesce(failed, 0) AS failed, coalesce(total_pages, 0) AS total_pages, coalesce(total_chunks, 0) AS total_chunks,
           coalesce(total_size, 0) AS total_size, coalesce(queries, 0) AS queries, coalesce(avg_confidence, 0) AS avg_confidence,
           coalesce(avg_response_time, 0) AS avg_response_time, coalesce(last_7_days, 0) AS last_7_days, coalesce(last_30_days, 0) AS last_30_days
    FROM d FULL JOIN q USING (user_id)
""", ("user_documents", "query_log"))
def user_statistics(v):
    return an.user_statistics(v.user_documents, owned_log(v), NOW)


@check("document_statistics", "D3 H27", """
    SELECT user_id, count(*) AS total_documents, count(*) FILTER (status = 'completed') AS completed_documents,
           count(*) FILTER (status = 'failed') AS failed_documents, round(count(*) FILTER (status = 'completed') / count(*) * 100, 6) AS success_rate,
           round(round(avg(total_pages), 9), 1) AS avg_pages, CAST(sum(total_pages) AS BIGINT) AS total_pages, CAST(sum(total_chunks) AS BIGINT) AS total_chunks
    FROM user_documents WHERE created_at >= TIMESTAMP '2024-01-01 02:00:00' GROUP BY user_id
""", ("user_documents",))
def document_statistics(v):
    return an.document_statistics(v.user_documents, "2024-01-01 02:00:00")


@check("query_statistics", "D4", f"""
    SELECT user_id, count(*) AS total_queries, round(round(avg(confidence_score), 9), 2) AS avg_confidence, round(round(avg(processing_time_ms), 9), 0) AS avg_response_time,
           count(DISTINCT created_at::DATE) AS active_days, round(round(count(*) / count(DISTINCT created_at::DATE), 9), 1) AS avg_queries_per_day
    FROM query_log WHERE created_at >= TIMESTAMP '{_WEEK}' GROUP BY user_id
""", ("query_log",))
def query_statistics(v):
    return an.query_statistics(v.query_log, _WEEK)


@check("storage_usage", "D5 H15", """
    WITH d AS (SELECT user_id, CAST(sum(file_size) AS BIGINT) AS total_size, count(*) AS total_documents, round(avg(file_size), 6) AS average_size
               FROM user_documents GROUP BY user_id),
    c AS (SELECT user_id, count(*) AS n FROM chunks GROUP BY user_id),
    t AS (SELECT *, coalesce(n, 0) AS total_chunks, coalesce(n, 0) * 384 * 4 AS vector_bytes, coalesce(n, 0) * 500 AS text_bytes,
                 total_size + coalesce(n, 0) * 384 * 4 + coalesce(n, 0) * 500 AS total_bytes FROM d LEFT JOIN c USING (user_id))
    SELECT user_id, total_size, total_documents, average_size, total_chunks, vector_bytes, text_bytes, total_bytes,
           CASE WHEN total_bytes < 1048576 THEN regexp_replace(printf('%.2f', round(total_bytes / 1024, 2)), '\\.?0+$', '') || ' KB'
                ELSE regexp_replace(printf('%.2f', round(total_bytes / 1048576, 2)), '\\.?0+$', '') || ' MB' END AS formatted_size
    FROM t
""", ("user_documents", "chunks"))
def storage_usage(v):
    return an.storage_usage(v.user_documents, v.chunks)


@check("query_analytics", "D6 D7", f"""
    SELECT user_id, count(*) AS total_queries, round(round(avg(confidence_score), 9), 2) AS avg_confidence, round(round(avg(processing_time_ms), 9), 0) AS avg_processing_time,
           round(round(avg(len(sources)), 9), 1) AS avg_sources_per_query, round(round(count(*) / 30, 9), 2) AS query_frequency,
           count(*) FILTER (confidence_score > 0.8) AS high_confidence, count(*) FILTER (confidence_score >= 0.5 AND confidence_score <= 0.8) AS medium_confidence,
           count(*) FILTER (confidence_score < 0.5) AS low_confidence
    FROM query_log WHERE created_at >= TIMESTAMP '{_MONTH}' GROUP BY user_id
""", ("query_log",))
def query_analytics(v):
    return an.query_analytics(v.query_log, _MONTH, 30)


@check("top_documents", "D8", """
    WITH cited AS (SELECT user_id, unnest(sources).document_name AS name FROM query_log)
    SELECT user_id, name, query_count, CAST(position AS INT) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY query_count DESC, name) AS position
        FROM (SELECT user_id, name, count(*) AS query_count FROM cited GROUP BY ALL)) WHERE position <= 5
""", ("query_log",))
def top_documents(v):
    return an.top_documents(v.query_log)


_STOPS = ", ".join(f"'{w}'" for w in an.STOP_WORDS)


@check("common_topics", "D9", f"""
    WITH words AS (SELECT user_id, unnest(regexp_split_to_array(regexp_replace(lower(query_text), '[^\\w\\s]', ' ', 'g'), '\\s+')) AS topic FROM query_log)
    SELECT user_id, topic, frequency, CAST(position AS INT) AS position FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY frequency DESC, topic) AS position FROM (
            SELECT user_id, topic, count(*) AS frequency FROM words WHERE length(topic) > 2 AND topic NOT IN ({_STOPS}) GROUP BY ALL HAVING count(*) > 1))
    WHERE position <= 10
""", ("query_log",))
def common_topics(v):
    return an.common_topics(v.query_log)


@check("overall_topics", "D9", f"""
    WITH words AS (SELECT unnest(regexp_split_to_array(regexp_replace(lower(query_text), '[^\\w\\s]', ' ', 'g'), '\\s+')) AS topic FROM query_log)
    SELECT topic, count(*) AS frequency FROM words WHERE length(topic) > 2 AND topic NOT IN ({_STOPS})
    GROUP BY ALL HAVING count(*) > 1 ORDER BY frequency DESC, topic LIMIT 10
""", ("query_log",))
def overall_topics(v):
    return an.common_topics(v.query_log, by=())


@check("activity_bounds", "D10", f"""
    WITH {_LOG}
    SELECT user_id, strftime(min(d), {_S}) AS first_document, strftime(max(t), {_S}) AS last_activity FROM (
        SELECT user_id, created_at AS d, created_at AS t FROM user_documents UNION ALL SELECT user_id, NULL, created_at FROM log) GROUP BY user_id
""", ("user_documents", "query_log"))
def activity_bounds(v):
    bounds = an.activity_bounds(v.user_documents, owned_log(v))
    return bounds.select("user_id", stamp("first_document").alias("first_document"), stamp("last_activity").alias("last_activity"))


def gappy(v):
    """chunk_vectors with a missing embedding here and there and two dimensions in some documents."""
    i = F.col("chunk_id")
    return v.chunk_vectors.withColumn("chunk_index", F.floor(i / 50) + F.when(i % 7 == 0, 1).otherwise(0)).withColumn(
        "embedding", F.when(i % 13 == 0, None).when(i % 17 == 0, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")))


_GAPPY = """
    gappy AS (SELECT chunk_id, document_id, page_number, chunk_id // 50 + CASE WHEN chunk_id % 7 = 0 THEN 1 ELSE 0 END AS chunk_index,
                     CASE WHEN chunk_id % 13 = 0 THEN NULL WHEN chunk_id % 17 = 0 THEN embedding[1:32] ELSE embedding END AS embedding
              FROM chunk_vectors)"""


@check("document_storage_stats", "D11 B5", f"""
    WITH {_GAPPY}
    SELECT document_id, count(*) AS total_chunks, count(embedding) AS stored_chunks, count(*) - count(embedding) AS failed_chunks,
           round(coalesce(avg(len(embedding)), 0), 6) AS avg_dimension
    FROM gappy GROUP BY document_id
""", ("chunk_vectors",))
def document_storage_stats(v):
    return an.document_storage_stats(gappy(v))


@check("storage_issues", "D18 E4", f"""
    WITH {_GAPPY}, counted AS (SELECT document_id, chunk_index, count(*) AS rows FROM gappy GROUP BY ALL),
    steps AS (SELECT *, lag(chunk_index) OVER (PARTITION BY document_id ORDER BY chunk_index) AS p FROM counted),
    dims AS (SELECT document_id, len(embedding) AS dim, count(*) AS n FROM gappy WHERE len(embedding) > 0 GROUP BY ALL)
    SELECT document_id, 'missing embeddings' AS issue, '' AS detail, count(*) AS rows FROM gappy WHERE embedding IS NULL GROUP BY document_id
    UNION ALL SELECT document_id, 'index gap', p || '-' || chunk_index, 1 FROM steps WHERE chunk_index <> p + 1
    UNION ALL SELECT document_id, 'duplicate index', CAST(chunk_index AS VARCHAR), rows FROM counted WHERE rows > 1
    UNION ALL SELECT document_id, 'mixed dimensions', string_agg(dim, ', ' ORDER BY dim), CAST(sum(n) AS BIGINT) FROM dims GROUP BY document_id HAVING count(*) > 1
""", ("chunk_vectors",))
def storage_issues(v):
    return integrity.storage_issues(gappy(v))


_SHIFTED = """
    shifted AS (SELECT document_id, chunk_index + CASE WHEN chunk_index >= 5 THEN 2 ELSE 0 END AS chunk_index,
                       CASE WHEN document_id % 9 = 0 THEN 10 - page_number ELSE page_number END AS page_number,
                       CASE WHEN chunk_index % 11 = 10 THEN ' ' ELSE chunk_text END AS chunk_text, chunk_tokens FROM chunks),
    stepped AS (SELECT *, lag(chunk_index) OVER w AS pi, lag(page_number) OVER w AS pp FROM shifted WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index))"""


def shifted(v):
    i = F.col("chunk_index")
    return v.chunks.select(
        "document_id", (i + F.when(i >= 5, 2).otherwise(0)).alias("chunk_index"),
        F.when(F.col("document_id") % 9 == 0, 10 - F.col("page_number")).otherwise(F.col("page_number")).alias("page_number"),
        F.when(i % 11 == 10, " ").otherwise(F.col("chunk_text")).alias("chunk_text"), "chunk_tokens")


@check("chunk_validation", "D16 E4 E5", f"""
    WITH {_SHIFTED}, per_page AS (SELECT document_id, count(*) AS pages, max(n) AS max_chunks_per_page FROM (
        SELECT document_id, page_number, count(*) AS n FROM shifted GROUP BY ALL) GROUP BY document_id)
    SELECT document_id, count(*) FILTER (trim(chunk_text) = '') AS empty_chunks, count(*) FILTER (chunk_index <> pi + 1) AS index_gaps,
           count(*) FILTER (page_number < pp) AS backward_pages, min(chunk_tokens) AS min_tokens, round(avg(chunk_tokens), 6) AS avg_tokens,
           max(chunk_tokens) AS max_tokens, any_value(pages) AS pages, any_value(max_chunks_per_page) AS max_chunks_per_page,
           count(*) FILTER (trim(chunk_text) = '' OR chunk_index <> pi + 1 OR page_number < pp) = 0 AS valid
    FROM stepped JOIN per_page USING (document_id) GROUP BY document_id
""", ("chunks",))
def chunk_validation(v):
    return integrity.chunk_validation(shifted(v))


@check("index_gaps", "E4", f"""
    WITH {_SHIFTED} SELECT document_id, pi AS from_index, chunk_index AS to_index FROM stepped WHERE chunk_index <> pi + 1
""", ("chunks",))
def index_gaps(v):
    return integrity.index_gaps(shifted(v))


@check("backward_pages", "E5", f"""
    WITH {_SHIFTED} SELECT document_id, chunk_index, pp AS prev_page_number, page_number FROM stepped WHERE page_number < pp
""", ("chunks",))
def backward_pages(v):
    return integrity.backward_pages(shifted(v))


@check("capacity", "D12", """
    WITH d AS (SELECT user_id, count(*) AS documents FROM user_documents GROUP BY user_id), c AS (SELECT user_id, count(*) AS chunks FROM chunks GROUP BY user_id)
    SELECT user_id, documents, chunks, round(round(chunks * 1536 * 4 / 1073741824, 9), 3) AS estimated_vectors_gb,
           round(round(greatest(documents / 8 * 100, chunks / 30000 * 100), 9), 1) AS percent_of_limit
    FROM d JOIN c USING (user_id)
""", ("user_documents", "chunks"))
def capacity(v):
    return an.capacity(v.user_documents, v.chunks)


@check("table_counts", "D13", """
    SELECT 'documents' AS table_name, count(*) AS rows FROM documents UNION ALL SELECT 'chunks', count(*) FROM embeddings
    UNION ALL SELECT 'queries', count(*) FROM events
""")
def table_counts(v):
    return an.table_counts(documents=v.table("documents"), chunks=v.table("embeddings"), queries=v.table("events"))


@check("database_stats", "D14", """
    SELECT (SELECT count(*) FROM user_documents) AS documents, (SELECT count(DISTINCT user_id) FROM user_documents) AS users,
           (SELECT count(*) FROM chunk_vectors) AS chunks, (SELECT count(*) FROM events) AS queries,
           round((SELECT count(*) FROM chunk_vectors) / (SELECT count(*) FROM user_documents), 6) AS avg_chunks_per_document
""", ("user_documents", "chunk_vectors"))
def database_stats(v):
    return an.database_stats(v.user_documents, v.chunk_vectors, v.table("events"))


# --- usage ------------------------------------------------------------------------------

@check("usage_stats", "D22", f"""
    SELECT model, count(*) AS requests, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(avg(latency_ms), 6) AS avg_latency_ms,
           round(avg(CASE WHEN ok THEN 0 ELSE 1 END), 6) AS error_rate, strftime(max(ts), {_S}) AS last_request
    FROM usage_log GROUP BY model
""", ("usage_log",))
def usage_stats(v):
    return an.usage_stats(v.usage_log).withColumn("last_request", stamp("last_request"))


@check("running_means", "E6", """
    SELECT event_id, count(*) OVER w AS requests_so_far, round(avg(latency_ms) OVER w, 6) AS mean_latency_ms,
           round(avg(CASE WHEN ok THEN 0 ELSE 1 END) OVER w, 6) AS error_rate_so_far
    FROM usage_log WINDOW w AS (PARTITION BY model ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""", ("usage_log",))
def running_means(v):
    return an.running_means(v.usage_log).select("event_id", "requests_so_far", "mean_latency_ms", "error_rate_so_far")


@check("pipeline_stats", "D23", """
    SELECT user_id, count(*) AS total_queries, round(avg(success::INT), 6) AS success_rate,
           round(coalesce(avg(processing_time_ms) FILTER (success), 0), 6) AS avg_response_ms, round(coalesce(avg(processing_time_ms // 5) FILTER (success), 0), 6) AS avg_search_ms,
           round(coalesce(avg(processing_time_ms - processing_time_ms // 5) FILTER (success), 0), 6) AS avg_generation_ms,
           round(coalesce(avg(len(sources)) FILTER (success), 0), 6) AS avg_sources
    FROM query_log GROUP BY user_id
""", ("query_log",))
def pipeline_stats(v):
    search = F.floor(F.col("processing_time_ms") / 5)
    return an.pipeline_stats(v.query_log.withColumns({
        "search_ms": search, "generation_ms": F.col("processing_time_ms") - search, "source_count": F.size("sources")}))


@check("priced_usage", "C13", """
    SELECT event_id, map {'gpt-4': 0.03, 'gpt-4-turbo': 0.01, 'gpt-3.5-turbo': 0.0005, 'local-7b': 0.0005}[model]::DOUBLE AS prompt_price,
           map {'gpt-4': 0.06, 'gpt-4-turbo': 0.03, 'gpt-3.5-turbo': 0.0015, 'local-7b': 0.0015}[model]::DOUBLE AS completion_price
    FROM usage_log
""", ("usage_log",))
def priced_usage(v):
    return an.with_prices(v.usage_log).select("event_id", "prompt_price", "completion_price")


@check("cost_analysis", "D25 C13", """
    WITH p AS (SELECT *, CASE model WHEN 'gpt-4' THEN 0.03 WHEN 'gpt-4-turbo' THEN 0.01 ELSE 0.0005 END::DOUBLE AS pp,
                      CASE model WHEN 'gpt-4' THEN 0.06 WHEN 'gpt-4-turbo' THEN 0.03 ELSE 0.0015 END::DOUBLE AS cp FROM usage_log),
    t AS (SELECT model, sum(prompt_tokens / 1000 * pp + completion_tokens / 1000 * cp) AS cost, count(*) AS requests,
                 CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, sum(latency_ms) AS ms FROM p GROUP BY model)
    SELECT model, requests, tokens, round(round(cost, 9), 4) AS total_cost, round(round(cost / requests, 9), 4) AS cost_per_request, round(cost / tokens, 6) AS cost_per_token,
           round(round(tokens / (ms / 1000), 9), 1) AS tokens_per_second, round(round(tokens / round(round(cost, 9), 4), 9), 0) AS tokens_per_dollar
    FROM t
""", ("usage_log",))
def cost_analysis(v):
    return an.cost_analysis(v.usage_log)


@check("history_page_stats", "D26", """
    WITH page AS (SELECT * FROM query_log ORDER BY created_at DESC, query_id LIMIT 20)
    SELECT (SELECT count(*) FROM query_log) AS total_queries, round(round(avg(confidence_score), 9), 2) AS avg_confidence,
           round(round(avg(processing_time_ms), 9), 0) AS avg_processing_time FROM page
""", ("query_log",))
def history_page_stats(v):
    page = listing.page_of(v.query_log, [F.desc("created_at"), F.asc("query_id")], 1, 20)
    return an.history_page_stats(v.query_log, page)


@check("embedding_cost", "D25", """
    SELECT doc_id, round(ceil(n_chars / 4.0) * CASE WHEN doc_id % 2 = 0 THEN 0.00013 ELSE 0.00002 END::DOUBLE, 6)::DOUBLE AS micro_dollars FROM documents
""")
def embedding_cost(v):
    model = F.when(F.col("doc_id") % 2 == 0, "text-embedding-3-large").otherwise("another")
    cost = an.embedding_cost(F.ceil(F.col("n_chars") / 4), model)
    return v.table("documents").select("doc_id", F.round(cost * 1000000, 6).alias("micro_dollars"))
