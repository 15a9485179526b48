"""Streaming jobs and their batch twins. A stream reads the whole table and stops when nothing is left."""

import uuid

from pyspark.sql import functions as F

from checks.registry import check
from checks.texts import page_cut_sql
from checks.views import pick
from quire.operators import analytics, windows
from quire.operators.hooks import Embedder
from quire.session import ensure_checkpoint_dir
from quire.streaming import jobs


def stream_of(v, name):
    schema = v.table(name).schema
    return v.spark.readStream.schema(schema).parquet(f"{v.dir}/{name}.parquet*")


def drain(v, stream, mode="append"):
    """Run a stream over everything there is and return what it wrote.

    Append streams write files; the others hand over their whole result each time.
    """
    folder = scratch(v)

    def write(batch, _):
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(f"{folder}/out")

    (stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
     .trigger(availableNow=True).foreachBatch(write).start().awaitTermination())
    return v.spark.read.parquet(f"{folder}/out")


def scratch(v):
    """A new folder next to the checkpoints, which every executor can reach."""
    return f"{ensure_checkpoint_dir(v.spark)}/{uuid.uuid4().hex}"


# --- first uploads ------------------------------------------------------------------

@check("first_upload_stream", "S2 C10", """
    SELECT DISTINCT lang, sha256(text) AS file_hash FROM documents
""")
def first_upload_stream(v):
    uploads = stream_of(v, "documents").select("lang", F.sha2("text", 256).alias("file_hash"))
    return drain(v, jobs.first_upload_stream(uploads, "lang"))


# --- windows that start at the first event -------------------------------------------

def _anchored(key: str, seconds: int) -> str:
    """Windows of each key, one recursion step a window."""
    return f"""
    WITH RECURSIVE ev AS (SELECT event_id, ts, {key} AS k FROM events),
    w AS (
        SELECT k, min(ts) AS start FROM ev GROUP BY k
        UNION ALL
        SELECT w.k, (SELECT min(ev.ts) FROM ev WHERE ev.k = w.k AND ev.ts > w.start + INTERVAL {seconds} SECOND) FROM w WHERE w.start IS NOT NULL),
    placed AS (SELECT ev.event_id, ev.ts, ev.k, w.start, row_number() OVER (PARTITION BY ev.k, w.start ORDER BY ev.ts, ev.event_id) AS position
               FROM ev JOIN w ON w.k = ev.k AND ev.ts >= w.start AND ev.ts <= w.start + INTERVAL {seconds} SECOND)
    """


_LIMIT_SQL = _anchored("user_id % 5", 900) + """
    SELECT event_id, position, position <= 3 AS allowed,
           CASE WHEN position > 3 THEN CAST(ceil((epoch_us(start) + 900000000 - epoch_us(ts)) / 1000000.0) AS BIGINT) END AS retry_after FROM placed
"""
_CACHE_SQL = _anchored("'u' || (user_id % 10) || ':' || event_type", 300) + """
    SELECT event_id, position > 1 AS cache_hit FROM placed
"""


@check("rate_limit_audit", "S3", _LIMIT_SQL)
def rate_limit_audit(v):
    events = v.table("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).alias("client_id"))
    return windows.rate_limit_audit(events, 3, 900).select("event_id", "position", "allowed", "retry_after")


@check("rate_limit_stream", "S3", _LIMIT_SQL)
def rate_limit_stream(v):
    events = stream_of(v, "events").select("event_id", "ts", (F.col("user_id") % 5).alias("client_id"))
    return drain(v, jobs.rate_limit_stream(events, limit=(3, 900))).select("event_id", "position", "allowed", "retry_after")


def lookups(events):
    key = F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"), F.lit(":"), "event_type")
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), key.alias("cache_key"))


@check("cache_audit", "S4", _CACHE_SQL)
def cache_audit(v):
    return windows.cache_audit(lookups(v.table("events"))).select("event_id", "cache_hit")


@check("cache_stream", "S4", _CACHE_SQL)
def cache_stream(v):
    return drain(v, jobs.cache_stream(lookups(stream_of(v, "events")))).select("event_id", "cache_hit")


@check("cache_keys", "S4", """
    SELECT chunk_id, user_id || ':' || array_to_string(list_transform(embedding[1:5], lambda x: printf('%.4f', round(x, 4))), ',') || ':10:0.65:a,b' AS key
    FROM chunk_vectors
""", ("chunk_vectors",))
def cache_keys(v):
    docs = F.array(F.lit("b"), F.lit("a"))  # the key rounds the values itself and keeps the sign of those near zero
    return v.chunk_vectors.select("chunk_id", windows.cache_key(F.col("user_id"), F.col("embedding"), F.lit(10), F.lit(0.65), docs).alias("key"))


@check("search_stats", "D24 S4", _anchored("'u' || (user_id % 10) || ':' || event_type", 300) + """
    SELECT user_id, count(*) AS searches, round(avg(CAST(round(value * 10) AS BIGINT)), 6) AS avg_search_ms, round(avg(event_id % 11), 6) AS avg_results,
           round(avg((position > 1)::INT), 6) AS cache_hit_rate
    FROM placed JOIN events USING (event_id) GROUP BY user_id
""")
def search_stats(v):
    judged = windows.cache_audit(lookups(v.table("events"))).select("event_id", "cache_hit")
    joined = v.table("events").join(judged, "event_id").withColumns({
        "search_ms": F.round(F.col("value") * 10).cast("bigint"), "results": F.col("event_id") % 11})
    return analytics.search_stats(joined)


# --- status and usage -------------------------------------------------------------------

_STATUS = ["pending", "processing", "processing", "completed", "failed"]
_STAGE = [None, "chunking", "embedding", None, "storing"]


@check("status_stream", "S5 H25", """
    WITH latest AS (SELECT event_id % 301 AS document_id, max(ts) AS ts, arg_max(event_id, ts) % 5 AS s FROM events GROUP BY ALL)
    SELECT document_id, ['pending', 'processing', 'processing', 'completed', 'failed'][s + 1] AS status, [0, 50, 70, 100, 0][s + 1] AS percentage,
           ['queued', 'chunking', 'embedding', 'completed', 'storing'][s + 1] AS stage, s >= 3 AS finished
    FROM latest
""")
def status_stream(v):
    i = F.col("event_id")
    events = stream_of(v, "events").select(
        (i % 301).alias("document_id"), F.col("ts").cast("timestamp").alias("ts"), pick(_STATUS, i % 5).alias("status"),
        pick(_STAGE, i % 5).alias("processing_stage"), F.lit(None).cast("string").alias("error_message"))
    return drain(v, jobs.status_stream(events), "complete").select("document_id", "status", "percentage", "stage", "finished")


@check("usage_metrics", "S6", """
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS requests, count(*) FILTER (NOT ok) AS errors,
           round(avg(latency_ms), 6) AS avg_latency_ms, round(quantile_cont(latency_ms, 0.95), 6) AS p95_latency_ms
    FROM usage_log GROUP BY ALL
""", ("usage_log",))
def usage_metrics(v):
    return analytics.usage_buckets(v.usage_log, 3600).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm"))


@check("recent_usage", "S6", """
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS requests, count(*) FILTER (NOT ok) AS errors
    FROM usage_log WHERE ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31' GROUP BY ALL
""", ("usage_log",))
def recent_usage(v):
    metrics = analytics.usage_metrics(v.usage_log, "2024-01-31 00:00:00", "24h")
    return metrics.select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "requests", "errors")


@check("usage_metrics_stream", "S6", """
    SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS bucket, count(*) AS requests, count(*) FILTER (NOT ok) AS errors,
           round(avg(latency_ms), 6) AS avg_latency_ms
    FROM usage_log GROUP BY ALL
""", ("usage_log",))
def usage_metrics_stream(v):
    usage = stream_of(v, "events").select("ts", (F.col("event_type") != "error").alias("ok"), F.round(F.col("value") * 10).cast("bigint").alias("latency_ms"))
    out = drain(v, jobs.usage_metrics_stream(usage), "complete")
    return out.select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "requests", "errors", "avg_latency_ms")


# --- ingest -------------------------------------------------------------------------------

@check("ingest_stream", "S1 A7 U1", "WITH RECURSIVE" + page_cut_sql("SELECT * FROM doc_pages", 800, 150) + """
    SELECT user_id, document_id, count(*) AS chunks, CAST(sum(CAST(ceil(length(chunk_text) / 4.0) AS INT)) AS BIGINT) AS tokens
    FROM numbered JOIN (SELECT DISTINCT document_id, user_id FROM doc_pages) USING (document_id) GROUP BY ALL
""", ("doc_pages",))
def ingest_stream(v):
    """Documents arrive, are cut, embedded and stored; what lies in the chunk table is counted."""
    folder = scratch(v)
    documents = stream_of(v, "documents").select(F.col("doc_id").alias("document_id"), F.col("source").alias("user_id"), "text")
    query = jobs.start_ingest(documents, f"{folder}/chunks", f"{folder}/rejects", f"{folder}/status", f"{folder}/state", Embedder(64))
    query.awaitTermination()
    stored = v.spark.read.parquet(f"{folder}/chunks")
    return stored.groupBy("user_id", "document_id").agg(F.count("*").alias("chunks"), F.sum("chunk_tokens").alias("tokens"))
