"""Structured Streaming jobs: ingest, first uploads, audits, status and usage metrics."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions.status import progress
from quire.operators.hooks import Embedder
from quire.operators.windows import _NEVER, LIMITS, _walk
from quire.plans.ingest import ingest
from quire.session import checkpoint, small_batches
from quire.sources.tables import put


def first_upload_stream(uploads: DataFrame, owner: str = "user_id", watermark: str | None = None,
                        time: str = "created_at") -> DataFrame:
    """Only the first upload of each (owner, hash); with a watermark old hashes leave the state."""
    if watermark:
        return uploads.withWatermark(time, watermark).dropDuplicatesWithinWatermark([owner, "file_hash"])
    return uploads.dropDuplicates([owner, "file_hash"])


# Rows of a stream's result made at once.
_SLICE = 50_000
# Stands for a missing time, after all others.
_NO_TIME = 1 << 62


def _ordered(times: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order by time, then id, for ids that numpy cannot sort as numbers; null ids last."""
    by_id = pd.Series(ids).sort_values(kind="stable").index.to_numpy()
    return by_id[np.argsort(times[by_id], kind="stable")]


def window_stream(events: DataFrame, key: str, time: str, order_id: str, seconds: int,
                  watermark: str = "1 hour") -> DataFrame:
    """Streaming twin of `anchored_windows`: key, id, time, window_start, position.

    State is one (end, count) pair a key and leaves once the watermark passes the window's end:
    the key's next event opens a new window in any case. A key's events of one batch are held as two numbers each
    (ids that are no numbers as objects) and leave in slices.
    """
    width = seconds * 1_000_000
    id_type = events.schema[order_id].dataType
    out = T.StructType([
        T.StructField(key, T.StringType()), T.StructField(order_id, id_type), T.StructField(time, T.TimestampType()),
        T.StructField("window_start", T.TimestampType()), T.StructField("position", T.LongType()),
    ])
    held = T.StructType([T.StructField("end", T.LongType()), T.StructField("count", T.LongType())])

    def step(group: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        parts = [(b["_us"].fillna(_NO_TIME).to_numpy(np.int64), b[order_id].to_numpy()) for b in batches]
        times, ids = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((ids, times)) if ids.dtype != object else _ordered(times, ids)
        times, ids = times[order], ids[order]
        del order
        end, count = state.get if state.exists else (_NEVER, 0)
        known = int(np.searchsorted(times, _NO_TIME))
        if known == 0 and end == _NEVER:
            raise ValueError("an event without a time opens no window")
        starts, positions = _walk(times[:known], width, end, count)
        if known:
            end, count = int(starts[-1]) + width, int(positions[-1])
        more = len(times) - known  # events without a time count in the window that is open last
        starts = np.concatenate((starts, np.full(more, end - width)))
        positions = np.concatenate((positions, count + 1 + np.arange(more)))
        state.update((end, count + more))
        state.setTimeoutTimestamp(max(end // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        for at in range(0, len(times), _SLICE):
            here = slice(at, at + _SLICE)
            when = pd.Series(pd.to_datetime(np.where(times[here] < _NO_TIME, times[here], 0), unit="us"))
            yield pd.DataFrame({
                key: group[0], order_id: ids[here], time: when.where(times[here] < _NO_TIME),
                "window_start": pd.to_datetime(starts[here], unit="us"), "position": positions[here],
            })

    slim = events.select(F.col(key).cast("string").alias(key), order_id, F.col(time).cast("timestamp").alias(time))
    small_batches(events.sparkSession)
    return (
        slim.withWatermark(time, watermark).withColumn("_us", F.unix_micros(time))
        .groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    )


def rate_limit_stream(events: DataFrame, limit: tuple[int, int] = LIMITS["query"], key: str = "client_id", time: str = "ts",
                      order_id: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    """Each event with whether the client's limit lets it through, and the wait in seconds if not."""
    most, seconds = limit
    placed = window_stream(events, key, time, order_id, seconds, watermark)
    allowed = F.col("position") <= most
    left = F.unix_micros("window_start") + seconds * 1_000_000 - F.unix_micros(time)
    return placed.withColumn("allowed", allowed).withColumn(
        "retry_after", F.when(~allowed, F.ceil(left / F.lit(1e6)).cast("bigint")))


def cache_stream(lookups: DataFrame, seconds: int = 300, key: str = "cache_key", time: str = "ts",
                 order_id: str = "event_id", watermark: str = "1 hour") -> DataFrame:
    """Each lookup as hit or miss."""
    placed = window_stream(lookups, key, time, order_id, seconds, watermark)
    return placed.withColumn("cache_hit", F.col("position") > 1)


def status_stream(events: DataFrame) -> DataFrame:
    """Latest status of each document with its progress; run in update or complete mode.

    events: document_id, ts, status, processing_stage, error_message.
    """
    latest = events.groupBy("document_id").agg(
        F.max(F.struct("ts", "status", "processing_stage", "error_message")).alias("_l")
    )
    state = progress(F.col("_l.status"), F.col("_l.processing_stage"), F.col("_l.error_message"))
    return latest.select(
        "document_id", F.col("_l.ts").alias("ts"), F.col("_l.status").alias("status"), state.alias("_p"),
    ).select(
        "document_id", "ts", "status", "_p.*", F.col("status").isin("completed", "failed").alias("finished"),
    )


def usage_metrics_stream(usage: DataFrame, seconds: int = 3600, watermark: str = "10 minutes") -> DataFrame:
    """Requests, errors, mean and approximate 95th percentile of latency per time bucket."""
    return (
        usage.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("_w"))
        .agg(
            F.count("*").alias("requests"), F.count_if(~F.col("ok")).alias("errors"),
            F.round(F.avg("latency_ms"), 6).alias("avg_latency_ms"),
            F.percentile_approx("latency_ms", 0.95).alias("p95_latency_ms"),
        )
        .select(F.col("_w.start").alias("bucket"), "requests", "errors", "avg_latency_ms", "p95_latency_ms")
    )


def start_ingest(documents: DataFrame, chunk_path: str, reject_path: str, status_path: str, state_path: str,
                 embedder: Embedder | None = None, once: bool = True, **options):
    """Ingest arriving documents (document_id, user_id, text, created_at) into the chunk table.

    A batch that fails is written to the status table with its stage and error, so that the stream goes on;
    `retry_failed` takes its documents up again. Every batch writes partitions of its own: one that runs again
    after a failure replaces what it wrote.
    """
    embedder = embedder or Embedder()

    def store(batch: DataFrame, batch_id: int) -> None:
        _ingest_batch(batch, batch_id, chunk_path, reject_path, status_path, embedder, options)

    writer = documents.writeStream.option("checkpointLocation", state_path).foreachBatch(store)
    return (writer.trigger(availableNow=True) if once else writer).start()


def retry_failed(documents: DataFrame, chunk_path: str, reject_path: str, status_path: str,
                 embedder: Embedder | None = None, **options) -> int:
    """Ingest the documents of failed batches again, taken from the table the stream reads; returns the batches retried.

    A batch keeps its id, so that it replaces whatever its failed run has left, its status rows included.
    """
    spark = documents.sparkSession
    failed = spark.read.parquet(status_path).where(F.col("status") == "failed").select("document_id", "batch_id")
    failed = checkpoint(failed)  # the rows are replaced below
    batches = [r["batch_id"] for r in failed.select("batch_id").distinct().orderBy("batch_id").collect()]
    for batch_id in batches:
        mine = failed.where(F.col("batch_id") == batch_id).select("document_id")
        batch = documents.join(mine, "document_id", "left_semi")
        _ingest_batch(batch, batch_id, chunk_path, reject_path, status_path, embedder or Embedder(), options)
    return len(batches)


def _ingest_batch(batch: DataFrame, batch_id: int, chunk_path: str, reject_path: str, status_path: str,
                  embedder: Embedder, options: dict) -> None:
    """Store one batch and write what became of it to the status table."""
    try:
        ingest(batch, chunk_path, reject_path, embedder, batch_id, **options)
        status, error = "completed", None
    except Exception as problem:
        status, error = "failed", str(problem)
    put(batch.select(
        "document_id", F.lit(status).alias("status"), F.when(F.lit(status == "failed"), "storing").alias("processing_stage"),
        F.lit(error).cast("string").alias("error_message"), F.current_timestamp().alias("ts"),
    ), status_path, [], batch_id)


def run_available(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None]):
    """Process everything that is there and stop."""
    query = (
        stream.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).foreachBatch(write).start()
    )
    query.awaitTermination()
    return query
