"""Fixed windows that start at the first event and again at the first event past their end.

Rate limits and cache lifetimes are both of this kind. Where a window starts depends on the
one before, yet no key has to fit one task: events are range partitioned by (key, time, id),
each task summarises how a window open at its start would leave it, the summaries are put
in order by key on the executors, and a second pass fills in the windows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.scans import in_order

_NEVER = np.iinfo(np.int64).min
_NO_KEY = object()  # differs from every key, null included


def _partition(batches):
    """A whole range partition, whose size the shuffle settings bound; None when it is empty."""
    parts = [b for b in batches if len(b)]
    return pd.concat(parts, ignore_index=True) if parts else None


def _runs(keys: np.ndarray):
    """(first, past last) of each stretch of equal keys."""
    if not len(keys):
        return []
    starts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
    return list(zip(starts[:-1], starts[1:]))


def _leaving(times: np.ndarray, width: int):
    """For each event that may be the first past an open window: state (reset, count) after the last event.

    Only events up to one width after the first can be; equal neighbours are merged.
    """
    n = len(times)
    following = np.searchsorted(times, times + width, side="right")
    reset, count = np.empty(n, np.int64), np.empty(n, np.int64)
    for i in range(n - 1, -1, -1):
        j = following[i]
        reset[i], count[i] = (times[i] + width, n - i) if j == n else (reset[j], count[j])
    reach = int(np.searchsorted(times, times[0] + width, side="right"))
    last = min(reach, n - 1)
    keep = [i for i in range(last + 1) if i == last or (reset[i], count[i]) != (reset[i + 1], count[i + 1])]
    return times[keep], reset[keep], count[keep]


def _walk(times: np.ndarray, width: int, reset: int, count: int):
    """Start and position of every event, given the window open before the first."""
    n = len(times)
    start, position = np.empty(n, np.int64), np.empty(n, np.int64)
    at = int(np.searchsorted(times, reset, side="right"))
    start[:at], position[:at] = reset - width if reset != _NEVER else 0, count + 1 + np.arange(at)
    while at < n:
        stop = int(np.searchsorted(times, times[at] + width, side="right"))
        start[at:stop], position[at:stop] = times[at], 1 + np.arange(stop - at)
        at = stop
    return start, position


def anchored_windows(events: DataFrame, key: str, time: str, order_id: str, seconds: int) -> DataFrame:
    """Add window_start (timestamp), window_end and position (1..) of each event within its window.

    An event exactly at the window's end still belongs to it.
    """
    width = seconds * 1_000_000
    slim = events.select(
        F.col(key).cast("string").alias("_key"), F.unix_micros(time).alias("_time"), F.col(order_id).alias("_id")
    )
    fixed = in_order(slim, ["_key"], ["_time", "_id"])  # both passes see the same partitions
    entries = fixed.sparkSession.sparkContext.broadcast(_entries(fixed, width))
    id_type = slim.schema["_id"].dataType
    schema = T.StructType([
        T.StructField("_id", id_type), T.StructField("_start", T.LongType()), T.StructField("position", T.LongType()),
    ])

    def fill(batches):
        rows = _partition(batches)
        if rows is None:
            return
        times, open_windows = rows["_time"].to_numpy(), entries.value
        keys, part = rows["_key"].to_numpy(), int(rows["_part"].iloc[0])
        starts, positions = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
        for first, past in _runs(keys):
            reset, count = _NEVER, 0
            if first == 0 and part in open_windows:
                reset, count = open_windows[part][1:]
            starts[first:past], positions[first:past] = _walk(times[first:past], width, reset, count)
        yield pd.DataFrame({"_id": rows["_id"], "_start": starts, "position": positions})

    found = fixed.mapInPandas(fill, schema)
    return (
        events.join(found.withColumnRenamed("_id", order_id), order_id)
        .withColumn("window_start", F.timestamp_micros("_start"))
        .withColumn("window_end", F.timestamp_micros(F.col("_start") + width))
        .drop("_start")
    )


def _entries(fixed: DataFrame, width: int) -> dict:
    """Partition -> (key, reset, count) of the window open at its first event.

    A span is a partition's first or last run of equal keys. What it makes of a window open before it, one row
    a possible outcome, goes to the task of its key, which walks a key's spans in order as a stream. Only one row
    a partition reaches the driver.
    """
    schema = "_part int, _at int, _key string, _n long, _last long, _time long, _reset long, _count long"

    def summarise(batches):
        rows = _partition(batches)
        if rows is None:
            return
        keys, times, part = rows["_key"].to_numpy(), rows["_time"].to_numpy(), int(rows["_part"].iloc[0])
        runs = _runs(keys)
        for at in sorted({0, len(runs) - 1}):
            first, past = runs[at]
            span = times[first:past]
            opened, resets, counts = _leaving(span, width)
            yield pd.DataFrame({"_part": part, "_at": at, "_key": keys[first], "_n": past - first, "_last": span[-1],
                                "_time": opened, "_reset": resets, "_count": counts})

    def chain(batches):
        key, reset, count = _NO_KEY, _NEVER, 0
        span, n, last, onward = None, 0, _NEVER, None
        for rows in batches:
            out = []
            parts, ats, keys, ns, lasts, times, resets, counts = (rows[c].to_numpy() for c in rows.columns)
            for first, past in _runs(parts.astype(np.int64) << 32 | ats):
                if (parts[first], ats[first]) != span:
                    if span is not None and reset < last:
                        reset, count = onward
                    elif span is not None:
                        count += n
                    span, n, last, onward = (parts[first], ats[first]), int(ns[first]), int(lasts[first]), None
                    if keys[first] != key:
                        key, reset, count = keys[first], _NEVER, 0
                    elif ats[first] == 0:
                        out.append((int(parts[first]), key, reset, count))
                at = first + int(np.searchsorted(times[first:past], reset, side="right"))
                if onward is None and at < past:
                    onward = int(resets[at]), int(counts[at])
            yield pd.DataFrame(out, columns=["_part", "_key", "_reset", "_count"])

    spans = fixed.mapInPandas(summarise, schema).repartition("_key").sortWithinPartitions("_key", "_part", "_at", "_time")
    found = spans.mapInPandas(chain, "_part int, _key string, _reset long, _count long").collect()
    return {r["_part"]: (r["_key"], r["_reset"], r["_count"]) for r in found}


def rate_limit_audit(events: DataFrame, limit: int, seconds: int, key: str = "client_id",
                     time: str = "ts", order_id: str = "event_id") -> DataFrame:
    """Each event with its place in the client's window, whether it is let through, and the wait if not."""
    placed = anchored_windows(events, key, time, order_id, seconds)
    allowed = F.col("position") <= limit
    wait = F.ceil((F.unix_micros("window_end") - F.unix_micros(time)) / F.lit(1e6)).cast("bigint")
    return placed.withColumn("allowed", allowed).withColumn("retry_after", F.when(~allowed, wait))


def cache_key(user_id, embedding, k, threshold, document_ids=None):
    """User, the first five vector values at four decimals, and the options."""
    values = F.array_join(F.transform(F.slice(embedding, 1, 5), lambda v: F.format_string("%.4f", v.cast("double"))), ",")
    docs = F.array_join(F.array_sort(document_ids), ",") if document_ids is not None else F.lit("")
    return F.concat_ws(":", user_id.cast("string"), values, k.cast("string"), threshold.cast("string"), docs)


def cache_audit(lookups: DataFrame, seconds: int = 300, key: str = "cache_key",
                time: str = "ts", order_id: str = "event_id") -> DataFrame:
    """Each lookup as hit or miss: a miss stores, an entry up to `seconds` old is a hit."""
    return anchored_windows(lookups, key, time, order_id, seconds).withColumn("cache_hit", F.col("position") > 1)


# Fixed values: (events, seconds) of the limits in force.
LIMITS = {"query": (10, 60), "upload": (5, 300), "api": (100, 900), "strict": (10, 900)}
