"""Windows that start at the first event: against the plain loop, with keys split over partitions."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators import windows

START = datetime(2024, 1, 1)


def plain(events, seconds):
    """events: (id, key, seconds since start) -> id -> (window start, position)."""
    out, opened = {}, {}
    for i, key, at in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        start, count = opened.get(key, (None, 0))
        if start is None or at > start + seconds:
            start, count = at, 0
        opened[key] = (start, count + 1)
        out[i] = (start, count + 1)
    return out


def run(spark, events, seconds):
    df = spark.createDataFrame([(i, k, START + timedelta(seconds=s)) for i, k, s in events], "event_id long, client_id string, ts timestamp")
    got = windows.anchored_windows(df, "client_id", "ts", "event_id", seconds).collect()
    return {r["event_id"]: (round((r["window_start"] - START).total_seconds(), 3), r["position"]) for r in got}


@pytest.mark.parametrize("seed", range(4))
def test_against_the_loop(spark, seed):
    rng = np.random.default_rng(seed)
    # one client holds most events, so it spans many partitions
    events = [(i, "hot" if rng.random() < 0.7 else f"c{rng.integers(5)}", float(rng.integers(0, 4000))) for i in range(1500)]
    for seconds in (1, 60, 900, 5000):
        assert run(spark, events, seconds) == plain(events, seconds)


def test_one_client_inside_one_window(spark):
    """Every event is a state of its own, and none reaches the driver but one a partition; a null client counts as one."""
    events = [(i, k, i / 8) for i, k in enumerate(["hot"] * 4000 + [None] * 3 + ["z"] * 2)]
    assert run(spark, events, 10_000) == plain([(i, k or "", s) for i, k, s in events], 10_000)


def test_gaps_and_the_exact_end(spark):
    events = [(i, "a", float(i * 5)) for i in range(11)] + [(20, "a", 60.0), (21, "a", 60.001)]
    got = run(spark, events, 60)
    assert got[20] == (0.0, 12)          # exactly at the end: still inside
    assert got[21] == (60.001, 1)        # a millisecond later: a new window


def test_cache_lookups(spark):
    events = [(i, "k", float(s)) for i, s in enumerate((0, 299, 300, 301, 302))]
    df = spark.createDataFrame([(i, k, START + timedelta(seconds=s)) for i, k, s in events], "event_id long, cache_key string, ts timestamp")
    got = {r["event_id"]: r["cache_hit"] for r in windows.cache_audit(df).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: True}


def test_limit_and_wait(spark):
    df = spark.createDataFrame([(i, "c", START + timedelta(seconds=i)) for i in range(12)], "event_id long, client_id string, ts timestamp")
    got = {r["event_id"]: (r["allowed"], r["retry_after"]) for r in windows.rate_limit_audit(df, *windows.LIMITS["query"]).collect()}
    assert got[9] == (True, None) and got[10] == (False, 50) and got[11] == (False, 49)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=60), st.integers(1, 120), st.integers(0, 59))
def test_summary_of_a_stretch(times, width, cut):
    """The state a stretch leaves, looked up by the open window before it, is what walking it leaves."""
    times = np.sort(np.array(times, np.int64))
    cut = min(cut, len(times))
    head, tail = times[:cut], times[cut:]
    if not len(head) or not len(tail):
        return
    start, position = windows._walk(head, width, windows._NEVER, 0)
    reset, count = start[-1] + width, position[-1]
    walked_start, walked_position = windows._walk(tail, width, reset, count)
    opened, resets, counts = windows._leaving(tail, width)
    if reset >= tail[-1]:
        left = (reset, count + len(tail))
    else:
        at = int(np.searchsorted(opened, reset, side="right"))
        left = (resets[at], counts[at])
    assert left == (walked_start[-1] + width, walked_position[-1])
