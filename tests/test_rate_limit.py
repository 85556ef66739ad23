"""Verdicts of long logs, cut into chunks, against one walk over each client's log."""

import random

import pytest

from roost.streaming.rate_limit import rate_limit_audit


def walk(rows, limit, window_us):
    found, open_window = {}, {}
    for event_id, key, ts in sorted(rows, key=lambda r: (r[2], r[0])):
        start, n = open_window.get(key, (None, 0))
        if start is None or ts >= start + window_us:
            start, n = ts, 0
        open_window[key] = (start, n + 1)
        found[event_id] = (start, n + 1, n + 1 <= limit)
    return found


def made(seed, n=4000):
    """One client without a pause, one with pauses, one that comes at exact window ends, and repeated times."""
    rng = random.Random(seed)
    rows, ts = [], 0
    for i in range(n):
        ts += rng.choice([0, 1, 200_000, 900_000, 1_500_000, 2_999_999])
        rows.append((i, "crowd", ts))
    ts = 0
    for i in range(n, n + 500):
        ts += rng.choice([1_000, 2_000_000, 3_000_000, 30_000_000])
        rows.append((i, "pauses", ts))
    rows += [(n + 500 + i, "exact", 3_000_000 * i) for i in range(300)]
    return rows


def audited(spark, rows, chunk_windows):
    frame = spark.createDataFrame(rows, "event_id bigint, key string, us bigint").selectExpr("event_id", "key", "timestamp_micros(us) ts")
    out = rate_limit_audit(frame.repartition(5), limit=3, window_seconds=3, chunk_windows=chunk_windows)
    return {
        r.event_id: (r.us, r.n_in_window, r.allowed)
        for r in out.selectExpr("event_id", "unix_micros(window_start) us", "n_in_window", "allowed").collect()
    }


@pytest.mark.parametrize("chunk_windows", [2, 3, 7, 64])
def test_chunks_equal_one_walk(spark, chunk_windows):
    rows = made(chunk_windows)
    assert audited(spark, rows, chunk_windows) == walk(rows, 3, 3_000_000)


def test_rows_without_key_or_time_and_empty_log(spark):
    rows = [(1, None, 5), (2, "a", None), (3, "a", 5)]
    assert audited(spark, rows, 2) == {3: (5, 1, True)}
    assert audited(spark, [], 2) == {}


def test_least_chunk(spark):
    with pytest.raises(ValueError):
        audited(spark, [], 1)
