"""Streamed verdicts against the batch ones when the events of a window come in several shuffled batches."""

import random

import pytest
from pyspark.sql import functions as F

from roost.streaming.rate_limit import STATE_PROVIDER, rate_limit_stream_in_order
from tests.test_rate_limit import made, walk

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROW = "event_id bigint, key string, us bigint"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, STATE_PROVIDER)
    yield spark
    spark.conf.unset(PROVIDER)


def streamed(spark, folder, batches, delay_seconds):
    """Verdicts after every batch went in on its own; the state outlives a restart of the stream between them."""
    source, out = str(folder / "in"), str(folder / "out")
    for rows in batches:
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(ROW).parquet(source).select("event_id", "key", F.timestamp_micros("us").alias("ts"))
        query = (
            rate_limit_stream_in_order(events, limit=3, window_seconds=3, delay_seconds=delay_seconds)
            .writeStream.format("parquet").outputMode("append").option("path", out)
            .option("checkpointLocation", str(folder / "ck")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
    return [(r.event_id, (r.window_start_us, r.n_in_window, r.allowed)) for r in spark.read.parquet(out).collect()]


def test_shuffled_batches_equal_batch(rocks, tmp_path):
    # a stream's watermark begins at 1970, where made() puts its first rows
    rows = [(event_id, key, us + 1_700_000_000_000_000) for event_id, key, us in made(5, 600)]
    rng = random.Random(3)
    last = max(ts for *_, ts in rows)
    batches = [[], [], []]
    for row in rows:
        batches[rng.randrange(3)].append(row)
    for batch in batches:
        rng.shuffle(batch)
    # a row without a client moves the watermark past the last event
    batches.append([(-1, None, last + 10_000_000_000), (-2, None, None), (None, "crowd", 5)])
    found = streamed(rocks, tmp_path, batches, delay_seconds=9_000)
    assert len(found) == len(rows)
    assert dict(found) == walk(rows, 3, 3_000_000)


def test_late_events_and_waiting_events(rocks, tmp_path):
    second = 1_000_000
    batches = [
        [(1, "a", 10 * second), (2, "a", 12 * second)],
        [(3, "a", 11 * second), (4, "a", 40 * second), (5, "b", 39 * second)],  # 3 belongs between 1 and 2
        [(6, "a", 9 * second), (7, "a", 13 * second + 1)],  # behind the watermark (35): dropped
        [(8, "a", 38 * second), (9, "a", 60 * second)],  # 8 comes after 4 but opens the window that 4 falls into
    ]
    found = dict(streamed(rocks, tmp_path, batches, delay_seconds=5))
    assert found == {
        1: (10 * second, 1, True), 3: (10 * second, 2, True), 2: (10 * second, 3, True),
        8: (38 * second, 1, True), 4: (38 * second, 2, True), 5: (39 * second, 1, True),
    }  # 9 waits
