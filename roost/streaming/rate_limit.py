"""Fixed-window rate limit over a request log, in batch and as a stream.

A client's window opens at its first request and lasts ``window_seconds``; the first
request at or after its end opens the next. Windows hang on the data, so calendar windows
do not apply.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from roost.sources.staging import stage

LIMIT = 12
WINDOW_SECONDS = 60
STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def client_key(forwarded: Column, fallback: Column | None = None) -> Column:
    """First address of a comma list of forwarded headers, else ``unknown``."""
    header = forwarded if fallback is None else F.coalesce(forwarded, fallback)
    first = F.trim(F.get(F.split(header, ","), F.lit(0)))
    return F.coalesce(F.nullif(first, F.lit("")), F.lit("unknown"))


def _verdict(limit: int, window_us: int) -> dict[str, Column]:
    left = F.col("window_start_us") + window_us - F.col("ts_us")
    return {
        "allowed": F.col("n_in_window") <= limit,
        "remaining": F.greatest(F.lit(0), limit - F.col("n_in_window")).cast("int"),
        "retry_after_seconds": F.greatest(F.lit(1), F.ceil(left / 1_000_000)).cast("int"),
    }


def _fill_windows(ts: np.ndarray, window_us: int, start: int | None, count: int):
    """Window start and number in it of sorted times that follow an open window; one step per window."""
    starts, counts = np.empty_like(ts), np.empty_like(ts)
    at = 0
    while at < len(ts):
        if start is None or ts[at] >= start + window_us:
            start, count = ts[at], 0
        end = at + int(np.searchsorted(ts[at:], start + window_us))
        starts[at:end] = start
        counts[at:end] = np.arange(count + 1, count + 1 + end - at)
        at, count = end, count + end - at
    return starts, counts, start, count


def _mark_windows(window_us: int):
    """Mark the window of every row of a partition sorted by (key, run, ts); each run opens a window with its first row.

    Only the open window is carried from batch to batch, so memory does not grow with a client's log.
    """

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, start, count = None, 0, 0
        for pdf in batches:
            if pdf.empty:
                continue
            names = pdf[["key", "run"]]
            fresh = (names != names.shift()).any(axis=1).to_numpy()
            fresh[0] = tuple(names.iloc[0]) != held
            held = tuple(names.iloc[-1])
            ts = pdf["ts_us"].to_numpy()
            starts, counts = np.empty_like(ts), np.empty_like(ts)
            cuts = [0, *(np.flatnonzero(fresh[1:]) + 1).tolist(), len(ts)]
            for low, high in pairwise(cuts):
                if fresh[low]:
                    start, count = None, 0
                starts[low:high], counts[low:high], start, count = _fill_windows(ts[low:high], window_us, start, count)
            yield pdf.assign(window_start_us=starts, n_in_window=counts)

    return mark


def _chunk_links(window_us: int, chunk_windows: int):
    """For every time at which a window can open first in a chunk: the time at which one then opens first in the next chunk."""

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts_us")
        times, home = pdf["ts_us"].to_numpy(), int(pdf["home"].iloc[0])
        n_own = int(np.searchsorted(times, (home + chunk_windows) * window_us))
        # from time to time within the chunk, twice as far each turn, until all have left it
        jump = np.concatenate([np.searchsorted(times, times[:n_own] + window_us), np.arange(n_own, len(times) + 1)])
        while n_own and jump[:n_own].min() < n_own:
            jump = jump[jump]
        if pdf["opens"].iloc[0]:
            n_entries = min(1, n_own)
        else:
            n_entries = min(n_own, int(np.searchsorted(times, (home + 1) * window_us)) + 1)
        after = pd.array(np.append(times, 0)[jump[:n_entries]], dtype="Int64")
        after[jump[:n_entries] == len(times)] = pd.NA
        return pdf.iloc[:n_entries][["key", "home", "opens"]].assign(node=times[:n_entries], after=after)

    return link


def _entries(times: DataFrame, slots: DataFrame, window_us: int, chunk_windows: int, most_chunks: int) -> DataFrame:
    """key, home, entry: when the first window opens in each chunk of the segments that have several."""
    kind = times.schema["key"].dataType.simpleString()
    own = times.join(slots.filter("n_chunks > 1"), ["key", "slot"]).select("key", "home", "opens", "slot", "ts_us")
    # a window that reaches over the seam ends within the first two slots of the next chunk
    shown = own.filter((~F.col("opens")) & (F.col("slot") < F.col("home") + 2))
    heads = slots.filter("slot = home").select("key", "home", "opens")
    ahead = shown.select("key", (F.col("home") - chunk_windows).alias("home"), "ts_us").join(heads, ["key", "home"])
    both = own.select("key", "home", "opens", "ts_us").unionByName(ahead)
    links = stage(
        both.groupBy("key", "home").applyInPandas(
            _chunk_links(window_us, chunk_windows), f"key {kind}, home bigint, opens boolean, node bigint, after bigint"
        ),
        "rate-links",
    )
    reached = links.filter("opens").select("key", "home", "node")
    jump = links.filter("after is not null").select("key", "node", "after")
    far = chunk_windows
    while far < most_chunks * chunk_windows:
        hop = reached.join(jump, ["key", "node"]).select("key", (F.col("home") + far).alias("home"), F.col("after").alias("node"))
        reached = stage(reached.unionByName(hop), "rate-reached")
        far *= 2
        if far < most_chunks * chunk_windows:
            on = jump.select("key", F.col("node").alias("after"), F.col("after").alias("beyond"))
            jump = stage(jump.join(on, ["key", "after"]).select("key", "node", F.col("beyond").alias("after")), "rate-jumps")
    return reached.withColumnRenamed("node", "entry")


def rate_limit_audit(
    events: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS, chunk_windows: int = 64
) -> DataFrame:
    """Verdict per request. ``events``: ``event_id``, ``key``, ``ts``; rows without key or time get none.

    A pause of one whole window always starts afresh. Pauses are found on the distinct
    (key, window-sized slot) pairs, which are bounded by time and not by traffic, and cut
    every log into independent segments. A segment longer than ``chunk_windows`` slots is cut further: each chunk
    maps the times at which a first window may open in it to those of the next chunk, the maps are composed by pointer
    doubling (as many rounds as the logarithm of the number of chunks), and the chunks are then filled on their own. So a
    client that never pauses spreads over the cluster too. A task of the first step holds the distinct times of one
    client in one chunk. Small tables are written under ``spark.checkpoint.dir`` when the function is called.
    """
    if chunk_windows < 2:
        raise ValueError("chunk_windows must be 2 or more")
    window_us = window_seconds * 1_000_000
    rows = events.select("event_id", "key", F.unix_micros("ts").alias("ts_us")).dropna(subset=["key", "ts_us"])
    rows = rows.withColumn("slot", F.floor(F.col("ts_us") / window_us))
    by_key = Window.partitionBy("key").orderBy("slot")
    fresh = F.coalesce(F.col("slot") - F.lag("slot").over(by_key) > 1, F.lit(True))
    first = F.max(F.when(F.col("fresh"), F.col("slot"))).over(by_key)
    number = F.floor((F.col("slot") - F.col("first")) / chunk_windows)
    slots = (
        rows.select("key", "slot")
        .distinct()
        .withColumn("fresh", fresh)
        .select("key", "slot", first.alias("first"))
        .withColumn("home", F.col("first") + number * chunk_windows)
        .withColumn("n_chunks", F.max(number).over(Window.partitionBy("key", "first")) + 1)
        .select("key", "slot", "home", (F.col("home") == F.col("first")).alias("opens"), "n_chunks")
    )
    slots = stage(slots, "rate-slots")
    most_chunks = slots.agg(F.max("n_chunks")).first()[0] or 0
    entry = F.lit(None).cast("bigint")
    if most_chunks > 1:
        times = rows.select("key", "slot", "ts_us").distinct()
        slots = slots.join(_entries(times, slots, window_us, chunk_windows, most_chunks), ["key", "home"], "left")
        entry = F.col("entry")
    # what comes before a chunk's first window belongs to the last window of the chunk before
    run = F.when(F.col("opens") | (F.col("ts_us") >= entry), F.col("home")).otherwise(F.col("home") - chunk_windows)
    ordered = (
        rows.join(slots, ["key", "slot"])
        .select("event_id", "key", run.alias("run"), "ts_us")
        .repartition("key", "run")
        .sortWithinPartitions("key", "run", "ts_us", "event_id")
    )
    kind = ordered.schema["key"].dataType.simpleString()
    marked = ordered.mapInPandas(
        _mark_windows(window_us),
        f"event_id bigint, key {kind}, run bigint, ts_us bigint, window_start_us bigint, n_in_window bigint",
    )
    return marked.withColumns(_verdict(limit, window_us)).select(
        "event_id", "key", F.timestamp_micros("ts_us").alias("ts"), F.timestamp_micros("window_start_us").alias("window_start"),
        "n_in_window", "allowed", "remaining", "retry_after_seconds",
    )


def rate_limit_stream(events: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """The same verdicts over a stream, at once: per client only (window start, count) is kept.

    Events are put in order inside a micro-batch only; ``rate_limit_stream_in_order`` waits and orders across them.

    State is dropped by an event-time timeout once the watermark passes the window's end.
    """
    window_us = window_seconds * 1_000_000
    rows = events.withWatermark("ts", f"{window_seconds} seconds").select("event_id", "key", "ts")
    kind = rows.schema["key"].dataType.simpleString()

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        start, count = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        # window arithmetic in microseconds since the epoch
        stamps = pdf["ts"].astype("datetime64[us]").astype("int64").tolist()
        out = []
        for event_id, ts in zip(pdf["event_id"].tolist(), stamps):
            if start is None or ts >= start + window_us:
                start, count = ts, 0
            count += 1
            out.append((event_id, key[0], ts, start, count))
        state.update((start, count))
        state.setTimeoutTimestamp(max((start + window_us) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["event_id", "key", "ts_us", "window_start_us", "n_in_window"])

    marked = rows.groupBy("key").applyInPandasWithState(
        update,
        f"event_id bigint, key {kind}, ts_us bigint, window_start_us bigint, n_in_window bigint",
        "window_start_us bigint, n bigint",
        "append",
        "EventTimeTimeout",
    )
    return marked.withColumns(_verdict(limit, window_us))


class _EventOrder(StatefulProcessor):
    """Holds a client's events until the watermark has passed them, then fills windows in event order."""

    def __init__(self, window_us: int):
        self.window_us = window_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us bigint, event_id bigint")
        self.window = handle.getValueState("window", "start_us bigint, n bigint")

    def _wake_at(self, ts_us: int) -> None:
        """A timer fires once the watermark lies above it; an earlier one does for later events too."""
        at = ts_us // 1000
        if all(known > at for known in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - names of the Spark interface
        for pdf in rows:
            self.waiting.appendList(list(zip(pdf["ts_us"].tolist(), pdf["event_id"].tolist())))
            self._wake_at(int(pdf["ts_us"].min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        passed_us = timerValues.getCurrentWatermarkInMs() * 1000
        self.handle.deleteTimer(expiredTimerInfo.getExpiryTimeInMs())
        held = sorted(tuple(row) for row in self.waiting.get()) if self.waiting.exists() else []
        n_due = bisect_right(held, (passed_us, float("inf")))
        due, later = held[:n_due], held[n_due:]
        start, count = self.window.get() if self.window.exists() else (None, 0)
        if due:
            ts = np.array([row[0] for row in due], dtype="int64")
            starts, counts, start, count = _fill_windows(ts, self.window_us, start, count)
            self.waiting.put(later) if later else self.waiting.clear()
            yield pd.DataFrame(
                {
                    "event_id": [row[1] for row in due], "key": pd.Series([key[0]] * len(due), dtype="object"), "ts_us": ts,
                    "window_start_us": starts, "n_in_window": counts,
                }
            )
        if start is not None and start + self.window_us > passed_us:
            self.window.update((int(start), int(count)))
            self._wake_at(int(start) + self.window_us + 999)
        elif self.window.exists():
            self.window.clear()
        if later:
            self._wake_at(later[0][0])


def rate_limit_stream_in_order(
    events: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS, delay_seconds: int | None = None
) -> DataFrame:
    """The same verdicts over a stream, in event order across micro-batches.

    An event may come up to ``delay_seconds`` (unset: one window) behind the newest one; its verdict is given once the
    watermark lies above its time, so events of one window equal the batch verdicts however they are spread over
    batches. Later ones are dropped, as by any watermark. State of a client: the events still waiting, its open window
    (start, count) until the watermark has passed the window's end, and one or two timers. Rows without key, time or id get no
    verdict; those with a time still move the watermark. A task holds the waiting events of one client at a time, which delay and rate bound.

    The session needs ``spark.sql.streaming.stateStore.providerClass`` set to the RocksDB provider (``STATE_PROVIDER``).
    """
    window_us = window_seconds * 1_000_000
    delay = window_seconds if delay_seconds is None else delay_seconds
    rows = (
        events.withWatermark("ts", f"{delay} seconds")
        .select("event_id", "key", "ts", F.unix_micros("ts").alias("ts_us"))
        .dropna(subset=["event_id", "key", "ts"])
    )
    kind = rows.schema["key"].dataType.simpleString()
    marked = rows.groupBy("key").transformWithStateInPandas(
        _EventOrder(window_us),
        f"event_id bigint, key {kind}, ts_us bigint, window_start_us bigint, n_in_window bigint",
        "append",
        "EventTime",
    )
    return marked.withColumns(_verdict(limit, window_us))
