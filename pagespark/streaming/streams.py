"""Streaming forms of the monitoring operators.

They take a streaming (or batch) frame of events with an event-time column ``ts`` of type
timestamp, and return a streaming frame; sources, sinks and triggers are the caller's.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.operators import monitor as M

try:
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
except ImportError:  # Spark before 4.0
    StatefulProcessor = object

#: A settled page is remembered for a day of event time.
FORGET_MS = 24 * 3600 * 1000
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_time(ntz: Column) -> Column:
    """A timestamp without zone, read as UTC whatever the session's time zone is."""
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), ntz))


def stream_mutation_types(events: DataFrame, window: str = "1 day", watermark: str = "10 minutes") -> DataFrame:
    """Records per page and type in tumbling windows.  Partial counts combine before the shuffle."""
    return (
        events.withWatermark("ts", watermark)
        .groupBy(F.window("ts", window), "page_id", M.mutation_type().alias("type"))
        .agg(F.count("*").alias("n"))
        .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "page_id", "type", "n")
    )


def stream_activity(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Sessions of activity per page with rate and level.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` so that sessions of
    a busy page merge before the shuffle.
    """
    sessions = (
        events.withWatermark("ts", watermark)
        .groupBy(F.session_window("ts", gap).alias("w"), "page_id")
        .agg(F.count("*").alias("total"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    )
    span = F.unix_millis("last") - F.unix_millis("first")
    rate = M.activity_rate(F.col("total"), span)
    return sessions.select(
        "page_id",
        F.col("w.start").alias("session_start"),
        F.col("w.end").alias("session_end"),
        "total",
        span.alias("time_span_ms"),
        F.round(rate, 2).alias("mutations_per_second"),
        M.activity_level(rate).alias("activity_level"),
    )


def stream_monitoring(
    mutations: DataFrame, requests: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes", late_requests: str | None = None
) -> DataFrame:
    """``monitoring_summary`` of each closed session: mutations (page_id, ts) and data calls (page_id, ts, url) of one page.

    Mutations alone make sessions.  A call inside one is counted there; a call outside of all is a row of its own moment
    with no mutations, level ``none``.  Both logs keep their own watermark (``late_requests``, by default ``watermark``), and a
    session closes when both have passed its end.

    A join of sessions with calls would have to keep each call for as long as a session may last.  Here both logs are
    one stream in which a mutation opens a window of ``gap`` and a call one of a microsecond, so state is one row for each
    open session, and calls combine before the shuffle as mutations do (see ``stream_activity``).  Requests that
    are no data calls open no window, but they move the clock on.
    """
    marks = mutations.withWatermark("ts", watermark).select("page_id", "ts", F.lit(False).alias("is_call"), F.lit(gap).alias("lasts"))
    lasts = F.when(M.is_api_call(F.col("url")), "1 microsecond").otherwise("0 seconds")
    calls = requests.withWatermark("ts", late_requests or watermark).select("page_id", "ts", F.lit(True).alias("is_call"), lasts.alias("lasts"))
    at = F.when(~F.col("is_call"), F.col("ts"))
    sessions = (
        marks.union(calls)
        .groupBy(F.session_window("ts", F.col("lasts")).alias("w"), "page_id")
        .agg(F.count(at).alias("total_mutations"), F.min(at).alias("first"), F.max(at).alias("last"), F.count_if("is_call").alias("api_calls_detected"))
    )
    seen, span = F.col("total_mutations") > 0, F.unix_millis("last") - F.unix_millis("first")
    rate = M.activity_rate(F.col("total_mutations"), span)
    return sessions.select(
        "page_id",
        F.col("w.start").alias("session_start"),
        F.col("w.end").alias("session_end"),
        "total_mutations",
        span.alias("time_span_ms"),
        F.when(seen, F.round(rate, 2)).alias("mutations_per_second"),
        F.when(seen, M.activity_level(rate)).otherwise("none").alias("activity_level"),
        "api_calls_detected",
    )


def stream_api_calls(requests: DataFrame) -> DataFrame:
    return M.api_calls(requests)


def stream_dedup(events: DataFrame, keys: list[str], watermark: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def _islands(first: list[tuple[int, int]], quiet_ms: int) -> list[tuple[int, int]]:
    """Merge stretches of activity that lie less than ``quiet_ms`` apart."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(first):
        if out and lo - out[-1][1] < quiet_ms:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


class _Settle(StatefulProcessor):
    """Keeps a page's stretches of activity until the first is known to have ended.

    State per page is that short list; stretches older than the watermark close, so the list is
    bounded by the watermark delay divided by the quiet time.  A settled page keeps only a mark,
    which a timer removes ``forget_ms`` of event time later.  A page that comes back after that is a new page
    and is reported again.
    """

    def __init__(self, quiet_ms: int, forget_ms: int):
        self.quiet_ms, self.forget_ms = quiet_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("activity", "done boolean, lows array<bigint>, highs array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        if old is not None and old[0]:
            for _ in rows:
                pass
            return
        stretches = list(zip(old[1], old[2])) if old is not None else []
        for part in rows:
            pairs = zip(part["first_ms"].tolist(), part["last_ms"].tolist())
            stretches = _islands([*stretches, *pairs], self.quiet_ms)
        self.state.update((False, [lo for lo, _ in stretches], [hi for _, hi in stretches]))
        if stretches:
            self.handle.registerTimer(stretches[0][1] + self.quiet_ms)
        return
        yield  # rows only ever come out of timers

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        old = self.state.get()
        if old is None:
            return
        if old[0]:
            self.state.clear()
            return
        quiet_from = old[2][0]
        if quiet_from + self.quiet_ms > timerValues.getCurrentWatermarkInMs():
            return  # the stretch went on; its later timer decides
        self.state.update((True, [], []))
        self.handle.registerTimer(timerValues.getCurrentWatermarkInMs() + self.forget_ms)
        yield pd.DataFrame({"page_id": [key[0]], "settled_at_ms": [quiet_from + self.quiet_ms]})

    def close(self) -> None:
        pass


def stream_settled(events: DataFrame, quiet_ms: int, watermark: str = "10 minutes", forget_ms: int = FORGET_MS) -> DataFrame:
    """Emit each page once, when it has first been quiet for ``quiet_ms``: (page_id, settled_at_ms).

    "Once" holds while the page is remembered: ``forget_ms`` of event time after it was reported.

    Before the shuffle each Arrow batch shrinks to its stretches of activity, so a page that holds
    a large share of the events sends few rows.  Needs the RocksDB state store.
    """

    def shrink(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            p = p.sort_values(["page_id", "ms"], kind="stable")
            fresh = (p["page_id"] != p["page_id"].shift()) | (p["ms"].diff() >= quiet_ms)
            runs = p.groupby(fresh.cumsum(), sort=False)
            yield pd.DataFrame(
                {"page_id": runs["page_id"].first(), "first_ms": runs["ms"].min(), "last_ms": runs["ms"].max()}
            ).astype("int64")

    stretches = (
        events.select("page_id", F.unix_millis("ts").alias("ms"))
        .mapInPandas(shrink, "page_id bigint, first_ms bigint, last_ms bigint")
        .withColumn("last_at", F.timestamp_millis("last_ms"))
        .withWatermark("last_at", watermark)
    )
    return stretches.groupBy("page_id").transformWithStateInPandas(
        statefulProcessor=_Settle(quiet_ms, forget_ms),
        outputStructType="page_id bigint, settled_at_ms bigint",
        outputMode="Append",
        timeMode="EventTime",
    )
