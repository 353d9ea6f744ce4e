"""Queries that run the streaming operators over the event table as a stream, to its end."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagespark.catalog.registry import query
from pagespark.catalog.tables import given
from pagespark.streaming import streams as R
from pagespark.streaming.run import run_available

_MS = "CAST(date_diff('millisecond', TIMESTAMP '1970-01-01', {0}) AS BIGINT)"
# what a stream has emitted when its input ends: everything that the watermark has passed
_WATERMARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


def _events(spark, sf):
    schema = given(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    kind = (
        F.when(F.col("event_type") == "click", "attributes")
        .when(F.col("event_type") == "view", "characterData")
        .when(F.col("event_type") != "error", "childList")
    )
    return stream.select("event_id", F.col("user_id").alias("page_id"), R.event_time(F.col("ts")).alias("ts"), kind.alias("type"), "props")


@query(
    "stream_mutation_types",
    f"""SELECT {_MS.format("date_trunc('day', ts)")} AS window_start_ms, user_id AS page_id,
      CASE event_type WHEN 'click' THEN 'attributes' WHEN 'view' THEN 'characterData' WHEN 'error' THEN 'unknown' ELSE 'childList' END AS type, count(*) AS n
    FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_WATERMARK} GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    rows = run_available(R.stream_mutation_types(_events(spark, sf)))
    return rows.select(F.unix_millis("window_start").alias("window_start_ms"), "page_id", "type", "n")


@query(
    "stream_activity",
    f"""SELECT page_id, session_start_ms, total, time_span_ms, round(rate, 2) AS mutations_per_second, CASE WHEN rate > 5 THEN 'high' WHEN rate > 1 THEN 'medium' ELSE 'low' END AS activity_level FROM (
    SELECT *, CASE WHEN time_span_ms > 0 THEN total / (time_span_ms / CAST(1000 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS rate FROM (
    SELECT page_id, {_MS.format('min(ts)')} AS session_start_ms, count(*) AS total, {_MS.format('max(ts)')} - {_MS.format('min(ts)')} AS time_span_ms
    FROM (SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY ts, event_id) AS s FROM (
      SELECT user_id AS page_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b
    GROUP BY page_id, s HAVING max(ts) + INTERVAL 12 HOUR <= {_WATERMARK}) t) u""",
)
def _(spark, sf):
    rows = run_available(R.stream_activity(_events(spark, sf), gap="12 hours"))
    start = F.unix_millis("session_start").alias("session_start_ms")
    return rows.select("page_id", start, "total", "time_span_ms", "mutations_per_second", "activity_level")


# clicks stand for data calls, errors for other requests, all else for mutations
_BOTH = "(SELECT least(max(ts) FILTER (event_type NOT IN ('click', 'error')), max(ts) FILTER (event_type IN ('click', 'error'))) - INTERVAL 10 MINUTE FROM events)"


@query(
    "stream_monitoring_summary",
    f"""WITH m AS (SELECT user_id AS page_id, ts, event_id FROM events WHERE event_type NOT IN ('click', 'error')),
    s AS (SELECT page_id, min(ts) AS first, max(ts) AS last, count(*) AS total FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY page_id ORDER BY ts, event_id) AS k FROM (
        SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY page_id ORDER BY ts, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM m) a) b GROUP BY page_id, k),
    c AS (SELECT c.page_id, c.ts, s.first FROM (SELECT user_id AS page_id, ts FROM events WHERE event_type = 'click') c
      LEFT JOIN s ON s.page_id = c.page_id AND c.ts >= s.first AND c.ts < s.last + INTERVAL 12 HOUR),
    r AS (SELECT s.page_id, s.first AS since, s.last + INTERVAL 12 HOUR AS ends, s.total, {_MS.format('s.last')} - {_MS.format('s.first')} AS span, count(c.ts) AS calls
      FROM s LEFT JOIN c ON c.page_id = s.page_id AND c.first = s.first GROUP BY ALL
      UNION ALL SELECT page_id, ts, ts + INTERVAL 1 MICROSECOND, 0, NULL, count(*) FROM c WHERE first IS NULL GROUP BY page_id, ts)
    SELECT page_id, {_MS.format('since')} AS session_start_ms, total AS total_mutations, span AS time_span_ms, round(rate, 2) AS mutations_per_second,
      CASE WHEN rate IS NULL THEN 'none' WHEN rate > 5 THEN 'high' WHEN rate > 1 THEN 'medium' ELSE 'low' END AS activity_level, calls AS api_calls_detected
    FROM (SELECT *, CASE WHEN span > 0 THEN total / (span / CAST(1000 AS DOUBLE)) WHEN total > 0 THEN CAST(0 AS DOUBLE) END AS rate FROM r WHERE ends <= {_BOTH}) t""",
)
def _(spark, sf):
    request = F.col("type").isNull() | (F.col("type") == "attributes")
    url = F.when(F.col("type") == "attributes", "https://h/api").otherwise("https://h/page")
    mutations, requests = _events(spark, sf).filter(~request), _events(spark, sf).filter(request).withColumn("url", url)
    rows = run_available(R.stream_monitoring(mutations, requests, gap="12 hours"))
    return rows.withColumn("session_start_ms", F.unix_millis("session_start")).drop("session_start", "session_end")


@query(
    "stream_api_calls",
    """SELECT event_id, concat('https://h/', CASE WHEN event_type = 'click' THEN 'api' ELSE event_type END, '?', props) AS url FROM events WHERE event_type = 'click'""",
)
def _(spark, sf):
    kind = F.when(F.col("type") == "attributes", "api").otherwise(F.coalesce("type", F.lit("none")))
    url = F.concat(F.lit("https://h/"), kind, F.lit("?"), F.col("props"))
    return run_available(R.stream_api_calls(_events(spark, sf).select("event_id", url.alias("url"))))


@query(
    "stream_settled",
    f"""SELECT page_id, min(last_ms) + 43200000 AS settled_at_ms FROM (
      SELECT user_id AS page_id, {_MS.format('ts')} AS last_ms, {_MS.format('lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS next_ms FROM events) a
    WHERE (next_ms IS NULL OR next_ms - last_ms >= 43200000) AND last_ms + 43200000 <= {_MS.format(_WATERMARK)} GROUP BY page_id""",
)
def _(spark, sf):
    half_day = 12 * 3600 * 1000
    return run_available(
        R.stream_settled(_events(spark, sf), half_day),
        {"spark.sql.streaming.stateStore.providerClass": R.ROCKSDB},
    )


@query("stream_dedup", "SELECT DISTINCT user_id AS page_id, event_id FROM events")
def _(spark, sf):
    events = _events(spark, sf)
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run_available(R.stream_dedup(twice, ["event_id"])).select("page_id", "event_id")
