"""Streaming operators over files that arrive in several batches, with late and repeated records."""

import json
import os

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from pagespark.sources import shared
from pagespark.streaming import run
from pagespark.streaming import streams as R

HOUR = 3_600_000
START = 1_000 * 24 * HOUR  # a midnight; at the epoch itself records would count as late


@pytest.fixture
def arrive(spark, tmp_path):
    """A stream whose files are read one per micro-batch, in order."""

    def make(batches):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        for i, rows in enumerate(batches):
            f = folder / f"{i:03d}.json"
            f.write_text("\n".join(json.dumps({"id": a, "page_id": p, "ms": ms, "type": t}) for a, p, ms, t in rows))
            os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema("id long, page_id long, ms long, type string").option("maxFilesPerTrigger", 1)
        return stream.json(str(folder)).withColumn("ts", F.timestamp_millis(F.col("ms") + START))

    return make


def test_windows_close_behind_the_watermark(arrive):
    events = arrive([[(1, 1, 0, "a"), (2, 1, 10, None), (3, 2, HOUR, "a")], [(4, 1, 20, "a"), (5, 1, 3 * HOUR, "a")],
                     [(6, 3, 3 * HOUR, "a")], [(7, 1, 30, "a")]])
    got = run.run_available(R.stream_mutation_types(events, window="1 hour", watermark="90 minutes"))
    # record 4 is late but within the watermark, record 7 is too late
    assert {(r.page_id, r.type, r.n) for r in got.collect()} == {(1, "a", 2), (1, "unknown", 1)}


def test_sessions(arrive):
    events = arrive([[(i, 1, i * 100, "a") for i in range(20)], [(90, 1, 9 * HOUR, "a")], [(91, 1, 99 * HOUR, "a")]])
    got = run.run_available(R.stream_activity(events, gap="1 hour"))
    rows = sorted((r.total, r.time_span_ms, r.mutations_per_second, r.activity_level) for r in got.collect())
    assert rows == [(1, 0, 0.0, "low"), (20, 1900, 10.53, "high")]


def test_duplicates_are_dropped(arrive):
    events = arrive([[(1, 1, 0, "a"), (1, 1, 0, "a")], [(1, 1, 0, "a"), (2, 1, 5, "a")]])
    got = run.run_available(R.stream_dedup(events, ["id"]))
    assert sorted(r.id for r in got.collect()) == [1, 2]


def test_settled_pages_are_reported_once(arrive):
    events = arrive(
        [
            [(1, 1, 0, "a"), (2, 1, 1500, "a"), (3, 2, 0, "a"), (4, 3, 500, "a")],
            [(5, 1, 3000, "a"), (6, 2, 9000, "a"), (7, 9, 60_000, "a")],
            [(8, 2, 90_000, "a"), (9, 3, 95_000, "a"), (10, 9, 200_000, "a")],
        ]
    )
    got = run.run_available(
        R.stream_settled(events, quiet_ms=2000, watermark="10 seconds"),
        {"spark.sql.streaming.stateStore.providerClass": R.ROCKSDB},
    )
    assert sorted((r.page_id, r.settled_at_ms - START) for r in got.collect()) == [(1, 5000), (2, 2000), (3, 2500), (9, 62_000)]


def test_a_settled_page_leaves_the_store(arrive):
    """Once forgotten, a page that comes back is reported again."""
    events = arrive([[(1, 1, 0, "a")], [(2, 9, 60_000, "a")], [(3, 9, 200_000, "a")], [(4, 9, 220_000, "a")], [(5, 1, 300_000, "a")], [(6, 9, 400_000, "a")], [(7, 9, 500_000, "a")]])
    got = run.run_available(
        R.stream_settled(events, quiet_ms=2000, watermark="10 seconds", forget_ms=30_000),
        {"spark.sql.streaming.stateStore.providerClass": R.ROCKSDB},
    )
    assert sorted(r.settled_at_ms - START for r in got.filter("page_id = 1").collect()) == [2000, 302_000]


def _calls(spark, tmp_path, batches):
    folder = tmp_path / "calls"
    folder.mkdir()
    for i, rows in enumerate(batches):
        f = folder / f"{i:03d}.json"
        f.write_text("\n".join(json.dumps({"page_id": p, "ms": ms, "url": u}) for p, ms, u in rows))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    calls = spark.readStream.schema("page_id long, ms long, url string").option("maxFilesPerTrigger", 1).json(str(folder))
    return calls.withColumn("ts", F.timestamp_millis(F.col("ms") + START))


API, PAGE = "https://h/api/x", "https://h/logo.png"


def test_monitoring_of_both_logs_equals_the_batch_summary(spark, arrive, tmp_path):
    mutations = [(i, 1, i * 100, "a") for i in range(20)] + [(50, 2, 0, "a"), (51, 2, HOUR // 2, None)]
    requests = [(1, 0, API), (1, 700, API), (1, 700, API), (1, 800, PAGE), (1, HOUR + 1_800, API), (2, HOUR, API), (3, 500, API), (3, 500, API)]
    end = [(99, 9, 99 * HOUR, "a")]
    events = arrive([mutations[10:], mutations[:10], end])
    got = run.run_available(R.stream_monitoring(events, _calls(spark, tmp_path, [requests[:3], requests[3:], [(9, 99 * HOUR, PAGE)]]), gap="1 hour"))
    columns = ["page_id", "total_mutations", "time_span_ms", "mutations_per_second", "activity_level", "api_calls_detected"]
    log = spark.createDataFrame([(p, i, ms, t) for i, p, ms, t in mutations], "page_id long, seq long, ts_ms long, type string")
    asked = spark.createDataFrame([(p, u) for p, _, u in requests], "page_id long, url string")
    batch = R.M.monitoring_summary(log, asked)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(map(tuple, batch.select(columns).collect()), key=str)
    assert got.filter("page_id = 3").first()["activity_level"] == "none"


def test_calls_outside_sessions_and_one_late_log(spark, arrive, tmp_path):
    """Calls never prolong a session; nothing closes before the later of the two logs has passed."""
    events = arrive([[(1, 1, 0, "a"), (2, 1, 2 * HOUR, "a")], [(3, 9, 99 * HOUR, "a")]])
    calls = _calls(spark, tmp_path, [[(1, 0, API), (1, HOUR - 1, API), (1, HOUR + 5, API), (1, 2 * HOUR - 1, API)], [(9, 5 * HOUR, PAGE)]])
    got = run.run_available(R.stream_monitoring(events, calls, gap="1 hour"))
    at = (F.unix_millis("session_start") - START).alias("at")
    rows = sorted(map(tuple, got.select(at, "total_mutations", "api_calls_detected", "activity_level").collect()))
    assert rows == [(0, 1, 2, "low"), (HOUR + 5, 0, 1, "none"), (2 * HOUR - 1, 0, 1, "none"), (2 * HOUR, 1, 0, "low")]
    late = run.run_available(R.stream_monitoring(events, calls, gap="1 hour", late_requests="4 hours"))
    assert [r.at for r in late.select(at).collect()] == [0]


def test_islands():
    assert R._islands([(5, 6), (0, 1), (2, 3), (9, 20), (10, 11)], 2) == [(0, 3), (5, 6), (9, 20)]


def test_event_time_ignores_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-07-01 00:00:00' AS t")
    with run.session_conf(spark, {"spark.sql.session.timeZone": "America/New_York"}):
        assert df.select(F.unix_millis(R.event_time(F.col("t")))).first()[0] == 1_719_792_000_000
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"


class _Cluster:
    """A session of a cluster that names a folder (the setting is fixed when a session starts)."""

    def __init__(self, folder):
        self.conf = {shared.CHECKPOINT_DIR: folder} if folder else {}
        self.sparkContext = SimpleNamespace(applicationId="app", master="spark://h:1", getCheckpointDir=lambda: None)


def test_shared_folder_follows_the_setting(tmp_path):
    one, two = (shared.shared_folder(_Cluster(f"{tmp_path}/")) for _ in range(2))
    assert one.startswith(f"{tmp_path}/pagespark/app/") and one != two
    with pytest.raises(ValueError):
        shared.shared_folder(_Cluster(None))
