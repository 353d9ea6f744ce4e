"""Log operators against brute force, with one page holding most of the log."""

import random

import pytest
from pyspark.sql import functions as F

from pagespark.operators import expand as E
from pagespark.operators import monitor as M

LOG = "page_id long, seq long, ts_ms long, type string, target struct<tag:string>"


@pytest.fixture(scope="module")
def records():
    rng = random.Random(3)
    rows, seq = [], 0
    for page, n in ((1, 900), (2, 40), (3, 1), (4, 30), (5, 12)):
        ts = 0
        for _ in range(n):
            ts += rng.choice([0, 1, 30, 400, 1999, 2000, 2001, 5000] if page != 1 else [0, 5, 50, 1500])
            rows.append((page, seq, ts, rng.choice(["childList", "attributes", None]), (rng.choice(["DIV", None]),)))
            seq += 1
    return rows


@pytest.fixture(scope="module")
def log(spark, records):
    return spark.createDataFrame(records, LOG).repartition(5)


def test_stability_point_equals_walking_the_log(log, records):
    want = {}
    for page in {r[0] for r in records}:
        last = 0
        for ts in sorted(r[2] for r in records if r[0] == page):
            if ts - last >= 2000:
                break
            last = ts
        want[page] = last + 2000
    got = {r.page_id: r.stable_at_ms for r in M.stability_point(log).collect()}
    assert got == want


def test_summary_levels_and_empty_pages(spark, log, records):
    pages = spark.createDataFrame([(i,) for i in range(1, 7)], "page_id long")
    requests = spark.createDataFrame(
        [(1, "https://h/API/x"), (1, "https://h/x.css"), (6, "https://h/a.json")], "page_id long, url string"
    )
    got = {r.page_id: r for r in M.monitoring_summary(log, requests, pages).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6}
    for page in range(1, 6):
        mine = [r for r in records if r[0] == page]
        span = mine[-1][2] - mine[0][2]
        rate = len(mine) / (span / 1000) if span else 0
        level = "high" if rate > 5 else "medium" if rate > 1 else "low"
        assert (got[page].total_mutations, got[page].time_span_ms, got[page].activity_level) == (len(mine), span, level)
    assert got[3].mutations_per_second == 0 and got[3].activity_level == "low"
    assert (got[6].total_mutations, got[6].activity_level, got[6].time_span_ms) == (0, "none", None)
    assert (got[1].api_calls_detected, got[6].api_calls_detected, got[2].api_calls_detected) == (1, 1, 0)


def test_span_follows_arrival_order(spark):
    rows = [(1, 0, 500, "a", ("X",)), (1, 1, 100, "a", ("X",)), (1, 2, 300, "a", ("X",))]
    df = spark.createDataFrame(rows, LOG).groupBy("page_id").agg(M.timeline_span().alias("s"))
    assert df.first().s == -200


def test_no_window_or_sort_per_page(log):
    for df in (M.stability_point(log), M.monitoring_summary(log), M.mutation_types(log)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "collect_list" not in plan


def settle(heights, quiet=1000, cap=10000):
    last, calm = heights[0], 0
    for k, h in enumerate(heights[1:], 1):
        calm, last = (calm + 100, h) if h == last else (0, h)
        if calm >= quiet:
            return k * 100, True, k * 100 >= cap
    return None, False, True


def test_settle_point(spark):
    rng = random.Random(5)
    series = {i: [rng.randrange(1 + i % 3) if k < 7 * i else 5 for k in range(140)] for i in range(25)}
    series[90] = [k for k in range(140)]
    series[91] = [k for k in range(130)] + [7] * 20
    rows = [(p, k, h) for p, hs in series.items() for k, h in enumerate(hs)]
    got = {r.page_id: (r.settled_at_ms, r.settled, r.timed_out) for r in M.settle_point(spark.createDataFrame(rows, "page_id long, sample_ix int, height int")).collect()}
    assert got == {p: settle(hs) for p, hs in series.items()}


def test_metric_changes_and_messages(spark):
    rows = [(1, "initial", 10, 100, 500), (1, "final", 21, 1101, 1100), (2, "initial", 5, 5, 0), (2, "final", 5, 5, 400), (3, "final", 9, 9, 9)]
    df = spark.createDataFrame(rows, "page_id long, snapshot_type string, totalElements int, totalTextLength int, pageHeight int")
    changes = M.metric_changes(df)
    assert {(r.page_id, r.metric, r.change) for r in changes.collect()} == {
        (1, "totalElements", 11), (1, "totalTextLength", 1001), (1, "pageHeight", 600), (2, "pageHeight", 400)}
    assert [tuple(r) for r in M.significant_changes(changes).collect()] == [
        (1, ["Added 11 new elements", "Added 1001 characters of text", "Page height changed by 600px"])
    ]


def test_expansion_changes_compare_maps_and_missing_sides(spark):
    schema = "page_id long, element_id string, text string, attributes map<string,string>"
    before = spark.createDataFrame([(1, "a", "x", {"k": "1", "j": "2"}), (1, "b", "x", None), (1, "c", "x", {})], schema)
    after = spark.createDataFrame([(1, "a", "x", {"j": "2", "k": "1"}), (1, "b", "x", {}), (1, "d", "x", {})], schema)
    got = {r.element_id: (r.in_before, r.in_after, r.content_changed) for r in E.expansion_changes(before, after).collect()}
    assert got == {"a": (True, True, False), "b": (True, True, True), "c": (True, False, True), "d": (False, True, True)}


def test_method_histogram_counts_null_as_unknown(spark):
    rows = [(1, "a", None, 0, True, None, True), (1, "b", None, 0, False, "click", True), (1, "c", "a", 1, True, "click", True),
            (2, "a", None, 0, False, None, False)]
    schema = "page_id long, element_id string, parent_element_id string, depth int, success boolean, method string, content_changed boolean"
    got = {r.page_id: r for r in E.expansion_summary(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].methods == {"unknown": 1} and got[2].methods == {}
    assert (got[1].total_elements, got[1].failed_expansions, got[1].content_changes, got[1].nested_discoveries) == (2, 1, 1, 1)
