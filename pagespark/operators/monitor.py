"""Content monitoring over recorded logs (batch).

Logs are grouped by page, and one page may hold a large share of all records.  So every
aggregate here combines on the map side and keeps constant state per page; nothing
sorts or collects a page's records in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagespark.operators import dom as D
from pagespark.operators.page import METRICS, METRIC_FIELDS, metric_columns, title_column, TITLE_FIELDS

QUIET_MS = 2000
SETTLE_QUIET_MS = 1000
SETTLE_MAX_MS = 10000
SETTLE_STEP_MS = 100
# What marks a request as a data call.
API_WORDS = ["api", "ajax", "json", "graphql"]
# Activity bands, in mutations per second.
HIGH_RATE, MEDIUM_RATE = 5, 1


def is_api_call(url: Column) -> Column:
    return F.coalesce(F.regexp_like(F.lower(url), F.lit("|".join(API_WORDS))), F.lit(False))


def api_calls(request_log: DataFrame) -> DataFrame:
    return request_log.filter(is_api_call(F.col("url")))


# -- snapshots ------------------------------------------------------------------------------
def snapshot_metrics(snapshots: DataFrame) -> DataFrame:
    """Content metrics of every capture: a projection over the parsed captures."""
    dom = D.ensure_dom(snapshots, *METRIC_FIELDS)
    return dom.select(*D.page_keys(dom), *metric_columns())


def snapshot_timeline(snapshots: DataFrame) -> DataFrame:
    """Captures with title and metrics.  The timeline order is captured_at; it is a column, not a sort."""
    dom = D.ensure_dom(snapshots, *METRIC_FIELDS, *TITLE_FIELDS)
    return dom.select(*D.page_keys(dom), "url", title_column().alias("title"), *metric_columns())


def snapshot_counts(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("page_id").agg(F.count("*").alias("n_snapshots"))


def metric_changes(metrics: DataFrame) -> DataFrame:
    """Metrics that differ between a page's initial and final capture: (page_id, metric, initial, final, change)."""
    names = [c for c in metrics.columns if c in (*METRICS, "pageHeight", "viewportHeight")]
    wide = metrics.filter(F.col("snapshot_type").isin("initial", "final")).groupBy("page_id").agg(
        *[
            F.max(F.when(F.col("snapshot_type") == kind, F.col(m))).cast("long").alias(f"{kind}_{m}")
            for m in names
            for kind in ("initial", "final")
        ]
    )
    pairs = F.array(
        *[F.struct(F.lit(m).alias("metric"), F.col(f"initial_{m}").alias("initial"), F.col(f"final_{m}").alias("final"))
          for m in names]
    )
    long = wide.select("page_id", F.inline(pairs))
    return long.withColumn("change", F.col("final") - F.col("initial")).filter(F.col("change") != 0)


def significant_changes(changes: DataFrame) -> DataFrame:
    """Messages for large differences, in a fixed order; pages without any are left out."""
    wanted = ["totalElements", "totalTextLength", "buttons", "links", "pageHeight"]
    page = changes.groupBy("page_id").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("change"))).alias(m) for m in wanted]
    )
    return page.select("page_id", significant_messages(F.col).alias("messages")).filter(F.size("messages") > 0)


def significant_messages(value) -> Column:
    # Thresholds and message forms.
    rules = [
        (value("totalElements") > 10, "Added %d new elements", "totalElements"),
        (value("totalTextLength") > 1000, "Added %d characters of text", "totalTextLength"),
        (value("buttons") > 0, "Added %d new buttons", "buttons"),
        (value("links") > 0, "Added %d new links", "links"),
        (F.abs(value("pageHeight")) > 500, "Page height changed by %dpx", "pageHeight"),
    ]
    return F.array_compact(F.array(*[F.when(t, F.format_string(form, value(m))) for t, form, m in rules]))


# -- mutations --------------------------------------------------------------------------------
def mutation_type() -> Column:
    return F.coalesce(F.col("type"), F.lit("unknown"))


def target_tag() -> Column:
    return F.coalesce(F.col("target.tag"), F.lit("unknown"))


def mutation_types(log: DataFrame) -> DataFrame:
    return log.groupBy("page_id", mutation_type().alias("type")).agg(F.count("*").alias("n"))


def mutation_targets(log: DataFrame) -> DataFrame:
    return log.groupBy("page_id", target_tag().alias("tag")).agg(F.count("*").alias("n"))


def timeline_span() -> Column:
    """Last minus first offset in arrival order."""
    return F.max_by("ts_ms", "seq") - F.min_by("ts_ms", "seq")


def activity_rate(total: Column, span_ms: Column) -> Column:
    return F.when(span_ms > 0, total / (span_ms / F.lit(1000.0))).otherwise(F.lit(0.0))


def activity_level(rate: Column) -> Column:
    return F.when(rate > HIGH_RATE, "high").when(rate > MEDIUM_RATE, "medium").otherwise("low")


def monitoring_summary(log: DataFrame, requests: DataFrame | None = None, pages: DataFrame | None = None) -> DataFrame:
    """Mutation totals, rate and activity level per page; level ``none`` where nothing was recorded.

    With ``pages``, every page has a row.  Otherwise pages found in either log have one.
    """
    per_page = log.groupBy("page_id").agg(F.count("*").alias("total_mutations"), timeline_span().alias("time_span_ms"))
    if requests is not None:
        calls = api_calls(requests).groupBy("page_id").agg(F.count("*").alias("api_calls_detected"))
        per_page = per_page.join(calls, "page_id", "full_outer")
    else:
        per_page = per_page.withColumn("api_calls_detected", F.lit(0).cast("long"))
    if pages is not None:
        per_page = pages.select("page_id").join(per_page, "page_id", "left")
    seen = F.coalesce(F.col("total_mutations"), F.lit(0)) > 0
    rate = activity_rate(F.col("total_mutations"), F.col("time_span_ms"))
    return per_page.select(
        "page_id",
        F.coalesce("total_mutations", F.lit(0)).alias("total_mutations"),
        F.when(seen, F.col("time_span_ms")).alias("time_span_ms"),
        F.when(seen, F.round(rate, 2)).alias("mutations_per_second"),
        F.when(seen, activity_level(rate)).otherwise("none").alias("activity_level"),
        F.coalesce("api_calls_detected", F.lit(0)).alias("api_calls_detected"),
    )


def stability_point(log: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """End of the first ``quiet_ms`` without a mutation, the clock starting at 0: (page_id, stable_at_ms).

    Time is cut into bins of ``quiet_ms``.  Inside a bin no gap can be long enough, so a bin
    is summed up by its last offset, and quiet follows it iff the next bin is empty or begins
    late enough.  A record therefore speaks for its own bin and, as a successor, to the bin
    before; both combine on the map side, and a busy page spreads over its bins.  Before the
    first record it is quiet iff bin 0 is empty.
    """
    q = F.lit(quiet_ms).cast("long")
    ts, none = F.col("ts_ms").cast("long"), F.lit(None).cast("long")
    own = F.floor(ts / q)
    said = log.select(
        "page_id",
        F.inline(
            F.array(
                F.struct(own.alias("bin"), ts.alias("last"), none.alias("next_first")),
                F.struct((own - 1).alias("bin"), none.alias("last"), ts.alias("next_first")),
            )
        ),
    )
    bins = said.groupBy("page_id", "bin").agg(F.max("last").alias("last"), F.min("next_first").alias("next_first"))
    filled = F.col("last").isNotNull()
    quiet = filled & (F.coalesce(F.col("next_first") - F.col("last"), q) >= q)
    page = bins.groupBy("page_id").agg(
        F.min(F.when(quiet, F.col("last"))).alias("last"), F.max(filled & (F.col("bin") == 0)).alias("starts_busy")
    )
    return page.select("page_id", F.when(F.col("starts_busy"), F.col("last") + q).otherwise(q).alias("stable_at_ms"))


def settle_point(
    samples: DataFrame,
    quiet_ms: int = SETTLE_QUIET_MS,
    max_ms: int = SETTLE_MAX_MS,
    step_ms: int = SETTLE_STEP_MS,
) -> DataFrame:
    """When a sampled height stopped changing: (page_id, settled_at_ms, settled, timed_out).

    ``samples(page_id, sample_ix, height)``: sample 0 is the baseline, later ones are checks.  All
    samples are looked at: a page that settles after ``max_ms`` has its true point and is marked
    ``timed_out``, as is one that never settles, whose point is unknown.

    Quiet needs ``k`` equal samples in a row, k = quiet_ms/step_ms.  Samples fall into chunks of k,
    each with the last k of the chunk before: a run of k equal steps lies in one such stretch, so a page
    with very many samples spreads over its chunks.
    """
    k = max(1, -(-quiet_ms // step_ms))
    own = F.floor(F.col("sample_ix") / k)
    near = samples.filter("sample_ix >= 0").select("page_id", "sample_ix", "height", F.explode(F.array(own, own + 1)).alias("chunk"))
    by_ix = W.partitionBy("page_id", "chunk").orderBy("sample_ix")
    changed = F.coalesce(F.col("height") != F.lag("height").over(by_ix), F.lit(True))
    last_change = F.max(F.when(F.col("changed"), F.col("sample_ix"))).over(by_ix)
    runs = near.withColumn("changed", changed).withColumn("since", last_change)
    calm = (F.col("sample_ix") - F.col("since")) * step_ms >= quiet_ms
    out = runs.groupBy("page_id").agg(F.min(F.when(calm, F.col("sample_ix") * step_ms)).alias("at"))
    return out.select(
        "page_id",
        F.col("at").alias("settled_at_ms"),
        F.col("at").isNotNull().alias("settled"),
        (F.coalesce("at", F.lit(max_ms)) >= max_ms).alias("timed_out"),
    )


def content_analysis(metrics: DataFrame, log: DataFrame) -> DataFrame:
    """Per page: metric changes, mutation histograms and span, significant changes.

    The arrays are bounded by their vocabulary (metric names, mutation types, tag names).
    """
    changes = metric_changes(metrics)
    entry = F.struct("metric", "initial", "final", "change")
    per_change = changes.groupBy("page_id").agg(
        F.array_sort(F.collect_list(entry)).alias("content_metric_changes"),
        *[
            F.max(F.when(F.col("metric") == m, F.col("change"))).alias(m)
            for m in ("totalElements", "totalTextLength", "buttons", "links", "pageHeight")
        ],
    ).withColumn("significant_changes", significant_messages(F.col))

    # the log is grouped once, by page, type and tag; everything else folds that small table
    cell = log.groupBy("page_id", mutation_type().alias("type"), target_tag().alias("tag")).agg(
        F.count("*").alias("n"), F.min(F.struct("seq", "ts_ms")).alias("first"), F.max(F.struct("seq", "ts_ms")).alias("last")
    )
    by_key = cell.select(
        "page_id", "n", "first", "last", F.inline(F.array(F.struct(F.lit(0).alias("kind"), F.col("type").alias("key")),
                                                          F.struct(F.lit(1).alias("kind"), F.col("tag").alias("key")))),
    ).groupBy("page_id", "kind", "key").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"))

    def histogram(kind: int, name: str) -> Column:
        pairs = F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n")))
        return F.map_from_entries(F.array_sort(pairs)).alias(name)

    folded = by_key.groupBy("page_id").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("total_mutations"),
        (F.max("last")["ts_ms"] - F.min("first")["ts_ms"]).alias("timeline_span"),
        histogram(0, "mutation_types"),
        histogram(1, "affected_elements"),
    )
    joined = per_change.join(folded, "page_id", "full_outer")
    no_map = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<bigint>"))
    return joined.select(
        "page_id",
        "content_metric_changes",
        F.struct(
            F.coalesce("total_mutations", F.lit(0)).alias("total_mutations"),
            F.coalesce("mutation_types", no_map).alias("mutation_types"),
            F.coalesce("affected_elements", no_map).alias("affected_elements"),
            F.coalesce("timeline_span", F.lit(0)).alias("timeline_span"),
        ).alias("mutation_analysis"),
        "significant_changes",
    )
