"""Page and batch summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.operators import dom as D
from pagespark.operators import monitor as M
from pagespark.operators import page as P
from pagespark.plans import spec as G

# Texts of the summaries.
CHALLENGES = ["Dynamic content loading", "Complex interaction patterns", "Network dependencies"]
NOTHING = "No successful analyses to summarize"


def page_summary(
    pages: DataFrame,
    interaction_log: DataFrame,
    mutation_log: DataFrame | None = None,
    request_log: DataFrame | None = None,
) -> DataFrame:
    """Element and interaction counts per page and, if monitored, its dynamic behaviour."""
    dom = D.ensure_dom(pages, *P.AREA_FIELDS)
    counts = dom.select(
        "page_id",
        "url",
        D.count_nodes(P.is_interactive).alias("total_elements"),
        D.count_css("[aria-expanded]").alias("expandable_elements"),
        F.size(P.area_structs()).alias("static_content_areas"),
    )
    facts = G.interaction_facts(interaction_log).select(
        "page_id",
        F.col("total").alias("total_interactions"),
        F.col("succeeded").alias("successful_interactions"),
        F.col("changed").alias("content_changes_detected"),
    )
    out = counts.join(facts, "page_id", "left")
    for c in ("total_interactions", "successful_interactions", "content_changes_detected"):
        out = out.withColumn(c, F.coalesce(c, F.lit(0)))
    if mutation_log is None:
        return out
    seen = M.monitoring_summary(mutation_log, request_log).select(
        "page_id",
        F.col("total_mutations").alias("mutations_detected"),
        F.col("api_calls_detected").alias("api_calls_made"),
        "activity_level",
    )
    out = out.join(seen, "page_id", "left")
    for c, none in (("mutations_detected", 0), ("api_calls_made", 0), ("activity_level", "none")):
        out = out.withColumn(c, F.coalesce(c, F.lit(none)))
    return out


def recommendations(summary: DataFrame) -> DataFrame:
    level = F.col("activity_level") if "activity_level" in summary.columns else F.lit(None)
    total = F.col("total_interactions")
    rate = F.when(total > 0, F.col("successful_interactions") / total)
    # Advice texts.
    rules: list[tuple[Column, str]] = [
        (rate < 0.7, "Consider implementing robust error handling for interactions"),
        (level == "high", "Use longer wait times due to high dynamic activity"),
        (F.col("expandable_elements") > 5, "Implement systematic expansion strategy for multiple expandable elements"),
    ]
    texts = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))
    return summary.withColumn("recommendations", texts)


def page_outcomes(pages: DataFrame) -> DataFrame:
    """Did each page parse?  A page that did not is a row with its error, not a failed job."""
    dom = D.ensure_dom(pages, "nid")
    return dom.select("page_id", "url", F.col("parse_error").isNull().alias("ok"), F.col("parse_error").alias("error"))


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    return outcomes.agg(
        F.count("*").alias("total_urls"),
        F.count_if("ok").alias("successful"),
        F.count_if(~F.col("ok")).alias("failed"),
    )


def batch_summary(pages: DataFrame, interaction_log: DataFrame) -> DataFrame:
    """One row: success rate, average interactions, layout types; a message instead if nothing succeeded.

    Counting by (ok, layout type) first leaves a handful of rows for the final step.
    """
    dom = D.ensure_dom(pages, *P.META_FIELDS)
    per_page = dom.select("page_id", F.col("parse_error").isNull().alias("ok"), G.layout_type().alias("layout_type"))
    facts = G.interaction_facts(interaction_log).select("page_id", F.col("total").alias("interactions"))
    counted = per_page.join(facts, "page_id", "left").groupBy("ok", "layout_type").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("interactions"), F.lit(0)).alias("interactions")
    )
    good = F.sum(F.when(F.col("ok"), F.col("n")))
    used = F.sum(F.when(F.col("ok"), F.col("interactions")))
    layouts = F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("layout_type", "n"))))
    made = counted.agg(good.alias("good"), F.sum("n").alias("total"), used.alias("used"), layouts.alias("layouts"))
    some = F.coalesce(F.col("good"), F.lit(0)) > 0
    average = F.when(some, F.col("used") / F.col("good"))
    return made.select(
        F.when(some, F.col("good") / F.col("total")).alias("success_rate"),
        average.alias("average_expandable_elements"),
        average.alias("average_interactions"),
        F.when(some, F.map_from_entries("layouts")).alias("common_layout_types"),
        F.when(some, F.lit(CHALLENGES)).alias("common_challenges"),
        F.when(~some, F.lit(NOTHING)).alias("message"),
    )
