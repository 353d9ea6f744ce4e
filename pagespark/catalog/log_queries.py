"""Queries over interaction, mutation and request logs, and over specifications and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagespark.catalog.registry import query
from pagespark.catalog.tables import derived, given, mutation_log, unescaped
from pagespark.operators import expand as E
from pagespark.operators import monitor as M
from pagespark.operators import page as P
from pagespark.plans import spec as G
from pagespark.plans import summary as B


def _pages(spark, sf):
    return given(spark, sf, "pages")


def _aug(spark, sf):
    return derived(spark, sf, "pages_aug")


def _log(spark, sf):
    return derived(spark, sf, "interaction_log")


def _requests(spark, sf):
    return derived(spark, sf, "request_log")


def _snapshots(spark, sf):
    return derived(spark, sf, "page_snapshots")


def _monitoring(spark, sf):
    return M.monitoring_summary(mutation_log(spark, sf), _requests(spark, sf), _pages(spark, sf))


def _methods(df, column="methods"):
    entries = F.transform(F.map_entries(column), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return df.withColumn(column, F.array_join(F.array_sort(entries), ";"))


# -- interaction log ------------------------------------------------------------------------
@query(
    "expansion_summary",
    """SELECT f.page_id, total AS total_elements, succeeded AS successful_expansions, total - succeeded AS failed_expansions, changed AS content_changes,
    nested AS nested_discoveries, coalesce(methods, '') AS methods FROM facts f LEFT JOIN method_text m ON f.page_id = m.page_id""",
)
def _(spark, sf):
    return _methods(E.expansion_summary(_log(spark, sf)))


@query(
    "method_counts",
    """SELECT page_id, coalesce(method, 'unknown') AS method, count(*) AS n FROM interaction_log WHERE depth = 0 AND success GROUP BY 1, 2""",
)
def _(spark, sf):
    return E.method_counts(_log(spark, sf))


@query(
    "interaction_patterns",
    """SELECT f.page_id, coalesce(methods, '') AS expansion_methods, CASE WHEN total > 0 THEN CAST(succeeded AS DOUBLE) / total ELSE 0 END AS overall_success_rate
    FROM facts f LEFT JOIN method_text m ON f.page_id = m.page_id""",
)
def _(spark, sf):
    return _methods(G.interaction_patterns(_log(spark, sf)), "expansion_methods")


@query(
    "expandable_analysis",
    """SELECT f.page_id, total AS total_expandable, succeeded AS successful_expansions, CASE WHEN nested > 0 THEN max_depth ELSE 0 END AS nested_levels,
    coalesce(methods, '') AS methods FROM facts f LEFT JOIN method_text m ON f.page_id = m.page_id""",
)
def _(spark, sf):
    return _methods(G.expandable_analysis(_log(spark, sf)))


@query(
    "content_reveals",
    "SELECT page_id, element_id, coalesce(method, 'unknown') AS method FROM interaction_log WHERE depth = 0 AND success AND content_changed",
)
def _(spark, sf):
    return G.content_reveals(_log(spark, sf))


@query(
    "interaction_requirements",
    """SELECT i.page_id, i.element_id, i.method, CASE WHEN n.page_id IS NULL THEN 'medium' ELSE 'high' END AS priority
    FROM (SELECT * FROM interaction_log WHERE depth = 0 AND success AND content_changed) i
    LEFT JOIN (SELECT DISTINCT page_id, parent_element_id FROM interaction_log WHERE depth > 0) n
    ON i.page_id = n.page_id AND i.element_id = n.parent_element_id""",
)
def _(spark, sf):
    return G.interaction_requirements(_log(spark, sf))


@query(
    "failure_stats",
    """SELECT page_id, CAST(total - succeeded AS DOUBLE) / total AS interaction_failure_rate FROM facts WHERE total > 0""",
)
def _(spark, sf):
    return G.failure_stats(_log(spark, sf))


# -- mutation and request logs ---------------------------------------------------------------
@query("api_calls", "SELECT page_id, url, method, resource_type FROM api")
def _(spark, sf):
    return M.api_calls(_requests(spark, sf))


@query("mutation_types", "SELECT page_id, coalesce(type, 'unknown') AS type, count(*) AS n FROM mutation_log GROUP BY 1, 2")
def _(spark, sf):
    return M.mutation_types(mutation_log(spark, sf))


@query(
    "mutation_targets", "SELECT page_id, coalesce(target_tag, 'unknown') AS tag, count(*) AS n FROM mutation_log GROUP BY 1, 2"
)
def _(spark, sf):
    return M.mutation_targets(mutation_log(spark, sf))


@query("monitoring_summary", "SELECT * FROM monitoring")
def _(spark, sf):
    return _monitoring(spark, sf)


@query(
    "timeline_span",
    "SELECT page_id, arg_max(ts_ms, seq) - arg_min(ts_ms, seq) AS span_ms FROM mutation_log GROUP BY page_id",
)
def _(spark, sf):
    return mutation_log(spark, sf).groupBy("page_id").agg(M.timeline_span().alias("span_ms"))


@query(
    "stability_point",
    """SELECT page_id, min(ts_ms) + 2000 AS stable_at_ms FROM (
      SELECT page_id, ts_ms, lead(ts_ms) OVER (PARTITION BY page_id ORDER BY ts_ms) AS next_ms FROM (
        SELECT page_id, ts_ms FROM mutation_log UNION ALL SELECT DISTINCT page_id, 0 FROM mutation_log) a) b
    WHERE next_ms IS NULL OR next_ms - ts_ms >= 2000 GROUP BY page_id""",
)
def _(spark, sf):
    return M.stability_point(mutation_log(spark, sf))


@query(
    "settle_point",
    """SELECT page_id, CAST(min(CASE WHEN run_ms >= 1000 THEN sample_ix * 100 END) AS INT) AS settled_at_ms,
      min(CASE WHEN run_ms >= 1000 THEN 1 END) IS NOT NULL AS settled, coalesce(min(CASE WHEN run_ms >= 1000 THEN sample_ix * 100 END), 10000) >= 10000 AS timed_out FROM (
      SELECT page_id, sample_ix, (sample_ix - max(CASE WHEN changed THEN sample_ix END) OVER (PARTITION BY page_id ORDER BY sample_ix)) * 100 AS run_ms FROM (
        SELECT page_id, sample_ix, coalesce(height <> lag(height) OVER (PARTITION BY page_id ORDER BY sample_ix), TRUE) AS changed
        FROM height_samples WHERE sample_ix >= 0) a) b GROUP BY page_id""",
)
def _(spark, sf):
    return M.settle_point(derived(spark, sf, "height_samples"))


_CHANGES = f"""
SELECT page_id, metric, initial, final, final - initial AS change FROM (
  SELECT m.page_id, x.metric, CASE x.metric WHEN 'totalElements' THEN p.n WHEN 'buttons' THEN 0 WHEN 'inputs' THEN 0 WHEN 'scripts' THEN 1
      WHEN 'textNodes' THEN p.text_nodes WHEN 'totalTextLength' THEN p.text_length WHEN 'visibleElements' THEN p.visible END AS initial,
    CASE x.metric WHEN 'totalElements' THEN m.totalElements WHEN 'buttons' THEN m.buttons WHEN 'inputs' THEN m.inputs WHEN 'scripts' THEN m.scripts
      WHEN 'textNodes' THEN m.textNodes WHEN 'totalTextLength' THEN m.totalTextLength WHEN 'visibleElements' THEN m.visibleElements END AS final
  FROM metrics m JOIN (SELECT t.page_id, t.n, t.visible, len(s.l) AS text_nodes,
      CAST(coalesce(list_sum(list_transform(s.l, lambda x: length({unescaped("x")}))), 0) AS BIGINT) AS text_length
    FROM (SELECT page_id, count(*) AS n, count(*) FILTER (WHERE nid = 0 OR nid >= body_nid) AS visible FROM plain_tags GROUP BY page_id) t
    JOIN (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(regexp_extract(html, '(?s)<body>(.*)$', 1), '(?s)</body>.*$', ''), '(?s)<[^>]*>'),
      lambda x: trim(x, ' \t\n') <> '') AS l FROM pages) s ON t.page_id = s.page_id) p ON m.page_id = p.page_id
  CROSS JOIN (SELECT unnest(['totalElements', 'visibleElements', 'textNodes', 'totalTextLength', 'buttons', 'inputs', 'scripts']) AS metric) x) d
WHERE final <> initial"""


@query("metric_changes", f"SELECT page_id, metric, initial, final, change FROM ({_CHANGES}) c")
def _(spark, sf):
    return M.metric_changes(M.snapshot_metrics(_snapshots(spark, sf)))


_SIGNIFICANT = f"""
SELECT page_id, concat_ws('; ', max(CASE WHEN metric = 'totalElements' AND change > 10 THEN concat('Added ', change, ' new elements') END),
  max(CASE WHEN metric = 'totalTextLength' AND change > 1000 THEN concat('Added ', change, ' characters of text') END),
  max(CASE WHEN metric = 'buttons' AND change > 0 THEN concat('Added ', change, ' new buttons') END)) AS messages
FROM ({_CHANGES}) c GROUP BY page_id"""


@query("significant_changes", f"SELECT * FROM ({_SIGNIFICANT}) s WHERE messages <> ''")
def _(spark, sf):
    changes = M.metric_changes(M.snapshot_metrics(_snapshots(spark, sf)))
    return M.significant_changes(changes).withColumn("messages", F.array_join("messages", "; "))


@query(
    "snapshot_timeline",
    """SELECT page_id, 'final' AS snapshot_type, url, totalElements, links FROM metrics NATURAL JOIN pages
    UNION ALL SELECT page_id, 'initial', max(url), count(*), count(*) FILTER (WHERE tag = 'A') FROM plain_tags GROUP BY page_id""",
)
def _(spark, sf):
    timeline = M.snapshot_timeline(_snapshots(spark, sf))
    return timeline.select("page_id", "snapshot_type", "url", "totalElements", "links")


@query("snapshot_counts", "SELECT page_id, count(*) AS n_snapshots FROM page_snapshots GROUP BY page_id")
def _(spark, sf):
    return M.snapshot_counts(_snapshots(spark, sf))


@query(
    "content_analysis",
    f"""SELECT coalesce(c.page_id, m.page_id) AS page_id, c.changes, coalesce(m.n, 0) AS total_mutations, coalesce(m.span, 0) AS timeline_span,
      coalesce(t.types, '') AS mutation_types, coalesce(g.tags, '') AS affected_elements, s.messages AS significant_changes
    FROM (SELECT page_id, string_agg(concat(metric, ':', initial, '>', final), ',' ORDER BY metric) AS changes FROM ({_CHANGES}) d GROUP BY page_id) c
    LEFT JOIN ({_SIGNIFICANT}) s ON c.page_id = s.page_id
    FULL JOIN (SELECT page_id, count(*) AS n, arg_max(ts_ms, seq) - arg_min(ts_ms, seq) AS span FROM mutation_log GROUP BY page_id) m ON c.page_id = m.page_id
    LEFT JOIN (SELECT page_id, string_agg(concat(type, '=', n), ';' ORDER BY type) AS types FROM (
      SELECT page_id, coalesce(type, 'unknown') AS type, count(*) AS n FROM mutation_log GROUP BY 1, 2) a GROUP BY page_id) t ON coalesce(c.page_id, m.page_id) = t.page_id
    LEFT JOIN (SELECT page_id, string_agg(concat(tag, '=', n), ';' ORDER BY tag) AS tags FROM (
      SELECT page_id, coalesce(target_tag, 'unknown') AS tag, count(*) AS n FROM mutation_log GROUP BY 1, 2) a GROUP BY page_id) g ON coalesce(c.page_id, m.page_id) = g.page_id""",
)
def _(spark, sf):
    df = M.content_analysis(M.snapshot_metrics(_snapshots(spark, sf)), mutation_log(spark, sf))
    shown = F.transform(
        "content_metric_changes",
        lambda c: F.concat(c["metric"], F.lit(":"), c["initial"].cast("string"), F.lit(">"), c["final"].cast("string")),
    )
    flat = df.select(
        "page_id",
        F.array_join(shown, ",").alias("changes"),
        "mutation_analysis.*",
        F.array_join("significant_changes", "; ").alias("significant_changes"),
    )
    return _methods(_methods(flat, "mutation_types"), "affected_elements")


# -- specification: markup -----------------------------------------------------------------------
_STATIC = """
SELECT page_id, 'heading' AS type, 'H1' AS level, trim(h1_text, ' \t\n') AS text, 'h1' AS selector, NULL AS tag, NULL AS class_name,
  CAST(NULL AS INT) AS link_count, CAST(NULL AS INT) AS text_length, 'high' AS importance FROM segments
UNION ALL SELECT page_id, 'navigation', NULL, NULL, NULL, 'NAV', '', CAST(len(regexp_extract_all(nav, '<a ')) AS INT), NULL, 'high' FROM segments
UNION ALL SELECT page_id, 'content_area', NULL, NULL, selector, tag, NULL, NULL, text_length, 'high' FROM areas"""


@query("static_elements", _STATIC)
def _(spark, sf):
    return G.static_elements(_aug(spark, sf)).drop("nid")


@query(
    "dynamic_element_specs",
    """SELECT page_id, nid, CASE WHEN aria IS NULL THEN 'clickable' ELSE 'expandable' END AS type, tag, txt AS text,
    CASE WHEN aria IS NULL THEN '[role="button"]' ELSE 'button' END AS selector, CASE WHEN aria IS NULL THEN 'medium' ELSE 'high' END AS importance
    FROM tags WHERE aria IS NOT NULL OR onclick""",
)
def _(spark, sf):
    return G.dynamic_element_specs(_aug(spark, sf)).drop("attributes", "xpath", "sel_ix")


@query(
    "layout_analysis",
    """SELECT a.page_id, a.n AS primary_content_areas,
    CASE WHEN contains(s.html, 'serviceWorker.register') THEN 'spa_application' ELSE 'static_website' END AS layout_type FROM (
      SELECT page_id, CAST(count(*) FILTER (WHERE text_length > 1000) AS INT) AS n FROM areas GROUP BY page_id) a JOIN segments s ON a.page_id = s.page_id""",
)
def _(spark, sf):
    return G.layout_analysis(_aug(spark, sf))


@query(
    "layout_analysis_measured",
    """SELECT s.page_id, 'traditional_website' AS layout_type, t.total_content_area FROM segments s LEFT JOIN (
      SELECT a.page_id, CAST(sum(CAST(l.width AS BIGINT) * l.height) AS BIGINT) AS total_content_area FROM (
        SELECT page_id, nid FROM tags WHERE tag = 'ARTICLE' UNION ALL SELECT page_id, nid FROM tags WHERE tag = 'MAIN' UNION ALL SELECT page_id, nid FROM tags WHERE tag = 'MAIN') a
      JOIN layout l ON a.page_id = l.page_id AND a.nid = l.nid GROUP BY a.page_id) t ON s.page_id = t.page_id""",
)
def _(spark, sf):
    out = G.layout_analysis(_aug(spark, sf), derived(spark, sf, "layout"), nav_aware=True)
    return out.drop("primary_content_areas")


@query(
    "content_selectors",
    """SELECT page_id, selector, 'content_area' AS type, CASE WHEN text_length > 2000 THEN 'high' ELSE 'medium' END AS confidence,
    text_length AS expected_content_length, concat('Main content area with ', text_length, ' characters') AS description FROM areas WHERE text_length > 500
    UNION ALL SELECT page_id, v.s, v.t, v.c, NULL, NULL FROM pages CROSS JOIN (VALUES ('main', 'semantic', 'high'), ('article', 'semantic', 'high'),
      ('.content', 'class-based', 'medium'), ('#content', 'id-based', 'medium'), ('[role="main"]', 'aria-based', 'high')) v(s, t, c)""",
)
def _(spark, sf):
    return G.content_selectors(_aug(spark, sf))


@query(
    "metadata_selectors",
    """SELECT page_id, 'meta[name="description"]' AS selector, 'content' AS attribute, 'meta_tag' AS type, 'high' AS confidence, 'Meta description' AS description
    FROM tags WHERE tag = 'META' AND name = 'description'
    UNION ALL SELECT page_id, 'h1', NULL, 'title_heading', 'high', 'Page title from H1' FROM tags WHERE tag = 'H1'""",
)
def _(spark, sf):
    return G.metadata_selectors(_aug(spark, sf))


@query(
    "navigation_patterns",
    """SELECT page_id, 'nav' AS selector, link_count, CASE WHEN link_count > 5 THEN 'primary' ELSE 'secondary' END AS type
    FROM (SELECT page_id, CAST(len(regexp_extract_all(nav, '<a ')) AS INT) AS link_count FROM segments) n""",
)
def _(spark, sf):
    return G.navigation_patterns(_aug(spark, sf))


@query(
    "form_patterns",
    """SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/search' AS action, 'post' AS method, CAST(2 AS INT) AS field_count,
    'search' AS type, TRUE AS interaction_required FROM tags WHERE tag = 'FORM'""",
)
def _(spark, sf):
    return G.form_patterns(_aug(spark, sf))


@query("javascript_required", "SELECT page_id, TRUE AS javascript_required FROM pages")
def _(spark, sf):
    return G.javascript_required(_pages(spark, sf))


@query(
    "javascript_required_monitored",
    "SELECT page_id, total_mutations > 0 OR api_calls_detected > 0 AS javascript_required FROM monitoring",
)
def _(spark, sf):
    return G.javascript_required(_pages(spark, sf), _monitoring(spark, sf))


# -- specification: monitoring -------------------------------------------------------------------
@query(
    "content_loading",
    """SELECT page_id, total_mutations > 0 AS dynamic_loading_detected, total_mutations AS mutation_count, coalesce(time_span_ms, 0) AS loading_timeframe,
    activity_level AS content_stability, api_calls_detected AS api_calls FROM monitoring""",
)
def _(spark, sf):
    return G.content_loading(_monitoring(spark, sf))


@query(
    "timing_requirements",
    """SELECT page_id, greatest(2000, coalesce(time_span_ms, 0)) AS recommended_wait_time, activity_level IN ('medium', 'high') AS stability_check_required,
    api_calls_detected > 0 AS network_wait_required FROM monitoring""",
)
def _(spark, sf):
    return G.timing_requirements(_monitoring(spark, sf))


@query(
    "performance_profile",
    """SELECT page_id, activity_level AS page_complexity, greatest(10000, 2 * coalesce(time_span_ms, 0)) AS recommended_timeout,
    CASE WHEN total_mutations > 100 THEN 'moderate' ELSE 'low' END AS memory_considerations,
    CASE WHEN activity_level = 'high' THEN 'not_recommended' ELSE 'possible' END AS parallel_processing FROM monitoring""",
)
def _(spark, sf):
    return G.performance_profile(_monitoring(spark, sf))


@query("network_endpoints", "SELECT page_id, url, method, count(*) AS n_calls FROM api GROUP BY page_id, url, method")
def _(spark, sf):
    return G.network_endpoints(_requests(spark, sf))


@query(
    "network_dependencies",
    """SELECT page_id, string_agg(DISTINCT method, ',') AS request_methods, count(*) AS concurrent_requests, TRUE AS requires_network_monitoring
    FROM api GROUP BY page_id""",
)
def _(spark, sf):
    deps = G.network_dependencies(_requests(spark, sf))
    return deps.withColumn("request_methods", F.array_join("request_methods", ","))


_EDGE = """
SELECT s.page_id, concat_ws('; ', CASE WHEN f.with_nested > 0 THEN concat('Nested expandable content (', f.with_nested, ' elements with nested interactions)') END,
  CASE WHEN m.activity_level = 'high' THEN 'High dynamic content activity - may require longer wait times' END,
  CASE WHEN f.total - f.succeeded > f.total * CAST(0.3 AS DOUBLE) THEN concat('High interaction failure rate (', f.total - f.succeeded, '/', f.total, ')') END,
  CASE WHEN contains(s.html, 'serviceWorker.register') THEN 'Service Worker detected - may affect caching and network requests' END) AS edge_cases
FROM segments s LEFT JOIN facts f ON s.page_id = f.page_id LEFT JOIN monitoring m ON s.page_id = m.page_id"""


@query("edge_cases", _EDGE)
def _(spark, sf):
    cases = G.edge_cases(P.page_meta(_aug(spark, sf)), _log(spark, sf), _monitoring(spark, sf))
    return cases.withColumn("edge_cases", F.array_join("edge_cases", "; "))


def _specs(spark, sf):
    return G.page_specs(_aug(spark, sf), _log(spark, sf), mutation_log(spark, sf), _requests(spark, sf))


@query(
    "page_specs",
    f"""SELECT s.page_id, s.url, CAST(coalesce(st.n, 0) AS INT) AS n_static, CAST(coalesce(dy.n, 0) AS INT) AS n_dynamic,
      CASE WHEN contains(s.html, 'serviceWorker.register') THEN 'spa_application' ELSE 'static_website' END AS layout_type,
      CAST(5 + (SELECT count(*) FROM areas a WHERE a.page_id = s.page_id AND a.text_length > 500) AS INT) AS n_selectors,
      coalesce(f.total, 0) AS total_expandable, coalesce(f.succeeded, 0) AS successful_expansions, coalesce(f.changed, 0) AS content_reveals,
      CASE WHEN f.total > 0 THEN CAST(f.total - f.succeeded AS DOUBLE) / f.total ELSE 0 END AS interaction_failure_rate,
      m.total_mutations > 0 OR m.api_calls_detected > 0 AS javascript_required, m.activity_level, e.edge_cases
    FROM segments s LEFT JOIN (SELECT page_id, count(*) AS n FROM ({_STATIC}) x GROUP BY page_id) st ON s.page_id = st.page_id
    LEFT JOIN (SELECT page_id, count(*) AS n FROM tags WHERE aria IS NOT NULL OR onclick GROUP BY page_id) dy ON s.page_id = dy.page_id
    LEFT JOIN facts f ON s.page_id = f.page_id LEFT JOIN monitoring m ON s.page_id = m.page_id
    LEFT JOIN ({_EDGE}) e ON s.page_id = e.page_id""",
)
def _(spark, sf):
    return _specs(spark, sf).select(
        "page_id",
        "metadata.url",
        F.size("site_structure.static_elements").alias("n_static"),
        F.size("site_structure.dynamic_elements").alias("n_dynamic"),
        "site_structure.layout_analysis.layout_type",
        F.size("content_patterns.main_content_selectors").alias("n_selectors"),
        "dynamic_behavior.expandable_content.total_expandable",
        "dynamic_behavior.expandable_content.successful_expansions",
        "dynamic_behavior.expandable_content.content_reveals",
        "extraction_strategy.error_handling.interaction_failure_rate",
        "technical_requirements.javascript_required",
        F.col("dynamic_behavior.content_loading_patterns.content_stability").alias("activity_level"),
        F.array_join("edge_cases", "; ").alias("edge_cases"),
    )


@query("page_specs_json")
def _(spark, sf):
    specs = _specs(spark, sf)
    return specs.select("page_id", F.to_json(F.struct(*[c for c in specs.columns if c != "page_id"])).alias("spec"))


@query(
    "spec_details",
    """SELECT page_id, section, count(*) AS n FROM (
      SELECT page_id, unnest(['content_reveals', 'user_interaction_requirements']) AS section FROM interaction_log WHERE depth = 0 AND success AND content_changed
      UNION ALL SELECT page_id, 'api_endpoints' FROM (SELECT DISTINCT page_id, url, method FROM api) u) s GROUP BY page_id, section""",
)
def _(spark, sf):
    rows = G.spec_details(_log(spark, sf), _requests(spark, sf))
    return rows.groupBy("page_id", "section").agg(F.count("item").alias("n"))


# -- summaries -----------------------------------------------------------------------------------
_SUMMARY = """
SELECT s.page_id, s.url, CAST(i.n AS INT) AS total_elements, CAST(i.e AS INT) AS expandable_elements, CAST(3 AS INT) AS static_content_areas,
  coalesce(f.total, 0) AS total_interactions, coalesce(f.succeeded, 0) AS successful_interactions, coalesce(f.changed, 0) AS content_changes_detected,
  m.total_mutations AS mutations_detected, m.api_calls_detected AS api_calls_made, m.activity_level
FROM segments s JOIN (SELECT page_id, count(*) FILTER (WHERE aria IS NOT NULL) AS e,
  count(*) FILTER (WHERE tag IN ('A', 'BUTTON', 'DETAILS', 'SUMMARY', 'INPUT', 'SELECT') OR onclick OR cls = 'expandable') AS n FROM tags GROUP BY page_id) i ON s.page_id = i.page_id
LEFT JOIN facts f ON s.page_id = f.page_id LEFT JOIN monitoring m ON s.page_id = m.page_id"""


def _summary(spark, sf):
    return B.page_summary(_aug(spark, sf), _log(spark, sf), mutation_log(spark, sf), _requests(spark, sf))


@query("page_summary", _SUMMARY)
def _(spark, sf):
    return _summary(spark, sf)


@query(
    "recommendations",
    f"""SELECT page_id, concat_ws('; ', CASE WHEN total_interactions > 0 AND CAST(successful_interactions AS DOUBLE) / total_interactions < CAST(0.7 AS DOUBLE)
        THEN 'Consider implementing robust error handling for interactions' END,
      CASE WHEN activity_level = 'high' THEN 'Use longer wait times due to high dynamic activity' END,
      CASE WHEN expandable_elements > 5 THEN 'Implement systematic expansion strategy for multiple expandable elements' END) AS recommendations
    FROM ({_SUMMARY}) s""",
)
def _(spark, sf):
    advice = B.recommendations(_summary(spark, sf))
    return advice.select("page_id", F.array_join("recommendations", "; ").alias("recommendations"))


def _with_failures(spark, sf):
    html = F.when(F.col("page_id") % 17 != 3, F.col("html"))
    return _aug(spark, sf).withColumn("html", html)


@query(
    "page_outcomes",
    "SELECT page_id, url, page_id % 17 <> 3 AS ok, CASE WHEN page_id % 17 = 3 THEN 'no html' END AS error FROM pages",
)
def _(spark, sf):
    return B.page_outcomes(_with_failures(spark, sf))


@query(
    "outcome_totals",
    """SELECT count(*) AS total_urls, count(*) FILTER (WHERE page_id % 17 <> 3) AS successful, count(*) FILTER (WHERE page_id % 17 = 3) AS failed FROM pages""",
)
def _(spark, sf):
    return B.outcome_totals(B.page_outcomes(_with_failures(spark, sf)))


@query(
    "batch_summary",
    """SELECT CAST(count(*) FILTER (WHERE ok) AS DOUBLE) / count(*) AS success_rate, CAST(sum(total) FILTER (WHERE ok) AS DOUBLE) / count(*) FILTER (WHERE ok) AS average_interactions,
      CAST(sum(total) FILTER (WHERE ok) AS DOUBLE) / count(*) FILTER (WHERE ok) AS average_expandable_elements,
      concat('spa_application=', count(*) FILTER (WHERE ok AND spa), ';static_website=', count(*) FILTER (WHERE ok AND NOT spa)) AS common_layout_types, NULL AS message
    FROM (SELECT s.page_id % 17 <> 3 AS ok, contains(s.html, 'serviceWorker.register') AS spa, coalesce(f.total, 0) AS total
      FROM segments s LEFT JOIN facts f ON s.page_id = f.page_id) x""",
)
def _(spark, sf):
    summary = B.batch_summary(_with_failures(spark, sf), _log(spark, sf))
    return _methods(summary, "common_layout_types").drop("common_challenges")
