"""Page specification: what a reader of the page has to know, per page and in one row.

Sections that come from the markup are array expressions over a parsed page, so the whole
markup half of a specification is one projection.  Sections that come from logs are
per-page aggregates joined on page_id.  Lists that grow with a log (called endpoints,
elements that revealed content) are not packed into the row: ``spec_details`` has them as
rows, because one page may hold a large part of a log.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.functions.scalars import let
from pagespark.functions.selectors import css, first_match, selector_name
from pagespark.operators import dom as D
from pagespark.operators import expand as E
from pagespark.operators import monitor as M
from pagespark.operators import page as P

AREA_IN_SPEC = ["main", "article", ".content", "#content"]
# Selectors worth trying on any page.
COMMON_SELECTORS = [
    ("main", "semantic", "high"),
    ("article", "semantic", "high"),
    (".content", "class-based", "medium"),
    ("#content", "id-based", "medium"),
    ('[role="main"]', "aria-based", "high"),
]
META_IN_SPEC = ["description", "keywords", "author", "title"]
PRIMARY_TEXT, SUBSTANTIAL_TEXT, LONG_TEXT = 1000, 500, 2000
VERSION = "1.0"

def _rows(dom: DataFrame, array: Column) -> DataFrame:
    return dom.select(*D.page_keys(dom), F.inline(array))


# -- sections from the markup -----------------------------------------------------------------
def static_elements_array(areas: Column) -> Column:
    def element(kind: str, nid: Column, importance: Column, **given: Column) -> Column:
        shape = {"level": "string", "text": "string", "selector": "string", "tag": "string", "class_name": "string",
                 "link_count": "int", "text_length": "int"}
        cells = [given.get(k, F.lit(None)).cast(t).alias(k) for k, t in shape.items()]
        return F.struct(F.lit(kind).alias("type"), nid.alias("nid"), *cells, importance.alias("importance"))

    def heading(x: Column) -> Column:
        anchor = F.when(x["id"] != "", F.concat(F.lit("#"), x["id"])).otherwise("")
        rank = F.when(x["tag"].isin("H1", "H2"), "high").otherwise("medium")
        return element(
            "heading", x["nid"], rank, level=x["tag"], text=D.trim(x["text"]),
            selector=F.concat(F.lower(x["tag"]), anchor),
        )

    def nav(x: Column) -> Column:
        return element(
            "navigation", x["nid"], F.lit("high"), tag=x["tag"], class_name=x["class_name"], link_count=x["links_within"]
        )

    def area(x: Column) -> Column:
        return element(
            "content_area", x["nid"], F.lit("high"), selector=x["selector"], tag=x["tag"], text_length=x["text_length"]
        )

    return F.concat(
        F.transform(D.matching(lambda n: n("tag").isin(P.HEADINGS)), heading),
        F.transform(D.matching(lambda n: css(P.NAV_SELECTOR, n)), nav),
        F.transform(F.filter(areas, lambda a: a["selector"].isin(AREA_IN_SPEC)), area),
    )


STATIC_FIELDS = {*P.AREA_FIELDS, "class_name", "links_within", "text"}


def static_elements(pages: DataFrame) -> DataFrame:
    """Headings, navigation blocks and main content areas."""
    return _rows(D.ensure_dom(pages, *STATIC_FIELDS), static_elements_array(P.area_structs()))


def dynamic_elements_array(text_limit: int | None = None) -> Column:
    ranked = F.transform(
        D.matching(P.is_dynamic),
        lambda x: F.struct(first_match(P.INTERACTIVE_SELECTORS, x.getField).alias("ix"), x.alias("node")),
    )

    def element(h: Column) -> Column:
        n = h["node"].getField
        kind = P.interaction_type(n)
        return F.struct(
            h["ix"].alias("sel_ix"),
            n("nid").alias("nid"),
            kind.alias("type"),
            selector_name(P.INTERACTIVE_SELECTORS, h["ix"]).alias("selector"),
            n("tag").alias("tag"),
            D.shown_text(n, text_limit).alias("text"),
            n("attrs").alias("attributes"),
            n("xpath").alias("xpath"),
            F.when(kind == "expandable", "high").otherwise("medium").alias("importance"),
        )

    def by_selector(a: Column, b: Column) -> Column:
        return F.when(a["sel_ix"] != b["sel_ix"], a["sel_ix"] - b["sel_ix"]).otherwise(a["nid"] - b["nid"])

    return F.array_sort(F.transform(ranked, element), by_selector)


def dynamic_element_specs(pages: DataFrame, text_limit: int | None = None) -> DataFrame:
    return _rows(D.ensure_dom(pages, *P.INTERACTIVE_FIELDS), dynamic_elements_array(text_limit))


def layout_type(nav_aware: bool = False) -> Column:
    """``traditional_website`` needs a navigation-like content selector, which the fixed list has not;
    ``nav_aware`` looks at navigation blocks instead."""
    nav = D.count_css(P.NAV_SELECTOR) > 0 if nav_aware else F.lit("nav" in "".join(P.CONTENT_SELECTORS))
    return (
        F.when(nav, "traditional_website").when(P.service_worker(), "spa_application").otherwise("static_website")
    )


LAYOUT_FIELDS = {*P.AREA_FIELDS, *P.META_FIELDS}


def layout_columns(nav_aware: bool = False) -> list[Column]:
    large = F.size(F.filter("areas", lambda a: a["text_length"] > PRIMARY_TEXT))
    return [
        F.when(F.size("areas") > 0, large).alias("primary_content_areas"),
        layout_type(nav_aware).alias("layout_type"),
    ]


def layout_analysis(pages: DataFrame, layout: DataFrame | None = None, nav_aware: bool = False) -> DataFrame:
    """Primary content areas and layout type; with a layout also the total area in pixels."""
    dom = D.ensure_dom(pages, *LAYOUT_FIELDS)
    keys = D.page_keys(dom)
    dom = dom.withColumn("areas", P.area_structs())
    if layout is None:
        return dom.select(*keys, *layout_columns(nav_aware))
    # one row per area, or one for a page without any, so that boxes join without a second parse
    areas = dom.select(*keys, *layout_columns(nav_aware), F.explode_outer("areas").alias("area"))
    boxes = layout.select(*[c for c in layout.columns if c in keys], "nid", "width", "height")
    measured = areas.withColumn("nid", F.col("area.nid")).join(boxes, [*keys, "nid"], "left")
    total = F.sum(F.col("width").cast("long") * F.col("height")).alias("total_content_area")
    return measured.groupBy(*keys, "primary_content_areas", "layout_type").agg(total)


def content_selectors_array(areas: Column) -> Column:
    def found(a: Column) -> Column:
        n = a["text_length"]
        return F.struct(
            a["selector"].alias("selector"),
            F.lit("content_area").alias("type"),
            F.when(n > LONG_TEXT, "high").otherwise("medium").alias("confidence"),
            n.alias("expected_content_length"),
            F.format_string("Main content area with %d characters", n).alias("description"),
        )

    common = [
        F.struct(
            F.lit(s).alias("selector"),
            F.lit(kind).alias("type"),
            F.lit(c).alias("confidence"),
            F.lit(None).cast("int").alias("expected_content_length"),
            F.lit(None).cast("string").alias("description"),
        )
        for s, kind, c in COMMON_SELECTORS
    ]
    return F.concat(F.transform(F.filter(areas, lambda a: a["text_length"] > SUBSTANTIAL_TEXT), found), F.array(*common))


def content_selectors(pages: DataFrame) -> DataFrame:
    return _rows(D.ensure_dom(pages, *P.AREA_FIELDS), content_selectors_array(P.area_structs()))


def metadata_selectors_array() -> Column:
    def item(selector: Column, attribute: Column, kind: str, description: Column) -> Column:
        return F.struct(
            selector.alias("selector"),
            attribute.cast("string").alias("attribute"),
            F.lit(kind).alias("type"),
            F.lit("high").alias("confidence"),
            description.alias("description"),
        )

    metas = F.transform(
        D.matching(lambda n: P.is_named_meta(n) & P.meta_name(n).isin(META_IN_SPEC)),
        lambda x: let(
            P.meta_name(x.getField),
            lambda name: item(
                F.format_string('meta[name="%s"]', name), F.lit("content"), "meta_tag", F.concat(F.lit("Meta "), name)
            ),
        ),
    )
    tops = F.transform(
        D.matching(lambda n: css("h1", n)),
        lambda x: item(F.lit("h1"), F.lit(None), "title_heading", F.lit("Page title from H1")),
    )
    return F.concat(metas, tops)


def metadata_selectors(pages: DataFrame) -> DataFrame:
    return _rows(D.ensure_dom(pages, "tag", "attrs"), metadata_selectors_array())


def navigation_array() -> Column:
    def pattern(x: Column) -> Column:
        dotted = F.concat(F.lower(x["tag"]), F.lit("."), F.replace(x["class_name"], F.lit(" "), F.lit(".")))
        return F.struct(
            F.regexp_replace(dotted, r"\.+$", "").alias("selector"),
            x["links_within"].alias("link_count"),
            F.when(x["links_within"] > 5, "primary").otherwise("secondary").alias("type"),
        )

    return F.transform(D.matching(lambda n: css(P.NAV_SELECTOR, n)), pattern)


def navigation_patterns(pages: DataFrame) -> DataFrame:
    dom = D.ensure_dom(pages, "tag", "classes", "class_name", "attrs", "links_within")
    return _rows(dom, navigation_array())


def form_patterns_array() -> Column:
    def pattern(x: Column) -> Column:
        n = x.getField
        return let(
            P.form_action(n),
            lambda action: F.struct(
                action.alias("action"),
                P.form_method(n).alias("method"),
                n("fields_within").alias("field_count"),
                F.when(F.contains(F.lower(action), F.lit("search")), "search").otherwise("form").alias("type"),
                (n("fields_within") > 0).alias("interaction_required"),
            ),
        )

    return F.transform(D.matching(lambda n: css("form", n)), pattern)


def form_patterns(pages: DataFrame) -> DataFrame:
    return _rows(D.ensure_dom(pages, "tag", "attrs", "fields_within"), form_patterns_array())


# -- sections from the interaction log -----------------------------------------------------------
def success_rate(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total).otherwise(F.lit(0.0))


def interaction_patterns(interaction_log: DataFrame) -> DataFrame:
    s = E.expansion_summary(interaction_log)
    rate = success_rate(F.col("successful_expansions"), F.col("total_elements"))
    return s.select("page_id", F.col("methods").alias("expansion_methods"), rate.alias("overall_success_rate"))


def expandable_analysis(interaction_log: DataFrame) -> DataFrame:
    """Totals, successes per method and the deepest nested level; ``content_reveals`` has the elements."""
    return E.with_methods(
        interaction_log,
        {
            "total_expandable": F.count_if(E.top_level()),
            "successful_expansions": F.count_if(E.top_level() & E.succeeded()),
            "max_nested_levels": F.coalesce(F.max(F.when(~E.top_level(), F.col("depth"))), F.lit(0)),
        },
    ).withColumnRenamed("max_nested_levels", "nested_levels")


def content_reveals(interaction_log: DataFrame) -> DataFrame:
    done = interaction_log.filter(E.top_level() & E.changed())
    return done.select("page_id", "element_id", E.method().alias("method"))


def interaction_requirements(interaction_log: DataFrame) -> DataFrame:
    """Elements whose use changed the page; priority is high for those that revealed others."""
    wanted = interaction_log.filter(E.top_level() & E.changed()).select("page_id", "element_id", "method")
    flagged = wanted.join(E.nested_counts(interaction_log), ["page_id", "element_id"], "left")
    priority = F.when(F.col("n_nested").isNotNull(), "high").otherwise("medium")
    return flagged.select("page_id", "element_id", "method", priority.alias("priority"))


def failure_stats(interaction_log: DataFrame) -> DataFrame:
    top = interaction_log.filter(E.top_level())
    return top.groupBy("page_id").agg(F.avg((~E.succeeded()).cast("int")).alias("interaction_failure_rate"))


def interaction_facts(interaction_log: DataFrame) -> DataFrame:
    """All per-page figures of the log that a specification needs, in one grouping chain."""
    facts = E.with_methods(
        interaction_log,
        {
            "total": F.count_if(E.top_level()),
            "succeeded": F.count_if(E.top_level() & E.succeeded()),
            "changed": F.count_if(E.top_level() & E.changed()),
            "max_depth": F.coalesce(F.max(F.when(~E.top_level(), F.col("depth"))), F.lit(0)),
        },
    )
    parents = E.nested_counts(interaction_log).groupBy("page_id").agg(F.count("*").alias("with_nested"))
    return facts.join(parents, "page_id", "left").withColumn("with_nested", F.coalesce("with_nested", F.lit(0)))


# -- sections from monitoring ------------------------------------------------------------------------
def content_loading_columns() -> list[Column]:
    return [
        (F.col("total_mutations") > 0).alias("dynamic_loading_detected"),
        F.col("total_mutations").alias("mutation_count"),
        F.coalesce("time_span_ms", F.lit(0)).alias("loading_timeframe"),
        F.col("activity_level").alias("content_stability"),
        F.col("api_calls_detected").alias("api_calls"),
    ]


def content_loading(monitoring: DataFrame) -> DataFrame:
    return monitoring.select("page_id", *content_loading_columns())


def timing_columns() -> list[Column]:
    return [
        F.greatest(F.lit(2000), F.coalesce("time_span_ms", F.lit(0))).alias("recommended_wait_time"),
        F.col("activity_level").isin("medium", "high").alias("stability_check_required"),
        (F.col("api_calls_detected") > 0).alias("network_wait_required"),
    ]


def timing_requirements(monitoring: DataFrame) -> DataFrame:
    return monitoring.select("page_id", *timing_columns())


def performance_columns() -> list[Column]:
    return [
        F.col("activity_level").alias("page_complexity"),
        F.greatest(F.lit(10000), F.coalesce("time_span_ms", F.lit(0)) * 2).alias("recommended_timeout"),
        F.when(F.col("total_mutations") > 100, "moderate").otherwise("low").alias("memory_considerations"),
        F.when(F.col("activity_level") == "high", "not_recommended").otherwise("possible").alias("parallel_processing"),
    ]


def performance_profile(monitoring: DataFrame) -> DataFrame:
    return monitoring.select("page_id", *performance_columns())


def network_endpoints(requests: DataFrame) -> DataFrame:
    """Called data endpoints with how often each was called, one row each."""
    return M.api_calls(requests).groupBy("page_id", "url", "method").agg(F.count("*").alias("n_calls"))


def network_dependencies(requests: DataFrame) -> DataFrame:
    """Number of data calls and the request methods used.

    Grouping by method first leaves one row per method for the second step, so the set in a row is
    bounded by the vocabulary of request methods.  The endpoints are rows of ``network_endpoints``.
    """
    by_method = M.api_calls(requests).groupBy("page_id", "method").agg(F.count("*").alias("n"))
    return by_method.groupBy("page_id").agg(
        F.array_sort(F.collect_list("method")).alias("request_methods"),
        F.sum("n").alias("concurrent_requests"),
        (F.sum("n") > 0).alias("requires_network_monitoring"),
    )


def javascript_required(pages: DataFrame, monitoring: DataFrame | None = None) -> DataFrame:
    """Monitored pages need scripts if anything moved or was called; others if they have scripts."""
    dom = D.ensure_dom(pages, "tag")
    if monitoring is None:
        return dom.select(*D.page_keys(dom), (P.script_count() > 0).alias("javascript_required"))
    seen = monitoring.select("page_id", _moved().alias("moved"))
    scripted = dom.select("page_id", (P.script_count() > 0).alias("scripted"))
    return scripted.join(seen, "page_id", "left").select(
        "page_id", F.coalesce("moved", "scripted").alias("javascript_required")
    )


def _moved() -> Column:
    return (F.col("total_mutations") > 0) | (F.col("api_calls_detected") > 0)


def edge_case_messages(with_nested: Column, level: Column, failed: Column, total: Column, worker: Column) -> Column:
    # Message forms.
    return F.array_compact(
        F.array(
            F.when(
                with_nested > 0,
                F.format_string("Nested expandable content (%d elements with nested interactions)", with_nested),
            ),
            F.when(level == "high", F.lit("High dynamic content activity - may require longer wait times")),
            F.when(failed > total * F.lit(0.3), F.format_string("High interaction failure rate (%d/%d)", failed, total)),
            F.when(worker, F.lit("Service Worker detected - may affect caching and network requests")),
        )
    )


def edge_cases(meta: DataFrame, interaction_log: DataFrame, monitoring: DataFrame) -> DataFrame:
    facts = interaction_facts(interaction_log).select("page_id", "total", "succeeded", "with_nested")
    joined = (
        meta.select("page_id", "has_service_worker")
        .join(facts, "page_id", "left")
        .join(monitoring.select("page_id", "activity_level"), "page_id", "left")
    )
    zero = F.lit(0)
    total = F.coalesce("total", zero)
    failed = total - F.coalesce("succeeded", zero)
    messages = edge_case_messages(
        F.coalesce("with_nested", zero), F.col("activity_level"), failed, total, F.col("has_service_worker")
    )
    return joined.select("page_id", messages.alias("edge_cases"))


# -- the whole specification -----------------------------------------------------------------------------
SPEC_FIELDS = {*STATIC_FIELDS, *P.INTERACTIVE_FIELDS, *P.META_FIELDS, "fields_within", "url"}


def page_specs(
    pages: DataFrame,
    interaction_log: DataFrame | None = None,
    mutation_log: DataFrame | None = None,
    request_log: DataFrame | None = None,
    text_limit: int | None = None,
) -> DataFrame:
    """One nested row per page.  The page is parsed once and its markup half is one projection."""
    dom = D.ensure_dom(pages, *SPEC_FIELDS).withColumn("areas", P.area_structs())
    spec = dom.select(
        "page_id",
        F.struct(
            F.col("url"),
            P.title_column().alias("title"),
            F.current_timestamp().alias("generation_timestamp"),
            F.lit(VERSION).alias("analysis_version"),
        ).alias("metadata"),
        static_elements_array(F.col("areas")).alias("static_elements"),
        dynamic_elements_array(text_limit).alias("dynamic_elements"),
        F.struct(*layout_columns()).alias("layout_analysis"),
        F.struct(
            content_selectors_array(F.col("areas")).alias("main_content_selectors"),
            metadata_selectors_array().alias("metadata_selectors"),
            navigation_array().alias("navigation_patterns"),
            form_patterns_array().alias("form_patterns"),
        ).alias("content_patterns"),
        P.service_worker().alias("worker"),
        (P.script_count() > 0).alias("scripted"),
    )
    zero = F.lit(0).cast("long")
    if interaction_log is None:
        empty_methods = F.lit(None).cast("map<string,bigint>").alias("methods")
        spec = spec.select(
            "*", *[zero.alias(c) for c in ("total", "succeeded", "changed", "with_nested", "max_depth")], empty_methods
        )
    else:
        spec = spec.join(interaction_facts(interaction_log), "page_id", "left")
    monitored = mutation_log is not None
    if monitored:
        spec = spec.join(M.monitoring_summary(mutation_log, request_log), "page_id", "left")
        for c, none in (("total_mutations", zero), ("api_calls_detected", zero), ("activity_level", F.lit("none"))):
            spec = spec.withColumn(c, F.coalesce(c, none))
        behaviour = [F.struct(*f()) for f in (content_loading_columns, timing_columns, performance_columns)]
    else:
        behaviour = [F.lit(None).cast("string")] * 3
    if request_log is not None:
        spec = spec.join(network_dependencies(request_log), "page_id", "left")
        network = F.struct("request_methods", "concurrent_requests", "requires_network_monitoring")
    else:
        network = F.lit(None).cast("string")
    total, done = F.coalesce("total", zero), F.coalesce("succeeded", zero)
    rate = success_rate(done, total)
    level = F.col("activity_level") if monitored else F.lit(None).cast("string")
    return spec.select(
        "page_id",
        "metadata",
        F.struct(
            F.col("static_elements"),
            F.col("dynamic_elements"),
            F.struct(F.col("methods").alias("expansion_methods"), rate.alias("overall_success_rate")).alias(
                "interaction_patterns"
            ),
            F.col("layout_analysis"),
        ).alias("site_structure"),
        "content_patterns",
        F.struct(
            F.struct(
                total.alias("total_expandable"),
                done.alias("successful_expansions"),
                F.col("methods").alias("expansion_methods"),
                F.coalesce("changed", zero).alias("content_reveals"),
                F.coalesce(F.col("max_depth").cast("long"), zero).alias("nested_levels"),
            ).alias("expandable_content"),
            behaviour[0].alias("content_loading_patterns"),
            behaviour[1].alias("timing_requirements"),
        ).alias("dynamic_behavior"),
        F.struct(
            F.struct(
                F.when(total > 0, (total - done) / total).otherwise(F.lit(0.0)).alias("interaction_failure_rate"),
            ).alias("error_handling")
        ).alias("extraction_strategy"),
        F.struct(
            (_moved() if monitored else F.col("scripted")).alias("javascript_required"),
            F.col("worker").alias("service_worker"),
            network.alias("network_dependencies"),
            behaviour[2].alias("performance_considerations"),
        ).alias("technical_requirements"),
        edge_case_messages(F.coalesce("with_nested", zero), level, total - done, total, F.col("worker")).alias(
            "edge_cases"
        ),
    )


def spec_details(interaction_log: DataFrame, request_log: DataFrame) -> DataFrame:
    """The log-sized lists of a specification as rows: (page_id, section, item) with item as JSON."""

    def section(df: DataFrame, name: str) -> DataFrame:
        cells = [c for c in df.columns if c != "page_id"]
        return df.select("page_id", F.lit(name).alias("section"), F.to_json(F.struct(*cells)).alias("item"))

    return (
        section(content_reveals(interaction_log), "content_reveals")
        .unionByName(section(interaction_requirements(interaction_log), "user_interaction_requirements"))
        .unionByName(section(network_endpoints(request_log), "api_endpoints"))
    )
