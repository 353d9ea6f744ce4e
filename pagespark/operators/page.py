"""Page structure: what a captured page consists of.

Every operator takes raw pages or a parsed frame (``dom.parse_pages``) and is one
projection over it, so no operator here shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagespark.functions.scalars import let, normalize_url
from pagespark.functions.selectors import Node, css, first_match, selector_name
from pagespark.operators import dom as D

# Selector lists, in report order.
INTERACTIVE_SELECTORS = [
    "button", "a", '[role="button"]', "[onclick]", "[aria-expanded]", ".expandable", ".collapsible",
    "details", "summary", "input", "select", "textarea", "[tabindex]", "[data-toggle]", "[data-collapse]",
]
CONTENT_SELECTORS = ["main", "article", ".content", "#content", ".main", ".container", ".wrapper", '[role="main"]']
NAV_SELECTOR = 'nav,.nav,.navigation,[role="navigation"]'
FIELD_SELECTOR = "input,select,textarea"
QUICK_SELECTOR = '[aria-expanded="false"],details:not([open])'
# Signs of a challenge page instead of content.
CHALLENGE_TITLES = [
    "just a moment", "checking your browser", "cloudflare", "access denied", "blocked", "captcha",
    "security check", "ddos protection", "rate limited",
]
CHALLENGE_SELECTORS = [
    ".cf-browser-verification", "#challenge-form", ".grecaptcha-badge", "[data-sitekey]", ".challenge-running",
    'meta[name="robots"][content*="noindex"]',
]
MINIMAL_TEXT = 100
METRICS = ["totalElements", "visibleElements", "textNodes", "totalTextLength", "links", "buttons", "inputs", "images",
           "scripts"]


def _one_row(dom: DataFrame, *cols: Column, also: tuple[str, ...] = ()) -> DataFrame:
    return dom.select(*D.page_keys(dom), *also, *cols)


def title_column() -> Column:
    """Text of the first <title>, white space collapsed; NULL when there is none."""
    titles = F.transform(D.matching(lambda n: css("title", n)), lambda x: x["text"])
    return F.trim(F.regexp_replace(F.try_element_at(titles, F.lit(1)), "[\t\n\f\r ]+", " "))


TITLE_FIELDS = ("tag", "text")


def page_titles(pages: DataFrame) -> DataFrame:
    return _one_row(D.ensure_dom(pages, *TITLE_FIELDS, tags=["title"]), title_column().alias("title"))


# -- interactive elements -----------------------------------------------------------
INTERACTIVE_FIELDS = ("tag", "id", "classes", "attrs", *D.TEXT_FIELDS, "xpath", "static_visible")


def interaction_type(n: Node) -> Column:
    return (
        F.when(css("[aria-expanded]", n), "expandable")
        .when(css("a", n), "link")
        .when(css("button", n), "button")
        .when(css("[onclick]", n), "clickable")
        .otherwise("interactive")
    )


def is_interactive(n: Node) -> Column:
    return first_match(INTERACTIVE_SELECTORS, n).isNotNull()


def is_dynamic(n: Node) -> Column:
    """Interactive elements that change the page when used: expandable or clickable ones."""
    return css("[aria-expanded]", n) | (css("[onclick]", n) & ~n("tag").isin("A", "BUTTON"))


def _interactive_columns(ix: Column, n: Node, text_limit: int | None = None) -> list[Column]:
    return [
        ix.alias("sel_ix"),
        n("nid").alias("nid"),
        selector_name(INTERACTIVE_SELECTORS, ix).alias("selector"),
        n("tag").alias("tag"),
        D.shown_text(n, text_limit).alias("text"),
        n("attrs").alias("attributes"),
        n("xpath").alias("xpath"),
        n("static_visible").alias("is_visible"),
        interaction_type(n).alias("interaction_type"),
    ]


def interactive_elements(pages: DataFrame, layout: DataFrame | None = None, text_limit: int | None = None) -> DataFrame:
    """Each interactive element once, under its first selector; report order is (sel_ix, nid).

    With a layout, elements carry their measured box and are visible only if it takes up room.
    """
    dom = D.ensure_dom(pages, *INTERACTIVE_FIELDS)
    found = D.ranked_rows(
        dom, lambda n: first_match(INTERACTIVE_SELECTORS, n), lambda n: F.lit(True),
        lambda ix, n: _interactive_columns(ix, n, text_limit),
    )
    if layout is None:
        return found
    placed = D.with_positions(found, layout)
    return placed.withColumn("is_visible", F.col("is_visible") & F.col("has_box")).drop("has_box")


def dynamic_elements(pages: DataFrame, text_limit: int | None = None) -> DataFrame:
    dom = D.ensure_dom(pages, *INTERACTIVE_FIELDS)
    project = lambda ix, n: _interactive_columns(ix, n, text_limit)
    return D.ranked_rows(dom, lambda n: first_match(INTERACTIVE_SELECTORS, n), is_dynamic, project)


# -- head -----------------------------------------------------------------------------
def meta_name(n: Node) -> Column:
    return F.coalesce(F.nullif(D.attr(n, "name"), F.lit("")), D.attr(n, "property"))


def is_named_meta(n: Node) -> Column:
    return css("meta", n) & F.coalesce(meta_name(n) != "", F.lit(False))


def meta_tags(pages: DataFrame) -> DataFrame:
    dom = D.ensure_dom(pages, "tag", "attrs", tags=["meta"])
    return D.node_rows(
        dom,
        is_named_meta,
        lambda n: [n("nid").alias("nid"), meta_name(n).alias("name"), D.attr(n, "content").alias("content")],
    )


def link_tags(pages: DataFrame) -> DataFrame:
    dom = D.ensure_dom(pages, "tag", "attrs", tags=["link"])
    return D.node_rows(
        dom,
        lambda n: css("link", n) & F.coalesce(D.attr(n, "rel") != "", F.lit(False)),
        lambda n: [n("nid").alias("nid"), *[D.attr(n, a).alias(a) for a in ("rel", "href", "type")]],
    )


META_FIELDS = ("tag", "attrs", "text")


def script_count() -> Column:
    return D.count_css("script")


def service_worker() -> Column:
    """Some script of the page registers a service worker."""
    return F.exists(
        D.matching(lambda n: css("script", n)),
        lambda x: F.contains(x["text"], F.lit("serviceWorker.register")),
    )


def language() -> Column:
    root = F.try_element_at("nodes", F.lit(1)).getField("attrs")
    return F.coalesce(F.nullif(F.try_element_at(root, F.lit("lang")), F.lit("")), F.lit("unknown"))


def page_meta(pages: DataFrame) -> DataFrame:
    return _one_row(
        D.ensure_dom(pages, *META_FIELDS),
        script_count().alias("scripts"),
        D.count_css('link[rel="stylesheet"]').alias("stylesheets"),
        language().alias("language"),
        service_worker().alias("has_service_worker"),
    )


# -- content patterns -------------------------------------------------------------------
AREA_FIELDS = ("tag", "id", "classes", "attrs", "text_len", "n_children", "static_visible")


def area_structs() -> Column:
    """Content areas of a page: a visible element once per selector it matches, by (selector, nid)."""

    def may_match(n: Node) -> Column:
        return n("tag").isin("MAIN", "ARTICLE") | (F.size(n("attrs")) > 0)

    def per_selector(candidates: Column, i: int, selector: str) -> Column:
        return F.transform(
            F.filter(candidates, lambda x: css(selector, x.getField)),
            lambda x: F.struct(
                F.lit(i).alias("sel_ix"),
                x["nid"].alias("nid"),
                F.lit(selector).alias("selector"),
                x["tag"].alias("tag"),
                x["text_len"].alias("text_length"),
                x["n_children"].alias("child_count"),
            ),
        )

    return let(
        D.matching(lambda n: n("static_visible") & may_match(n)),
        lambda nodes: F.concat(*[per_selector(nodes, i, s) for i, s in enumerate(CONTENT_SELECTORS)]),
    )


def content_areas(pages: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    dom = D.ensure_dom(pages, *AREA_FIELDS)
    areas = dom.select(*D.page_keys(dom), F.inline(area_structs()))
    return areas if layout is None else D.with_positions(areas, layout).filter("has_box").drop("has_box")


def navigation_blocks(pages: DataFrame, text_limit: int | None = None) -> DataFrame:
    dom = D.ensure_dom(pages, "tag", "classes", "attrs", "class_name", "links_within", *D.TEXT_FIELDS)
    return D.node_rows(
        dom,
        lambda n: css(NAV_SELECTOR, n),
        lambda n: [
            n("nid").alias("nid"),
            n("tag").alias("tag"),
            n("class_name").alias("class_name"),
            n("links_within").alias("link_count"),
            D.shown_text(n, text_limit).alias("text"),
        ],
    )


HEADINGS = ["H1", "H2", "H3", "H4", "H5", "H6"]


def headings(pages: DataFrame) -> DataFrame:
    dom = D.ensure_dom(pages, "tag", "id", "text", tags=map(str.lower, HEADINGS))
    return D.node_rows(
        dom,
        lambda n: n("tag").isin(HEADINGS),
        lambda n: [
            n("nid").alias("nid"),
            n("tag").alias("level"),
            D.trim(n("text")).alias("text"),
            n("id").alias("id"),
        ],
    )


def form_action(n: Node) -> Column:
    """Where the form goes: its action resolved against the page, the page itself when empty."""
    action = F.coalesce(D.trim(D.attr(n, "action")), F.lit(""))
    return F.when(action == "", F.col("url")).otherwise(normalize_url(action, F.col("url")))


def form_method(n: Node) -> Column:
    method = F.lower(D.attr(n, "method"))
    return F.when(method.isin("post", "dialog"), method).otherwise("get")


def forms(pages: DataFrame) -> DataFrame:
    dom = D.ensure_dom(pages, "tag", "attrs", "fields_within", tags=["form"])
    return D.node_rows(
        dom,
        lambda n: css("form", n),
        lambda n: [
            n("nid").alias("nid"),
            form_action(n).alias("action"),
            form_method(n).alias("method"),
            n("fields_within").alias("field_count"),
        ],
    )


# -- whole-page figures -------------------------------------------------------------------
def raw_page_info(pages: DataFrame) -> DataFrame:
    dom = D.ensure_dom(
        pages, "tag", "attrs", "text", "html_start", "html_end", "body_text"
    )
    body = F.try_element_at(D.matching(lambda n: css("body", n)), F.lit(1))
    counts = {
        "element_count": "*", "script_count": "script", "style_count": 'style,link[rel="stylesheet"]',
        "form_count": "form", "input_count": "input", "button_count": "button", "link_count": "a",
        "image_count": "img",
    }
    metas = F.transform(
        D.matching(lambda n: css("meta[name]", n)),
        lambda x: F.struct(D.attr(x.getField, "name").alias("name"), D.attr(x.getField, "content").alias("content")),
    )
    return _one_row(
        dom,
        title_column().alias("title"),
        F.length("body_text").alias("body_text_length"),
        (body["html_end"] - body["html_start"]).alias("body_html_length"),
        *[D.count_css(s).alias(name) for name, s in counts.items()],
        metas.alias("meta_tags"),
        F.substring("body_text", 1, 200).alias("first_200_chars"),
        also=("url", "parse_error"),
    )


METRIC_FIELDS = ("tag", "static_visible", "text_node_lengths")


def metric_columns() -> list[Column]:
    """Content metrics of one capture, named as reports and deltas name them."""
    values = [
        F.size("nodes"),
        D.count_nodes(lambda n: n("static_visible")),
        F.coalesce(F.size("text_node_lengths"), F.lit(0)),
        F.aggregate(F.coalesce("text_node_lengths", F.array().cast("array<int>")), F.lit(0), lambda a, x: a + x),
        *[D.count_css(s) for s in ("a", "button", FIELD_SELECTOR, "img", "script")],
    ]
    return [v.alias(name) for name, v in zip(METRICS, values)]


def content_metrics(pages: DataFrame, layout: DataFrame | None = None, viewport_height: int | None = None) -> DataFrame:
    """Counts per capture.  With a layout, visibility is measured and page height known."""
    dom = D.ensure_dom(pages, *METRIC_FIELDS)
    if layout is None:
        return _one_row(dom, *metric_columns())
    keys = D.page_keys(dom)
    # a page's figures travel with its first node, so that boxes join without a second parse
    cells = F.transform("nodes", lambda x: F.struct(x["nid"], x["tag"], x["static_visible"]))
    nodes = dom.select(*keys, F.struct(*metric_columns()).alias("m"), F.posexplode_outer(cells).alias("ix", "n"))
    nodes = nodes.select(*keys, "n.*", F.when(F.coalesce("ix", F.lit(0)) == 0, F.col("m")).alias("m"))
    measured = D.with_visibility(nodes, layout).groupBy(*keys).agg(
        F.max("m").alias("m"),
        F.count_if("visible").cast("int").alias("seen"),
        F.max(F.when(F.col("tag") == "BODY", F.col("height"))).alias("pageHeight"),
    )
    figures = [F.col("seen" if name == "visibleElements" else f"m.{name}").alias(name) for name in METRICS]
    return measured.select(*keys, *figures, "pageHeight", F.lit(viewport_height).cast("int").alias("viewportHeight"))


def visible_elements(
    pages: DataFrame, layout: DataFrame, viewport_height: int = 1080, scan: int | None = None, text_limit: int | None = None
) -> DataFrame:
    """Elements (of the first ``scan``, if given) of more than 10x10 px that start above the fold."""
    dom = D.ensure_dom(pages, "tag", "id", "class_name", *D.TEXT_FIELDS)
    first = D.node_rows(
        dom,
        lambda n: F.lit(True) if scan is None else n("nid") < scan,
        lambda n: [
            *[n(f).alias(f) for f in ("nid", "tag", "id", "class_name")],
            D.shown_text(n, text_limit).alias("text"),
        ],
    )
    shown = layout.filter((F.col("width") > 10) & (F.col("height") > 10) & (F.col("y") < viewport_height))
    return first.join(shown, [c for c in layout.columns if c in first.columns])


def static_nodes(
    pages: DataFrame, layout: DataFrame | None = None, depth: int | None = None, children: int | None = None,
    text_limit: int | None = None,
) -> DataFrame:
    """Snapshot nodes that are visible, not expandable and carry no data-* attribute.

    With a ``layout``, only those that take up room, with their boxes.
    """
    dom = D.ensure_dom(
        pages, "tag", "id", "classes", "class_name", "attrs", *D.TEXT_FIELDS, "static_visible", "aria_within", "body_depth",
        "max_child_ix_on_path",
    )
    found = D.node_rows(
        dom,
        lambda n: D.in_snapshot(n, depth, children)
        & n("static_visible")
        & ~D.is_expandable(n)
        & ~F.exists(F.map_keys(n("attrs")), lambda k: F.startswith(k, F.lit("data-"))),
        lambda n: [
            *[n(f).alias(f) for f in ("nid", "tag", "id", "class_name")],
            D.shown_text(n, text_limit).alias("text"),
        ],
    )
    return found if layout is None else D.with_positions(found, layout).filter("has_box").drop("has_box")


CHALLENGE_FIELDS = ("tag", "id", "classes", "attrs", "text", "body_text")


def challenge_reasons() -> Column:
    title = F.lower(title_column())
    reasons = [F.when(F.contains(title, F.lit(t)), F.lit(f"Title contains '{t}'")) for t in CHALLENGE_TITLES]
    reasons += [
        F.when(D.count_css(s) > 0, F.lit(f"Found protection element: {s}")) for s in CHALLENGE_SELECTORS
    ]
    reasons.append(F.when(F.length(D.trim(F.col("body_text"))) < MINIMAL_TEXT, F.lit("Very minimal page content")))
    return F.nullif(F.array_join(F.array_compact(F.array(*reasons)), "; "), F.lit(""))


def detect_challenge(pages: DataFrame) -> DataFrame:
    """Label captures that show a challenge or block page, so that they can be dropped."""
    return _one_row(D.ensure_dom(pages, *CHALLENGE_FIELDS), challenge_reasons().alias("challenge"))


def quick_profile(pages: DataFrame, limit: int | None = None, text_limit: int | None = None) -> DataFrame:
    """Structure counts and the (first ``limit``) collapsed elements of each page."""
    dom = D.ensure_dom(
        pages, *TITLE_FIELDS, "id", "classes", "attrs", "n_children", "static_visible", *D.TEXT_FIELDS
    )
    first = D.matching(lambda n: css(QUICK_SELECTOR, n))
    first = first if limit is None else F.slice(first, 1, limit)
    candidates = F.transform(
        first,
        lambda x, i: F.struct(
            F.concat(F.lit("element_"), i.cast("string")).alias("element_id"),
            x["nid"].alias("nid"),
            x["tag"].alias("tag"),
            D.shown_text(x.getField, text_limit).alias("text"),
        ),
    )
    return _one_row(
        dom,
        title_column().alias("title"),
        D.count_nodes(is_interactive).alias("n_interactive"),
        F.size(area_structs()).alias("n_content_areas"),
        D.count_css(NAV_SELECTOR).alias("n_navigation"),
        D.count_nodes(lambda n: n("tag").isin(HEADINGS)).alias("n_headings"),
        D.count_css("form").alias("n_forms"),
        candidates.alias("candidates"),
        also=("url",),
    )
