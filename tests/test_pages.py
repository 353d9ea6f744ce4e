"""Page operators against hand-written pages and brute force over the node table."""

import json

import pytest
from pyspark.sql import functions as F

from pagespark.functions.selectors import css
from pagespark.operators import dom as D
from pagespark.operators import expand as E
from pagespark.operators import page as P
from pagespark.plans import spec as G
from pagespark.plans import summary as B

PAGE = """<!doctype html><html lang="en"><head><title> A  b </title><meta name="author" content="z">
<meta property="og:x" content="y"><meta charset="utf-8"><link rel="stylesheet" href="s.css">
<script>navigator.serviceWorker.register('/w')</script></head><body>
<nav class="menu top"><a href="/a">A</a><a href="/b">B</a></nav>
<main id="content" class="content wide"><h1 id="top">T  1</h1><h2>two</h2><p>text</p></main>
<div class="accordion-header" id="acc" aria-expanded="false"><span class="collapsible" data-k="1">c</span>
<details><summary>s</summary><i aria-expanded="false">x</i></details><details open></details></div>
<form action="find?q=1" method="POST"><input><textarea></textarea></form><form></form>
<div onclick="f()" tabindex="0">go</div><button hidden>no</button>
</body></html>"""


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "https://h.org/x/y?z#w", PAGE), (2, "https://h.org/2", ""), (3, "https://h.org/3", None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


@pytest.fixture(scope="module")
def dom(pages):
    return D.parse_pages(pages).cache()


def rows(df, *cols, page=1):
    return [tuple(r) for r in df.filter(F.col("page_id") == page).select(*cols).collect()]


def test_head(dom):
    assert rows(P.page_titles(dom), "title") == [("A b",)]
    assert rows(P.meta_tags(dom), "name", "content") == [("author", "z"), ("og:x", "y")]
    assert rows(P.link_tags(dom), "rel", "href", "type") == [("stylesheet", "s.css", None)]
    assert rows(P.page_meta(dom), "scripts", "stylesheets", "language", "has_service_worker") == [(1, 1, "en", True)]
    assert rows(P.page_meta(dom), "scripts", "language", page=2) == [(0, "unknown")]
    assert rows(P.page_meta(dom), "scripts", "language", page=3) == [(0, "unknown")]


def test_interactive_elements_in_report_order(dom):
    found = P.interactive_elements(dom).orderBy("sel_ix", "nid")
    assert rows(found, "selector", "tag", "interaction_type", "is_visible") == [
        ("button", "BUTTON", "button", False),
        ("a", "A", "link", True),
        ("a", "A", "link", True),
        ("[onclick]", "DIV", "clickable", True),
        ("[aria-expanded]", "DIV", "expandable", True),
        ("[aria-expanded]", "I", "expandable", True),
        (".collapsible", "SPAN", "interactive", True),
        ("details", "DETAILS", "interactive", True),
        ("details", "DETAILS", "interactive", True),
        ("summary", "SUMMARY", "interactive", True),
        ("input", "INPUT", "interactive", True),
        ("textarea", "TEXTAREA", "interactive", True),
    ]
    kinds = rows(P.dynamic_elements(dom).orderBy("sel_ix", "nid"), "tag", "interaction_type")
    assert kinds == [("DIV", "clickable"), ("DIV", "expandable"), ("I", "expandable")]


def test_content_patterns(dom):
    areas = rows(P.content_areas(dom), "selector", "tag", "child_count")
    assert areas == [("main", "MAIN", 3), (".content", "MAIN", 3), ("#content", "MAIN", 3)]
    assert rows(P.navigation_blocks(dom), "class_name", "link_count", "text") == [("menu top", 2, "AB")]
    assert rows(P.headings(dom), "level", "text", "id") == [("H1", "T  1", "top"), ("H2", "two", "")]
    assert rows(P.forms(dom), "action", "method", "field_count") == [
        ("https://h.org/x/find?q=1", "post", 2),
        ("https://h.org/x/y?z#w", "get", 0),
    ]


def test_expandables(dom):
    found = E.expandable_elements(dom).orderBy("sel_ix", "nid")
    assert rows(found, "selector", "tag", "is_currently_expanded") == [
        ('[aria-expanded="false"]', "DIV", False),
        ('[aria-expanded="false"]', "I", False),
        ("details:not([open])", "DETAILS", False),
        (".collapsible:not(.expanded)", "SPAN", False),
    ]
    assert rows(found, "attributes")[0][0] == {"class": "accordion-header", "id": "acc", "aria-expanded": "false"}
    nested = E.nested_expandables(dom).orderBy("sel_ix", "nid")
    assert rows(nested, "parent_id", "tag", "rank") == [("acc", "I", 1), ("acc", "DETAILS", 2), ("acc", "SPAN", 3)]
    labels = [r[0] for r in rows(E.element_id(found), "element_id")]
    assert labels[0] == "id_acc" and labels[3].startswith("SPAN_collapsible_")


def test_whole_page_figures(dom):
    got = rows(P.content_metrics(dom), "totalElements", "textNodes", "links", "buttons", "inputs", "scripts")
    assert got == [(28, 10, 2, 1, 2, 1)]
    assert rows(P.content_metrics(dom), "totalElements", "totalTextLength", page=3) == [(0, 0)]
    info = P.raw_page_info(dom).filter("page_id = 1").first()
    assert (info.title, info.form_count, info.style_count) == ("A b", 2, 1)
    assert info.body_html_length == len(PAGE) - PAGE.index("<body>") - len("<body>") - len("</body></html>")
    assert [tuple(m) for m in info.meta_tags] == [("author", "z")]
    assert rows(P.detect_challenge(dom), "challenge") == [("Very minimal page content",)]


def test_challenge_phrases(spark):
    html = '<title>Access Denied</title><div class="challenge-running"></div>' + "long text " * 20
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    reason = P.detect_challenge(df).first().challenge
    assert reason == "Title contains 'access denied'; Found protection element: .challenge-running"


def test_snapshot_limits(spark):
    wide = "<body>" + "<p>a</p>" * 60 + "<div>" * 14
    df = spark.createDataFrame([(1, "u", wide)], "page_id long, url string, html string")
    assert D.dom_snapshot(df).filter("tag in ('P', 'DIV')").count() == 74
    snap = D.dom_snapshot(df, depth=10, children=50)
    assert snap.filter("tag = 'P'").count() == 50
    assert snap.filter("tag = 'DIV'").count() == 0  # under the 61st child
    deep = spark.createDataFrame([(1, "u", "<body>" + "<div>" * 14)], "page_id long, url string, html string")
    assert D.dom_snapshot(deep, 10).agg(F.max("body_depth")).first()[0] == 10


def test_layout(spark, dom):
    boxes = [(1, i, 0, 10 * i, 11 if i % 2 else 0, 20, "auto") for i in range(28)]
    layout = spark.createDataFrame(boxes, "page_id long, nid int, x int, y int, width int, height int, z_index string")
    seen = P.visible_elements(dom, layout, viewport_height=100)
    assert sorted(r[0] for r in rows(seen, "nid")) == [1, 3, 5, 7, 9]
    m = P.content_metrics(dom, layout, 100).filter("page_id = 1").first()
    nodes = D.with_visibility(D.dom_nodes(dom), layout)
    assert m.visibleElements == nodes.filter("page_id = 1 and visible").count()
    assert m.pageHeight == 20 and m.viewportHeight == 100


SELECTORS = ["i", ".wide", "#acc", "[open]", '[method="POST"]', '[action*="q="]', "div.accordion-header#acc", "h1, h2",
             ".content:not(.narrow)", "details:not([open])", "*", "div:not(#acc)"]
MATCHES = [1, 1, 1, 1, 1, 1, 1, 2, 1, 1, 31, 1]  # "*" also counts the skeleton of the empty page


@pytest.mark.parametrize("selector,count", list(zip(SELECTORS, MATCHES)))
def test_selectors(dom, selector, count):
    assert D.select_css(D.dom_nodes(dom), selector).count() == count


def test_selector_errors():
    for bad in ("a > b", "", "a:hover"):
        with pytest.raises(ValueError):
            css(bad)


def test_partitioning_does_not_matter(spark, pages):
    def digest(df):
        return sorted(map(str, D.dom_nodes(df).drop("attrs").collect()))

    assert digest(pages.repartition(1)) == digest(pages.repartition(7))


def test_one_bad_page_does_not_fail_the_batch(pages):
    out = {r.page_id: (r.ok, r.error) for r in B.page_outcomes(pages).collect()}
    assert out == {1: (True, None), 2: (True, None), 3: (False, "no html")}
    assert tuple(B.outcome_totals(B.page_outcomes(pages)).first()) == (3, 2, 1)


def test_batch_without_success_says_so(spark):
    none = spark.createDataFrame([(1, "u", None)], "page_id long, url string, html string")
    log = spark.createDataFrame([], LOG)
    row = B.batch_summary(none, log).first()
    assert row.message == "No successful analyses to summarize" and row.success_rate is None


LOG = ("page_id long, element_id string, parent_element_id string, depth int, success boolean, method string, "
       "content_changed boolean")  # fmt: skip


def test_specification(spark, dom):
    log = spark.createDataFrame(
        [(1, "acc", None, 0, True, "click", True), (1, "n", "acc", 1, True, "click", True), (1, "b", None, 0, False, None, False)],
        LOG,
    )
    spec = G.page_specs(dom, log)
    row = json.loads(spec.filter("page_id = 1").select(F.to_json(F.struct(*spec.columns))).first()[0])
    site = row["site_structure"]
    assert [e["type"] for e in site["static_elements"]] == ["heading", "heading", "navigation"] + ["content_area"] * 3
    assert site["static_elements"][0]["selector"] == "h1#top"
    assert [e["type"] for e in site["dynamic_elements"]] == ["clickable", "expandable", "expandable"]
    assert site["layout_analysis"]["layout_type"] == "spa_application"
    assert site["interaction_patterns"] == {"expansion_methods": {"click": 1}, "overall_success_rate": 0.5}
    assert row["content_patterns"]["navigation_patterns"][0]["selector"] == "nav.menu.top"
    assert row["technical_requirements"]["javascript_required"] is True
    assert row["edge_cases"] == [
        "Nested expandable content (1 elements with nested interactions)",
        "High interaction failure rate (1/2)",
        "Service Worker detected - may affect caching and network requests",
    ]
    assert spec.count() == 3  # pages without anything keep their row
    need = {(r.element_id, r.priority) for r in G.interaction_requirements(log).collect()}
    assert need == {("acc", "high")}


def test_exactly_thirty_percent_failures_is_not_high(spark, dom):
    log = spark.createDataFrame([(1, f"e{i}", None, 0, i >= 3, "click", False) for i in range(10)], LOG)
    monitoring = spark.createDataFrame([(1, "low")], "page_id long, activity_level string")
    cases = G.edge_cases(P.page_meta(dom), log, monitoring).filter("page_id = 1").first().edge_cases
    assert not [c for c in cases if c.startswith("High interaction")]
    advice = B.recommendations(B.page_summary(dom, log)).filter("page_id = 1").first().recommendations
    assert advice == []


def test_commas_inside_attributes(spark):
    df = spark.createDataFrame([(1, "u", '<a title="x,y">1</a><b>2</b><i>3</i>')], "page_id long, url string, html string")
    assert [r.tag for r in D.select_css(D.dom_nodes(df), '[title="x,y"],i').orderBy("nid").collect()] == ["A", "I"]


def test_tags_leave_the_kernel_as_they_are_in_the_page(spark):
    df = spark.createDataFrame([(1, "u", "<h1>a</h1><p><h2 id=x>b <b>c</b></h2>"), (2, "u", None)], "page_id long, url string, html string")
    every = D.dom_nodes(df).filter("tag in ('H1', 'H2')").orderBy("nid").collect()
    assert D.parse_pages(df, tags=frozenset(["h1", "h2"])).select("page_id", F.inline("nodes")).select(every[0].__fields__).orderBy("nid").collect() == every
    assert rows(P.headings(df), "level", "text") == [("H1", "a"), ("H2", "b c")]


@pytest.mark.parametrize("size", [0, 1, 99, 101, 1023, 1024, 1025, 5000])
def test_texts_of_elements_are_whole(spark, size):
    text = ("é😀 b" * size)[:size]
    html = f"<p>{'x' * 700}</p><nav> {text}z <a href='/'>l</a></nav><button class='expandable' id='b' onclick='f()'>\n {text}|end </button><details>{text}<i class='collapsible'>{text}.</i></details>"
    df = spark.createDataFrame([(1, "https://h/", html)], "page_id long, url string, html string")
    want = f"{text}|end".strip()
    shown = {r.tag: r.text for r in P.interactive_elements(df).collect()}
    assert shown["BUTTON"] == want and shown["DETAILS"] == f"{text}{text}.".strip()
    assert P.navigation_blocks(df).first().text == f"{text}z l".strip()
    assert {r.tag: r.text for r in E.expandable_elements(df).collect()}["BUTTON"] == want
    content = {r.tag: r for r in E.element_content(df).collect()}
    assert content["BUTTON"].text == want and content["BUTTON"].inner_html == f"\n {text}|end "
    assert content["DETAILS"].inner_html == f"{text}<i class='collapsible'>{text}.</i>"
    assert {r.tag: r.text for r in D.dom_snapshot(df).collect()}["BUTTON"] == want
    assert P.interactive_elements(df, text_limit=7).filter("tag = 'BUTTON'").first().text == want[:7]
    assert D.dom_snapshot(df, text_limit=3).filter("tag = 'BUTTON'").first().text == want[:3]
    # a digest of the whole text: texts with a common beginning stay apart
    twice = spark.createDataFrame([(k, "", f"<details>{'s' * 300}{k}</details>") for k in (1, 2)], "page_id long, url string, html string")
    assert E.element_id(E.expandable_elements(twice)).select("element_id").distinct().count() == 2


def test_elements_that_share_an_id_pair_up_in_order(spark):
    schema = "page_id long, element_id string, nid int, inner_html string"
    before = spark.createDataFrame([(1, "x", 4, "a"), (1, "x", 9, "b"), (1, "y", 2, "c")], schema)
    after = spark.createDataFrame([(1, "x", 5, "a"), (1, "x", 11, "B"), (1, "x", 12, "n")], schema)
    got = sorted((r.element_id, r.in_before, r.in_after, r.content_changed) for r in E.expansion_changes(before, after).collect())
    assert got == [("x", False, True, True), ("x", True, True, False), ("x", True, True, True), ("y", True, False, True)]
    unplaced = E.expansion_changes(before.drop("nid"), after.drop("nid"))
    assert unplaced.count() == 4
