"""Queries over DOM extraction, page structure and expandable content."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagespark.catalog.registry import query
from pagespark.catalog.tables import derived, given, unescaped
from pagespark.functions import scalars as S
from pagespark.operators import dom as D
from pagespark.operators import expand as E
from pagespark.operators import page as P


def _pages(spark, sf):
    return given(spark, sf, "pages")


def _aug(spark, sf):
    return derived(spark, sf, "pages_aug")


# -- DOM --------------------------------------------------------------------------------
@query("dom_tag_counts", "SELECT page_id, tag, count(*) AS n FROM tags GROUP BY page_id, tag")
def _(spark, sf):
    return D.dom_nodes(_aug(spark, sf), ["tag"]).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query("dom_node_list", "SELECT page_id, nid, tag, id, cls AS class_name FROM tags")
def _(spark, sf):
    nodes = D.dom_nodes(_aug(spark, sf), ["tag", "id", "class_name"])
    return nodes.select("page_id", "nid", "tag", "id", "class_name")


@query("dom_snapshot", "SELECT page_id, nid, tag, cls AS class_name, visible AS static_visible, expandable AS is_expandable FROM snapshot")
def _(spark, sf):
    nodes = D.dom_snapshot(_aug(spark, sf))
    return nodes.select("page_id", "nid", "tag", "class_name", "static_visible", "is_expandable")


@query(
    "page_text",
    f"""SELECT page_id, CAST(length(article_text) AS INT) AS article_length, h1_text AS h1,
    CAST(length({unescaped("regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1)")}) AS INT) AS footer_length FROM segments""",
)
def _(spark, sf):
    dom = D.ensure_dom(_aug(spark, sf), "tag", *D.TEXT_FIELDS)

    def first(tag):
        return F.element_at(F.transform(D.matching(lambda n: n("tag") == tag), lambda x: D.text_of(x.getField)), 1)

    return dom.select(
        "page_id",
        F.length(first("ARTICLE")).alias("article_length"),
        first("H1").alias("h1"),
        F.length(first("FOOTER")).alias("footer_length"),
    )


@query(
    "xpath_of_links",
    """SELECT page_id, nid, 'BODY/NAV[1]/UL[1]/LI[' || row_number() OVER (PARTITION BY page_id ORDER BY nid) || ']/A[1]' AS xpath
    FROM tags WHERE tag = 'A'""",
)
def _(spark, sf):
    return D.select_css(D.with_xpath(_aug(spark, sf)), "a").select("page_id", "nid", "xpath")


@query(
    "xpath_of_elements",
    """SELECT page_id, nid, tag, CASE WHEN tag IN ('HTML', 'BODY') THEN tag WHEN tag = 'HEAD' THEN 'HTML/HEAD[1]'
      WHEN nid < body_nid THEN 'HTML/HEAD[1]/' || tag || '[' || k || ']' WHEN tag = 'UL' THEN 'BODY/NAV[1]/UL[1]'
      WHEN tag = 'LI' THEN 'BODY/NAV[1]/UL[1]/LI[' || k || ']' WHEN tag = 'A' THEN 'BODY/NAV[1]/UL[1]/LI[' || k || ']/A[1]'
      WHEN tag = 'H1' THEN 'BODY/ARTICLE[1]/H1[1]' WHEN tag = 'DETAILS' THEN 'id("d1")' WHEN tag = 'SUMMARY' THEN 'id("d1")/SUMMARY[1]'
      WHEN tag = 'P' AND raw2 LIKE '<details%' THEN 'id("d1")/P[1]' WHEN tag = 'BUTTON' AND cls = '' THEN 'id("d1")/P[1]/BUTTON[1]'
      WHEN tag = 'P' THEN 'BODY/ARTICLE[1]/P[' || k || ']' WHEN tag IN ('INPUT', 'SELECT') THEN 'BODY/FORM[1]/' || tag || '[1]'
      ELSE 'BODY/' || tag || '[' || k || ']' END AS xpath
    FROM (SELECT *, row_number() OVER (PARTITION BY page_id, tag ORDER BY nid) AS k FROM tags) t WHERE tag NOT IN ('B', 'BR')""",
)
def _(spark, sf):
    return D.with_xpath(_aug(spark, sf)).filter(~F.col("tag").isin("B", "BR"))


@query("xpath_all")
def _(spark, sf):
    return D.with_xpath(_aug(spark, sf)).select("page_id", "nid", "tag", "xpath")


@query("static_visibility", "SELECT page_id, nid, visible FROM seen")
def _(spark, sf):
    nodes = D.dom_nodes(_aug(spark, sf), ["static_visible"])
    return D.with_visibility(nodes).select("page_id", "nid", "visible")


@query(
    "measured_visibility",
    """SELECT s.page_id, s.nid, s.visible AND coalesce(l.width > 0 AND l.height > 0, FALSE) AS visible
    FROM seen s LEFT JOIN layout l ON s.page_id = l.page_id AND s.nid = l.nid""",
)
def _(spark, sf):
    nodes = D.dom_nodes(_aug(spark, sf), ["static_visible"])
    return D.with_visibility(nodes, derived(spark, sf, "layout")).select("page_id", "nid", "visible")


@query("expandable_flag", "SELECT page_id, nid, expandable AS is_expandable FROM seen")
def _(spark, sf):
    nodes = D.dom_nodes(_aug(spark, sf), ["tag", "classes", "attrs", "aria_within"])
    return D.with_expandable(nodes).select("page_id", "nid", "is_expandable")


@query(
    "css_selection",
    """SELECT page_id, nid, tag FROM tags WHERE tag = 'LI' OR cls = 'ad' OR id = 'd1' OR raw LIKE '% onclick=%'
    OR name = 'robots' AND content LIKE '%noindex%' OR tag = 'BUTTON' AND aria = 'false' AND cls <> 'x' OR tag = 'DETAILS'""",
)
def _(spark, sf):
    wanted = (
        'li,.ad,#d1,[onclick],meta[name="robots"][content*="noindex"],button[aria-expanded="false"]:not(.x),'
        "details:not([open])"
    )
    nodes = D.dom_nodes(_aug(spark, sf), ["tag", "id", "classes", "attrs"])
    return D.select_css(nodes, wanted).select("page_id", "nid", "tag")


@query(
    "first_match_selection",
    """SELECT page_id, nid, sel_ix, list_extract(['button', '[aria-expanded]', 'main,article', '.content', 'a'], sel_ix + 1) AS selector FROM (
    SELECT page_id, nid, CAST(CASE WHEN tag = 'BUTTON' THEN 0 WHEN aria IS NOT NULL THEN 1 WHEN tag IN ('MAIN', 'ARTICLE') THEN 2
    WHEN cls = 'content' THEN 3 WHEN tag = 'A' THEN 4 END AS INT) AS sel_ix FROM tags) t WHERE sel_ix IS NOT NULL""",
)
def _(spark, sf):
    nodes = D.dom_nodes(_aug(spark, sf), ["tag", "classes", "attrs"])
    found = D.select_first_match(nodes, ["button", "[aria-expanded]", "main,article", ".content", "a"])
    return found.select("page_id", "nid", "sel_ix", "selector")


@query(
    "element_signature",
    """SELECT page_id, nid, concat_ws('|', CASE WHEN id <> '' THEN 'id:' || id END, 'tag:' || tag, CASE WHEN cls <> '' THEN 'class:' || cls END) AS signature
    FROM tags""",
)
def _(spark, sf):
    nodes = D.dom_nodes(_aug(spark, sf), ["tag", "id", "class_name"])
    return D.element_signature(nodes).select("page_id", "nid", "signature")


# -- page structure --------------------------------------------------------------------------
_TITLE = "trim(regexp_replace(title_text, '[\\t\\n\\f\\r ]+', ' ', 'g'))"


@query("page_titles", f"SELECT page_id, {_TITLE} AS title FROM segments")
def _(spark, sf):
    return P.page_titles(_aug(spark, sf))


_INTERACTIVE = """
SELECT *, CASE WHEN aria IS NOT NULL THEN 'expandable' WHEN tag = 'A' THEN 'link' WHEN tag = 'BUTTON' THEN 'button'
  WHEN onclick THEN 'clickable' ELSE 'interactive' END AS interaction_type,
  list_extract(['button', 'a', '[role="button"]', '[onclick]', '[aria-expanded]', '.expandable', '.collapsible', 'details', 'summary',
    'input', 'select', 'textarea'], sel_ix + 1) AS selector
FROM (SELECT *, CAST(CASE WHEN tag = 'BUTTON' THEN 0 WHEN tag = 'A' THEN 1 WHEN raw LIKE '% role="button"%' THEN 2 WHEN onclick THEN 3
  WHEN cls = 'expandable' THEN 5 WHEN tag = 'DETAILS' THEN 7 WHEN tag = 'SUMMARY' THEN 8 WHEN tag = 'INPUT' THEN 9
  WHEN tag = 'SELECT' THEN 10 END AS INT) AS sel_ix FROM seen) t WHERE sel_ix IS NOT NULL"""


@query(
    "interactive_elements",
    f"""SELECT page_id, sel_ix, nid, selector, tag, CASE WHEN tag = 'DETAILS' THEN 'Sin n' ELSE trim(txt) END AS text,
    visible AS is_visible, interaction_type, CAST(len(regexp_extract_all(raw, ' [a-z-]+(="[^"]*")?')) AS INT) AS n_attributes
    FROM ({_INTERACTIVE}) i""",
)
def _(spark, sf):
    found = P.interactive_elements(_aug(spark, sf))
    return found.withColumn("n_attributes", F.size("attributes")).drop("attributes", "xpath")


@query(
    "interactive_elements_measured",
    f"""SELECT i.page_id, i.nid, i.selector, l.x, l.y, l.width, l.height, i.visible AND coalesce(l.width > 0 AND l.height > 0, FALSE) AS is_visible
    FROM ({_INTERACTIVE}) i LEFT JOIN layout l ON i.page_id = l.page_id AND i.nid = l.nid""",
)
def _(spark, sf):
    found = P.interactive_elements(_aug(spark, sf), derived(spark, sf, "layout"))
    return found.select("page_id", "nid", "selector", "x", "y", "width", "height", "is_visible")


@query(
    "content_areas_measured",
    """SELECT t.page_id, t.nid, s.selector, l.width, l.height FROM tags t JOIN (VALUES ('MAIN', 'main'), ('ARTICLE', 'article'), ('MAIN', '.content')) s(tag, selector)
    ON t.tag = s.tag JOIN layout l ON t.page_id = l.page_id AND t.nid = l.nid WHERE l.width > 0 AND l.height > 0""",
)
def _(spark, sf):
    areas = P.content_areas(_aug(spark, sf), derived(spark, sf, "layout"))
    return areas.select("page_id", "nid", "selector", "width", "height")


@query(
    "expandable_elements_measured",
    """SELECT s.page_id, s.nid, s.tag, l.y FROM seen s JOIN layout l ON s.page_id = l.page_id AND s.nid = l.nid
    WHERE (s.aria = 'false' OR s.tag = 'DETAILS') AND s.visible AND l.width > 0 AND l.height > 0""",
)
def _(spark, sf):
    found = E.expandable_elements(_aug(spark, sf), derived(spark, sf, "layout"))
    return found.select("page_id", "nid", "tag", "y")


@query(
    "interaction_types",
    f"SELECT page_id, interaction_type, count(*) AS n FROM ({_INTERACTIVE}) i GROUP BY page_id, interaction_type",
)
def _(spark, sf):
    found = P.interactive_elements(_aug(spark, sf))
    return found.groupBy("page_id", "interaction_type").agg(F.count("*").alias("n"))


@query(
    "dynamic_elements",
    f"""SELECT page_id, nid, tag, selector, interaction_type FROM ({_INTERACTIVE}) i WHERE interaction_type IN ('expandable', 'clickable')""",
)
def _(spark, sf):
    return P.dynamic_elements(_aug(spark, sf)).select("page_id", "nid", "tag", "selector", "interaction_type")


@query(
    "meta_tags",
    "SELECT page_id, nid, coalesce(name, property) AS name, content FROM tags WHERE tag = 'META' AND coalesce(name, property) IS NOT NULL",
)
def _(spark, sf):
    return P.meta_tags(_aug(spark, sf))


@query("link_tags", "SELECT page_id, nid, rel, href, type FROM tags WHERE tag = 'LINK' AND rel IS NOT NULL")
def _(spark, sf):
    return P.link_tags(_aug(spark, sf))


@query(
    "page_meta",
    """SELECT t.page_id, t.scripts, t.stylesheets, coalesce(nullif(regexp_extract(s.html, '<html lang="([^"]*)"', 1), ''), 'unknown') AS language,
    contains(s.html, 'serviceWorker.register') AS has_service_worker
    FROM (SELECT page_id, CAST(count(*) FILTER (WHERE tag = 'SCRIPT') AS INT) AS scripts,
      CAST(count(*) FILTER (WHERE tag = 'LINK' AND rel = 'stylesheet') AS INT) AS stylesheets FROM tags GROUP BY page_id) t
    JOIN segments s ON t.page_id = s.page_id""",
)
def _(spark, sf):
    return P.page_meta(_aug(spark, sf))


@query("content_areas", "SELECT page_id, sel_ix, selector, tag, text_length FROM areas")
def _(spark, sf):
    return P.content_areas(_aug(spark, sf)).select("page_id", "sel_ix", "selector", "tag", "text_length")


@query(
    "interactive_elements_limited",
    f"""SELECT page_id, nid, CASE WHEN tag = 'DETAILS' THEN 'Sin n' ELSE substr(trim(txt), 1, 20) END AS text FROM ({_INTERACTIVE}) i""",
)
def _(spark, sf):
    return P.interactive_elements(_aug(spark, sf), text_limit=20).select("page_id", "nid", "text")


@query(
    "navigation_blocks",
    """SELECT page_id, 'NAV' AS tag, '' AS class_name, CAST(len(regexp_extract_all(nav, '<a ')) AS INT) AS link_count,
    trim(trim(nav_text, ' \t\n')) AS text FROM segments""",
)
def _(spark, sf):
    return P.navigation_blocks(_aug(spark, sf)).withColumn("text", F.trim("text")).drop("nid")


@query("headings", "SELECT page_id, 'H1' AS level, trim(h1_text, ' \t\n') AS text, '' AS id FROM segments")
def _(spark, sf):
    return P.headings(_aug(spark, sf)).drop("nid")


@query(
    "forms",
    """SELECT page_id, nid, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/search' AS action, 'post' AS method, CAST(2 AS INT) AS field_count
    FROM tags WHERE tag = 'FORM'""",
)
def _(spark, sf):
    return P.forms(_aug(spark, sf))


@query(
    "raw_page_info",
    f"""SELECT s.page_id, s.url, trim(regexp_replace(s.title_text, '[\\t\\n\\f\\r ]+', ' ', 'g')) AS title, t.element_count, t.script_count, t.style_count, t.form_count,
    t.input_count, t.button_count, t.link_count, t.image_count, t.meta_names, CAST(length(s.body) AS INT) AS body_html_length,
    CAST(length({unescaped("regexp_replace(regexp_replace(s.body, '<div class=\"expandable\" hidden>h</div>', ''), '(?s)<[^>]*>', '', 'g')")}) AS INT) AS body_text_length
    FROM segments s JOIN (SELECT page_id, CAST(count(*) AS INT) AS element_count, CAST(count(*) FILTER (WHERE tag = 'SCRIPT') AS INT) AS script_count,
      CAST(count(*) FILTER (WHERE tag = 'STYLE' OR tag = 'LINK' AND rel = 'stylesheet') AS INT) AS style_count,
      CAST(count(*) FILTER (WHERE tag = 'FORM') AS INT) AS form_count, CAST(count(*) FILTER (WHERE tag = 'INPUT') AS INT) AS input_count,
      CAST(count(*) FILTER (WHERE tag = 'BUTTON') AS INT) AS button_count, CAST(count(*) FILTER (WHERE tag = 'A') AS INT) AS link_count,
      CAST(count(*) FILTER (WHERE tag = 'IMG') AS INT) AS image_count,
      coalesce(string_agg(name, ',' ORDER BY nid) FILTER (WHERE tag = 'META' AND name IS NOT NULL), '') AS meta_names
      FROM tags GROUP BY page_id) t ON s.page_id = t.page_id""",
)
def _(spark, sf):
    names = F.array_join(F.transform("meta_tags", lambda m: m["name"]), ",")
    info = P.raw_page_info(_aug(spark, sf)).withColumn("meta_names", names)
    return info.drop("meta_tags", "first_200_chars", "parse_error")


@query("content_metrics", "SELECT * FROM metrics")
def _(spark, sf):
    return P.content_metrics(_aug(spark, sf))


@query(
    "content_metrics_of_given_pages",
    """SELECT page_id, count(*) AS totalElements, count(*) FILTER (WHERE tag = 'A') AS links, count(*) FILTER (WHERE tag = 'SCRIPT') AS scripts
    FROM plain_tags GROUP BY page_id""",
)
def _(spark, sf):
    return P.content_metrics(_pages(spark, sf)).select("page_id", "totalElements", "links", "scripts")


@query(
    "visible_elements",
    """SELECT t.page_id, t.nid, t.tag, l.width, l.height, l.y, l.z_index FROM tags t JOIN layout l ON t.page_id = l.page_id AND t.nid = l.nid
    WHERE l.width > 10 AND l.height > 10 AND l.y < 600""",
)
def _(spark, sf):
    shown = P.visible_elements(_aug(spark, sf), derived(spark, sf, "layout"), viewport_height=600)
    return shown.select("page_id", "nid", "tag", "width", "height", "y", "z_index")


@query(
    "static_nodes",
    "SELECT page_id, nid, tag, id, cls AS class_name FROM snapshot WHERE visible AND NOT expandable AND raw NOT LIKE '% data-%'",
)
def _(spark, sf):
    return P.static_nodes(_aug(spark, sf)).drop("text")


@query(
    "static_nodes_measured",
    """SELECT s.page_id, s.nid, s.tag, l.x, l.y, l.width, l.height FROM snapshot s JOIN layout l ON s.page_id = l.page_id AND s.nid = l.nid
    WHERE s.visible AND NOT s.expandable AND s.raw NOT LIKE '% data-%' AND l.width > 0 AND l.height > 0""",
)
def _(spark, sf):
    found = P.static_nodes(_aug(spark, sf), derived(spark, sf, "layout"))
    return found.select("page_id", "nid", "tag", "x", "y", "width", "height")


@query(
    "challenge_pages",
    f"""SELECT page_id, nullif(concat_ws('; ', CASE WHEN contains(lower({_TITLE}), 'just a moment') THEN 'Title contains ''just a moment''' END,
      CASE WHEN page_id % 11 = 0 THEN 'Found protection element: [data-sitekey]' END,
      CASE WHEN page_id % 10 = 0 THEN 'Found protection element: meta[name="robots"][content*="noindex"]' END), '') AS challenge FROM segments""",
)
def _(spark, sf):
    return P.detect_challenge(_aug(spark, sf))


@query(
    "quick_profile",
    f"""SELECT s.page_id, s.url, {_TITLE} AS title, i.n_interactive, CAST(3 AS INT) AS n_content_areas, CAST(1 AS INT) AS n_navigation,
    CAST(1 AS INT) AS n_headings, i.n_forms, coalesce(c.candidates, '') AS candidates FROM segments s
    JOIN (SELECT t.page_id, CAST(coalesce(max(k.n), 0) AS INT) AS n_interactive, CAST(count(*) FILTER (WHERE t.tag = 'FORM') AS INT) AS n_forms FROM tags t
      LEFT JOIN (SELECT page_id, count(*) AS n FROM ({_INTERACTIVE}) i GROUP BY page_id) k ON t.page_id = k.page_id GROUP BY t.page_id) i ON s.page_id = i.page_id
    LEFT JOIN (SELECT page_id, string_agg(concat('element_', rn - 1, ':', nid, ':', tag), ',' ORDER BY nid) AS candidates FROM (
      SELECT page_id, nid, tag, row_number() OVER (PARTITION BY page_id ORDER BY nid) AS rn FROM tags WHERE aria = 'false' OR tag = 'DETAILS') r
      GROUP BY page_id) c ON s.page_id = c.page_id""",
)
def _(spark, sf):
    shown = F.transform("candidates", lambda c: F.concat_ws(":", c["element_id"], c["nid"].cast("string"), c["tag"]))
    return P.quick_profile(_aug(spark, sf)).withColumn("candidates", F.array_join(shown, ","))


# -- expandable content ---------------------------------------------------------------------------
_EXPANDABLE = """
SELECT page_id, nid, tag, id, cls AS class_name, aria AS aria_expanded, raw, CASE WHEN tag = 'DETAILS' THEN 'Sin n' ELSE txt END AS text,
  CAST(CASE WHEN aria = 'false' THEN 0 ELSE 2 END AS INT) AS sel_ix, visible FROM seen WHERE (aria = 'false' OR tag = 'DETAILS') AND visible"""


@query(
    "expandable_elements",
    f"""SELECT page_id, sel_ix, nid, CASE sel_ix WHEN 0 THEN '[aria-expanded="false"]' ELSE 'details:not([open])' END AS selector, tag, id, class_name,
    text, aria_expanded, concat_ws(';', CASE WHEN aria_expanded IS NOT NULL THEN 'aria-expanded=' || aria_expanded END,
      CASE WHEN class_name <> '' THEN 'class=' || class_name END, CASE WHEN id <> '' THEN 'id=' || id END) AS attributes,
    FALSE AS is_currently_expanded FROM ({_EXPANDABLE}) e""",
)
def _(spark, sf):
    entries = F.array_sort(F.transform(F.map_entries("attributes"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return E.expandable_elements(_aug(spark, sf)).withColumn("attributes", F.array_join(entries, ";"))


@query(
    "nested_expandables",
    """SELECT d.page_id, d.nid AS parent_nid, 'd1' AS parent_id, b.nid, CAST(0 AS INT) AS sel_ix, b.tag, CAST(1 AS INT) AS rank
    FROM tags d JOIN tags b ON d.page_id = b.page_id AND b.nid = d.nid + 3 WHERE d.tag = 'DETAILS' AND b.tag = 'BUTTON'""",
)
def _(spark, sf):
    found = E.nested_expandables(_aug(spark, sf))
    return found.select("page_id", "parent_nid", "parent_id", "nid", "sel_ix", "tag", "rank")


@query(
    "nested_expandables_measured",
    """SELECT d.page_id, d.nid AS parent_nid, b.nid, b.tag, l.width FROM tags d JOIN tags b ON d.page_id = b.page_id AND b.nid = d.nid + 3
    JOIN layout l ON b.page_id = l.page_id AND b.nid = l.nid WHERE d.tag = 'DETAILS' AND b.tag = 'BUTTON' AND l.width > 0 AND l.height > 0""",
)
def _(spark, sf):
    found = E.nested_expandables(_aug(spark, sf), layout=derived(spark, sf, "layout"))
    return found.select("page_id", "parent_nid", "nid", "tag", "width")


@query(
    "element_ids",
    f"""SELECT page_id, nid, CASE WHEN id <> '' THEN 'id_' || id
    ELSE concat_ws('_', tag, nullif(replace(class_name, ' ', '_'), ''), md5(text)) END AS element_id FROM ({_EXPANDABLE}) e""",
)
def _(spark, sf):
    return E.element_id(E.expandable_elements(_aug(spark, sf))).select("page_id", "nid", "element_id")


@query(
    "element_content",
    """SELECT t.page_id, t.nid, t.tag, CASE WHEN t.tag = 'DETAILS' THEN '<summary>S</summary><p>in <button aria-expanded="false">n</button></p>'
      WHEN t.tag = 'NAV' THEN s.nav ELSE s.article END AS inner_html, CAST(CASE t.tag WHEN 'DETAILS' THEN 2 WHEN 'NAV' THEN 1 END AS INT) AS child_count
    FROM tags t JOIN segments s ON t.page_id = s.page_id WHERE t.tag IN ('DETAILS', 'NAV', 'ARTICLE')""",
)
def _(spark, sf):
    found = E.element_content(_aug(spark, sf), "details,nav,article")
    count = F.when(F.col("tag") != "ARTICLE", F.col("child_count"))
    return found.select("page_id", "nid", "tag", "inner_html", count.alias("child_count"))


@query(
    "expansion_changes",
    """SELECT page_id, CAST(coalesce(b, 0) > 0 AS BOOLEAN) AS in_before, TRUE AS in_after, b IS DISTINCT FROM a AS content_changed, element_id FROM (
    SELECT p.page_id, p.b, q.a, p.element_id FROM (SELECT page_id, 'body' AS element_id, count(*) AS b FROM plain_tags GROUP BY page_id) p
    JOIN (SELECT page_id, count(*) AS a FROM tags GROUP BY page_id) q ON p.page_id = q.page_id) x
    UNION ALL SELECT page_id, FALSE, TRUE, TRUE, 'main' FROM pages""",
)
def _(spark, sf):
    def side(pages):
        nodes = E.element_content(pages, "body,main").withColumn("element_id", F.lower("tag"))
        return nodes.select("page_id", "element_id", "inner_html", "text", "attributes", "child_count")

    return E.expansion_changes(side(_pages(spark, sf)), side(_aug(spark, sf)))


# -- scalar functions -----------------------------------------------------------------------------------
_URLS = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^https?://', '') WHEN 2 THEN replace(url, '://', ':') ELSE concat(url, '') END AS u FROM pages"""


def _urls(spark, sf):
    u = F.col("url")
    made = (
        F.when(F.col("page_id") % 4 == 1, F.regexp_replace(u, "^https?://", ""))
        .when(F.col("page_id") % 4 == 2, F.replace(u, F.lit("://"), F.lit(":")))
        .otherwise(u)
    )
    return _pages(spark, sf).select("page_id", made.alias("u"))


@query("url_validity", f"SELECT page_id, page_id % 4 IN (0, 3) AS is_valid FROM ({_URLS}) t")
def _(spark, sf):
    return _urls(spark, sf).select("page_id", S.is_url_valid(F.col("u")).alias("is_valid"))


@query(
    "url_resolution",
    "SELECT page_id, nid, regexp_extract(url, '^(https?://[^/?#]+)', 1) || href AS target FROM plain_tags WHERE tag = 'A'",
)
def _(spark, sf):
    dom = D.ensure_dom(_pages(spark, sf), "tag", "attrs")
    return D.node_rows(
        dom,
        lambda n: n("tag") == "A",
        lambda n: [n("nid").alias("nid"), S.normalize_url(D.attr(n, "href"), F.col("url")).alias("target")],
    )


@query("url_file_names", "SELECT page_id, regexp_replace(replace(u, 'https://', ''), '^http://', '') AS bare, replace(replace(replace(u, 'https://', ''), 'http://', ''), '/', '_') AS name, translate(replace(replace(u, 'https://', ''), 'http://', ''), '/:', '__') AS strict_name FROM (" + _URLS + ") t")
def _(spark, sf):
    u = F.col("u")
    return _urls(spark, sf).select(
        "page_id",
        F.regexp_replace(F.replace(u, F.lit("https://"), F.lit("")), "^http://", "").alias("bare"),
        S.safe_filename(u).alias("name"),
        S.safe_filename(u, strict=True).alias("strict_name"),
    )


@query("url_schemes", f"SELECT page_id, CASE WHEN u LIKE 'http://%' OR u LIKE 'https://%' THEN u ELSE 'https://' || u END AS u FROM ({_URLS}) t")
def _(spark, sf):
    return _urls(spark, sf).select("page_id", S.ensure_scheme(F.col("u")).alias("u"))


@query(
    "clean_text",
    "SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0b\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')) AS text FROM documents",
)
def _(spark, sf):
    return given(spark, sf, "documents").select("doc_id", S.clean_text(F.col("text")).alias("text"))


@query("escape_html", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS html FROM pages")
def _(spark, sf):
    return _pages(spark, sf).select("page_id", S.escape_html(F.col("html")).alias("html"))
