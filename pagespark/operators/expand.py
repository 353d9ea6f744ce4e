"""Expandable content: candidates in the markup, and outcomes recorded in an interaction log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagespark.functions.selectors import Node, all_matches, css, first_match, selector_name
from pagespark.operators import dom as D

# Selector lists, in report order.
EXPANDABLE_SELECTORS = [
    '[aria-expanded="false"]', '[aria-expanded="true"]', "details:not([open])", ".expandable:not(.expanded)",
    ".collapsible:not(.expanded)", ".accordion-header", '[data-toggle="collapse"]', '[data-bs-toggle="collapse"]',
    ".dropdown-toggle:not(.show)", '[role="button"][aria-expanded]',
]
NESTED_SELECTORS = [
    '[aria-expanded="false"]', "details:not([open])", ".expandable:not(.expanded)", ".collapsible:not(.expanded)",
]
EXPANDABLE_FIELDS = ("tag", "id", "class_name", "classes", "attrs", *D.TEXT_FIELDS, "static_visible")


def is_expanded(n: Node) -> Column:
    return css('[aria-expanded="true"],[open],.expanded,.show', n)


def _state_attributes(n: Node) -> Column:
    return F.map_filter(
        n("attrs"),
        lambda k, _: F.startswith(k, F.lit("data-")) | F.startswith(k, F.lit("aria-")) | k.isin("id", "class", "role"),
    )


def is_expandable_candidate(n: Node) -> Column:
    return n("static_visible") & first_match(EXPANDABLE_SELECTORS, n).isNotNull()


def expandable_elements(pages: DataFrame, layout: DataFrame | None = None, text_limit: int | None = None) -> DataFrame:
    """Visible elements that look expandable, once each; report order is (sel_ix, nid)."""
    dom = D.ensure_dom(pages, *EXPANDABLE_FIELDS)

    def project(ix: Column, n: Node) -> list[Column]:
        return [
            ix.alias("sel_ix"),
            n("nid").alias("nid"),
            selector_name(EXPANDABLE_SELECTORS, ix).alias("selector"),
            n("tag").alias("tag"),
            n("id").alias("id"),
            n("class_name").alias("class_name"),
            D.shown_text(n, text_limit).alias("text"),
            D.attr(n, "aria-expanded").alias("aria_expanded"),
            _state_attributes(n).alias("attributes"),
            is_expanded(n).alias("is_currently_expanded"),
        ]

    found = D.ranked_rows(
        dom, lambda n: first_match(EXPANDABLE_SELECTORS, n), lambda n: n("static_visible"), project
    )
    return found if layout is None else D.with_positions(found, layout).filter("has_box").drop("has_box")


def nested_expandables(
    pages: DataFrame, per_parent: int | None = None, layout: DataFrame | None = None, text_limit: int | None = None
) -> DataFrame:
    """Collapsed elements inside an expandable element that has an id, ranked per parent.

    Parents and candidates stand in one row, the page's: each parent takes the candidates inside its
    interval.  Nothing is shuffled.  ``per_parent`` keeps the first so many; with a ``layout``
    elements without a box are left out (ranks then have gaps).
    """
    dom = D.ensure_dom(pages, *EXPANDABLE_FIELDS, "end_nid")

    def is_parent(n: Node) -> Column:
        return is_expandable_candidate(n) & (n("id") != "")

    def cells(x: Column) -> Column:
        n = x.getField
        hits = all_matches(NESTED_SELECTORS, n)
        return F.transform(
            hits,
            lambda ix: F.struct(
                ix.alias("sel_ix"), *[n(f).alias(f) for f in ("nid", "tag", "id", "class_name")],
                D.shown_text(n, text_limit).alias("text"), D.attr(n, "aria-expanded").alias("aria_expanded"),
            ),
        )

    # one entry for each selector that a candidate matches, in report order
    inner = F.array_sort(F.flatten(F.transform(D.matching(lambda n: n("static_visible")), cells)), _report_order)
    parents = F.transform(
        D.matching(is_parent), lambda x: F.struct(x["nid"].alias("nid"), x["end_nid"].alias("end_nid"), x["id"].alias("id"))
    )
    both = dom.select(*D.page_keys(dom), parents.alias("parents"), inner.alias("inner")).filter(F.size("parents") > 0)
    each = both.select(*D.page_keys(dom), "inner", F.explode("parents").alias("p"))
    own = F.filter("inner", lambda c: (c["nid"] > F.col("p.nid")) & (c["nid"] <= F.col("p.end_nid")))
    own = own if per_parent is None else F.slice(own, 1, per_parent)
    rows = each.select(*D.page_keys(dom), F.col("p.nid").alias("parent_nid"), F.col("p.id").alias("parent_id"), F.posexplode(own).alias("pos", "c"))
    found = rows.select(
        *D.page_keys(dom), "parent_nid", "parent_id", "c.*", (F.col("pos") + 1).alias("rank"),
        selector_name(NESTED_SELECTORS, F.col("c.sel_ix")).alias("selector"),
    )
    return found if layout is None else D.with_positions(found, layout).filter("has_box").drop("has_box")


def _report_order(a: Column, b: Column) -> Column:
    def compare(f: str, equal: Column) -> Column:
        return F.when(a[f] < b[f], -1).when(a[f] > b[f], 1).otherwise(equal)

    return compare("sel_ix", compare("nid", F.lit(0)))


def element_id(elements: DataFrame) -> DataFrame:
    """``id_<id>``, else tag, class and a digest of the whole text; a label, not a key."""
    classes = F.nullif(F.replace(F.col("class_name"), F.lit(" "), F.lit("_")), F.lit(""))
    digest = F.md5(F.encode("text", "UTF-8"))
    made = F.concat_ws("_", F.nullif(F.col("tag"), F.lit("")), classes, digest)
    return elements.withColumn(
        "element_id", F.when(F.col("id") != "", F.concat(F.lit("id_"), F.col("id"))).otherwise(made)
    )


def element_content(pages: DataFrame, selector: str = ",".join(EXPANDABLE_SELECTORS)) -> DataFrame:
    """Inner html, text, attributes and child count of the selected elements."""
    dom = D.ensure_dom(
        pages, "tag", "id", "classes", "attrs", "n_children", "html_start", "html_end", "html_chunks", *D.TEXT_FIELDS
    )
    return D.node_rows(
        dom,
        lambda n: css(selector, n),
        lambda n: [
            n("nid").alias("nid"),
            n("tag").alias("tag"),
            D.html_of(n).alias("inner_html"),
            D.shown_text(n).alias("text"),
            n("attrs").alias("attributes"),
            n("n_children").alias("child_count"),
        ],
    )


# -- recorded outcomes -------------------------------------------------------------------
def expansion_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("page_id", "element_id")) -> DataFrame:
    """Did an element's recorded content differ after the interaction?  Compares all shared columns.

    Maps are compared by their sorted entries.  Elements that share a key pair up in order of ``nid`` where
    both sides have it (else of their content), the first with the first: each gives one row.
    Columns: keys, in_before, in_after, content_changed.
    """
    placed = "nid" in before.columns and "nid" in after.columns
    compared = [c for c in before.columns if c in after.columns and c not in (*keys, "nid")]

    def side(df: DataFrame) -> DataFrame:
        types = dict(df.dtypes)
        cols = [
            (F.array_sort(F.map_entries(c)) if types[c].startswith("map") else F.col(c)).alias(c) for c in compared
        ]
        df = df.select(*keys, F.struct(*cols).alias("content"), *(["nid"] if placed else []))
        nth = F.row_number().over(W.partitionBy(*keys).orderBy("nid" if placed else "content"))
        return df.withColumn("_nth", nth)

    b, a = side(before).alias("b"), side(after).alias("a")
    on = reduce(lambda x, y: x & y, [F.col(f"b.{k}") == F.col(f"a.{k}") for k in (*keys, "_nth")])
    return b.join(a, on, "full_outer").select(
        *[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys],
        F.col("b.content").isNotNull().alias("in_before"),
        F.col("a.content").isNotNull().alias("in_after"),
        (~F.col("b.content").eqNullSafe(F.col("a.content"))).alias("content_changed"),
    )


def top_level() -> Column:
    return F.col("depth") == 0


def succeeded() -> Column:
    return F.coalesce(F.col("success"), F.lit(False))


def changed() -> Column:
    return succeeded() & F.coalesce(F.col("content_changed"), F.lit(False))


def method() -> Column:
    return F.coalesce(F.col("method"), F.lit("unknown"))


def _count(test: Column, name: str) -> Column:
    return F.count_if(test).alias(name)


def method_counts(interaction_log: DataFrame) -> DataFrame:
    """How often each method succeeded on a top-level element: (page_id, method, n)."""
    done = interaction_log.filter(top_level() & succeeded())
    return done.groupBy("page_id", method().alias("method")).agg(F.count("*").alias("n"))


def with_methods(interaction_log: DataFrame, totals: dict[str, Column]) -> DataFrame:
    """Per-page sums beside a method histogram.

    First by (page, method), which combines on the map side, so a page with a huge log
    reaches the second step as one row per method.
    """
    part = interaction_log.groupBy("page_id", method().alias("method")).agg(
        _count(top_level() & succeeded(), "_n"), *[c.alias(k) for k, c in totals.items()]
    )
    entry = F.when(F.col("_n") > 0, F.struct("method", F.col("_n")))
    folded = {k: (F.max if k.startswith("max_") else F.sum) for k in totals}
    out = part.groupBy("page_id").agg(
        *[f(k).alias(k) for k, f in folded.items()], F.array_sort(F.collect_list(entry)).alias("_m")
    )
    return out.withColumn("methods", F.map_from_entries("_m")).drop("_m")


def expansion_summary(interaction_log: DataFrame) -> DataFrame:
    """Totals over top-level elements, discoveries of nested ones, successes per method."""
    return with_methods(
        interaction_log,
        {
            "total_elements": F.count_if(top_level()),
            "successful_expansions": F.count_if(top_level() & succeeded()),
            "failed_expansions": F.count_if(top_level() & ~succeeded()),
            "content_changes": F.count_if(top_level() & changed()),
            "nested_discoveries": F.count_if(~top_level()),
        },
    )


def nested_counts(interaction_log: DataFrame) -> DataFrame:
    """Elements that revealed others: (page_id, element_id, n_nested, max_depth)."""
    inner = interaction_log.filter(~top_level() & F.col("parent_element_id").isNotNull())
    return inner.groupBy("page_id", F.col("parent_element_id").alias("element_id")).agg(
        F.count("*").alias("n_nested"), F.max("depth").alias("max_depth")
    )
