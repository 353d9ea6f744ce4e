"""DOM extraction: pages -> nodes.

``parse_pages`` runs the HTML kernel once per page and keeps a page's nodes beside it
as an array, so every per-page operator is a projection: no shuffle, no join, no
repeated parse.  ``dom_nodes`` is the flat form, one row per node.

The kernel builds only the node fields that are asked for.  Operators pass the fields
they use when they are given raw pages; give them a parsed frame to share one parse.

Differences from a live browser, by design: there is no rendering, so visibility is what
the markup says (``static_visible``) unless a ``layout`` table is joined; lengths are code
points; trees follow the simplified rules of ``html_kernel``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagespark.functions.selectors import Node, all_matches, css, first_match, selector_name
from pagespark.operators.html_kernel import JS_SPACE, Document, chunked, tag_text, xpaths

#: Characters in a piece of a page's text or source: an element's text is cut out of the pieces it lies in.
CHUNK = 1024
# Elements whose whole text the kernel hands over; that of others is cut from the page's pieces.
TEXT_TAGS = frozenset("h1 h2 h3 h4 h5 h6 title script".split())

_INT, _STR, _BOOL = pa.int32(), pa.string(), pa.bool_()


def _each(get: Callable) -> Callable:
    return lambda doc: [get(n) for n in doc.nodes]


# field -> (Arrow type, DDL type, values of one document)
NODE_FIELDS: dict[str, tuple] = {
    "nid": (_INT, "int", _each(lambda n: n.nid)),
    "parent_nid": (_INT, "int", _each(lambda n: None if n.parent is None else n.parent.nid)),
    "end_nid": (_INT, "int", _each(lambda n: n.end)),
    "depth": (_INT, "int", _each(lambda n: n.depth)),
    "body_depth": (_INT, "int", _each(lambda n: n.body_depth)),
    "child_ix": (_INT, "int", _each(lambda n: n.child_ix)),
    "n_children": (_INT, "int", _each(lambda n: n.n_children)),
    "same_tag_ix": (_INT, "int", _each(lambda n: n.same_tag_ix)),
    "tag": (_STR, "string", _each(lambda n: n.tag.upper())),
    "id": (_STR, "string", _each(lambda n: n.attrs.get("id", ""))),
    "class_name": (_STR, "string", _each(lambda n: n.attrs.get("class", ""))),
    "classes": (pa.list_(_STR), "array<string>", _each(lambda n: n.attrs["class"].split() if "class" in n.attrs else [])),
    "attrs": (pa.map_(_STR, _STR), "map<string,string>", _each(lambda n: list(n.attrs.items()))),
    "text_start": (_INT, "int", _each(lambda n: n.text_start)),
    "text_len": (_INT, "int", _each(lambda n: n.text_end - n.text_start)),
    "html_start": (_INT, "int", _each(lambda n: n.html_start)),
    "html_end": (_INT, "int", _each(lambda n: n.html_end)),
    "max_child_ix_on_path": (_INT, "int", _each(lambda n: n.max_child_ix)),
    "xpath": (_STR, "string", lambda d: xpaths(d.nodes)),
    "static_visible": (_BOOL, "boolean", _each(lambda n: n.visible)),
    # counts over strict descendants, so that containment needs no self-join
    "links_within": (_INT, "int", _each(lambda n: n.links)),
    "fields_within": (_INT, "int", _each(lambda n: n.fields)),
    "aria_within": (_INT, "int", _each(lambda n: n.arias)),
    "text": (_STR, "string", lambda d: tag_text(d, TEXT_TAGS)),
}
PAGE_FIELDS: dict[str, tuple] = {
    "full_text": (_STR, "string", lambda d: d.full_text),
    "body_text": (_STR, "string", lambda d: "".join(d.visible_text)),
    "text_chunks": (pa.list_(_STR), "array<string>", lambda d: chunked(d.full_text, CHUNK)),
    "html_chunks": (pa.list_(_STR), "array<string>", lambda d: chunked(d.source, CHUNK)),
    "text_node_lengths": (pa.list_(_INT), "array<int>", lambda d: d.text_lens),
}
_BATCH_CHARS = 500_000  # output is cut into batches of about this much input text, whose nodes a worker holds at once
#: Set it for tables in files that Spark cannot split, such as a few small ones.
PARTITIONS = "spark.pagespark.kernelPartitions"


def spread(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Partitions for a Python kernel: those of the scan, or as many as the session's PARTITIONS says.

    A large scan has enough splits, and shuffling its text would cost more than the kernel.
    """
    n = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(n), *keys) if n else df


def parse_pages(
    pages: DataFrame, fields: Iterable[str] | None = None, tags: frozenset[str] | None = None
) -> DataFrame:
    """Add ``nodes`` (document order), page text columns and ``parse_error`` to each page.

    A page that cannot be parsed, or has NULL html, keeps its row with an empty ``nodes`` and
    the reason in ``parse_error``.  The source html is carried along only if asked for.
    With ``tags`` (lower case) only elements with one of them leave the kernel; their fields are
    those they have in the whole page.
    """
    wanted = {*NODE_FIELDS, *PAGE_FIELDS, "html"} if fields is None else set(fields)
    node_fields = [f for f in NODE_FIELDS if f in wanted or f == "nid"]
    page_fields = [f for f in PAGE_FIELDS if f in wanted]
    carried = [c for c in pages.columns if c != "html" or "html" in wanted]
    node_ddl = ",".join(f"{f}:{NODE_FIELDS[f][1]}" for f in node_fields)
    schema = T.StructType(
        [pages.schema[c] for c in carried]
        + [T.StructField("nodes", T.DataType.fromDDL(f"array<struct<{node_ddl}>>"))]
        + [T.StructField(f, T.DataType.fromDDL(PAGE_FIELDS[f][1])) for f in page_fields]
        + [T.StructField("parse_error", T.StringType())]
    )

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sources = batch.column(batch.schema.get_field_index("html"))
            first = 0
            while first < batch.num_rows:
                docs, chars, last = [], 0, first
                while last < batch.num_rows and chars < _BATCH_CHARS:
                    source = sources[last].as_py()
                    chars += len(source or "")
                    docs.append(_parse(source))
                    last += 1
                yield _to_batch(batch.slice(first, last - first), docs, carried, node_fields, page_fields, tags)
                first = last

    keys = [f.name for f in pages.schema if f.name != "html" and not isinstance(f.dataType, T.MapType)]
    return spread(pages, keys or ["html"]).mapInArrow(kernel, schema)


def _parse(source: str | None):
    if source is None:
        return "no html"
    try:
        return Document(source)
    except Exception as e:  # one bad page never fails the job
        return f"{type(e).__name__}: {e}"


def _to_batch(batch, docs, carried, node_fields, page_fields, tags) -> pa.RecordBatch:
    good = [d for d in docs if isinstance(d, Document)]
    offsets, total = [0], 0
    for d in docs:
        if isinstance(d, Document):
            total += len(d.nodes) if tags is None else sum(n.tag in tags for n in d.nodes)
        offsets.append(total)
    columns = []
    for f in node_fields:
        kind, _, values = NODE_FIELDS[f]
        made = [v for d in good for n, v in zip(d.nodes, values(d)) if tags is None or n.tag in tags]
        columns.append(pa.array(made, type=kind))
    structs = pa.StructArray.from_arrays(columns, fields=[pa.field(f, NODE_FIELDS[f][0]) for f in node_fields])
    arrays = [batch.column(batch.schema.get_field_index(c)) for c in carried]
    arrays.append(pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), structs))
    for f in page_fields:
        kind, _, value = PAGE_FIELDS[f]
        arrays.append(pa.array([value(d) if isinstance(d, Document) else None for d in docs], type=kind))
    arrays.append(pa.array([None if isinstance(d, Document) else d for d in docs], type=pa.string()))
    return pa.RecordBatch.from_arrays(arrays, names=[*carried, "nodes", *page_fields, "parse_error"])


# -- working with parsed pages --------------------------------------------------
_HEAVY = {"nodes", "html", "url", "parse_error", *PAGE_FIELDS}


def ensure_dom(df: DataFrame, *fields: str, tags: Iterable[str] | None = None) -> DataFrame:
    """Parse raw pages for exactly ``fields`` (of elements with one of ``tags``); pass a parsed frame through."""
    return df if "nodes" in df.columns else parse_pages(df, fields, None if tags is None else frozenset(tags))


def page_keys(dom: DataFrame) -> list[str]:
    """Columns that identify a capture: page_id, and snapshot columns where present."""
    return [c for c in dom.columns if c not in _HEAVY]


def matching(pred: Callable[[Node], Column]) -> Column:
    """The page's nodes that satisfy ``pred``, in document order."""
    return F.filter("nodes", lambda x: pred(x.getField))


def count_nodes(pred: Callable[[Node], Column]) -> Column:
    return F.size(matching(pred))


def count_css(selector: str) -> Column:
    return count_nodes(lambda n: css(selector, n))


def node_rows(
    dom: DataFrame, pred: Callable[[Node], Column], project: Callable[[Node], list[Column]], *also: str
) -> DataFrame:
    """One output row per matching node; ``project`` gets a node, page columns are in scope."""
    made = F.transform(matching(pred), lambda x: F.struct(*project(x.getField)))
    return dom.select(*page_keys(dom), *also, F.inline(made))


def ranked_rows(
    dom: DataFrame,
    rank: Callable[[Node], Column],
    keep: Callable[[Node], Column],
    project: Callable[[Column, Node], list[Column]],
) -> DataFrame:
    """One row per node that has a rank (such as its first matching selector), which is computed once."""
    ranked = F.transform(matching(keep), lambda x: F.struct(rank(x.getField).alias("ix"), x.alias("node")))
    hits = F.filter(ranked, lambda h: h["ix"].isNotNull())
    made = F.transform(hits, lambda h: F.struct(*project(h["ix"], h["node"].getField)))
    return dom.select(*page_keys(dom), F.inline(made))


# what an element's text is cut from
TEXT_FIELDS = ("text_start", "text_len", "text_chunks")


def _cut(chunks: str, start: Column, size: Column) -> Column:
    """Characters of a page from the pieces they lie in: the cost is that of the cut, wherever it stands."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((start + size) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(chunks, first + 1, last - first + 1), ""), start % CHUNK + 1, size)


def text_of(n: Node) -> Column:
    """A node's whole textContent, cut from the page's text (TEXT_FIELDS)."""
    return _cut("text_chunks", n("text_start"), n("text_len"))


def html_of(n: Node) -> Column:
    """A node's inner html as it stands in the source (html_start, html_end, html_chunks)."""
    return _cut("html_chunks", n("html_start"), n("html_end") - n("html_start"))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(JS_SPACE))


def shown_text(n: Node, limit: int | None = None) -> Column:
    """A node's trimmed text, whole unless a number of characters is given."""
    text = trim(text_of(n))
    return text if limit is None else F.substring(text, 1, limit)


def attr(n: Node, name: str) -> Column:
    return F.try_element_at(n("attrs"), F.lit(name))


def is_expandable(n: Node) -> Column:
    """The element says it expands, or holds one that does."""
    return css("[aria-expanded],.collapsible,.expandable", n) | (n("aria_within") > 0)


# -- operators on flat node rows --------------------------------------------------
def dom_nodes(pages: DataFrame, fields: Iterable[str] | None = None) -> DataFrame:
    """One row per element.  ``a`` contains ``b`` iff a.nid < b.nid <= a.end_nid on the same page."""
    wanted = None if fields is None else [f for f in fields if f in NODE_FIELDS]
    dom = pages if "nodes" in pages.columns else parse_pages(pages, wanted or list(NODE_FIELDS))
    return dom.select(*page_keys(dom), F.inline("nodes"))


def page_text(pages: DataFrame) -> DataFrame:
    dom = ensure_dom(pages, *PAGE_FIELDS)
    return dom.select(*page_keys(dom), *PAGE_FIELDS, "parse_error")


def in_snapshot(n: Node, depth: int | None, children: int | None) -> Column:
    """The node is in the body, at most ``depth`` below it, and under the first ``children`` of every ancestor."""
    inside = n("body_depth").isNotNull()
    if depth is not None:
        inside &= F.coalesce(n("body_depth") <= depth, F.lit(False))
    return inside if children is None else inside & (n("max_child_ix_on_path") < children)


def dom_snapshot(
    pages: DataFrame, depth: int | None = None, children: int | None = None, text_limit: int | None = None
) -> DataFrame:
    """Body subtree with each element's text, whole unless a depth, a number of children or characters is given."""
    dom = ensure_dom(pages, *NODE_FIELDS, "text_chunks")
    fields = [f for f in NODE_FIELDS if f != "text"]

    def project(n: Node) -> list[Column]:
        return [*[n(f).alias(f) for f in fields], shown_text(n, text_limit).alias("text"), is_expandable(n).alias("is_expandable")]

    return node_rows(dom, lambda n: in_snapshot(n, depth, children), project)


def with_xpath(pages: DataFrame) -> DataFrame:
    """(page_id, nid, tag, xpath); the path comes from the kernel, which has the ancestors in hand."""
    return dom_nodes(pages, ["tag", "xpath"])


def with_positions(elements: DataFrame, layout: DataFrame) -> DataFrame:
    """Add each element's measured box, and ``has_box``: it takes up room."""
    keys = [c for c in layout.columns if c in elements.columns]
    boxed = F.coalesce((F.col("width") > 0) & (F.col("height") > 0), F.lit(False))
    return elements.join(layout, keys, "left").withColumn("has_box", boxed)


def with_visibility(nodes: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """``visible``: what the markup says, narrowed by measured boxes when a layout is given."""
    if layout is None:
        return nodes.withColumn("visible", F.col("static_visible"))
    return with_positions(nodes, layout).withColumn("visible", F.col("static_visible") & F.col("has_box")).drop("has_box")


def with_expandable(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("is_expandable", is_expandable(F.col))


def select_css(nodes: DataFrame, selector: str) -> DataFrame:
    return nodes.filter(css(selector))


def select_first_match(nodes: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """Each node once, under the first selector it matches; report order is (sel_ix, nid)."""
    hit = nodes.withColumn("sel_ix", first_match(selectors)).filter(F.col("sel_ix").isNotNull())
    return hit.withColumn("selector", selector_name(selectors, F.col("sel_ix")))


def select_all_matches(nodes: DataFrame, selectors: Sequence[str]) -> DataFrame:
    """A node once per selector it matches."""
    hit = nodes.withColumn("sel_ix", F.explode(all_matches(selectors)))
    return hit.withColumn("selector", selector_name(selectors, F.col("sel_ix")))


def element_signature(nodes: DataFrame) -> DataFrame:
    def part(label: str, name: str) -> Column:
        return F.concat(F.lit(label), F.nullif(F.col(name), F.lit("")))

    joined = F.concat_ws("|", part("id:", "id"), part("tag:", "tag"), part("class:", "class_name"))
    return nodes.withColumn("signature", F.coalesce(F.nullif(joined, F.lit("")), F.lit("unknown")))
