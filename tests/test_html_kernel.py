"""Tree rules of the HTML kernel, on hand-written pages."""

import random
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import types as T

from pagespark.operators import dom as D
from pagespark.operators.html_kernel import Document, chunked, xpaths


def tree(source):
    """Nested (tag, [children]) without html and head."""
    doc = Document(source)
    made = {n.nid: (n.tag, []) for n in doc.nodes}
    for n in doc.nodes[1:]:
        made[n.parent.nid][1].append(made[n.nid])
    body = next(n for n in doc.nodes if n.body_depth == 0)
    return made[body.nid][1]


def text(doc, n):
    return doc.full_text[n.text_start : n.text_end]


def by_tag(doc, tag):
    return [n for n in doc.nodes if n.tag == tag]


def test_list_items_close_each_other_but_not_across_lists():
    assert tree("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [
        ("ul", [("li", []), ("li", [("ul", [("li", [])])]), ("li", [])])
    ]


def test_paragraph_closed_by_block_and_by_parent_end():
    assert tree("<p>a<div>b</div>c") == [("p", []), ("div", [])]
    assert tree("<div><p>a<b>x</div><p>c") == [("div", [("p", [("b", [])])]), ("p", [])]


def test_table_without_tbody():
    assert tree("<table><tr><td>1<td>2<tr><th>3</table>") == [
        ("table", [("tr", [("td", []), ("td", [])]), ("tr", [("th", [])])])
    ]


def test_definition_list_and_options():
    assert tree("<dl><dt>a<dd>b<dt>c</dl>") == [("dl", [("dt", []), ("dd", []), ("dt", [])])]
    assert tree("<select><option>a<option>b<optgroup><option>c</select>") == [
        ("select", [("option", []), ("option", []), ("optgroup", [("option", [])])])
    ]


def test_attributes():
    doc = Document("""<DIV ID=q Class='a  b' ID=z data-x="1>2" hidden title=a&amp;b don't>x</DIV>""")
    (n,) = by_tag(doc, "div")
    assert n.attrs == {"id": "q", "class": "a  b", "data-x": "1>2", "hidden": "", "title": "a&b", "don't": ""}
    assert not n.visible


def test_raw_text_comments_and_entities():
    doc = Document('<title>a &lt;b></title><script>"</p><i>"</script><!-- <b> --><p>&copy; x<!-- y -->z &amp; <3')
    assert [n.tag for n in doc.nodes] == ["html", "head", "title", "script", "body", "p"]
    assert text(doc, by_tag(doc, "title")[0]) == "a <b>"
    assert text(doc, by_tag(doc, "script")[0]) == '"</p><i>"'
    assert text(doc, by_tag(doc, "p")[0]) == "© xz & <3"
    assert doc.text_lens == [3, 6]


@pytest.mark.parametrize("source", ["", "  \n ", "plain", "<!doctype html>", "<div", '<a href="x', "</p></b>", "<"])
def test_odd_pages_still_have_a_skeleton(source):
    doc = Document(source)
    assert [n.tag for n in doc.nodes[:3]] == ["html", "head", "body"]


def test_skeleton_tags_are_merged_not_repeated():
    doc = Document('<html lang="en"><head></head><body class="x"><p>a</body></html><p>b<body id="y">')
    assert [n.tag for n in doc.nodes] == ["html", "head", "body", "p", "p"]
    assert doc.nodes[0].attrs == {"lang": "en"}
    assert doc.nodes[2].attrs == {"class": "x", "id": "y"}


def test_inner_html_offsets():
    source = "<html><body>\n<div>a<br>b</div> <p>c</body></html>"
    doc = Document(source)
    inner = {n.tag: source[n.html_start : n.html_end] for n in doc.nodes}
    assert inner["div"] == "a<br>b"
    assert inner["p"] == "c</body></html>" or inner["p"] == "c"
    assert inner["body"] == "\n<div>a<br>b</div> <p>c"


def test_visibility():
    doc = Document(
        "<style>a</style><body><div style='color:red; DISPLAY : none'><i>x</i></div><u hidden></u>"
        "<input type=Hidden><input><noscript><b></b></noscript><s style='visibility:hidden'></s><em>y</em>"
    )
    shown = [n.tag for n in doc.nodes if n.visible]
    assert shown == ["html", "body", "input", "em"]
    assert doc.visible_text == ["y"]


def test_descendant_counts_exclude_the_element_itself():
    doc = Document("<nav><a href=1></a><a href=2><a href=3></a></a></nav><form><input><select></select></form><div aria-expanded=x></div>")
    assert by_tag(doc, "nav")[0].links == 3
    assert [n.links for n in by_tag(doc, "a")] == [0, 1, 0]
    assert by_tag(doc, "form")[0].fields == 2
    assert by_tag(doc, "div")[0].arias == 0 and doc.nodes[0].arias == 1


def test_xpath():
    doc = Document('<body><div><p>a<p>b</div><div id="k"><p><i></i><i></i>')
    assert xpaths(doc.nodes)[2:] == [
        "BODY", "BODY/DIV[1]", "BODY/DIV[1]/P[1]", "BODY/DIV[1]/P[2]", 'id("k")', 'id("k")/P[1]',
        'id("k")/P[1]/I[1]', 'id("k")/P[1]/I[2]',
    ]


def test_pieces_are_the_whole_text():
    for text in ("", "a", "ab" * 700, "é" * 1024, "😀x" * 1500):
        pieces = chunked(text, 1024)
        assert "".join(pieces) == text and all(len(p) == 1024 for p in pieces[:-1])


def test_deep_pages_keep_every_element():
    doc = Document("<div>" * 5000)
    assert len(doc.nodes) == 5003
    assert max(n.depth for n in doc.nodes) == 5001


def test_hostile_nesting_takes_linear_time():
    for hostile in ("<div>", "<p><button>" + "<span>" * 9, "</b>", "<b></i>", "<li><span>", "<ul><li>"):
        Document(hostile * 60_000)


def test_intervals_on_random_tag_soup():
    rng = random.Random(7)
    tags = ["div", "p", "li", "ul", "td", "tr", "table", "a", "b", "br", "script", "h1", "option", "select", "body", "head"]
    for _ in range(300):
        parts = []
        for _ in range(rng.randrange(40)):
            t = rng.choice(tags)
            parts.append(rng.choice([f"<{t}>", f"</{t}>", f"<{t} id={rng.randrange(9)}>", "x", " ", "&amp;", "<!--c-->"]))
        source = "".join(parts)
        doc = Document(source)
        for n in doc.nodes:
            assert n.nid <= n.end < len(doc.nodes)
            assert 0 <= n.text_start <= n.text_end <= len(doc.full_text)
            assert 0 <= n.html_start <= n.html_end <= len(source)
            inside = doc.nodes[n.nid + 1 : n.end + 1]
            assert n.links == sum(m.tag == "a" for m in inside)
            if n.parent is not None:
                assert n.parent.nid < n.nid and n.end <= n.parent.end
                assert n.depth == n.parent.depth + 1
        assert doc.nodes[0].text_end == len(doc.full_text)


class _Pages:
    """What ``parse_pages`` asks of a frame; gives its kernel instead of running it."""

    schema = T.StructType().add("page_id", "long").add("html", "string")
    columns = ["page_id", "html"]
    sparkSession = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default))

    def mapInArrow(self, kernel, schema):
        return kernel


def test_a_worker_holds_the_nodes_of_a_few_pages_at_once(spark):
    html = ["<p>" + "word " * 2000] * 200
    batch = pa.RecordBatch.from_pydict({"page_id": list(range(200)), "html": html})
    got = list(D.parse_pages(_Pages(), ["tag"])(iter([batch])))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(200))
    assert max(b.num_rows for b in got) * len(html[0]) < 600_000
